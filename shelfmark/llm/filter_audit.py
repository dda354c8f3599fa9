"""What a sequence of filters removes, for every order of the filters.

Each document's failures are five bits, found in one scan; documents are counted per part and
combination of failures, which is a 2x2x2x2x2 tensor a part, and once more for good and for
toxic documents.  A step of an order needs, along each filter's axis, its passes, its failures or
all: `contract` gives the three choices as vectors and contracts all steps of all orders by one
einsum per measure.  Only 32 cells a part leave the first aggregation, however many documents.

Filters: A too few words, B too few distinct words, C too many capitals, D a forbidden
character, E the text of a smaller doc_id.  Words are runs without blanks or 0x09 to 0x0D.

Null texts are empty texts, and null parts the part ''.  A row with a null doc_id is a document
that repeats none and that none repeats.  Rows that share an id are documents of their own, and
of equal texts those with the smallest id all stay.  A document is good (toxic) if a label of its
id says so.  Of `docs` only doc_id, text and source are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.frames import grouped, whole_groups
from shelfmark.llm.text_runs import runs

FILTERS = "ABCDE"
MEASURES = ("documents", "good", "toxic")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_FORBIDDEN = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INNER = bytes(range(0x80, 0xC0))  # bytes that start no code point
# Bytes of one text cut into words at once.
_PIECE = 1 << 20
# Parts contracted at once.
_PARTS = 64


def _word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words)."""
    if len(text) <= _PIECE:
        words = text.split()
        return len(words), len(set(words))
    total, distinct, at = 0, set(), 0
    while at < len(text):
        gap = _BLANK.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        words = text[at:end].split()
        total += len(words)
        distinct.update(words)
        at = end
    return total, len(distinct)


def failures(text: bytes, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> int:
    """A is bit 0, B bit 1, C bit 2, D bit 3."""
    words, distinct = _word_counts(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (words < least_words)
        | (100 * distinct < distinct_percent * words) << 1
        | (100 * capitals > capital_percent * len(text.translate(None, _INNER))) << 2
        | (_FORBIDDEN.search(text) is not None) << 3
    )


def _marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in runs(batches):
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array([failures(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
            names=["doc_id", "part", "failed", "digest"],
        )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (five bits), documents, good, toxic: at most 32 rows a part."""
    marked = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(
        _marker, "doc_id bigint, part string, failed int, digest binary"
    )
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = marked.groupBy("doc_id", "part", "failed", "digest").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    no = F.lit(False)
    # Copies are summed up before they meet, and with them those of the smallest id.
    alike = rows.groupBy("digest", "part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.col("n")))).alias("first"),
    )
    # One id may stand in rows of several parts: of one part's rows `first` is one id, counted whole.
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    stay = F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0) + F.col("unnamed")
    parted = alike.withColumn("stay", stay).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct("failed", F.col("stay").alias("n")), F.struct((F.col("failed") + (1 << FILTERS.index("E"))).alias("failed"), (F.col("n") - F.col("stay")).alias("n")))).alias("c"),
    )
    count = lambda c: F.sum(F.when(c, F.col("c.n")).otherwise(0))
    return parted.groupBy("part", F.col("c.failed").alias("failed")).agg(
        F.sum("c.n").alias("documents"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic")
    )


PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def chosen(n: int, orders: Sequence[Sequence[int]]) -> dict[str, np.ndarray]:
    """Per outcome, (orders * steps, n axes, 2): what each step takes along each axis."""
    found = {"kept": [], "removed": [], "failing": [], "unique_fails": []}
    for order in orders:
        for step, own in enumerate(order):
            passed = set(order[:step])
            earlier = [PASS if k in passed else ALL for k in range(n)]
            found["kept"].append([PASS if k == own else v for k, v in enumerate(earlier)])
            found["removed"].append([FAIL if k == own else v for k, v in enumerate(earlier)])
            found["failing"].append([FAIL if k == own else ALL for k in range(n)])
            found["unique_fails"].append([FAIL if k == own else PASS for k in range(n)])
    return {k: np.array(v, np.int64) for k, v in found.items()}


def contract(tensors: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """(parts, 2, ..., 2) by (steps, axes, 2) to (parts, steps)."""
    n = tensors.ndim - 1
    given = [tensors, [0, *range(2, n + 2)]]
    for axis in range(n):
        given += [choice[:, axis], [1, axis + 2]]
    return np.einsum(*given, [0, 1], optimize=True)


def steps(tensors: dict[str, np.ndarray], orders: Sequence[Sequence[int]]) -> dict[str, np.ndarray]:
    """Per column, (parts, orders * steps)."""
    n = tensors["documents"].ndim - 1
    choice = chosen(n, orders)
    out = {k: contract(tensors["documents"], choice[k]) for k in ("kept", "removed", "unique_fails")}
    out["redundant"] = contract(tensors["documents"], choice["failing"]) - out["removed"]
    out["good_lost"] = contract(tensors["good"], choice["removed"])
    out["toxic_lost"] = contract(tensors["toxic"], choice["removed"])
    own = np.array([k for order in orders for k in order])
    by_filter = np.stack([out["removed"][:, own == k].sum(axis=1) for k in range(n)], axis=1)
    out["shapley"] = by_filter[:, own]
    return out


def _auditor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    orders = list(permutations(range(len(FILTERS))))
    names = np.array(["".join(FILTERS[k] for k in order) for order in orders], object)
    per_order = len(FILTERS)
    for frame, new in whole_groups(batches, ["part"]):
        number = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(frame))))
        parts, failed = frame["part"].to_numpy()[new], frame["failed"].to_numpy()
        for first in range(0, len(parts), _PARTS):
            here = (number >= first) & (number < first + _PARTS)
            n = min(_PARTS, len(parts) - first)
            tensors = {}
            for measure in MEASURES:
                flat = np.zeros((n, 1 << per_order), np.int64)
                np.add.at(flat, (number[here] - first, failed[here]), frame[measure].to_numpy(np.int64)[here])
                # Bit 0 varies fastest, so the last axis is filter A.
                tensors[measure] = flat.reshape(n, *[2] * per_order).transpose(0, *range(per_order, 0, -1))
            columns = {k: v.ravel() for k, v in steps(tensors, orders).items()}
            each = len(orders) * per_order
            yield pd.DataFrame({
                "part": np.repeat(parts[first : first + n], each),
                "filter_order": np.tile(np.repeat(names, per_order), n),
                "step": np.tile(np.arange(1, per_order + 1, dtype=np.int32), n * len(orders)),
                **columns,
            })[RESULT]


RESULT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with what the step does there."""
    schema = ", ".join(f"{c} {'string' if c in RESULT[:2] else 'int' if c == 'step' else 'bigint'}" for c in RESULT)
    return grouped(cells(docs, labels), ["part"], ["failed"]).mapInPandas(_auditor, schema)
