"""Fill-in-middle transformation of whole texts, cut between units.

A unit is a run of white space with the word after it, or white space that ends the text.  Texts
lie in words of eight UTF-8 bytes, padded with blanks, so that arithmetic on a 64-bit word marks
the bytes that end a unit (`unit_ends`), counts of marks per word, summed up, tell by search which
word holds the k-th end, and clearing marks from below finds it there (`ends_of`).  Code points are
counted by the same words.  All texts of a run are marked at once; no text is decoded.

A document's sha-256 of "seed:doc_id" gives the two cuts, whether it is transformed at all, and
the form.  Outputs are told back into texts by `restore`, with column expressions.

Null texts are empty and plain, as are texts that hold one of the markers.  A null id is hashed
as no digits.  Repeated rows give equal rows.  Of `docs` only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.text_runs import runs

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_EACH = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_ONE = np.uint64(1)


def _blank(x: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is 0x20 or 0x09 to 0x0D; no sum leaves its byte."""
    low = x & _LOW
    at_least = lambda k: low + _EACH * np.uint64(0x80 - k)
    controls = at_least(0x09) & ~at_least(0x0E) & ~x
    other = x ^ (_EACH * np.uint64(0x20))
    space = ~(((other & _LOW) + _LOW) | other)
    return (controls | space) & _HIGH


class Words:
    """Texts as 64-bit words: `first` word of each text, `n` units of each."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        # One blank at least follows each text.
        self.first = np.concatenate(([0], np.cumsum(self.lengths // 8 + 1)))
        room = bytearray(b" ") * int(self.first[-1] * 8)
        for text, at in zip(texts, (self.first * 8).tolist(), strict=False):
            room[at : at + len(text)] = text
        self.words = np.frombuffer(room, "<u8")
        self.marks = self._unit_ends()
        self.upto = np.concatenate(([0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)))
        self.n = np.diff(self.upto[self.first])
        # Bytes 10xxxxxx start no code point.
        self.inner = self.words & ~(self.words << _ONE) & _HIGH
        self.inner_upto = np.concatenate(([0], np.cumsum(np.bitwise_count(self.inner), dtype=np.int64)))

    def _unit_ends(self) -> np.ndarray:
        """The high bit of each byte that ends a unit: a word's last one, or the text's."""
        blank = _blank(self.words)
        after = blank >> np.uint64(8)
        after[:-1] |= blank[1:] << np.uint64(56)
        marks = ~blank & after & _HIGH
        some = np.flatnonzero(self.lengths)
        last = self.lengths[some] - 1
        at, bit = self.first[some] + last // 8, np.uint64(0x80) << (last % 8 * 8).astype(np.uint64)
        marks[at] |= blank[at] & bit
        return marks

    def ends_of(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th unit of each text; 0 for k = 0."""
        start = self.first[:-1]
        target = self.upto[start] + k
        # The first word by whose end so many units have ended.
        word = np.maximum(np.searchsorted(self.upto, target, "left") - 1, 0)
        left = target - self.upto[word]
        x = self.marks[word].copy()
        for passed in range(1, 8):
            more = left > passed
            x[more] &= x[more] - _ONE
        byte = np.bitwise_count((x & (~x + _ONE)) - _ONE).astype(np.int64) >> 3
        return np.where(k > 0, (word - start) * 8 + byte + 1, 0)

    def chars_before(self, end: np.ndarray) -> np.ndarray:
        """Code points of each text before byte `end`."""
        start = self.first[:-1]
        word = start + end // 8
        below = (_ONE << (end % 8 * 8).astype(np.uint64)) - _ONE
        inner = self.inner_upto[word] - self.inner_upto[start] + np.bitwise_count(self.inner[word] & below)
        return end - inner


def _draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four 32-bit numbers to each id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _strings(values: list[bytes]) -> pa.Array:
    held = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(held), held.buffers()[1], held.buffers()[2])


def _transformed(ids: list[int | None], texts: list[bytes], seed: int, percent: int, spm_percent: int) -> pa.RecordBatch:
    draws = _draws(ids, seed)
    words = Words(texts)
    cuts = np.sort(draws[:, :2] % (words.n + 1)[:, None], axis=1)
    ends = [words.ends_of(cuts[:, k]) for k in (0, 1)]
    chars = [words.chars_before(e) for e in ends]
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = markers
    plain = [not t or drawn >= percent or any(x in t for x in markers) for t, drawn in zip(texts, (draws[:, 2] % 100).tolist(), strict=True)]
    forms, outputs = [], []
    for t, leave, spm, a, b in zip(texts, plain, (draws[:, 3] % 100 < spm_percent).tolist(), ends[0].tolist(), ends[1].tolist(), strict=True):
        if leave:
            forms.append("plain")
            outputs.append(t)
        elif spm:
            forms.append("spm")
            outputs.append(b"".join((s, t[b:], p, t[:a], m, t[a:b])))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, t[:a], s, t[b:], m, t[a:b])))
    none = np.array(plain, bool)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array(words.n, pa.int64()), pa.array(forms, pa.string()),
            pa.array(chars[0], pa.int64(), mask=none), pa.array(chars[1] - chars[0], pa.int64(), mask=none), _strings(outputs),
        ],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n units, form, code points of prefix and middle, and the output of every row of `docs`.

    Of the texts `percent` of 100 are transformed, of these `spm_percent` with the suffix first.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in runs(batches):
            yield _transformed(part.column(0).to_pylist(), texts, seed, percent, spm_percent)

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)


def restore(transformed: DataFrame) -> DataFrame:
    """Adds `restored`, the text before, from `output` and `form` alone.

    A transformed text held no marker and none arises where its parts meet one, so markers
    split an output into exactly its three parts.
    """
    parts = F.split("output", "<[PSM]>", -1)
    prefix = F.when(F.col("form") == "psm", parts[1]).otherwise(parts[2])
    suffix = F.when(F.col("form") == "psm", parts[2]).otherwise(parts[1])
    return transformed.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat(prefix, parts[3], suffix)))


def digests(docs: DataFrame) -> DataFrame:
    """The transformation's outcome with digests in place of the texts."""
    return restore(transform(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
