"""Hierarchical packing of documents into sequences of several lengths.

A document's ids, closed by `end_id`, fill windows of the longest tier; what remains goes
to the shortest tier that holds it.  Tiers are packed from the longest down: a remainder
opens a sequence of its tier and the gap is filled from shorter tiers, whole remainders
first, else a cut of one.  Each run of texts is packed by itself, and what is left of it at
the end is cut at powers of two, so no sequence is padded.  Sequences of a tier form step
groups of equal tokens.  No shuffle: a task packs the rows it reads, some megabytes at a time.

Null texts are empty: the end id alone.  Repeated rows and null ids are packed as they are.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from shelfmark.llm.tokens import encoder
from shelfmark.llm.workers import tidy

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_length int, step_id bigint"
)


def plan(lengths: Sequence[int], longest: int = 1024, shortest: int = 64) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """((document, start, length, sequence, offset)..., length of each sequence)."""
    tiers = [shortest]
    while tiers[-1] < longest:
        tiers.append(tiers[-1] * 2)
    waiting: dict[int, deque] = {t: deque() for t in tiers}
    pieces, sequences = [], []

    def route(doc: int, start: int, length: int) -> None:
        waiting[next(t for t in tiers if t >= length)].append((doc, start, length))

    for doc, n in enumerate(lengths):
        whole = n - n % longest
        for start in range(0, whole, longest):
            pieces.append((doc, start, longest, len(sequences), 0))
            sequences.append(longest)
        if n > whole:
            route(doc, whole, n - whole)
    for tier in reversed(tiers):
        while waiting[tier]:
            held, at = [waiting[tier].popleft()], 0
            at = held[0][2]
            while at < tier:
                gap = tier - at
                fits = next((t for t in reversed(tiers) if t <= gap and waiting[t]), None)
                if fits:
                    piece = waiting[fits].popleft()
                else:
                    source = next((t for t in tiers if t <= tier and waiting[t]), None)
                    if source is None:
                        break
                    doc, start, length = waiting[source].popleft()
                    piece = (doc, start, min(gap, length))
                    if length > gap:
                        route(doc, start + gap, length - gap)
                held.append(piece)
                at += piece[2]
            _close(held, at, tier, pieces, sequences)
    return pieces, sequences


def _close(held, total: int, tier: int, pieces: list, sequences: list) -> None:
    """Adds the sequence, or several with powers of two as lengths where it isn't full."""
    sizes = [tier] if total == tier else [1 << k for k in reversed(range(total.bit_length())) if total >> k & 1]
    held = deque(held)
    for size in sizes:
        at = 0
        while at < size:
            doc, start, length = held.popleft()
            used = min(length, size - at)
            pieces.append((doc, start, used, len(sequences), at))
            if used < length:
                held.appendleft((doc, start + used, length - used))
            at += used
        sequences.append(size)


def _packer(name: str, end_id: int, longest: int, shortest: int, step_tokens: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        code = encoder(name, True)
        base, made = TaskContext.get().partitionId() << 32, 0
        seen: dict[int, int] = {}
        for frame in batches:
            keys = frame["doc_id"].astype("Int64")
            for begin, stop, ids, each in code.batches(frame["text"].tolist()):
                ids = np.insert(ids, np.cumsum(each), end_id).astype("<u4")
                each = each + 1
                firsts = np.cumsum(each) - each
                pieces, sequences = plan(each.tolist(), longest, shortest)
                steps = []
                for size in sequences:
                    nth = seen.get(size, 0)
                    seen[size] = nth + 1
                    # Tier and place among its groups, in one number.
                    steps.append(base | size << 20 | nth // max(1, step_tokens // size))
                p = np.array(pieces, np.int64)
                p = p[np.lexsort((p[:, 1], p[:, 0]))]
                begins = firsts[p[:, 0]] + p[:, 1]
                yield pd.DataFrame({
                    "doc_id": keys.iloc[begin:stop].take(p[:, 0]).array, "start": p[:, 1], "length": p[:, 2],
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, begins + p[:, 2], strict=True)],
                    "doc_tokens": each[p[:, 0]], "sequence_id": base + made + p[:, 3], "offset": p[:, 4],
                    "sequence_length": np.array(sequences, np.int32)[p[:, 3]], "step_id": np.array(steps, np.int64)[p[:, 3]],
                })
                made += len(sequences)

    return pack


def pack(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, longest: int = 1024, shortest: int = 64,
    step_tokens: int = 1 << 15,
) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence.

    `longest` and `shortest` are powers of two; `step_id` groups a task's sequences of one
    length, `step_tokens` tokens to a group.
    """
    if longest & (longest - 1) or shortest & (shortest - 1) or not 0 < shortest <= longest:
        raise ValueError("tiers are powers of two")
    return docs.select("doc_id", "text").mapInPandas(tidy(_packer(tokenizer, end_id, longest, shortest, step_tokens)), SCHEMA)
