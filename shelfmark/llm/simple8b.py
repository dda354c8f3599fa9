"""Token-id files coded by Simple-8b: a varying number of ids to a 64-bit word.

A word's top four bits select how many ids of which width its other sixty bits hold.
Selector 15 is an escape: the next word is one value as it stands.  A file set is a folder
of Parquet files in ascending order of documents, written by Spark's committer, so it needs
no shared disk but the folder's own and a lost executor leaves no half file.  A row is a
block: its documents and their lengths, its words, and `offsets`, the first id of every
`STRIDE`-th word (-1 where that is an escaped value), from which words decode independently;
decoding is vectorised.

Null texts are empty ones and have the end id alone.  Null document ids come first.
Repeated ids keep an order by text.  An empty table writes an empty set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.tokens import encoder
from shelfmark.llm.workers import tidy
from shelfmark.session import scratch_dir

# Fixed values of the code: ids to a word and bits of each, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
ESCAPE = 15
STRIDE = 128
# Ids to a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 17
BLOCK_SCHEMA = "file int, block int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, offsets array<bigint>, words binary"


def _runs(good: np.ndarray, count: int) -> np.ndarray:
    """Where `count` in a row hold, by doubling; shorter by what no longer fits."""
    size = 1
    while size * 2 <= count:
        good = good[:-size] & good[size:]
        size *= 2
    rest = count - size
    return good[:-rest] & good[rest:] if rest else good


_BITS = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    if not len(values) or values.max() < len(_BITS):
        return _BITS[values.astype(np.int64)]
    return np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), values, side="right").astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first value's number of each) of unsigned 64-bit values.

    At each place the selector that holds most is taken; the last word may hold fewer.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    bits = _bits(values)
    best = np.full(n, ESCAPE, np.uint8)
    for selector in reversed(range(len(COUNTS))):
        count, width = COUNTS[selector], WIDTHS[selector]
        # Runs of ones, and of zeros, need no bits.
        good = bits <= width if width else values == 1 - selector
        if n >= count:
            np.copyto(best[: n - count + 1], np.uint8(selector), where=_runs(good, count))
        if width:  # the end of the values may be shorter than the selector's count
            tail = good[max(0, n - count + 1) :][::-1]
            held = len(tail) if tail.all() else int(np.argmin(tail))
            if held:
                best[n - held :] = selector
    step = np.array([*COUNTS, 1], np.uint8)[best].tobytes()
    taken, at = [], 0
    while at < n:
        taken.append(at)
        at += step[at]
    at = np.array(taken, np.int64)
    selectors = best[at].astype(np.int64)
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((values, np.zeros(max(COUNTS), np.uint64)))
    for selector, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.flatnonzero(selectors == selector)
        if width and len(own):
            packed, begins = words[own], at[own]
            for k in range(count):
                packed |= padded[begins + k] << np.uint64(k * width)
            words[own] = packed
    escaped = np.flatnonzero(selectors == ESCAPE)
    if not len(escaped):
        return words, at
    return np.insert(words, escaped + 1, values[at[escaped]]), np.insert(at, escaped + 1, -1)


def decode(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n values, and the first value's number of each word (-1 for raw words)."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    # A word after an escape is raw; of escapes in a row every other one is.
    escapes = np.flatnonzero(selectors == ESCAPE)
    raw = np.zeros(len(words) + 1, bool)
    for k in escapes.tolist():
        if not raw[k]:
            raw[k + 1] = True
    raw = raw[:-1]
    counts = np.where(raw, 0, np.array([*COUNTS, 1])[selectors])
    begins = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) or 1, np.uint64)
    for selector, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.flatnonzero((selectors == selector) & ~raw)
        if not len(own):
            continue
        if width:
            bits = words[own, None] >> (np.arange(count) * width).astype(np.uint64) & np.uint64((1 << width) - 1)
        else:
            bits = np.full((len(own), count), 1 - selector, np.uint64)
        out[begins[own, None] + np.arange(count)] = bits
    held = np.flatnonzero((selectors == ESCAPE) & ~raw)
    out[begins[held]] = words[held + 1]
    return out[:n], np.where(raw, -1, begins)


def _block(file: int, number: int, docs: list, lengths: list, ids: np.ndarray) -> dict:
    words, begins = encode(ids)
    marks = begins[::STRIDE]
    return {
        "file": file, "block": number, "doc_ids": docs, "lengths": [int(x) for x in lengths], "n_ids": len(ids),
        "offsets": marks.tolist(), "words": words.astype("<u8").tobytes(),
    }


def _writer(name: str, end_id: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        code, file, number = encoder(name, False), TaskContext.get().partitionId(), 0
        docs, lengths, held, size = [], [], [], 0
        for frame in batches:
            keys = [None if pd.isna(k) else int(k) for k in frame["doc_id"].tolist()]
            for begin, stop, ids, each in code.batches(frame["text"].tolist()):
                ends = np.cumsum(each)
                ids, done, blocks = np.insert(ids, ends, end_id), 0, []
                for k, n in zip(range(begin, stop), each + 1, strict=True):
                    docs.append(keys[k])
                    lengths.append(n)
                    held.append(ids[done : done + n])
                    done, size = done + n, size + n
                    if size >= BLOCK_IDS:
                        blocks.append(_block(file, number, docs, lengths, np.concatenate(held)))
                        docs, lengths, held, size, number = [], [], [], 0, number + 1
                if blocks:
                    yield pd.DataFrame(blocks)
        if docs:
            yield pd.DataFrame([_block(file, number, docs, lengths, np.concatenate(held))])

    return write


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    """Writes the ids of every whole text, `end_id` after each, in ascending doc_id order."""
    ordered = (
        docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    ordered.mapInPandas(tidy(_writer(tokenizer, end_id)), BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for row in frame.itertuples():
            ids, _ = decode(np.frombuffer(row.words, "<u8"), row.n_ids)
            ends = np.cumsum(row.lengths)
            begins = ends - row.lengths
            data = ids.astype("<u4")
            yield pd.DataFrame({
                "doc_id": pd.array(row.doc_ids, "Int64"), "start": begins + row.before, "n_tokens": np.asarray(row.lengths, np.int64),
                "ids_crc32": [zlib.crc32(data[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)],
                "file": row.file, "block": row.block,
            })


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files under `path`.

    Starts come from the blocks' own counts: a sum over files, then over a file's blocks.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # A row for each file and block, never the ids.
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("_ids"))
    files = files.select("file", (F.sum("_ids").over(Window.orderBy("file")) - F.col("_ids")).alias("_file_before"))
    inner = Window.partitionBy("file").orderBy("block")
    starts = blocks.select("file", "block", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("_block_before"))
    starts = starts.join(files, "file").select("file", "block", (F.col("_file_before") + F.col("_block_before")).alias("before"))
    return blocks.join(starts, ["file", "block"]).mapInPandas(
        tidy(_reader), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file int, block int"
    )


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    path = scratch_dir(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer, end_id)
    return read_digests(docs.sparkSession, path)
