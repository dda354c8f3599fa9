"""Near duplicates by SimHash, found by the generalised pigeonhole principle.

A fingerprint is the bitwise majority of the hashes of a text's 4-word shingles.  Two that differ
in at most `distance` bits are linked.  Bits that are set together are grouped into partitions, so
that the other partitions tell texts apart; partition i gets a threshold T_i >= -1, and as long as
the T_i + 1 sum to distance + 1, two linked fingerprints differ in at most T_i bits of some
partition i.  The number of partitions and their unequal thresholds come from dynamic programming
on what each would cost: rows probed and candidates met, estimated from counts over all fingerprints.
A partition with threshold -1 isn't probed.

Each fingerprint stands under its own bits of a partition and probes those up to T_i flips away,
of which one side of each pair is enough.  All that meet are verified by their whole bits.  Equal
fingerprints are one from the start.  Links are never written as pairs: a task gives for each
fingerprint the smallest one it hangs together with there, and components follow by rounds of
joins.  Places where many meet are dealt over tasks by pairs of blocks, whole.

Null and empty texts have fingerprint 0 and are linked like others.  Rows are documents: a row
with a null id links but never names a component, rows that share an id each count with their own
text.  A component without any id is null.  Of `docs` only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.frames import connected, whole_groups
from shelfmark.llm.text_runs import runs
from shelfmark.session import cut

SHINGLE = 4
BITS = 64
SEED = 42
# What a probe and a comparison cost, in microseconds: only their ratio counts.
ROW_COST, PAIR_COST = 2.0, 0.004
PARTITIONS = (2, 3, 4, 5)
# Rows that meet at one place before it is dealt by blocks.
BLOCK = 256
# Links held before they are reduced to what hangs together.
_LINKS = 1 << 20
# Shingles hashed at once, and rows whose bytes count bits up without overflow.
_RUN, _LANES = 1 << 16, 255
_PLACE = ["part", "key", "low", "high"]
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def _words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(words with one blank between, first byte of each, byte after each)."""
    given = np.frombuffer(text.lower(), np.uint8)
    blank = np.concatenate((_BLANKS[given], [True]))
    ends = ~blank[:-1] & blank[1:]
    # A word's bytes and one blank after it.
    keep = ~blank[:-1]
    keep[1:] |= ends[:-1]
    line = np.where(blank[:-1], np.uint8(0x20), given)[keep]
    if not len(line):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(line == 0x20)
    if line[-1] == 0x20:
        line, gaps = line[:-1], gaps[:-1]
    return line.tobytes(), np.concatenate(([0], gaps + 1)), np.append(gaps, len(line))


def fingerprint(text: bytes) -> int:
    """Unsigned; bit k is set if it is in more than half of the shingles' hashes, repeats counted."""
    line, starts, ends = _words(text)
    if not len(starts):
        return 0
    width = min(SHINGLE, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for first in range(0, len(starts), _RUN):
        spans = zip(starts[first : first + _RUN].tolist(), ends[first : first + _RUN].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
        lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view("<u8").reshape(-1, BITS // 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), _LANES), axis=0)
        counts += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed number."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in runs(batches):
            found = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id bigint, fp bigint")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((BITS, BITS), np.int64)
    for frame in batches:
        for first in range(0, len(frame), _RUN):
            bits = _bits(frame["fp"].to_numpy()[first : first + _RUN]).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
    yield pd.DataFrame({"at": np.arange(BITS * BITS, dtype=np.int32), "n": total.ravel()})


def together(distinct: DataFrame) -> np.ndarray:
    """How many fingerprints have both bits set, for all pairs of bits."""
    sums = distinct.select("fp").mapInPandas(_together, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS)
    for row in sums.collect():  # BITS * BITS rows
        out[row["at"]] = row["n"]
    return out.reshape(BITS, BITS)


def grouped_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in `parts` partitions of nearly equal size, correlated ones together."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(len(p))), []
    for k in range(parts):
        size = len(left) // (parts - k)
        pool = sorted(left)
        group = [max(pool, key=lambda b: (alike[b, pool].sum() - alike[b, b], -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (alike[b, group].sum(), -b)))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def near_shares(agree: Sequence[float], most: int) -> np.ndarray:
    """The share of pairs that differ in at most 0..most of the bits, taken as independent."""
    exact = np.zeros(most + 1)
    exact[0] = 1.0
    for q in agree:
        exact[1:] = exact[1:] * q + exact[:-1] * (1 - q)
        exact[0] *= q
    return np.cumsum(exact)


def allocate(costs: Sequence[Sequence[float]], distance: int) -> tuple[float, list[int]]:
    """(cost, thresholds): costs[i][t + 1] is what threshold t costs partition i, from t = -1;
    the thresholds + 1 sum to distance + 1 at the least cost."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(math.inf, [])] * (distance + 1)
    for cost in costs:
        best = [
            min((best[s - u][0] + cost[u], [*best[s - u][1], u - 1]) for u in range(min(s, len(cost) - 1) + 1))
            for s in range(distance + 2)
        ]
    return best[distance + 1]


def costs_of(n: int, groups: Sequence[Sequence[int]], agree: np.ndarray, distance: int, alone: Sequence[float] | None = None) -> list[list[float]]:
    """Per partition, the cost of each threshold from -1 to `distance`; `alone` are the pairs
    counted with equal bits, by which the estimates of more flips are scaled."""
    costs, n = [], max(n, 1)
    for i, group in enumerate(groups):
        near = near_shares(agree[list(group)], distance)
        pairs = alone[i] if alone is not None else near[0] * n * n
        probes = np.cumsum([1.0] + [math.comb(len(group), r) / 2 for r in range(1, distance + 1)])
        costs.append([0.0, *(ROW_COST * n * probes + PAIR_COST * pairs * near / max(near[0], 1e-300))])
    return costs


def _mask(bits: Sequence[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def _key(bits: Sequence[int]):
    return F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("bigint"))


def allocation(distinct: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition: least cost by counts over all fingerprints."""
    n, both = distinct.count(), together(distinct)
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    choices = [grouped_bits(both, n, m) for m in PARTITIONS]
    groups = min(choices, key=lambda g: allocate(costs_of(n, g, agree, distance), distance)[0])
    counted = (
        distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _key(g).alias("key")) for i, g in enumerate(groups)])).alias("k"))
        .groupBy("k").agg(F.count("*").cast("double").alias("n"))
        .groupBy("k.part").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    )
    pairs = {r["part"]: r["pairs"] for r in counted.collect()}  # one row a partition
    thresholds = allocate(costs_of(n, groups, agree, distance, [pairs.get(i, 0.0) for i in range(len(groups))]), distance)[1]
    return list(zip(groups, thresholds, strict=True))


def probes(distinct: DataFrame, parts: Sequence[tuple[Sequence[int], int]]) -> DataFrame:
    """(part, key, probe, fp): each fingerprint at its own bits, and where `probe` at flipped ones.

    Of two that differ in a partition, the one with the lowest differing bit set probes."""
    own, flipped = [], []
    for i, (bits, most) in enumerate(parts):
        if most < 0:
            continue
        own.append(F.struct(F.lit(i).alias("part"), _key(bits).alias("key"), F.lit(False).alias("probe")))
        flips = F.array(*[F.struct(F.lit(_mask(c)).cast("bigint").alias("flip"), F.lit(_mask(c[:1])).cast("bigint").alias("low")) for r in range(1, most + 1) for c in combinations(sorted(bits), r)])
        if most:
            rows = distinct.select("fp", F.explode(flips).alias("f")).where(F.col("fp").bitwiseAND(F.col("f.low")) != 0)
            flipped.append(rows.select(F.lit(i).alias("part"), _key(bits).bitwiseXOR(F.col("f.flip")).alias("key"), F.lit(True).alias("probe"), "fp"))
    held = distinct.select("fp", F.explode(F.array(*own)).alias("k")).select("k.part", "k.key", "k.probe", "fp")
    return reduce(DataFrame.unionByName, flipped, held)


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """`rows` with (low, high): a place where more than `block` meet is dealt over pairs of
    blocks, about the root of their number, so that each two of its rows share one at least."""
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    sizes = sizes.select("part", "key", F.greatest(F.ceil(F.sqrt(F.col("_n") / block)), F.lit(2)).cast("int").alias("_blocks"))
    side = F.when(F.col("_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("_blocks"))).cast("int")
    others = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("_blocks") - 1), F.col("_side")))
    return (
        rows.join(sizes, ["part", "key"], "left").withColumn("_side", side).withColumn("_other", F.explode(others))
        .select("part", "key", F.least("_side", "_other").alias("low"), F.greatest("_side", "_other").alias("high"), "probe", "fp")
    )


def _linker(distance: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, new in whole_groups(batches, _PLACE):
            fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
            n = len(fps)
            after = np.repeat(np.append(new[1:], n), np.diff(np.append(new, n))) - np.arange(n) - 1
            active = np.flatnonzero(~frame["probe"].to_numpy(bool) & (after > 0))
            a, b, held, step = [], [], 0, 1
            while len(active):
                hit = active[np.bitwise_count(fps[active] ^ fps[active + step]) <= distance]
                a.append(hit)
                b.append(hit + step)
                held += len(hit)
                if held > _LINKS:
                    a, b = _hung(n, a, b)
                    held = 0
                step += 1
                active = active[after[active] >= step]
            (i,), (j,) = _hung(n, a, b)
            if len(i):
                yield pd.DataFrame({"a": fps[i].view(np.int64), "b": fps[j].view(np.int64)})

    return link


def _hung(n: int, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The links (a, b) as one from each to the first it hangs together with."""
    none = np.zeros(0, np.int64)
    root = connected(n, np.concatenate([none, *a]), np.concatenate([none, *b]))
    moved = np.flatnonzero(root != np.arange(n))
    return [moved], [root[moved]]


def links(distinct: DataFrame, distance: int = 4, block: int = BLOCK, parts: Sequence[tuple[Sequence[int], int]] | None = None) -> DataFrame:
    """(a, b): fingerprints within `distance`, as many as hold together what all such pairs do."""
    parts = allocation(distinct, distance) if parts is None else parts
    places = dealt(probes(distinct, parts), block).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "probe", "fp")
    return places.mapInPandas(_linker(distance), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id that links lead to."""
    known = cut(fingerprints(docs), "fingerprints")
    distinct = cut(known.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(links(distinct, distance, block)).withColumnRenamed("node", "fp")
    members = distinct.join(linked, "fp")
    smallest = members.groupBy("component").agg(F.min("first").alias("smallest"))
    named = cut(distinct.join(linked.join(smallest, "component"), "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")), "named")
    return known.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
