"""Approximate nearest neighbours by several shifted Hilbert orderings.

Vectors of length one are projected at random to a few dimensions, once for each ordering,
shifted, laid on a grid and numbered along a Hilbert curve.  Spark sorts each ordering by
range; a query looks at the keys around its own, and the windows of all orderings merge and
are reranked by inner product on the original vectors.

The curve keeps near vectors near in a few dimensions only, so on data without structure the
windows must hold a good part of all orderings.  `window`, the keys to either side, and
`orderings` are what a search begins with.  Its recall is measured: `SAMPLE` queries, those whose ids
hash lowest, are compared with all rows, and until two standard errors below their mean recall is
at least `recall`, as many orderings again as there are and, up to `_WIDEST` keys, windows twice as
wide are added.  A window that holds all rows ends it, as that search is exact.

Equal vectors are indexed once, with the k + 1 smallest ids that hold them: no more can be
among the k nearest of any query, and a vector that a third of all rows share is one key.

Vectors null, empty, zero or holding null or non-finite components take no part, nor do
rows with null ids.  All vectors have one length.  Ties go to smaller ids.  Fewer candidates
than k give them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.vectors import ranked, usable
from shelfmark.session import cut


# Queries whose recall is measured, and the widest window, which bounds what a group holds.
SAMPLE = 200
_WIDEST = 8192


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """The place along a Hilbert curve of grid points (one row each), as whole numbers.

    Walks the bits from the highest: the Gray code of a cell's corner, then the reflection
    and exchange of axes that turns the curve inside that cell.
    """
    x = grid.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for axis in range(dims):
            high = (x[axis] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(high, low, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint64(b) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << one | (x[axis] >> np.uint64(b) & one)
    return key.astype(np.int64)


def _keys(orderings: range, dims: int, bits: int, seed: int):
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            x = np.stack(frame["vector"].to_numpy()).astype(float)
            x /= np.linalg.norm(x, axis=1)[:, None]
            for curve in orderings:
                rng = np.random.default_rng((seed, curve))
                axes = np.linalg.qr(rng.normal(size=(x.shape[1], min(dims, x.shape[1]))))[0]
                # Spread to about one; the grid of each ordering is shifted by less than a cell.
                y = x @ axes * np.sqrt(x.shape[1])
                cells = 1 << bits
                grid = np.clip((y + 3) / 6 * (cells - 1) + rng.random(axes.shape[1]), 0, cells - 1).astype(np.int64)
                yield pd.DataFrame({"rep": frame["rep"].to_numpy(), "curve": np.int32(curve), "key": hilbert(grid, bits)})

    return keys


def _nearest(window: int, chunk: int, k: int):
    def nearest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        rank, rep = rows["rank"].to_numpy(np.int64), rows["rep"].to_numpy(np.int64)
        asks = np.flatnonzero(rows["is_query"].to_numpy(bool) & (rank // chunk == key[1]))
        x = np.stack(rows["vector"].to_numpy()).astype(float)
        out = []
        for at in range(0, len(asks), 64):
            own = asks[at : at + 64]
            low, high = np.searchsorted(rank, [rank[own[0]] - window, rank[own[-1]] + window + 1])
            scores = x[own] @ x[low:high].T
            scores[np.abs(rank[own][:, None] - rank[low:high]) > window] = -np.inf
            take = min(k, high - low)
            for q, line in zip(own, scores, strict=True):
                # All that tie with the k-th, then the smaller ids of them.
                best = np.flatnonzero((line >= np.partition(line, -take)[-take]) & (line > -np.inf))
                best = best[np.lexsort((rep[low + best], -line[best]))[:k]]
                out.append((np.full(len(best), rep[q]), rep[low + best], line[best]))
        q, c, s = (np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pd.DataFrame({"query_id": q, "vec_id": c, "score": s})

    return nearest


def _against_all(ids: np.ndarray, asks: np.ndarray, k: int):
    def against_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            rep = frame["rep"].to_numpy(np.int64)
            scores = asks @ np.stack(frame["vector"].to_numpy()).astype(float).T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "vec_id": rep[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()})

    return against_all


def _sampled(distinct: DataFrame, k: int) -> dict[int, set[int]]:
    """The k nearest of each of at most `SAMPLE` queries, itself not among them, by comparing
    with all rows."""
    sample = distinct.where("is_query").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("rep", "vector").collect()
    best: dict[int, set[int]] = {r["rep"]: set() for r in sample}
    if sample:
        task = _against_all(np.array([r["rep"] for r in sample], np.int64), np.array([r["vector"] for r in sample], float), k + 1)
        found = distinct.select("rep", "vector").mapInPandas(task, "query_id bigint, vec_id bigint, score double")
        for r in ranked(found.where("query_id <> vec_id"), k).collect():
            best[r["query_id"]].add(r["vec_id"])
    return {q: near for q, near in best.items() if near}


def measured(found: DataFrame, best: dict[int, set[int]]) -> tuple[float, float]:
    """Mean recall of the sampled queries, and its standard error."""
    got: dict[int, set[int]] = {q: set() for q in best}
    for r in found.where(F.col("query_id").isin(list(best))).select("query_id", "vec_id").collect():
        got[r["query_id"]].add(r["vec_id"])
    shares = np.array([len(got[q] & near) / len(near) for q, near in best.items()])
    return float(shares.mean()), float(shares.std() / np.sqrt(len(shares)))


def _search(distinct: DataFrame, n: int, orderings: range, window: int, k: int, dims: int, bits: int, seed: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest within the windows of each of `orderings`."""
    keyed = (
        distinct.select("rep", "vector").mapInPandas(_keys(orderings, dims, bits, seed), "rep bigint, curve int, key bigint")
        .repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
        .select("rep", "curve", F.monotonically_increasing_id().alias("place"))
    )
    keyed = cut(keyed, "curves")
    part = F.shiftright("place", 33)
    # A row for each partition.
    parts = keyed.groupBy(part.alias("part")).agg(F.count("*").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("before"))
    position = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = keyed.withColumn("part", part).join(parts, "part").select("rep", "curve", (position - (F.col("curve") - orderings.start) * F.lit(n)).alias("rank"))
    chunk = 4 * window
    cells = F.sequence(F.greatest(F.lit(0), F.floor((F.col("rank") - window) / chunk)), F.floor((F.col("rank") + window) / chunk))
    spread = numbered.withColumn("chunk", F.explode(cells)).join(distinct.select("rep", "vector", "is_query"), "rep")
    return spread.groupBy("curve", "chunk").applyInPandas(_nearest(window, chunk, k), "query_id bigint, vec_id bigint, score double")


def nearest(
    embeddings: DataFrame, every: int = 20, k: int = 20, orderings: int = 26, window: int = 1024, dims: int = 8, bits: int = 3, seed: int = 7,
    recall: float = 0.9,
) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by `every`, the k
    nearest found among all other rows of (vec_id, embedding)."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double") * x)
    good = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).where(norm > 0).select("vec_id", F.col("embedding").alias("vector"))
    asks = F.col("vec_id") % every == 0
    # A vector's smallest ids, first within salts, so that no group is large.
    salted = Window.partitionBy("vector", "salt")
    few = (
        good.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
        .withColumn("nth", F.row_number().over(salted.orderBy("vec_id"))).withColumn("is_query", F.max(asks).over(salted))
        .where(F.col("nth") <= k + 1)
    )
    distinct = few.groupBy("vector").agg(
        F.min("vec_id").alias("rep"), F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.max("is_query").alias("is_query")
    )
    distinct = cut(distinct, "distinct")
    n = distinct.count()
    best = _sampled(distinct, k)
    curves, merged = range(orderings), None
    while True:
        found = _search(distinct, n, curves, window, k + 1, dims, bits, seed)
        found = found if merged is None else found.unionByName(merged.drop("rank"))
        merged = cut(ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k + 1), "neighbours")
        if not best or window >= n:
            break
        mean, error = measured(merged, best)
        if mean - 2 * error >= recall:
            break
        curves, window = range(curves.stop, 2 * curves.stop), max(window, min(2 * window, _WIDEST))
    named = merged.join(distinct.select(F.col("rep").alias("vec_id"), "ids"), "vec_id").select(F.col("query_id").alias("rep"), "score", "ids")
    queries = good.where(asks).join(distinct.select("vector", "rep"), "vector").select("vec_id", "rep")
    each = queries.withColumnRenamed("vec_id", "query_id").join(named, "rep").select("query_id", F.explode("ids").alias("vec_id"), "score")
    return ranked(each.where("vec_id != query_id"), k)
