"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import ball_tree, queries, space_curves

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def odd_rows(rng, n=400, width=8):
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=width)]) for i in range(n)]
    same = rows[1][1]
    # A third of the rows share one vector.
    rows = [(i, same if i % 3 == 1 else v) for i, v in rows]
    return rows + [
        (1000, None), (1100, []), (1200, [None] * width), (1300, [float("nan")] * width), (1400, [float("inf")] * width),
        (None, same), (1500, [0.0] * width), (17, rows[17][1]), (2, rows[2][1]),
    ]


def best(rows, every, k, score, keep):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and keep(v)]
    out = set()
    for q, v in {i: (i, v) for i, v in good if i % every == 0}.values():
        found = sorted((-score(v, w), j) for j, w in good if j != q)[:k]
        out |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


def whole(v, w):
    return int(np.dot(np.floor(1024 * np.array(v)).astype(int), np.floor(1024 * np.array(w)).astype(int)))


def test_top_k_is_exact(spark):
    rows = odd_rows(np.random.default_rng(1))
    good = [r for r in rows]
    expected = best(good, 20, 10, whole, lambda v: True)
    got = ball_tree.top_k_of_table(table(spark, rows).withColumn("score", F.lit(1)), every=20)
    assert {tuple(r) for r in got.collect()} == expected


@pytest.mark.parametrize("shard_rows,block_queries", [(40, 3), (10_000, 500)])
def test_top_k_over_shards_and_blocks(spark, shard_rows, block_queries):
    rng = np.random.default_rng(2)
    rows = [(i, [int(x) for x in rng.integers(-9, 9, 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = ball_tree.top_k(df.where("vec_id % 7 = 0"), df, 4, shard_rows, block_queries)
    expected = best(rows, 7, 4, lambda v, w: int(np.dot(v, w)), lambda v: True)
    assert {tuple(r) for r in got.collect()} == expected


def exact(v, w):
    return sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v, w, strict=True))


@pytest.mark.parametrize("kind", ["beyond 2^53", "products beyond 2^63"])
def test_top_k_of_large_components(spark, kind):
    """Scores that differ by few units: no doubles, and sums of products that are no longs."""
    rng = np.random.default_rng(9)
    if kind == "beyond 2^53":
        base = [float(x) for x in rng.normal(size=3) * 1e5]
        rows = [(i, base + [int(d) / 1024 for d in rng.integers(-3, 4, 3)]) for i in range(90)]
    else:
        rows = [(i, [3e9, -3e9] + [int(d) / 1024 for d in rng.integers(-3, 4, 3)]) for i in range(1, 90) if i % 20]
        rows.append((0, [3e9, 3e9, 1.0, 2.0, 3.0]))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors = df.select("vec_id", ball_tree.quantized(F.col("embedding")).alias("vector"))
    for shard_rows in (40, 10_000):
        got = ball_tree.top_k(vectors.where("vec_id % 20 = 0"), vectors, 10, shard_rows)
        assert {tuple(r) for r in got.collect()} == best(rows, 20, 10, exact, lambda v: True)


def test_score_beyond_a_long_is_an_error(spark):
    df = table(spark, [(0, [1e12, 1.0]), (1, [1e12, 1.0])])
    with pytest.raises(Exception, match="does not fit a long"):
        ball_tree.top_k_of_table(df).collect()


def test_fewer_candidates_than_k_and_empty(spark):
    few = table(spark, [(0, [1.0, 2.0]), (5, [1.0, 2.0]), (3, [0.5, 0.5])])
    assert ball_tree.top_k_of_table(few).count() == 2
    assert space_curves.nearest(few).count() == 2
    none = table(spark, []).where("vec_id > 0")
    assert ball_tree.top_k_of_table(none).count() == 0
    assert space_curves.nearest(none).count() == 0


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = space_curves.hilbert(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest_with_ties_and_odd_rows(spark):
    rows = odd_rows(np.random.default_rng(3))
    score = lambda v, w: float(np.dot(np.array(v, float), np.array(w, float)))
    expected = best(rows, 20, 20, score, lambda v: any(v))
    got = {tuple(r) for r in space_curves.nearest(table(spark, rows)).collect()}
    # Windows hold all of so few rows, so nothing is approximate.
    assert {r[:3] for r in got} == {r[:3] for r in expected}
    assert {r[0] for r in got} == {r[0] for r in expected}


def test_recall_on_structureless_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], SCHEMA)
    got = space_curves.nearest(df, every=200, window=256)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -9)
    hits = [len(found[q] & set(np.argsort(-exact[q])[:20].tolist())) / 20 for q in found]
    # A window of this size holds a twenty-third of the rows; the default one holds a sixth.
    assert len(found) == 60 and np.mean(hits) > 0.85


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {}
    for r in queries.op5_nearest_neighbours(spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    assert np.mean([len(got[q] & set(np.argsort(-s[q])[:20].tolist())) / 20 for q in got]) >= 0.99
