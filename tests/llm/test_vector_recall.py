"""Recall of the approximate search against brute force."""

import numpy as np
import pytest

from shelfmark.llm import space_curves


@pytest.mark.parametrize("options", [{}, {"orderings": 4, "window": 128}])
def test_recall_is_reached_from_any_start(spark, options):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = {}
    for r in space_curves.nearest(df, **options).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact = x.astype(float)[::20] @ x.astype(float).T
    exact[np.arange(len(exact)), np.arange(0, len(x), 20)] = -9
    best = {20 * i: set(np.argsort(-s)[:20].tolist()) for i, s in enumerate(exact)}
    assert len(found) == 600 and np.mean([len(found[q] & best[q]) / 20 for q in best]) >= 0.9
