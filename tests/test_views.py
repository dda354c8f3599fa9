"""The views of the checks on ids that the small tables do not have."""

import pytest

from checks import columns, inventory, plans  # noqa: F401
from checks.registry import QUERIES
from checks.views import Tables

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DAY = 86_400 * 10**9
IDS = [*range(40), *range(90_540, 90_560), 100_001, 512_819, 10**9]


def written(spark, folder, ids):
    rows = [(i, f"text {i}", "en", "src0", len(f"text {i}")) for i in ids]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("ids"), IDS)


def test_times_of_any_id(spark, tmp_path):
    ids = [*IDS, -1, -106_751, -106_752, -(10**9)]
    got = {r["doc_id"]: r["mtime_ns"] for r in Tables(spark, written(spark, tmp_path, ids)).files.collect()}
    assert set(got) == set(ids)
    for i, mtime in got.items():
        plain = 1_400_000_000_000_000_000 + i * DAY
        assert mtime == plain if -106_751 <= i <= 90_548 else mtime % DAY == plain % DAY
        assert abs(mtime) < 1 << 63


@pytest.mark.parametrize("name", ["capture_date", "detect_touched", "merge_sources", "plan_dated"])
def test_queries_on_any_id(spark, folder, name):
    found = QUERIES[name](spark, folder).collect()
    assert found
    if name == "capture_date":
        assert len(found) == len(IDS) and all(r["day"] for r in found)
