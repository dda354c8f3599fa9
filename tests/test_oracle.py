"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, connection, name):
    if name in oracle_sql():
        assert differences(spark, connection, FOLDER, queries()[name], oracle_sql()[name]) is None
    else:
        assert queries()[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["plan_dated", "plan_flat", "caption_jobs", "duplicate_groups_in_parts", "resolve_paths", "batches"])
def test_query_with_nearly_every_key_hot(spark, connection, name, monkeypatch):
    monkeypatch.setattr("shelfmark.skew.HOT_ROWS", 3)
    assert differences(spark, connection, FOLDER, queries()[name], oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).columns[:2] == ["path", "action"]
