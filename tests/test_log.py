"""Tables kept as logs: newest wins, writes follow the change, reads follow the keys asked for."""

import os
import random

from shelfmark.operators import change
from shelfmark.sources import state
from shelfmark.sources.log import Log, Table, merged_from

TABLE = {"t": Table("k string, v bigint", ("k",))}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v bigint")


def keys(spark, names):
    return spark.createDataFrame([(k,) for k in names], "k string")


def held(log, version=None, **more):
    return {r["k"]: r["v"] for r in log.read("t", version, **more).collect()}


def written(folder, before):
    """Bytes of data below `folder` that were not there `before`, and all files now."""
    now = {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}
    return sum(n for f, n in now.items() if f not in before), set(now)


def test_newest_record_counts_in_every_version(spark, tmp_path):
    rng = random.Random(1)
    log, want = Log(spark, str(tmp_path / "log"), TABLE, buckets=4), [{}]
    assert held(log) == {}
    for version in range(1, 7):
        now = dict(want[-1])
        changed = {f"k{rng.randrange(40)}": rng.randrange(1000) for _ in range(rng.choice([1, 5, 30]))}
        lost = {k for k in rng.sample(sorted(now), min(len(now), 3))} - set(changed)
        log.write(version, {"t": frame(spark, list(changed.items()))}, {"t": keys(spark, lost)} if lost else None)
        now.update(changed)
        want.append({k: v for k, v in now.items() if k not in lost})
        # Done again, it is the same version.
        if version == 3:
            log.write(version, {"t": frame(spark, list(changed.items()))}, {"t": keys(spark, lost)} if lost else None)
    assert [held(log, v) for v in range(1, 7)] == want[1:]
    some = ["k1", "k2", "k7", "nowhere"]
    assert held(log, of=keys(spark, some)) == {k: v for k, v in want[-1].items() if k in some}
    log.drop(2)
    assert log.versions() == [5, 6] and [held(log, v) for v in (5, 6)] == want[5:]
    # A version without its marker does not count.
    os.remove(f"{log.folder}/v=6/_COMPLETE")
    assert held(log) == want[5]
    log.write(7, {"t": frame(spark, [("only", 1)])}, whole=True)
    assert held(log) == {"only": 1}


def test_writes_follow_the_batch_and_reads_its_keys(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), TABLE, buckets=16)
    log.write(1, {"t": spark.range(200_000).selectExpr("concat('key', id) k", "id v")})
    first, files = written(log.folder, set())
    sizes = []
    for version in range(2, 10):
        log.write(version, {"t": frame(spark, [(f"key{version * 1000 + i}", -1) for i in range(20)])})
        more, files = written(log.folder, files)
        sizes.append(more)
    assert max(sizes) < first / 20
    asked = log.read("t", of=keys(spark, ["key2001", "key77"]))
    assert {r["k"]: r["v"] for r in asked.collect()} == {"key2001": -1, "key77": 77}
    # Of sixteen buckets two at most are opened.
    assert len({f.split("in_bucket=")[1].split("/")[0] for f in asked.inputFiles()}) <= 2
    runs = [len(r) for r in log._known(None)["tables"]["t"].values()]
    assert max(runs) <= 6 and log.read("t").count() == 200_000


def test_runs_halve():
    rng = random.Random(2)
    runs, total, moved = [], 0, 0
    for version in range(3000):
        rows = rng.choice([1, 1, 1, 10])
        runs.append((version, False, rows))
        total += rows
        at = merged_from(runs)
        if at < len(runs) - 1:
            size = sum(r[2] for r in runs[at:])
            moved += size
            runs[at:] = [(version, True, size)]
        assert all(a[2] > b[2] for a, b in zip(runs, runs[1:]))
    assert len(runs) <= 14 and moved <= 14 * total


def test_versions_can_be_taken_back_by_key(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), TABLE, buckets=2)
    log.write(1, {"t": frame(spark, [("a", 1), ("b", 1)])}, before=True)
    log.write(2, {"t": frame(spark, [("a", 2), ("b", 2), ("c", 2), ("d", 2)])}, before=True)
    log.write(3, {"t": frame(spark, [("b", 3)])}, before=True)
    changes, gone = log.reverted("t", 2, keys(spark, ["a", "b", "c", "x"]))
    assert [tuple(r) for r in changes.collect()] == [("a", 1)] and [r["k"] for r in gone.collect()] == ["c"]
    log.write(4, {"t": changes}, {"t": gone})
    assert held(log) == {"a": 1, "b": 3, "d": 2}


def test_two_keys_dealt_by_one(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), {"": Table("s string, n int, c bigint", ("s", "n"))}, prefix="batch")
    make = lambda rows: spark.createDataFrame(rows, "s string, n int, c bigint")
    log.write(0, {"": make([("x", 1, 5), ("x", 2, 1), ("y", 1, 1)])})
    log.write(1, {"": make([("x", 2, 4)])})
    asked = log.read("", of=make([("x", 0, 0)]))
    assert sorted(tuple(r) for r in asked.collect()) == [("x", 1, 5), ("x", 2, 4)]


def test_state_counts_the_paths_of_images(spark, tmp_path):
    folder = str(tmp_path / "state")
    full = lambda rows: change.complete_state(spark.createDataFrame(rows, "path string, size bigint, image_uri string"))
    none = spark.createDataFrame([], state.HASHES_SCHEMA)
    counts = lambda: {r["image_uri"]: r["refs"] for r in state.state_log(spark, folder).read("refs").collect()}
    assert state.append_state(spark, folder, full([("a", 1, "i"), ("b", 1, "i"), ("c", 1, None)]), none) == 0
    assert counts() == {"i": 2}
    assert state.append_state(spark, folder, full([("b", 2, "j"), ("c", 1, "i"), ("d", 1, "j")]), none) == 1
    assert counts() == {"i": 2, "j": 2}
    gone = spark.createDataFrame([("d",)], "path string")
    assert state.append_state(spark, folder, full([("a", 3, None), ("c", 3, None)]), none, gone_files=gone) == 2
    assert counts() == {"j": 1}
    files, _ = state.read_state(spark, folder)
    assert sorted((r["path"], r["image_uri"]) for r in files.collect()) == [("a", None), ("b", "j"), ("c", None)]
    assert {r["image_uri"]: r["refs"] for r in change.image_refs(files).collect()} == counts()
