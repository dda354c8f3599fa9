"""A stream read in steps gives what the batch operator gives on the whole."""

import datetime as dt

from pyspark.sql import functions as F

from shelfmark.operators import copies, reports, series
from shelfmark.plans.dated import DatedOptions
from shelfmark.sources import state
from shelfmark.streaming import jobs

SCHEMA = "path string, series string, sha256 string, md5 string, size bigint, mtime_ns bigint, day date, date_source string"


def steps(spark, folder, count=3):
    """Thirty files in `count` parts; the whole as a table."""
    day = lambda i: dt.date(2014, 7, 12 + i % 3)
    rows = [
        (f"/lib/{i:03}/IMG_{day(i):%Y%m%d}_{i}.jpg", str(day(i)), f"s{i % 11}", f"m{i % 11}", 10 + i, 1000 + i, day(i), "file name" if i % 4 else "video metadata")
        for i in range(30)
    ]
    whole = spark.createDataFrame(rows, SCHEMA)
    for step in range(count):
        part = [r for i, r in enumerate(rows) if i * count // 30 == step]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        yield whole


def test_dedup(spark, tmp_path):
    folders = [str(tmp_path / name) for name in ("leaders", "told", "cp")]
    for whole in steps(spark, tmp_path / "in"):
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        jobs.stream_dedup(source, *folders).awaitTermination()
    told = spark.read.parquet(folders[1]).select("path", "sha256", "leader", "is_leader")
    # The parts come in path order, so who leads is who leads the whole.
    leads = copies.elect_copies(whole).select("path", "sha256", "leader", "is_leader")
    assert told.count() == 30 and told.exceptAll(leads).count() == 0


def test_change_detection(spark, tmp_path):
    schema = "path string, size bigint, mtime_ns bigint, sha256 string, failed string"
    arrivals = [
        [("a", 1, 1, "x", None), ("b", 1, 1, "y", None), ("d", 5, 5, "v", "too big")],
        [("a", 1, 1, "x", None), ("b", 1, 2, "y", None), ("c", 3, 3, "z", None), ("d", 5, 5, "v", None)],
        [("a", 2, 2, "w", None), ("b", 1, 2, "y", None), ("c", 3, 3, "z", None), ("c", 3, 9, "z", None), ("d", 5, 5, "v", None), ("d", 5, 6, "v", None)],
        [("d", 5, 6, "v", None)],
    ]
    folders = [str(tmp_path / name) for name in ("records", "told", "cp")]
    for part in arrivals:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_change_detect(source, *folders).awaitTermination()
    found = sorted((r["path"], r["mtime_ns"], r["status"]) for r in spark.read.parquet(folders[1]).collect())
    assert found == [
        ("a", 1, "new"), ("a", 1, "unchanged"), ("a", 2, "changed"), ("b", 1, "new"), ("b", 2, "touched"), ("b", 2, "unchanged"),
        ("c", 3, "new"), ("c", 3, "unchanged"), ("c", 9, "touched"),
        ("d", 5, "new"), ("d", 5, "refused"), ("d", 5, "refused"), ("d", 6, "touched"), ("d", 6, "unchanged"),
    ]
    # A batch writes the records of its own paths.
    assert spark.read.parquet(f"{folders[0]}/batch=3").count() == 1


def test_slots(spark, tmp_path):
    albums = spark.createDataFrame([("2014-07-12", 1, 2), ("2014-07-13", 2, 0)], "series string, n int, cnt bigint")
    for whole in steps(spark, tmp_path / "in"):
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        jobs.stream_assign_slots(
            source, str(tmp_path / "albums"), str(tmp_path / "placed"), str(tmp_path / "cp"), capacity=4, albums=albums
        ).awaitTermination()
    # The parts come in path order, so filling them in turn is filling the whole.
    placed = spark.read.parquet(str(tmp_path / "placed")).select("path", "album_name")
    whole_placed = series.assign_slots(whole, albums, capacity=4).select("path", "album_name")
    assert placed.count() == 30 and placed.exceptAll(whole_placed).count() == 0


def test_day_counts(spark, tmp_path):
    for whole in steps(spark, tmp_path / "in"):
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        counts = jobs.stream_day_counts(source)
        query = counts.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).foreachBatch(
            lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).start()
        query.awaitTermination()
    latest = spark.read.parquet(str(tmp_path / "out")).groupBy("day", "date_source").agg(F.max("files").alias("files"))
    by_day = {str(r["day"]): r["n"] for r in latest.groupBy("day").agg(F.sum("files").alias("n")).collect()}
    batch = {str(r["day"]): r["files"] for r in reports.day_counts(whole).where("day is not null").collect()}
    assert by_day == batch


def test_planning_keeps_state_between_batches(spark, tmp_path):
    albums = spark.createDataFrame([], "album_key string, name string, image_count bigint")
    images = spark.createDataFrame([], "album_key string, file_name string, md5 string, uri string")
    options = DatedOptions(as_of="2026-12-01", root="/lib")

    def start():
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        return jobs.stream_plan(
            source, str(tmp_path / "state"), str(tmp_path / "actions"), albums, images, options, str(tmp_path / "cp")
        )

    for whole in steps(spark, tmp_path / "in", count=2):
        assert jobs.run_repeatedly(start, 2) == [None, None]
    actions = spark.read.parquet(str(tmp_path / "actions"))
    counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 30 and counts["uploaded"] == 11
    assert state.versions(spark, str(tmp_path / "state")) == [1, 2]
    files, hashes = state.read_state(spark, str(tmp_path / "state"))
    assert files.count() == 30 and hashes.count() == 11
    # The same files once more: nothing to do.
    whole.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert jobs.run_repeatedly(start, 1) == [None]
    again = spark.read.parquet(str(tmp_path / "actions/batch=2"))
    assert [r["action"] for r in again.select("action").distinct().collect()] == ["unchanged"]


def test_planning_carries_names_and_room(spark, tmp_path):
    """Equal names of other content, more files than an album holds, copies of one day: over three batches."""
    day = dt.date(2014, 7, 12)
    name = "IMG_20140712.jpg"
    parts = [
        [("/lib/a/" + name, "s1", "m1" * 16), ("/lib/b/IMG_20140712_1.jpg", "s2", "m2" * 16)],
        [("/lib/c/" + name, "s3", "m3" * 16), ("/lib/d/IMG_20140712_2.jpg", "s1", "m1" * 16), ("/lib/e/IMG_20140712_3.jpg", "s4", "m4" * 16)],
        [("/lib/f/" + name, "s5", "m5" * 16), ("/lib/g/IMG_20140712_1.jpg", "s6", "m6" * 16), ("/lib/h/x/IMG_20140712_9.jpg", "s2", "m2" * 16)],
    ]
    albums = spark.createDataFrame([("K", "2014-07-12", 1)], "album_key string, name string, image_count bigint")
    images = spark.createDataFrame([], "album_key string, file_name string, md5 string, uri string")
    options = DatedOptions(as_of="2026-12-01", root="/lib", capacity=2)
    for part in parts:
        rows = [(path, str(day), sha, md5, 10, 1000, day, "file name") for path, sha, md5 in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        jobs.stream_plan(source, str(tmp_path / "state"), str(tmp_path / "actions"), albums, images, options, str(tmp_path / "cp")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "actions")).collect()
    sent = [(r["album_name"], r["target_name"]) for r in done if r["action"] == "uploaded"]
    assert len(sent) == 6 == len(set(n for _, n in sent))
    filled = {}
    for album, _ in sent:
        filled[album] = filled.get(album, 0) + 1
    assert filled == {"2014-07-12": 1, "2014-07-12 (2)": 2, "2014-07-12 (3)": 2, "2014-07-12 (4)": 1}
    assert sorted(r["path"] for r in done if r["action"] == "linked") == ["/lib/d/IMG_20140712_2.jpg", "/lib/h/x/IMG_20140712_9.jpg"]
    assert {r["album_key"] for r in done if r["album_name"] == "2014-07-12"} == {"K"}
    assert sum(r["created"] for r in done if r["action"] == "uploaded") >= 3


def test_a_failing_run_does_not_stop_the_next():
    outcomes = iter([RuntimeError("no network"), None])

    class Query:
        def awaitTermination(self):
            error = next(outcomes)
            if error:
                raise error

    assert jobs.run_repeatedly(Query, 2) == ["no network", None]


FILE = "path string, sha256 string, md5 string, size bigint, mtime_ns bigint"


class Planned:
    """A stream of plans over parts that arrive one after another, with outcomes told between."""

    def __init__(self, spark, folder, albums=(), capacity=5000):
        self.spark, self.folder = spark, folder
        self.albums = spark.createDataFrame(list(albums), "album_key string, name string, image_count bigint")
        self.images = spark.createDataFrame([], "album_key string, file_name string, md5 string, uri string")
        self.options = DatedOptions(as_of="2026-12-01", root="/lib", capacity=capacity)

    def arrive(self, rows):
        self.spark.createDataFrame([(*r, 10, m) for *r, m in rows], FILE).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def tell(self, rows):
        schema = "batch bigint, path string, outcome string, reason string"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/told")
        source = self.spark.readStream.schema(schema).parquet(f"{self.folder}/told")
        jobs.stream_outcomes(source, f"{self.folder}/outcomes", f"{self.folder}/cp-told").awaitTermination()

    def plan(self, fed=True):
        source = self.spark.readStream.schema(FILE).parquet(f"{self.folder}/in")
        jobs.stream_plan(
            source, f"{self.folder}/state", f"{self.folder}/actions", self.albums, self.images, self.options, f"{self.folder}/cp",
            outcomes_folder=f"{self.folder}/outcomes" if fed else None,
        ).awaitTermination()

    def batch(self, n):
        rows = self.spark.read.parquet(f"{self.folder}/actions/batch={n}").collect()
        return {r["path"].removeprefix("/lib/"): (r["action"], r["album_name"], r["target_name"]) for r in rows}

    def records(self):
        files, hashes = state.read_state(self.spark, f"{self.folder}/state")
        return {r["path"].removeprefix("/lib/"): r["sha256"] for r in files.collect()}, {r["sha256"]: r["uri"] for r in hashes.collect()}


def md5(name):
    return (name * 32)[:32]


def test_first_content_is_sent_again_after_two_replacements(spark, tmp_path):
    run = Planned(spark, tmp_path)
    name = "IMG_20140712.jpg"
    for k, sha in enumerate(["s1", "s2", "s3"]):
        run.arrive([(f"/lib/a/{name}", sha, md5(str(k)), 1000 + k)])
        run.plan(fed=False)
    assert [run.batch(n)[f"a/{name}"][0] for n in range(3)] == ["uploaded", "replaced", "replaced"]
    # The name is held by the third content alone; the first and second are nowhere.
    run.arrive([(f"/lib/b/{name}", "s1", md5("0"), 1), (f"/lib/c/{name}", "s2", md5("1"), 1), (f"/lib/d/{name}", "s3", md5("2"), 1)])
    run.plan(fed=False)
    now = run.batch(3)
    assert {p[0]: a for p, (a, _, _) in now.items()} == {"b": "uploaded", "c": "uploaded", "d": "linked"}
    names = [n for p, (_, _, n) in now.items() if p[0] in "bc"]
    assert name not in names and len(set(names)) == 2
    files, hashes = run.records()
    assert len(files) == 4 and len(hashes) == 3 and len(set(hashes.values())) == 3


def test_failed_actions_give_back_slots_names_and_contents(spark, tmp_path):
    run = Planned(spark, tmp_path, [("K", "2014-07-12", 0)], capacity=3)
    part = lambda letter, k: (f"/lib/{letter}/IMG_20140712_{k}.jpg", f"s{letter}{k}", md5(f"{letter}{k}"), 1)
    first = [part("a", k) for k in range(3)]
    run.arrive([*first, ("/lib/b/IMG_20140712_8.jpg", "sa0", md5("a0"), 1)])
    run.plan()
    assert {p: a[:2] for p, a in run.batch(0).items()} == {
        "a/IMG_20140712_0.jpg": ("uploaded", "2014-07-12"), "a/IMG_20140712_1.jpg": ("uploaded", "2014-07-12"),
        "a/IMG_20140712_2.jpg": ("uploaded", "2014-07-12"), "b/IMG_20140712_8.jpg": ("linked", "2014-07-12"),
    }
    failed = [(0, "/lib/a/IMG_20140712_0.jpg", "failed", "no answer"), (0, "/lib/a/IMG_20140712_1.jpg", "ok", None), (0, "/lib/a/IMG_20140712_2.jpg", "refused", "too large")]
    run.tell(failed)
    run.arrive([(f"/lib/c/IMG_20140712_{k}.jpg", f"sc{k}", md5(f"c{k}"), 1) for k in (0, 5, 6)])
    run.plan()
    # Two slots and both names are free again; the third file opens the next album.
    assert run.batch(1) == {
        "c/IMG_20140712_0.jpg": ("uploaded", "2014-07-12", "IMG_20140712_0.jpg"), "c/IMG_20140712_5.jpg": ("uploaded", "2014-07-12", "IMG_20140712_5.jpg"),
        "c/IMG_20140712_6.jpg": ("uploaded", "2014-07-12 (2)", "IMG_20140712_6.jpg"),
    }
    # Told again, it changes nothing: the album is still full.
    run.tell(failed)
    run.arrive([*first, ("/lib/b/IMG_20140712_8.jpg", "sa0", md5("a0"), 1)])
    run.plan()
    again = run.batch(2)
    assert {p: a[0] for p, a in again.items()} == {
        "a/IMG_20140712_0.jpg": "uploaded", "a/IMG_20140712_1.jpg": "unchanged", "a/IMG_20140712_2.jpg": "unchanged", "b/IMG_20140712_8.jpg": "linked",
    }
    assert again["a/IMG_20140712_0.jpg"][1] == "2014-07-12 (2)"
    files, hashes = run.records()
    assert len(files) == 7 and set(hashes) == {"sa0", "sa1", "sc0", "sc5", "sc6"}
    # A replacement that fails leaves the content before it in its place.
    run.arrive([("/lib/a/IMG_20140712_1.jpg", "new", md5("new"), 2)])
    run.plan()
    run.tell([(3, "/lib/a/IMG_20140712_1.jpg", "failed", None)])
    run.arrive([("/lib/z/IMG_20140712_7.jpg", "sa1", md5("a1"), 1)])
    run.plan()
    assert run.batch(3)["a/IMG_20140712_1.jpg"][0] == "replaced" and run.batch(4)["z/IMG_20140712_7.jpg"][0] == "linked"
    files, hashes = run.records()
    assert files["a/IMG_20140712_1.jpg"] == "sa1" and "new" not in hashes and "sa1" in hashes


def test_a_refused_collect_is_uploaded_next(spark, tmp_path):
    run = Planned(spark, tmp_path)
    run.arrive([("/lib/a/IMG_20140712.jpg", "s", md5("s"), 1)])
    run.plan()
    run.arrive([("/lib/b/IMG_20150101.jpg", "s", md5("s"), 1)])
    run.plan()
    assert run.batch(1)["b/IMG_20150101.jpg"][0] == "collected"
    run.tell([(1, "/lib/b/IMG_20150101.jpg", "collect_refused", None)])
    run.arrive([("/lib/b/IMG_20150101.jpg", "s", md5("s"), 1)])
    run.plan()
    assert run.batch(2)["b/IMG_20150101.jpg"][0] == "uploaded"


def test_batches_look_up_their_own_buckets(spark, tmp_path):
    leaders = jobs._leaders(spark, str(tmp_path / "leaders"))
    leaders.write(0, {"": spark.range(20_000).selectExpr("concat('s', id) sha256", "concat('/p', id) leader")})
    asked = jobs._read(leaders, "", 0, spark.createDataFrame([("s7",), ("s7",), ("new",)], "sha256 string"))
    assert [r["leader"] for r in asked.collect()] == ["/p7"] and len(asked.inputFiles()) <= 2
    # One bucket of 16 holds some 1250 rows.
    assert spark.read.parquet(*asked.inputFiles()).count() < 3000
