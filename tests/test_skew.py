"""Hot keys: same rows as without splitting, and bounded."""

import hashlib
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark import skew
from shelfmark.operators import naming, series


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows have one key, a third have none."""
    row = F.col("id")
    key = F.when(row % 3 == 0, "hot").when(row % 3 == 1, F.concat(F.lit("k"), (row % 50).cast("string")))
    return spark.range(6000).select(key.alias("k"), F.sha2(row.cast("string"), 256).alias("p")).cache()


def test_numbering_is_that_of_one_window(spark, skewed):
    plain = skewed.withColumn("m", F.row_number().over(Window.partitionBy("k").orderBy("p")))
    for rows in (40, 500, 10_000):
        numbered = skew.ranked(skewed, ["k"], ["p"], "n", hot_rows=rows)
        assert numbered.count() == 6000
        assert numbered.join(plain, "p").where(F.col("n") != F.col("m")).count() == 0


def test_hot_keys_are_split_evenly(spark, skewed):
    hot = skew.hot_keys(skewed, ["k"], 100)
    found = {r["k"]: r["slices"] for r in hot.collect()}
    assert found["hot"] == 20 and found[None] == 20
    assert skew.hot_keys(skewed, ["k"], 10_000) is None


def test_no_task_gets_a_hot_key_whole(spark, skewed):
    plan = skew.ranked(skewed, ["k"], ["p"], "n", hot_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in plan
    salted = skew.salted_join(skewed, skewed.select("k").distinct(), ["k"], "left", hot_rows=100)
    assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_joins_are_plain_joins(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k4", 3), ("k4", 4), ("x", 5)], "k string, v int")
    salted = skew.salted_join(skewed, right, ["k"], how, hot_rows=100)
    plain = skewed.join(right, "k", how)
    assert salted.count() == plain.count()
    assert salted.exceptAll(plain.select(*salted.columns)).count() == 0


def test_the_number_of_hot_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 8)
    many = spark.range(4000).select((F.col("id") % 40).alias("k"), F.col("id").alias("p"))
    hot = skew.hot_keys(many, ["k"], 10).collect()
    assert len(hot) == 8 and sum(r["slices"] for r in hot) <= 16
    numbered = skew.ranked(many, ["k"], ["p"], "n", hot_rows=10)
    assert numbered.where(F.col("n") != F.floor(F.col("p") / 40) + 1).count() == 0


def test_a_hot_series_is_filled_like_one_file_at_a_time(spark):
    files = [(f"/f{i:04}", "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    albums = [("hot", 1, 3), ("hot", 2, 9), ("hot", 3, 0), ("hot", 5, 1), ("s1", 1, 5), ("s2", 2, 0)]
    count = {}
    for s in {s for _, s in files}:
        found = {n: c for a, n, c in albums if a == s}
        count[s] = []
        while len(count[s]) + 1 in found:
            count[s].append(found[len(count[s]) + 1])
    want = {}
    for path, s in sorted(files):
        n = next((i for i, c in enumerate(count[s]) if c < 5), len(count[s]))
        if n == len(count[s]):
            count[s].append(0)
        count[s][n] += 1
        want[path] = n + 1
    placed = series.assign_slots(
        spark.createDataFrame(files, "path string, series string"),
        spark.createDataFrame(albums, "series string, n int, cnt bigint"), capacity=5, hot_rows=50,
    )
    assert {r["path"]: r["n"] for r in placed.collect()} == want


def test_a_series_ends_after_a_thousand_albums(spark):
    files = spark.range(2005).select(F.format_string("/f%05d", "id").alias("path"), F.lit("s").alias("series"))
    albums = spark.createDataFrame([], "series string, n int, cnt bigint")
    placed = series.assign_slots(files, albums, capacity=2)
    errors = placed.where(F.col("slot_error").isNotNull())
    assert errors.count() == 5 and errors.agg(F.min("path")).first()[0] == "/f02000"
    assert placed.agg(F.max("n")).first()[0] == 1000


def brute_force_names(images):
    """One after another: first of each name first, then the others in order."""
    taken, found = set(), {}
    firsts = {}
    for key, name in images:
        firsts.setdefault(name, key)
    for name, key in firsts.items():
        taken.add(name)
        found[key] = name
    for key, name in images:
        if key in found:
            continue
        candidate, k = name, 1
        while candidate in taken:
            head, dot, ext = candidate.rpartition(".")
            stem, ext = (head, ext) if dot and head else (candidate, "")
            candidate = f"{stem}_{k}.{ext}" if ext else f"{stem}_{k}"
            k += 1
        if len(candidate) <= 255:
            taken.add(candidate)
            found[key] = candidate
        else:
            digest = hashlib.md5(f"{name}|{key}".encode()).hexdigest()
            head, dot, ext = name.rpartition(".")
            stem, dotted = (head, f".{ext}" if ext else "") if dot and head else (name, "")
            found[key] = f"{stem[:40]}_{digest}{dotted[:10]}"
    return found


def test_download_names_are_those_taken_one_by_one(spark):
    names = ["a.jpg", "a_1.jpg", "a_1_2.jpg", "a_1_2_3.jpg", "a", "a.", "a_1", ".x", ".x_1", "b.c.d", "b.c_1.d", "a_2.jpg", "a_1_1.jpg"]
    images = [(i, names[(i * i + i // 7) % len(names)]) for i in range(120)] + [(200 + i, "a.jpg") for i in range(320)]
    frame = spark.createDataFrame(images, "seq int, file_name string")
    for rows in (10_000, 15):
        found = naming.unique_download_names(frame, ["seq"], hot_rows=rows).collect()
        assert {r["seq"]: r["target_name"] for r in found} == brute_force_names(images)
        given = [r["target_name"] for r in found if r["target_name"]]
        assert len(given) == len(set(given)) == len(images)


def brute_force_resolution(files, remote):
    """In rounds: own names in path order, then tagged ones in path order."""
    names = {(s, n): (m, u, None) for s, n, m, u in remote}
    found, later = {}, []
    for path, s, name, md5 in sorted(files):
        if (s, name) not in names:
            names[s, name] = (md5, None, path)
            found[path] = ("own", name)
        else:
            later.append((path, s, name, md5))
    for path, s, name, md5 in later:
        head, dot, ext = name.rpartition(".")
        stem, ext = (head, "." + ext) if dot and head else (name, "")
        tags = [f"{stem}~{md5[:8]}{ext}"] + [f"{stem}~{md5[:8]}-{n}{ext}" for n in range(2, 1000)]
        held = [c for c in [name, *tags] if names.get((s, c), ("",))[0] == md5]
        free = [c for c in tags if (s, c) not in names]
        if held:
            _, uri, holder = names[s, held[0]]
            found[path] = ("present", uri or holder)
        elif free:
            names[s, free[0]] = (md5, None, path)
            found[path] = ("tagged", free[0])
        else:
            found[path] = ("error", None)
    return found


def test_names_are_those_taken_one_by_one(spark):
    md5s = ["aaaa1111aaaa", "bbbb2222cccc", "bbbb2222dddd", "bbbb2222eeee", "ffff"]
    files = [
        (f"/{i:03}", f"s{i % 2}", ["A.JPG", "B.JPG", "noext", ".h", "A~bbbb2222-2.JPG"][i % 5], md5s[(i * 7 + i // 5) % 5])
        for i in range(80)
    ]
    remote = [
        ("s0", "A.JPG", "aaaa1111aaaa", "/1"), ("s0", "A~bbbb2222.JPG", "ffff0000", "/2"),
        ("s0", "A~bbbb2222-3.JPG", "bbbb2222cccc", "/3"), ("s1", "noext", "x", "/4"), ("s1", "noext~ffff", "y", "/5"),
        ("s1", "B~bbbb2222-2.JPG", "bbbb2222eeee", "/6"),
    ]
    frame = spark.createDataFrame(files, "path string, series string, file_name string, md5 string")
    listing = spark.createDataFrame([(*r, "K") for r in remote], "series string, file_name string, md5 string, uri string, album_key string")
    want = brute_force_resolution(files, remote)
    for rows in (10_000, 5):
        named = naming.resolve_names(frame, listing, hot_rows=rows).collect()
        got = {r["path"]: (r["name_action"], r["target_name"] or r["present_uri"] or r["present_path"]) for r in named}
        assert got == want
        targets = [(r["series"], r["target_name"]) for r in named if r["target_name"]]
        assert len(targets) == len(set(targets))


def test_names_run_out(spark):
    remote = [("s", "a.jpg", "m", "/0"), ("s", "a~12345678.jpg", "m", "/1")] + [
        ("s", f"a~12345678-{n}.jpg", "m", f"/{n}") for n in range(2, 999)
    ]
    listing = spark.createDataFrame([(*r, "K") for r in remote], "series string, file_name string, md5 string, uri string, album_key string")
    files = spark.createDataFrame(
        [("/1", "s", "a.jpg", "12345678a"), ("/2", "s", "a.jpg", "12345678b")], "path string, series string, file_name string, md5 string"
    )
    named = {r["path"]: (r["name_action"], r["target_name"]) for r in naming.resolve_names(files, listing).collect()}
    assert named == {"/1": ("tagged", "a~12345678-999.jpg"), "/2": ("error", None)}
