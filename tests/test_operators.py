"""Operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import change, copies, remote, reports, scanning, search, siblings, tree
from shelfmark.session import cut


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def paths(spark, *names):
    return spark.createDataFrame([(n, 1, 1) for n in names], "path string, size bigint, mtime_ns bigint")


SHOTS = ("a/1.CR2", "a/1.jpg", "a/2.NEF", "a/3.TIF", "a/3.dng", "b/1.cr2", "b/4.HEIC", "b/4.arw", "b/5.png")


@pytest.mark.parametrize("handling, left, counts", [
    ("render", {"a/1.jpg", "a/2.NEF", "a/3.TIF", "b/1.cr2", "b/4.HEIC", "b/5.png"}, (3, 0, 3)),
    ("skip", {"a/1.jpg", "a/3.TIF", "b/4.HEIC", "b/5.png"}, (0, 5, 0)),
    ("upload", set(SHOTS), (0, 0, 0)),
])
def test_raw_siblings(spark, handling, left, counts):
    files = paths(spark, *SHOTS)
    assert {r["path"] for r in siblings.suppress_raw_siblings(files, handling).collect()} == left
    assert tuple(siblings.raw_selection_counts(files, handling).first()) == counts
    # The one-pass form agrees with the two steps.
    once = siblings.select_siblings(files, handling)
    assert rows(once, "path", "raw_outcome") == rows(siblings.raw_selection(files, handling), "path", "raw_outcome")


@pytest.mark.parametrize("handling", ["render", "skip", "upload"])
def test_live_photos(spark, handling):
    files = paths(
        spark, "IMG_1.HEIC", "IMG_1.MOV", "IMG_2.jpg", "img_2.mp4", "VID_3.mov", "other/IMG_1.MOV",
        "x/5.CR2", "x/5.jpg", "x/5.mov", "x/6.nef", "x/6.png", "x/6.mov", "x/7.tif", "x/7.mov", "x/8.dng", "x/8.MP4",
    )
    kept = siblings.suppress_raw_siblings(files, handling)
    paired = siblings.pair_live_photos(kept)
    once = siblings.select_siblings(files, handling).where(F.col("raw_outcome").isin("kept", "rendered"))
    assert rows(once, "path", F.coalesce("live_photo_of", F.lit(""))) == rows(paired, "path", F.coalesce("live_photo_of", F.lit("")))
    found = dict(rows(paired.where("live_photo_of is not null"), "path", "live_photo_of"))
    assert found["IMG_1.MOV"] == "IMG_1.HEIC" and found["img_2.mp4"] == "IMG_2.jpg"
    assert "VID_3.mov" not in found and "other/IMG_1.MOV" not in found and "x/7.mov" not in found
    assert found["x/5.mov"] == "x/5.jpg" and found["x/6.mov"] == "x/6.png"
    assert found.get("x/8.MP4") == (None if handling == "skip" else "x/8.dng")


def test_excluded_hidden_and_system_files(spark):
    files = paths(
        spark, "/r/keep/a.jpg", "/r/old_backup/b.jpg", "/r/keep/deep/old_backup/c.jpg", "/r/keep/._a.jpg", "/r/.hidden/d.jpg",
        "/r/keep/@eaDir/a.jpg/THUMB.jpg", "/r/keep/Thumbs.db", "/r/keep/a.xmp", "/r/@eaDir", "/.r/keep/a.jpg",
    )
    visible = scanning.filter_excludes(scanning.filter_hidden_and_system(files, "/r"), ["/old_backup/"], "/r")
    assert rows(scanning.filter_supported(visible), "path") == [
        ("/.r/keep/a.jpg",), ("/r/keep/a.jpg",), ("/r/keep/deep/old_backup/c.jpg",)
    ]
    assert scanning.count_unsupported(visible).first()["unsupported"] == 3


def test_ignore_files(spark):
    files = paths(
        spark, "/r/a/keep.jpg", "/r/a/skip/x.jpg", "/r/a/skip/deep/y.jpg", "/r/b/skip/z.jpg", "/r/a/n.png", "/r/a/sub/n.png",
        "/r/a/sub/m.png", "/r/c/only.gif", "/r/c/d/only.gif", "/r/e/in/a.jpg", "/r/e/out.jpg",
    )
    lines = spark.createDataFrame([
        ("/r/a", 1, "skip/"), ("/r/a", 2, "*.png"), ("/r/a/sub", 1, "!n.png"), ("/r/a/skip", 1, "!*"),
        ("/r/c", 1, "/only.gif"), ("/r", 1, "in"), ("/r", 2, "# *"), ("/r", 3, ""), ("/r/e", 1, "out.jpg"), ("/r/e", 2, "!out.jpg"),
    ], "dir string, seq int, line string")
    kept = scanning.filter_ignore_files(files, scanning.compile_ignore_rules(lines))
    assert [p for p, in rows(kept, "path")] == ["/r/a/keep.jpg", "/r/a/sub/n.png", "/r/b/skip/z.jpg", "/r/c/d/only.gif", "/r/e/out.jpg"]


def test_rules_are_kept_once(spark):
    """A deep tree below one directory with rules, and rules at two depths of another."""
    deep = ["/r/" + "/".join(f"d{k}" for k in range(n)) for n in range(1, 60)]
    files = paths(spark, *[f"{d}/{n}" for d in deep for n in ("a.jpg", "b.png")], "/q/x.jpg", "/q/s/t/x.jpg")
    rules = scanning.compile_ignore_rules(spark.createDataFrame(
        [("/r", 1, "*.png"), ("/r/d0/d1", 1, "!b.png"), ("/r/d0/d1/d2", 1, "b.*"), ("/q/s", 1, "x.jpg"), ("/none", 1, "*")],
        "dir string, seq int, line string",
    ))
    kept = {p for p, in rows(scanning.filter_ignore_files(files, rules), "path")}
    assert kept == {f"{d}/a.jpg" for d in deep} | {"/r/d0/d1/b.png", "/q/x.jpg"}
    directories = spark.createDataFrame([(d,) for d in [*deep, "/q/s/t", "/q"]], "_dir string")
    pointers, chains = scanning.rule_nodes(directories, rules)
    assert dict(rows(pointers, "_dir", "node")) == {
        d: "/r" if d == "/r/d0" else "/r/d0/d1" if d == "/r/d0/d1" else "/r/d0/d1/d2" for d in deep
    } | {"/q/s/t": "/q/s"}
    assert {r["node"]: [c["dir"] for c in r["chain"]] for r in chains.collect()} == {
        "/r": ["/r"], "/r/d0/d1": ["/r", "/r/d0/d1"], "/r/d0/d1/d2": ["/r", "/r/d0/d1", "/r/d0/d1/d2"], "/q/s": ["/q/s"], "/none": ["/none"]
    }


def state_of(spark, *records):
    return change.complete_state(spark.createDataFrame(
        records, "path string, size bigint, mtime_ns bigint, sha256 string, image_uri string, failed string, captioned boolean"
    ))


def test_unsettled_records_are_not_unchanged(spark):
    files = spark.createDataFrame([(p, 1, 1, "s") for p in "abcde"], "path string, size bigint, mtime_ns bigint, sha256 string")
    state = state_of(
        spark, ("a", 1, 1, "s", "/i", None, True), ("b", 1, 1, "s", None, None, False), ("c", 1, 1, "s", None, "big", False),
        ("d", 1, 2, "s", None, "big", False),
    )
    found = rows(change.detect_touched(files, state), "path", "status", "previously_refused")
    assert found == [
        ("a", "unchanged", False), ("b", "changed", False), ("c", "unchanged", True), ("d", "touched", False), ("e", "new", False)
    ]
    blank = change.detect_unchanged(files, state, no_cache=True)
    assert blank.where("status = 'unchanged'").count() == 0


def test_captions_list_every_copy_in_parts(spark):
    files = spark.createDataFrame([(f"p{i}", 1, 1) for i in range(9)], "path string, size bigint, mtime_ns bigint")
    state = state_of(
        spark, *[(f"p{i}", 1, 1, "s", "/x", None, i != 3) for i in range(5)], ("p5", 1, 1, "s", "/y", None, True),
        ("p6", 1, 2, "s", "/z", None, False), ("p7", 1, 1, "s", None, "no", False),
    )
    assert rows(change.caption_jobs(files, state), "image_uri", "part", "caption") == [("/x", 0, "p0\np1\np2\np3\np4")]
    parts = rows(change.caption_jobs(files, state, chunk=2), "image_uri", "part", "caption")
    assert parts == [("/x", 0, "p0\np1"), ("/x", 1, "p2\np3"), ("/x", 2, "p4")]


def test_a_copy_of_a_refused_file_fails(spark):
    files = spark.createDataFrame([("a", "s", 1), ("b", "s", 1), ("c", "s", 2), ("d", "t", 1), ("e", "t", 1)], "path string, sha256 string, day int")
    outcomes = spark.createDataFrame([("a", "ok", 1), ("d", "refused", 1)], "path string, outcome string, day int")
    followed = copies.follow_leaders(copies.elect_copies(files), outcomes)
    assert rows(followed, "path", "copy_action") == [
        ("a", "leader"), ("b", "linked"), ("c", "collected"), ("d", "leader"), ("e", "failed")
    ]


def test_remote_names_match_ignoring_digest_case(spark):
    files = spark.createDataFrame([("1", "a", "aa"), ("2", "b", "bb"), ("3", "c", "cc"), ("4", "d", "dd")], "path string, file_name string, md5 string")
    listing = spark.createDataFrame([("a", "AA", "/a"), ("b", "xx", "/b"), ("d", None, "/d")], "file_name string, md5 string, uri string")
    assert rows(remote.match_remote_name(files, listing), "path", "name_match") == [
        ("1", "skip"), ("2", "replace"), ("3", "none"), ("4", "replace")
    ]
    assert rows(remote.match_remote_content(files, listing), "path") == [("1",)]


def nodes(spark):
    return spark.createDataFrame([
        ("r", None, "", "Folder", 0, "Name"), ("b", "r", "Backup", "Folder", 0, "Name"), ("y", "b", "2014", "Folder", 0, "DateAdded"),
        ("t1", "b", "Twin", "Folder", 1, "Name"), ("t2", "b", "Twin", "Album", 2, "Position"), ("t3", "b", "2", "Folder", 3, "Name"),
        ("al", "y", "Day", "Album", 0, "Date Taken"), ("pg", "y", "Day", "Page", 1, ""), ("tx", "t1", "In", "Album", 0, "Position"),
        ("lost", "nowhere", "Lost", "Album", 0, "Position"), ("c1", "c2", "Loop", "Folder", 0, "Name"), ("c2", "c1", "Loop", "Folder", 0, "Name"),
    ], "uri string, parent_uri string, name string, node_type string, pos int, sort_method string")


def test_paths_are_found_or_say_where_they_fail(spark):
    closure = tree.node_closure(nodes(spark))
    assert closure.count() == 9
    asked = {
        "/Backup//2014/": ("ok", "Backup/2014", "y"), "Backup/2014/Day": ("ok", "Backup/2014/Day", "al"),
        "Backup/Twin": ("ambiguous", "Backup/Twin", None), "Backup/Twin/In": ("ok", "Backup/Twin/In", "tx"),
        "Backup/2014/Day/x": ("missing", "Backup/2014/Day", None), "backup": ("missing", "backup", None), "//": ("empty", "", None),
        "Lost": ("missing", "Lost", None),
    }
    requests = spark.createDataFrame([(i, p) for i, p in enumerate(asked)], "request_id int, path string")
    found = tree.resolve_paths(closure, requests).orderBy("request_id").collect()
    assert {r["path"]: (r["status"], r["at"], r["node"] and r["node"]["uri"]) for r in found} == asked


def test_moves(spark):
    closure = tree.node_closure(nodes(spark))
    asked = {
        ("Backup/2014", "Backup/2014/x", "either"): "into itself", ("Backup/2014", "Backup/2014", "folder"): "into itself",
        ("Backup/2014", "Backup/2", "folder"): "ok", ("Backup/2", "", "either"): "ok", ("Backup", "/", "either"): "into itself",
        ("Backup/2014/Day", "Backup/2014", "album"): "already there", ("Backup/2014/Day", "Backup", "folder"): "wrong kind",
        ("Backup/2014", "gone", "either"): "destination missing", ("Backup/2014", "Backup/Twin", "either"): "destination ambiguous",
        ("Backup/2", "Backup/2014/Day", "either"): "destination wrong kind", ("gone", "gone", "either"): "missing",
    }
    asked[("Backup", "/", "either")] = "already there"
    requests = spark.createDataFrame([(i, *k) for i, k in enumerate(asked)], "request_id int, path string, destination string, kind string")
    found = tree.validate_moves(closure, requests).collect()
    assert {(r["path"], r["destination"], r["kind"]): r["verdict"] for r in found} == asked


def test_sort_drift_of_one_node(spark):
    closure = tree.node_closure(nodes(spark))

    def drift(path, **settings):
        return rows(tree.sort_drift(closure, path, **settings), "path", "status")

    assert drift("Backup", folders_by="name") == [("Backup", "already")]
    assert drift("Backup", folders_by="name", direction="desc") == [("Backup", "changed")]
    assert drift("Backup", albums_by="taken") == [("Backup", "needs a folder setting")]
    assert drift("Backup", albums_by="taken", recursive=True) == [
        ("Backup/2014/Day", "already"), ("Backup/Twin", "changed"), ("Backup/Twin/In", "changed")
    ]
    assert drift("Backup/2014/Day", folders_by="name") == [("Backup/2014/Day", "needs an album setting")]
    assert drift("Backup/Twin", folders_by="name") == [("Backup/Twin", "ambiguous")]
    assert drift("Nope/x", folders_by="name") == [("Nope", "missing")]
    with pytest.raises(ValueError):
        tree.sort_drift(closure, "Backup")


def test_structure_of_a_root_with_files(spark):
    files = paths(spark, "/x/lib/a.jpg", "/x/lib/d/b.jpg", "/x/lib/d/e/c.jpg", "/x/lib/f/g/h.jpg")
    assert rows(tree.plan_structure(files, "/x/lib/"), "path", "kind", "name", "both") == [
        ("", "Album", "lib", False), ("d", "Album", "d", True), ("d", "Folder", "d", True), ("d/e", "Album", "e", False),
        ("f", "Folder", "f", False), ("f/g", "Album", "g", False),
    ]


def test_search_needs_something_to_look_for(spark):
    images = spark.createDataFrame([], "image_key string, title string, caption string, keywords string, file_name string, taken timestamp_ntz")
    with pytest.raises(ValueError):
        search.search_images(images)
    with pytest.raises(ValueError):
        search.search_images(images, taken_from="2020-01-02", taken_to="2020-01-01")
    assert search.search_images(images, taken_from="2020-01-01", taken_to="2020-01-01").count() == 0


def test_comment_limits_are_bytes(spark):
    comments = spark.createDataFrame([
        (1, "ok", "n", None, 5), (2, "é" * 30001, "n", None, 5), (3, "é" * 30000, "n" * 50, None, None),
        (4, "x", "é" * 26, None, 9), (5, "x", None, "e" * 51, 9), (6, "x", None, None, 6), (7, "", "n" * 99, None, 0),
    ], "id int, text string, name string, email string, rating int")
    found = rows(reports.quarantine_comments(comments), "id", F.coalesce("problem", F.lit("")))
    assert [p for _, p in found] == ["", "text too long", "", "name too long", "email too long", "rating out of range", "text empty"]


def test_empty_stores_have_statistics(spark):
    empty = spark.createDataFrame([], "file_size bigint, uploaded_at timestamp")
    assert tuple(reports.state_stats(empty).first()) == (0, 0, None, None)
    assert rows(reports.busiest_days(spark.createDataFrame([], "day date")), "day") == []


def test_images_of_albums_that_are_not_listed_show_keys(spark):
    images = spark.createDataFrame([("i1", "A", "a.jpg"), ("i2", "A", ""), ("i3", "Z", None), ("i4", None, "d.jpg")], "image_key string, album_key string, file_name string")
    albums = spark.createDataFrame([("A", "Album"), ("B", "Other")], "album_key string, name string")
    rows = {r["image_key"]: (r["album_name"], r["shown_name"]) for r in remote.images_with_album_name(images, albums).collect()}
    assert rows == {"i1": ("Album", "a.jpg"), "i2": ("Album", "i2"), "i3": ("Z", "i3"), "i4": (None, "d.jpg")}


def test_collects_leave_out_names_and_albums_of_the_target(spark):
    files = spark.createDataFrame([("p1", "a", "s1"), ("p2", "b", "s1"), ("p3", "b", "s2"), ("p4", "b", "unknown")], "path string, file_name string, sha256 string")
    albums = spark.createDataFrame([("T",)], "album_key string")
    names = spark.createDataFrame([("a",), ("a",), ("other",)], "file_name string")
    hashes = spark.createDataFrame([("s1", "/u1", "E"), ("s2", "/u2", "T"), ("s3", "/u3", "E")], "sha256 string, uri string, album_key string")
    planned = {r["path"]: (r["collect_uri"], r["cached"]) for r in remote.plan_collects(files, albums, names, hashes).collect()}
    assert planned == {"p1": (None, True), "p2": ("/u1", True), "p3": (None, True), "p4": (None, None)}


def test_ways_of_a_deep_tree_are_written_in_pieces(spark, tmp_path, monkeypatch):
    """A chain of 400 folders, a loop and what hangs on both; written whole, their ways would
    take more than 400,000 names in all rounds."""
    deep = 400
    chain = [(f"f{k}", f"f{k - 1}" if k else None, f"n{k}" if k else "", "Folder", k, "Name") for k in range(deep)]
    hung = [(f"a{k}", f"f{k}", f"album {k}", "Album", 7, "Position") for k in range(deep)]
    loop = [(f"l{k}", f"l{(k + 1) % 300}", "loop", "Folder", 0, "Name") for k in range(300)]
    lost = [("al", "l3", "on a loop", "Album", 0, "Name"), ("aa", "a3", "in an album", "Album", 0, "Name"), ("an", "none", "nowhere", "Album", 0, "Name")]
    # A folder that stands twice gives each way below it twice.
    twice = [("f398", "f397", "again", "Folder", 1, "Name")]
    table = spark.createDataFrame(chain + hung + loop + lost + twice, nodes(spark).schema)
    written = []
    monkeypatch.setattr(tree, "cut", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(tree, "_APART", 16, raising=False)
    closure = tree.node_closure(table)
    assert sum(w.agg(F.sum(F.size("chain"))).first()[0] or 0 for w in written) < 200_000
    found = {}
    for r in closure.collect():
        found.setdefault(r["uri"], []).append(r)
    assert set(found) == {x[0] for x in chain + hung}
    for k in range(deep):
        for uri, own, pos, ways in ((f"f{k}", [], k, found[f"f{k}"]), (f"a{k}", [f"a{k}"], 7, found[f"a{k}"])):
            assert len(ways) == (2 if k >= 398 else 1)
            for r in ways:
                uris = [f"f{i}" for i in range(k + 1)] + own
                assert r["chain"] == uris and r["depth"] == len(uris) - 1 and [p["uri"] for p in r["places"]] == uris
                assert r["places"][-1]["pos"] == pos or "again" in r["parts"]
                assert r["path"] == "/".join(r["parts"]) and len(r["parts"]) == len(uris) - 1
    assert sorted(r["parts"][397] for r in found["a399"]) == ["again", "n398"]
