"""Runs from start to end: plan, apply, plan again."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import change, reports
from shelfmark.plans import dated, flat
from shelfmark.plans.dated import DatedOptions, outcomes_of, plan_dated

OPTIONS = DatedOptions(as_of="2026-12-01", root="/lib")
FILES = (
    "path string, size bigint, mtime_ns bigint, sha256 string, md5 string, exif_original string, duration_s double, "
    "short_side int, unfinished boolean, rendered_md5 string, render_error string"
)
DAY = 1_405_152_000_000_000_000


class Library:
    """A library, the state of its runs, and a remote that takes everything."""

    def __init__(self, spark):
        self.spark = spark
        self.files = {}
        self.state = change.complete_state(spark.createDataFrame([], "path string"))
        self.hashes = spark.createDataFrame([], "sha256 string, uri string, album_key string, file_size bigint")
        self.albums, self.images = {}, []

    def write(self, path, content, mtime=DAY, **fields):
        sha, md5 = hashlib.sha256(content).hexdigest(), hashlib.md5(content).hexdigest()
        self.files[path] = dict(path=f"/lib/{path}", size=len(content), mtime_ns=mtime, sha256=sha, md5=md5) | fields

    def tables(self):
        names = [f.split()[0] for f in FILES.split(", ")]
        inventory = self.spark.createDataFrame([tuple(f.get(n) for n in names) for f in self.files.values()], FILES)
        albums = self.spark.createDataFrame([(k, k, c) for k, c in self.albums.items()], "album_key string, name string, image_count bigint")
        images = self.spark.createDataFrame(self.images, "album_key string, file_name string, md5 string, uri string")
        return inventory, self.state, self.hashes, albums, images

    def plan(self, options=OPTIONS):
        actions = plan_dated(*self.tables(), options).collect()
        assert len(actions) == len({a["path"] for a in actions})
        return {a["path"].removeprefix("/lib/"): a for a in actions}

    def run(self, options=OPTIONS):
        """Plan and apply; the actions by path."""
        planned = plan_dated(*self.tables(), options)
        rows = planned.collect()
        for a in rows:
            if a["action"] == "uploaded":
                self.images.append((a["album_name"], a["target_name"], a["uploaded_md5"].upper(), f"planned:{a['sha256']}"))
            if a["action"] in ("uploaded", "collected"):
                self.albums[a["album_name"]] = self.albums.get(a["album_name"], 0) + 1
            if a["action"] == "replaced":
                self.images = [(k, n, a["uploaded_md5"] if u == a["image_uri"] else m, u) for k, n, m, u in self.images]
        actions = self.planned = self.spark.createDataFrame(rows, planned.schema)
        # This remote's albums have their names as keys.
        keyed = actions.withColumn("album_key", F.coalesce("album_key", "album_name"))
        hashes = change.apply_hash_outcomes(self.hashes, dated.hash_outcomes_of(keyed)).collect()
        state = change.apply_outcomes(self.state, outcomes_of(keyed)).collect()
        self.hashes = self.spark.createDataFrame(hashes, self.hashes.schema)
        self.state = self.spark.createDataFrame(state, self.state.schema)
        return {a["path"].removeprefix("/lib/"): a for a in rows}


def actions(found):
    return {p: a["action"] for p, a in found.items()}


def name(day, n=1):
    return f"IMG_{day}_{n:04}.jpg"


@pytest.fixture(scope="module")
def story(spark):
    """Three runs over one library; each scenario has a folder and a day of its own."""
    library = Library(spark)
    write, later = library.write, DAY + 10
    # First run.
    for folder, day in (("plain", 20140101), ("touch", 20140102), ("edit", 20140103), ("shared/a", 20140104), ("shared/b", 20140104), ("reuse/a", 20140105)):
        write(f"{folder}/{name(day)}", folder.split("/")[0].encode())
    for i in range(6):
        write(f"copies/{i}/{name(20140106)}", b"same bytes")
    write(f"copies/other/{name(20150106)}", b"same bytes")
    write(f"cams/1/{name(20140107)}", b"camera one")
    write(f"cams/2/{name(20140107)}", b"camera two")
    write("live/IMG_1.HEIC", b"photo", exif_original="2014:01:08 10:00:00")
    write("live/IMG_1.MOV", b"video", mtime=DAY)
    write("live/VID_2.MOV", b"other", mtime=0)
    write("raw/IMG_0001.CR2", b"raw", exif_original="2024:06:01", rendered_md5="jpeg")
    write("broken/1.dng", b"not raw", render_error="cannot render")
    write("video/VID_20140109_0001.mov", b"1", duration_s=1261.0)
    write("video/VID_20140109_0002.mov", b"2", duration_s=1200.9, short_side=237)
    write("video/VID_20140109_0003.mp4", b"3", unfinished=True, duration_s=9e9)
    write("video/VID_20140109_0004.mov", b"4", short_side=236)
    write("video/copy/VID_20140109_0004.mov", b"4", short_side=236)
    write(f"known/{name(20140110)}", b"known elsewhere")
    write("old_bak/IMG_20140111_0001.jpg", b"left out")
    write("plain/notes.txt", b"no photo")
    for i in range(7):
        write(f"fill/{name(20140112, i)}", b"fill %d" % i)
    library.albums = {"2014-01-12": 2, "2014-01-12 (3)": 0}
    sha = hashlib.sha256(b"known elsewhere").hexdigest()
    library.hashes = spark.createDataFrame([(sha, "/elsewhere/X-0", "ELSEWHERE", 3)], library.hashes.schema)
    options = DatedOptions(as_of="2026-12-01", root="/lib", excludes=("old_bak/",), capacity=4)
    library.options = options
    library.summary = dated.scan_summary(library.tables()[0], options).first()
    library.preview = reports.date_source_counts(dated.plan_preview(library.tables()[0], library.state, options)).collect()
    first = library.run(options)
    library.first_summary = reports.run_summary(library.planned).first()
    # Second run.
    write(f"touch/{name(20140102)}", b"touch", mtime=later)
    write(f"edit/{name(20140103)}", b"edited", mtime=later)
    write(f"shared/a/{name(20140104)}", b"different now", mtime=later)
    write(f"reuse/a/{name(20140105)}", b"reuse edited", mtime=later)
    write(f"reuse/moved/{name(20140105)}", b"reuse")
    write("raw/IMG_0001.CR2", b"raw, other bytes", mtime=later, exif_original="2024:06:01", rendered_md5="jpeg")
    # The photo loses its metadata, but its recorded date counts.
    write("live/IMG_1.HEIC", b"photo", mtime=later)
    write("live/IMG_1.MOV", b"video two", mtime=5)
    second = library.run(options)
    # Third run, nothing changed but one broken file.
    write("broken/1.dng", b"still not", mtime=later, render_error="cannot render")
    third = library.run(options)
    return library, first, second, third


def test_a_run_without_changes_finds_all_unchanged(story):
    library, first, second, third = story
    found = actions(third)
    assert found.pop("broken/1.dng") == "refused"
    # The copy of a refused file was tried again, and refused itself, before.
    assert sorted(actions(second)[p] for p in second if "0004.mov" in p) == ["refused", "unchanged"]
    assert set(found.values()) == {"unchanged"}


def test_counts(story):
    library, first, *_ = story
    summary = library.first_summary
    assert summary["scanned"] == len(first) == sum(
        summary[c] for c in ("unchanged", "touched", "uploaded", "replaced", "linked", "collected", "failed", "refused")
    )
    assert library.summary["unsupported"] == 1 and library.summary["live_photo_videos"] == 1
    assert sum(r["files"] for r in library.preview) == summary["to_process"]
    created = {a["album_name"] for a in first.values() if a["created"]}
    assert summary["albums_created"] == len(created)


def test_touched_then_edited(story):
    library, first, second, _ = story
    assert second[f"touch/{name(20140102)}"]["action"] == "touched"
    edited = second[f"edit/{name(20140103)}"]
    assert edited["action"] == "replaced" and edited["image_uri"].startswith("planned:")
    # The old content is forgotten, the new one known.
    known = {r["sha256"] for r in library.hashes.collect()}
    assert hashlib.sha256(b"edited").hexdigest() in known and hashlib.sha256(b"edit").hexdigest() not in known


def test_copies_are_uploaded_once_and_linked(story):
    found = {p: a for p, a in story[1].items() if p.startswith("copies")}
    assert sorted(actions(found).values()) == ["collected"] + ["linked"] * 5 + ["uploaded"]
    assert found[f"copies/other/{name(20150106)}"]["album_name"] == "2015-01-06"
    assert {a["album_name"] for a in found.values() if a["action"] == "linked"} == {"2014-01-06"}


def test_editing_one_of_two_copies_uploads_it_anew(story):
    edited = story[2][f"shared/a/{name(20140104)}"]
    tag = hashlib.md5(b"different now").hexdigest()[:8]
    assert (edited["action"], edited["target_name"]) == ("uploaded", f"IMG_20140104_0001~{tag}.jpg")
    assert story[2][f"shared/b/{name(20140104)}"]["action"] == "unchanged"


def test_an_image_a_new_copy_will_use_is_not_replaced(story):
    assert story[2][f"reuse/a/{name(20140105)}"]["action"] == "uploaded"
    assert story[2][f"reuse/moved/{name(20140105)}"]["action"] == "linked"


def test_same_name_different_content(story):
    names = {a["target_name"] for p, a in story[1].items() if p.startswith("cams")}
    assert names == {name(20140107), f"IMG_20140107_0001~{hashlib.md5(b'camera two').hexdigest()[:8]}.jpg"}


def test_content_known_elsewhere_is_collected(story):
    found = story[1][f"known/{name(20140110)}"]
    assert (found["action"], found["image_uri"], found["album_name"]) == ("collected", "/elsewhere/X-0", "2014-01-10")


def test_live_videos_go_to_their_photos_day(story):
    _, first, second, _ = story
    assert first["live/IMG_1.MOV"]["date_source"] == "Live Photo's photo" and first["live/IMG_1.MOV"]["day"] == dt.date(2014, 1, 8)
    assert first["live/VID_2.MOV"]["day"] == dt.date(1970, 1, 1)
    assert second["live/IMG_1.MOV"]["day"] == dt.date(2014, 1, 8)


def test_raw_files_are_rendered_once(story):
    first = story[1]["raw/IMG_0001.CR2"]
    assert (first["action"], first["target_name"], first["uploaded_md5"]) == ("uploaded", "IMG_0001.jpg", "jpeg")
    assert story[2]["raw/IMG_0001.CR2"]["action"] == "touched"


def test_unrenderable_files_wait_for_a_change(story):
    first, second, third = (run["broken/1.dng"] for run in story[1:])
    assert (first["action"], first["reason"]) == ("refused", "cannot render")
    assert second["action"] == "unchanged" and second["previously_refused"]
    assert third["action"] == "refused"


def test_videos_that_would_be_refused(story):
    found = {p.removeprefix("video/"): a for p, a in story[1].items() if p.startswith("video")}
    assert found["VID_20140109_0001.mov"]["reason"] == "video too long"
    assert found["VID_20140109_0003.mp4"]["reason"] == "unfinished recording"
    assert found["VID_20140109_0002.mov"]["action"] == "uploaded"
    # The first path is refused, so its copy fails.
    assert sorted(a["action"] for p, a in found.items() if "0004" in p) == ["failed", "refused"]


def test_excluded_paths_are_left_out(story):
    assert not any(p.startswith("old_bak") or p.endswith(".txt") for p in story[1])


def test_days_fill_album_after_album(story):
    library, first, *_ = story
    names = [first[p]["album_name"] for p in sorted(first) if p.startswith("fill")]
    assert names == ["2014-01-12"] * 2 + ["2014-01-12 (2)"] * 4 + ["2014-01-12 (3)"]
    assert max(library.albums.values()) <= 4


def test_without_state_content_is_found_by_name(spark):
    library = Library(spark)
    library.write(name(20140712), b"one")
    library.albums = {"2014-07-12": 1}
    library.images = [("2014-07-12", name(20140712), hashlib.md5(b"one").hexdigest().upper(), "/there")]
    library.hashes = spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(), "/else", "ELSE", 3)], library.hashes.schema)
    found = library.plan(DatedOptions(as_of="2026-12-01", root="/lib", no_cache=True))[name(20140712)]
    assert (found["action"], found["image_uri"], found["album_name"]) == ("linked", "/there", "2014-07-12")


def test_flat_plan(spark):
    files = spark.createDataFrame([
        ("/f/a.jpg", 1, "sa", "ma"), ("/f/b.jpg", 1, "sb", "mb"), ("/f/c.jpg", 1, "sc", "mc"), ("/f/d.jpg", 1, "sd", "md"),
        ("/f/e.CR2", 1, "se", "me"), ("/f/g.CR2", 1, "sg", "mg"), ("/f/.h.jpg", 1, "sh", "mh"), ("/f/i.jpg", 1, "sd", "md"),
        ("/f/j.jpg", 1, "sj", "mj"), ("/f/k.txt", 1, "sk", "mk"), ("/f/l.jpg", 1, "sl", "ml"),
    ], "path string, size bigint, sha256 string, md5 string")
    albums = spark.createDataFrame([("Trip", 1, 9, "T1"), ("Trip", 2, 3, "T2"), ("Else", 1, 0, "E")], "series string, n int, cnt bigint, album_key string")
    images = spark.createDataFrame([
        ("T1", "a.jpg", "MA", "/1"), ("T1", "b.jpg", "zz", "/2"), ("T2", "b.jpg", "xx", "/3"), ("T2", "e.jpg", "yy", "/4"), ("T2", "z.jpg", "MC", "/5"), ("E", "d.jpg", "MD", "/6"),
    ], "album_key string, file_name string, md5 string, uri string")
    hashes = spark.createDataFrame([("sj", "/known", "E"), ("sl", "/here", "T2")], "sha256 string, uri string, album_key string")

    def plan(**settings):
        rows = flat.plan_flat(files, albums, images, hashes, flat.FlatOptions("Trip", capacity=10, **settings)).collect()
        return {r["path"][3:]: (r["action"], r["album_name"], r["target_name"] or r["image_uri"]) for r in rows}

    assert plan(check_remote=True) == {
        "a.jpg": ("skipped", None, None), "b.jpg": ("replaced", None, "b.jpg"), "c.jpg": ("skipped", None, None),
        "d.jpg": ("uploaded", "Trip (2)", "d.jpg"), "e.CR2": ("skipped", None, None), "g.CR2": ("uploaded", "Trip (2)", "g.jpg"),
        ".h.jpg": ("uploaded", "Trip (2)", ".h.jpg"), "i.jpg": ("skipped", None, None), "j.jpg": ("collected", "Trip", "/known"),
        "l.jpg": ("skipped", None, None),
    }
    blank = plan(no_cache=True, raw_handling="skip")
    assert set(blank) == {"a.jpg", "b.jpg", "c.jpg", "d.jpg", ".h.jpg", "i.jpg", "j.jpg", "l.jpg"}
    assert all(blank[p][0] == "uploaded" for p in ("c.jpg", "i.jpg", "j.jpg", "l.jpg"))


def test_same_render_is_a_record_of_its_own(story):
    """Other bytes of a RAW that render to the same image: known by their new hash from then on."""
    library, first, second, third = story
    raw = second["raw/IMG_0001.CR2"]
    sha = hashlib.sha256(b"raw, other bytes").hexdigest()
    assert raw["action"] == "touched" and raw["old_sha256"] == hashlib.sha256(b"raw").hexdigest() or raw["old_sha256"] != sha
    record = library.state.where("path = '/lib/raw/IMG_0001.CR2'").first()
    assert record["sha256"] == sha and record["image_uri"] == raw["image_uri"]
    assert library.hashes.where(F.col("sha256") == sha).first()["uri"] == raw["image_uri"]


def test_captions_of_uploads(spark):
    library = Library(spark)
    library.write("a/IMG_20140712_0001.jpg", b"one")
    planned = plan_dated(*library.tables(), OPTIONS)
    for captioned in (False, True):
        state = change.apply_outcomes(library.state, outcomes_of(planned, captioned))
        assert [r["captioned"] for r in state.collect()] == [captioned]
