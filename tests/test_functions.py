"""Column expressions against known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import dates, keywords, media, paths
from shelfmark.operators import scanning

D = dt.date


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_dates_in_file_names(spark):
    names = {
        "IMG_20140712_142311.jpg": D(2014, 7, 12),
        "PXL_20230101_101010123.jpg": D(2023, 1, 1),
        "IMG-20140712-WA0001.jpg": D(2014, 7, 12),
        "2014-07-12 14.23.11.jpg": D(2014, 7, 12),
        "Screenshot_2019_03_04.png": D(2019, 3, 4),
        "VID_20160101_000000.mp4": D(2016, 1, 1),
        "FB_IMG_1405171391000.jpg": D(2014, 7, 12),
        "DSC01234.JPG": None,
        "IMG_1234.HEIC": None,
        "123456789012.jpg": None,
        "20141399.jpg": None,
        "19850101.jpg": None,
        "2014-07-123.jpg": None,
        "2014-07_12.jpg": None,
        # An invalid date is passed over for a later one.
        "20141399_2015.02.03.jpg": D(2015, 2, 3),
        "20990101_20150203.jpg": D(2015, 2, 3),
    }
    found = column(spark, list(names), lambda c: dates.file_name_date(c, "2026-12-01"))
    assert dict(zip(names, found)) == names


def test_timestamps_in_file_names_are_shown_in_the_zone(spark):
    name = ["FB_IMG_1405130400000.jpg"]  # 02:00 UTC on the 12th
    assert column(spark, name, lambda c: dates.file_name_date(c, "2026-12-01")) == [D(2014, 7, 12)]
    assert column(spark, name, lambda c: dates.file_name_date(c, "2026-12-01", "America/Chicago")) == [D(2014, 7, 11)]


def test_exif_dates(spark):
    texts = {
        "2014:07:12 14:23:11": D(2014, 7, 12), "0000:00:00 00:00:00": None, "    :  :     :  :  ": None,
        "2999:01:01 00:00:00": None, "2026-09-12 16:55:47": D(2026, 9, 12), "2026/09/12 16:55:47": D(2026, 9, 12),
        "2026:09-12 16:55:47": None, "1899:12:31": None, "2014": None,
    }
    found = column(spark, list(texts), lambda c: dates.exif_date(c, "2026-12-01"))
    assert dict(zip(texts, found)) == texts


def test_movie_clocks(spark):
    rows = [
        ("2014-07-12T23:30:00-0500", 3482844800, D(2014, 7, 12)),
        (None, 2082844800 + 365 * 86400 - 1, None),
        (None, 2082844800 + 365 * 86400, D(1971, 1, 1)),
        (None, 0, None), ("1970-01-01", None, None), (None, 1 << 62, None), ("2014-7-1", None, None),
    ]
    frame = spark.createDataFrame([(i, a, s) for i, (a, s, _) in enumerate(rows)], "i int, a string, s bigint")
    found = frame.orderBy("i").select(dates.video_date(F.col("a"), F.col("s"), "2026-12-01")).collect()
    assert [r[0] for r in found] == [r[2] for r in rows]


def test_file_times_before_1970(spark):
    found = column(spark, [-1, 0, 86_399_999_999_999, 86_400_000_000_000], dates.modified_date, "bigint")
    assert found == [D(1969, 12, 31), D(1970, 1, 1), D(1970, 1, 1), D(1970, 1, 2)]


def test_camera_clock_around_daylight_saving(spark):
    spans = {
        "2026-05-01 12:00:00": ("2026-05-01 19:00:00", "2026-05-01 19:00:00"),
        "2026-01-15 12:00:00": ("2026-01-15 20:00:00", "2026-01-15 20:00:00"),
        "2026-11-01 01:30:00": ("2026-11-01 08:30:00", "2026-11-01 09:30:00"),
        "2026-03-08 02:30:00": ("2026-03-08 09:30:00", "2026-03-08 10:30:00"),
    }
    found = column(spark, list(spans), lambda c: dates.stored_span(c.cast("timestamp_ntz")))
    assert [(str(r["lo"]), str(r["hi"])) for r in found] == list(spans.values())
    back = column(spark, ["2026-05-01 19:00:00", "2026-01-15 20:00:00"], lambda c: dates.camera_time(c.cast("timestamp_ntz")))
    assert [str(b) for b in back] == ["2026-05-01 12:00:00", "2026-01-15 12:00:00"]


def test_search_bounds():
    at = dt.datetime
    assert dates.parse_bound("2026-05-01", False) == at(2026, 5, 1)
    assert dates.parse_bound("2026-05-01", True) == at(2026, 5, 1, 23, 59, 59)
    assert dates.parse_bound("2026-05-01T12:30", False) == at(2026, 5, 1, 12, 30)
    assert dates.parse_bound("2026-05-01 12:30", True) == at(2026, 5, 1, 12, 30, 59)
    assert dates.parse_bound(" 2026-05-01 12:30:15 ", True) == at(2026, 5, 1, 12, 30, 15)
    for bad in ("May 1", "2026-13-01"):
        with pytest.raises(ValueError):
            dates.parse_bound(bad, False)


def test_name_candidates(spark):
    rows = [
        ("IMG_0001.JPG", "0123456789", 0, "IMG_0001.JPG"), ("IMG_0001.JPG", "0123456789", 1, "IMG_0001~01234567.JPG"),
        ("IMG_0001.JPG", "0123456789", 2, "IMG_0001~01234567-2.JPG"), ("noext", "0123456789", 1, "noext~01234567"),
        (".hidden", "ab", 1, ".hidden~ab"), ("a.j~g", "ab", 3, "a~ab-3.j~g"), ("a~b.c.d", "cc", 999, "a~b.c~cc-999.d"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, md5 string, n int, want string").orderBy("i")
    built = frame.select("*", paths.name_candidate(F.col("name"), F.col("md5"), F.col("n")).alias("got"))
    found = built.select("*", paths.parse_candidate(F.col("got")).alias("back")).collect()
    for row in found:
        assert row["got"] == row["want"]
        if row["n"]:
            assert tuple(row["back"]) == (row["name"], row["md5"][:8], row["n"])
    odd = column(spark, ["plain.jpg", "a~12345678-1.jpg", "a~12345678-1000.jpg", "~tag.jpg", "a~123456789.jpg"], paths.parse_candidate)
    assert odd == [None] * 5


def test_series_names(spark):
    parsed = column(spark, ["Trip", "Trip (2)", "Trip (1)", "Trip (02)", "Trip (2) (3)", "(5)"], paths.parse_series_name)
    assert [tuple(p) for p in parsed] == [
        ("Trip", 1), ("Trip", 2), ("Trip (1)", 1), ("Trip (02)", 1), ("Trip (2)", 3), ("(5)", 1),
    ]


def test_keywords(spark):
    edited = column(spark, ["Beach; Sun , ,dog"], lambda c: keywords.edit_keywords(c, ["sun", " Cat ", "cat"], [" BEACH "]))
    assert edited == [["Sun", "dog", "Cat"]]
    assert column(spark, [" ; ,"], keywords.split_keywords) == [[]]


def test_urls(spark):
    urls = {
        "https://x.com/photos/IMG_1.jpg?w=1": "IMG_1.jpg", "https://x.com/a%20b.jpg#t": "a b.jpg",
        "https://x.com/a+b.jpg": "a+b.jpg", "https://x.com/photos/": None, "https://x.com/noext": None,
    }
    assert dict(zip(urls, column(spark, list(urls), paths.url_file_name))) == urls
    good = column(spark, ["http://x.com/a", "https://x", "ftp://x.com/a", "file:///a", "x.jpg", ""], paths.fetchable)
    assert good == [True, True, False, False, False, False]


def test_extensions(spark):
    found = column(spark, ["/a/b.JPG", "/a/.hidden", "/a/noext", "/a.b/c", "x.tar.GZ"], paths.extension)
    assert found == ["jpg", "", "", "", "gz"]
    assert column(spark, ["a.3gp"], media.is_dated_video) == [True]
    assert column(spark, ["a.3gp"], media.is_supported) == [False]


def test_outcomes(spark):
    rows = [(400, None, "refused"), (429, None, "failed"), (503, None, "failed"), (200, 64, "refused"), (200, 5, "failed"), (200, None, "ok"), (201, None, "ok")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, c int, want string").orderBy("i")
    assert all(r[0] == r[1] for r in frame.select("want", media.outcome_class(F.col("s"), F.col("c"))).collect())


@pytest.mark.parametrize("pattern, inside, outside", [
    ("/old/", ["old/a.jpg", "old/b/c.jpg"], ["a/old/b.jpg", "old"]),
    ("old/", ["a/old/b.jpg"], ["a/old", "a/older/b.jpg"]),
    ("*.png", ["a.png", "a/b.png", "x.png/b.jpg"], ["apng", "a.jpg"]),
    ("a/*.jpg", ["a/b.jpg"], ["b/a/c.jpg", "a/b/c.jpg"]),
    ("a/**/z.jpg", ["a/z.jpg", "a/b/c/z.jpg"], ["b/a/z.jpg"]),
    ("**/tmp", ["tmp/a", "x/tmp/a", "x/tmp"], ["tmpx"]),
    ("keep/**", ["keep/a", "keep/b/c"], ["keep"]),
    ("IMG_[0-3]?.jpg", ["IMG_01.jpg"], ["IMG_41.jpg", "IMG_0.jpg"]),
    ("IMG_[!0-3].jpg", ["IMG_4.jpg"], ["IMG_1.jpg"]),
    (r"\#a", ["#a"], ["a"]), ("a.b", ["a.b"], ["axb"]), ("a b  ", ["a b"], ["a b  "]),
    ("#recycle/", ["#recycle/x", "a/#recycle/x"], ["recycle/x"]),
])
def test_exclude_patterns(spark, pattern, inside, outside):
    found = column(spark, inside + outside, lambda c: scanning.exclude_condition(c, [pattern]))
    assert found == [True] * len(inside) + [False] * len(outside)
