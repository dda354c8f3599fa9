"""Column expressions: types, dates, names, keywords, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from shelfmark.functions import dates, keywords, media, paths
from shelfmark.operators import reports

AS_OF = "2026-12-01"

_RAW = "'raw','dng','cr2','cr3','nef','arw','orf','raf','rw2','pef','srw','erf','mrw','3fr','fff','iiq'"
_IMAGE = "'jpg','jpeg','png','heif','heic','gif','bmp','tiff','tif'"
_VIDEO = "'mp4','mov','avi','m4v','mkv'"


@check("media_class", f"""
SELECT path, ext IN ({_RAW},{_IMAGE},{_VIDEO}) AS supported, ext IN ({_RAW}) AS raw,
       ext IN ('tif','tiff','bmp') AS convertible, ext IN ({_RAW},'tif','tiff','bmp') AS renderable,
       ext IN ('jpg','jpeg','heic','heif','png',{_RAW}) AS still, ext IN ('mov','mp4') AS live_video,
       ext IN ('mov','mp4','m4v','3gp') AS dated_video
FROM v_files
""")
def _(t):
    return t.files.select("path", media.media_class(F.col("path")).alias("c")).select("path", "c.*")


@check("plausible_date", """
SELECT path, extract(year FROM cast(day_text AS date)) >= 2015
       AND cast(day_text AS date) <= DATE '2016-06-15' + INTERVAL 1 DAY AS plausible
FROM v_files
""")
def _(t):
    return t.files.select("path", dates.plausible(F.col("day_text").cast("date"), 2015, "2016-06-15").alias("plausible"))


@check("video_refusal", """
SELECT path,
       cast(CASE WHEN unfinished THEN 64 WHEN floor(duration_s) > 20 * 60 THEN 71 WHEN short_side < 237 THEN 72 ELSE 0 END AS bigint) AS code,
       CASE WHEN unfinished THEN 'unfinished recording' WHEN floor(duration_s) > 20 * 60 THEN 'video too long'
            WHEN short_side < 237 THEN 'video too small' ELSE '' END AS reason
FROM v_video_meta
""")
def _(t):
    refusal = media.video_refusal(F.col("path"), F.col("unfinished"), F.col("duration_s"), F.col("short_side"))
    return t.video_meta.select("path", refusal.alias("r")).select(
        "path",
        F.coalesce("r.code", F.lit(0)).cast("bigint").alias("code"),
        F.coalesce("r.reason", F.lit("")).alias("reason"),
    )


@check("outcome_class", """
SELECT path, CASE WHEN status IN (400, 413, 415, 422) THEN 'refused' WHEN status < 200 OR status > 299 THEN 'failed'
                  WHEN code IN (6, 64, 66, 71, 72) THEN 'refused' WHEN code IS NOT NULL THEN 'failed' ELSE 'ok' END AS outcome
FROM v_outcomes
""")
def _(t):
    return t.outcomes.select("path", media.outcome_class(F.col("status"), F.col("code")).alias("outcome"))


@check("is_video_format", """
SELECT image_key, format IN ('MP4','MOV','M4V','AVI','MPG','MPEG','MTS','M2TS','3GP','WMV','MKV','WEBM') AS is_video
FROM v_images
""")
def _(t):
    return t.images.select("image_key", media.is_video_format(F.lower("format")).alias("is_video"))


# Names of every kind a date is found in, made from each file's own day.
_DATED_NAMES = """
SELECT path, day_text, doc_id % 7 AS kind,
       CASE doc_id % 7 WHEN 0 THEN file_name
            WHEN 1 THEN concat('Screenshot_', replace(day_text, '-', '_'), '.png')
            WHEN 2 THEN concat('FB_IMG_', cast(1405171391000 + doc_id * 86400000 AS varchar), '.jpg')
            WHEN 3 THEN concat(day_text, ' 14.23.11.jpg')
            WHEN 4 THEN concat(day_text, '3.jpg')
            WHEN 5 THEN concat('20141399-', cast(1405171391 + doc_id * 86400 AS varchar), '.jpg')
            ELSE concat('19850101_', replace(day_text, '-', '.'), '_', replace(day_text, '-', ''), '.heic') END AS name,
       doc_id, stem_lc
FROM v_files
"""


@check("file_name_date", f"""
SELECT path, name, coalesce(cast(CASE kind
         WHEN 0 THEN CASE WHEN stem_lc LIKE 'img!_%' ESCAPE '!' THEN cast(day_text AS date) END
         WHEN 2 THEN cast(DATE '2014-07-12' + cast(doc_id AS int) AS date)
         WHEN 4 THEN NULL
         WHEN 5 THEN cast(DATE '2014-07-12' + cast(doc_id AS int) AS date)
         ELSE cast(day_text AS date) END AS varchar), 'none') AS name_date
FROM ({_DATED_NAMES}) n
""")
def _(t):
    found = dates.file_name_date(F.col("name"), "2100-01-01")
    return t.sql(_DATED_NAMES).select("path", "name", F.coalesce(found.cast("string"), F.lit("none")).alias("name_date"))


_EXIF = """CASE WHEN regexp_matches({0}, '^[0-9]{{4}}([:][0-9]{{2}}[:]|[-][0-9]{{2}}[-]|[/][0-9]{{2}}[/]|[.][0-9]{{2}}[.])[0-9]{{2}}')
     AND extract(year FROM try_strptime(translate(substr({0}, 1, 10), ':/.', '---'), '%Y-%m-%d')) >= 1900
     AND try_strptime(translate(substr({0}, 1, 10), ':/.', '---'), '%Y-%m-%d') <= DATE '2026-12-02'
     THEN cast(try_strptime(translate(substr({0}, 1, 10), ':/.', '---'), '%Y-%m-%d') AS date) END"""


@check("exif_date", f"""
SELECT path, coalesce(cast({_EXIF.format('exif_original')} AS varchar), 'none') AS original,
       coalesce(cast({_EXIF.format('exif_modified')} AS varchar), 'none') AS modified
FROM v_meta
""")
def _(t):
    def text(column):
        return F.coalesce(dates.exif_date(F.col(column), AS_OF).cast("string"), F.lit("none"))

    return t.meta.select("path", text("exif_original").alias("original"), text("exif_modified").alias("modified"))


@check("day_path", """
SELECT path, strftime(day, '%Y') AS year, strftime(day, '%m') AS month, strftime(day, '%Y-%m-%d') AS album FROM v_dated
""")
def _(t):
    names = dates.day_path(F.col("day"))
    return t.dated.select("path", names[0].alias("year"), names[1].alias("month"), names[2].alias("album"))


_VIDEO_DATE = """coalesce(
  CASE WHEN extract(year FROM cast(substr(apple_date, 1, 10) AS date)) >= 1971 THEN cast(substr(apple_date, 1, 10) AS date) END,
  CASE WHEN mvhd_seconds - 2082844800 >= 31536000
        AND DATE '1970-01-01' + cast(floor((mvhd_seconds - 2082844800) / 86400.0) AS int) <= DATE '2026-12-02'
       THEN cast(DATE '1970-01-01' + cast(floor((mvhd_seconds - 2082844800) / 86400.0) AS int) AS date) END)"""


@check("video_date", f"SELECT path, coalesce(cast({_VIDEO_DATE} AS varchar), 'none') AS video_date FROM v_video_meta")
def _(t):
    found = dates.video_date(F.col("apple_date"), F.col("mvhd_seconds"), AS_OF)
    return t.video_meta.select("path", F.coalesce(found.cast("string"), F.lit("none")).alias("video_date"))


# The same clock shown in a zone west of UTC.
@check("video_date_in_zone", """
SELECT path, coalesce(cast(CASE WHEN apple_date IS NOT NULL THEN cast(substr(apple_date, 1, 10) AS date)
  WHEN mvhd_seconds - 2082844800 >= 31536000 THEN cast((TIMESTAMP '1970-01-01 00:00:00' + to_seconds(mvhd_seconds - 2082844800))
       AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS date) END AS varchar), 'none') AS video_date
FROM v_video_meta
""")
def _(t):
    found = dates.video_date(F.col("apple_date"), F.col("mvhd_seconds"), "2100-01-01", "America/New_York")
    return t.video_meta.select("path", F.coalesce(found.cast("string"), F.lit("none")).alias("video_date"))


@check("capture_date", f"""
WITH d AS (
  SELECT f.path, f.stem_lc, f.day_text, f.mtime_ns, {_EXIF.format('exif_original')} AS original,
         {_EXIF.format('exif_modified')} AS modified, {_VIDEO_DATE} AS video
  FROM v_files f LEFT JOIN v_meta m ON m.path = f.path LEFT JOIN v_video_meta v ON v.path = f.path)
SELECT path, cast(coalesce(original, video, CASE WHEN stem_lc LIKE 'img!_%' ESCAPE '!' THEN cast(day_text AS date) END, modified,
            cast(DATE '1970-01-01' + cast(mtime_ns // 86400000000000 AS int) AS date)) AS varchar) AS day,
       CASE WHEN original IS NOT NULL THEN 'photo metadata' WHEN video IS NOT NULL THEN 'video metadata'
            WHEN stem_lc LIKE 'img!_%' ESCAPE '!' THEN 'file name' WHEN modified IS NOT NULL THEN 'photo''s last-edited date'
            ELSE 'file modified time' END AS date_source
FROM d
""")
def _(t):
    files = t.files.join(t.meta, "path", "left").join(t.video_meta, "path", "left")
    found = dates.capture_date(
        F.col("path"), F.col("mtime_ns"), F.col("exif_original"), F.lit(None).cast("string"),
        F.col("exif_modified"), F.col("apple_date"), F.col("mvhd_seconds"), AS_OF,
    )
    return files.select("path", found.alias("c")).select(
        "path", F.col("c.day").cast("string").alias("day"), F.col("c.date_source").alias("date_source")
    )


_PACIFIC = "AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles'"
_LO_HI = f"""
SELECT id, camera, s, w, (s {_PACIFIC}) = camera AS is_s, (w {_PACIFIC}) = camera AS is_w
FROM (SELECT id, camera, camera + INTERVAL 7 HOUR AS s, camera + INTERVAL 8 HOUR AS w FROM (SELECT event_id AS id, ts AS camera FROM events) e) c
"""


@check("stored_span", f"""
SELECT id, strftime(CASE WHEN is_s OR NOT is_w THEN s ELSE w END, '%Y-%m-%d %H:%M:%S') AS lo,
       strftime(CASE WHEN is_w OR NOT is_s THEN w ELSE s END, '%Y-%m-%d %H:%M:%S') AS hi
FROM ({_LO_HI}) p
""")
def _(t):
    span = dates.stored_span(F.col("ts"))
    pattern = "yyyy-MM-dd HH:mm:ss"
    return t.events.select(
        F.col("event_id").alias("id"), F.date_format(span["lo"], pattern).alias("lo"), F.date_format(span["hi"], pattern).alias("hi")
    )


# Midnight on the day a clock is changed, moved over the hours around it.
@check("stored_span_orders", f"""
SELECT id, strftime(CASE WHEN is_s OR NOT is_w THEN s ELSE w END, '%Y-%m-%d %H:%M:%S') AS lo,
       strftime(CASE WHEN is_w OR NOT is_s THEN w ELSE s END, '%Y-%m-%d %H:%M:%S') AS hi
FROM ({_LO_HI.replace('SELECT event_id AS id, ts AS camera FROM events',
      "SELECT o_orderkey AS id, cast(o_orderdate AS timestamp) + to_minutes(cast(o_orderkey % 300 AS bigint)) AS camera FROM orders")}) p
""")
def _(t):
    camera = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 300).cast("int"))
    span = dates.stored_span(camera)
    pattern = "yyyy-MM-dd HH:mm:ss"
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.date_format(span["lo"], pattern).alias("lo"), F.date_format(span["hi"], pattern).alias("hi")
    )


@check("camera_time", f"""
SELECT image_key, strftime(cast(taken AS timestamp) {_PACIFIC}, '%Y-%m-%d %H:%M:%S') AS camera FROM v_images
""")
def _(t):
    camera = dates.camera_time(F.col("taken").cast("timestamp_ntz"))
    return t.images.select("image_key", F.date_format(camera, "yyyy-MM-dd HH:mm:ss").alias("camera"))


@check("series_names", """
SELECT album_key, name, CASE WHEN image_count <= 1 THEN name ELSE concat(name, ' (', cast(image_count AS varchar), ')') END AS series_name,
       name AS base, cast(CASE WHEN image_count <= 1 THEN 1 ELSE image_count END AS bigint) AS n
FROM v_albums
""")
def _(t):
    named = t.albums.select("album_key", "name", paths.series_name(F.col("name"), F.col("image_count")).alias("series_name"))
    parsed = paths.parse_series_name(F.col("series_name"))
    return named.select("album_key", "name", "series_name", parsed["base"].alias("base"), parsed["n"].cast("bigint").alias("n"))


@check("edit_keywords", """
SELECT image_key, concat_ws('|', CASE WHEN lower(lang) <> 'fr' THEN lang END, source,
         CASE image_seq % 4 WHEN 0 THEN 'Beach' WHEN 1 THEN 'beach' END,
         'New', CASE WHEN image_seq % 4 > 1 THEN 'BEACH' END) AS keywords
FROM (SELECT image_key, upload_seq AS image_seq, trim(split_part(keywords, ';', 1)) AS lang,
             trim(split_part(replace(split_part(keywords, ';', 2), ',', ';'), ';', 1)) AS source FROM v_images) k
""")
def _(t):
    edited = keywords.edit_keywords(F.col("keywords"), [" New ", "BEACH", "", "new"], ["FR "])
    return t.images.select("image_key", F.array_join(edited, "|").alias("keywords"))


@check("name_forms", """
SELECT path, concat(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '.jpg') AS rendered,
       CASE WHEN doc_id % 3 = 0 THEN file_name ELSE concat(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '.png') END AS sized,
       concat(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '~', substr(md5, 1, 8), regexp_extract(file_name, '\\.[^.]*$')) AS tagged,
       concat(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '~', substr(md5, 1, 8), '-7', regexp_extract(file_name, '\\.[^.]*$')) AS numbered,
       file_name AS parsed_base, cast(7 AS bigint) AS parsed_n
FROM v_files
""")
def _(t):
    ext = F.when(F.col("doc_id") % 3 == 0, "").otherwise("png")
    numbered = paths.name_candidate(F.col("file_name"), F.col("md5"), F.lit(7))
    named = t.files.select(
        "path",
        paths.rendered_name(F.col("path")).alias("rendered"),
        paths.sized_name(F.col("file_name"), ext).alias("sized"),
        paths.name_candidate(F.col("file_name"), F.col("md5"), F.lit(1)).alias("tagged"),
        numbered.alias("numbered"),
    )
    form = paths.parse_candidate(F.col("numbered"))
    return named.withColumns({"parsed_base": form["base"], "parsed_n": form["n"].cast("bigint")})


@check("image_keys", """
SELECT image_key, split_part(image_key, '-', 1) AS bare, concat('/api/v2/image/', image_key) AS uri,
       concat('/api/v2/image/', split_part(image_key, '-', 1), '-0') AS uri_of_bare, image_key AS key_of_uri
FROM v_images
""")
def _(t):
    bare = F.substring_index("image_key", "-", 1)
    uri = paths.uri_of_key(F.col("image_key"))
    return t.images.select(
        "image_key", bare.alias("bare"), uri.alias("uri"), paths.uri_of_key(bare).alias("uri_of_bare"),
        paths.key_of_uri(uri).alias("key_of_uri"),
    )


# Page addresses as they are, and with a file name put behind their path.
_URLS = """
SELECT page_id, url, concat(regexp_replace(url, '[?#].*$', ''), CASE page_id % 4 WHEN 0 THEN '/IMG%20' WHEN 1 THEN '/a+b_' WHEN 2 THEN '/noext' ELSE '/p' END,
       cast(page_id AS varchar), CASE page_id % 4 WHEN 2 THEN '' ELSE '.jpg' END, CASE WHEN page_id % 3 = 0 THEN '?w=1' ELSE '' END) AS file_url,
       CASE page_id % 5 WHEN 0 THEN replace(replace(url, 'https://', 'ftp://'), 'http://', 'ftp://') WHEN 1 THEN concat('x', cast(page_id AS varchar)) ELSE url END AS odd_url
FROM pages
"""


@check("url_file_names", f"""
SELECT page_id, true AS fetchable, page_id % 5 > 1 AS odd_fetchable,
       CASE page_id % 4 WHEN 0 THEN concat('IMG ', cast(page_id AS varchar), '.jpg') WHEN 1 THEN concat('a+b_', cast(page_id AS varchar), '.jpg')
            WHEN 2 THEN 'none' ELSE concat('p', cast(page_id AS varchar), '.jpg') END AS file_name
FROM ({_URLS}) u
""")
def _(t):
    name = F.coalesce(paths.url_file_name(F.col("file_url")), F.lit("none"))
    return t.sql(_URLS).select(
        "page_id", paths.fetchable(F.col("url")).alias("fetchable"), paths.fetchable(F.col("odd_url")).alias("odd_fetchable"),
        name.alias("file_name"),
    )


@check("content_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", paths.md5_sha256(F.col("text").cast("binary")).alias("h")).select("doc_id", "h.*")


@check("path_parts", """
SELECT path, concat('lib/', dir) AS parent, concat('lib|', dir, '|', file_name) AS parts,
       regexp_extract(file_name, '^(.*)\\.[^.]*$', 1) AS stem, ext AS extension
FROM v_files
""")
def _(t):
    path = F.col("path")
    return t.files.select(
        "path", paths.parent_path(F.concat(F.lit("/"), path)).alias("parent"),
        F.array_join(paths.path_parts(path), "|").alias("parts"),
        paths.stem(path).alias("stem"), paths.extension(path).alias("extension"),
    )


@check("quarantine_comments", """
SELECT conv_id, turn, CASE WHEN strlen(text) = 0 THEN 'text empty' WHEN strlen(text) > 60000 THEN 'text too long'
       WHEN strlen(name) > 50 THEN 'name too long' WHEN rating > 5 THEN 'rating out of range' ELSE 'none' END AS problem
FROM v_comments
""")
def _(t):
    return reports.quarantine_comments(t.comments).select(
        "conv_id", "turn", F.coalesce("problem", F.lit("none")).alias("problem")
    )
