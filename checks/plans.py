"""Whole plans, each against one long SQL statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.columns import AS_OF, _EXIF, _VIDEO_DATE
from checks.registry import check
from shelfmark.operators import change, reports
from shelfmark.plans import dated, flat, transfers
from shelfmark.session import cut

OPTIONS = dated.DatedOptions(as_of=AS_OF, root="/lib", capacity=5)

_RAW = "('raw','dng','cr2','cr3','nef','arw','orf','raf','rw2','pef','srw','erf','mrw','3fr','fff','iiq')"
_RENDERS = f"(ext IN {_RAW} OR ext IN ('tif','tiff','bmp'))"


def inventory(t):
    """Files with what was read from their contents."""
    meta = t.meta.join(t.video_meta, "path", "full_outer")
    return t.files.select("path", "size", "mtime_ns", "sha256", "md5").join(meta, "path", "left")


def images(t):
    return t.images.select(
        "album_key", "file_name", F.col("archived_md5").alias("md5"),
        F.concat(F.lit("/album/"), "album_key", F.lit("/image/"), "image_key").alias("uri"),
    )


# Scan, dates and change detection, shared by the plans below.
_DATED = f"""
listed AS (SELECT f.*, min(CASE WHEN {_RENDERS} THEN path END) OVER s AS first_render, bool_or(ext IN ('jpg','jpeg','heic','heif')) OVER s AS camera
           FROM v_files f WHERE ext <> 'xmp' WINDOW s AS (PARTITION BY dir, stem_lc)),
kept AS (SELECT *, max(CASE WHEN ext IN ('jpg','jpeg','heic','heif','png') OR ext IN {_RAW} THEN path END) OVER (PARTITION BY dir, stem_lc) AS still
         FROM listed WHERE NOT {_RENDERS} OR (NOT camera AND path = first_render)),
read AS (SELECT k.*, {_EXIF.format('exif_original')} AS original, {_EXIF.format('exif_modified')} AS modified, {_VIDEO_DATE} AS video,
                v.unfinished, v.duration_s, v.short_side, CASE WHEN k.ext IN ('mov','mp4') THEN k.still END AS live
         FROM kept k LEFT JOIN v_meta m ON m.path = k.path LEFT JOIN v_video_meta v ON v.path = k.path),
dated AS (SELECT r.*, coalesce(s.capture_date, p.original) AS live_day,
                 coalesce(r.original, r.video, CASE WHEN r.stem_lc LIKE 'img!_%' ESCAPE '!' THEN cast(r.day_text AS date) END, r.modified,
                          cast(DATE '1970-01-01' + cast(r.mtime_ns // 86400000000000 AS int) AS date)) AS own_day,
                 CASE WHEN r.original IS NOT NULL THEN 'photo metadata' WHEN r.video IS NOT NULL THEN 'video metadata'
                      WHEN r.stem_lc LIKE 'img!_%' ESCAPE '!' THEN 'file name' WHEN r.modified IS NOT NULL THEN 'photo''s last-edited date'
                      ELSE 'file modified time' END AS own_source
          FROM read r LEFT JOIN v_state s ON s.path = r.live LEFT JOIN read p ON p.path = r.live),
checked AS (SELECT d.path, d.file_name, d.ext, d.size, d.sha256, d.md5, coalesce(live_day, own_day) AS day,
                   CASE WHEN live_day IS NOT NULL THEN 'Live Photo''s photo' ELSE own_source END AS date_source,
                   s.image_uri AS prev_uri, s.uploaded_md5 AS prev_md5, s.sha256 AS prev_sha, h.uri AS known_uri, h.album_key AS known_key,
                   (s.image_uri IS NOT NULL OR s.failed IS NOT NULL) AS settled, s.failed,
                   coalesce(s.size = d.size AND s.mtime_ns = d.mtime_ns AND (s.image_uri IS NOT NULL OR s.failed IS NOT NULL), false) AS unchanged,
                   CASE WHEN d.ext NOT IN ('mov','mp4') THEN NULL WHEN unfinished THEN 'unfinished recording'
                        WHEN floor(duration_s) > 1200 THEN 'video too long' WHEN short_side < 237 THEN 'video too small' END AS video_problem
            FROM dated d LEFT JOIN v_state s ON s.path = d.path LEFT JOIN v_hashes h ON h.sha256 = d.sha256)
"""

# Every day has one album at most, so each series has one existing album or none.
_PLAN = f"""
WITH {_DATED},
kinds AS (SELECT *, CASE WHEN unchanged THEN 'unchanged' WHEN prev_sha = sha256 AND settled THEN 'touched' WHEN known_uri IS NOT NULL THEN 'known' ELSE 'upload' END AS kind,
                 CASE WHEN {_RENDERS} THEN concat(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '.jpg') ELSE file_name END AS send_name
          FROM checked),
up AS (SELECT *, path = min(path) OVER (PARTITION BY sha256) AS leads FROM kinds WHERE kind = 'upload'),
refs AS (SELECT uri, sum(n) AS n FROM (SELECT image_uri AS uri, count(*) AS n FROM v_state WHERE image_uri IS NOT NULL GROUP BY image_uri
         UNION ALL SELECT known_uri, count(*) FROM kinds WHERE kind = 'known' AND known_uri IS DISTINCT FROM prev_uri GROUP BY known_uri) r GROUP BY uri),
lead AS (SELECT up.*, CASE WHEN video_problem IS NOT NULL THEN 'refused' WHEN prev_uri IS NOT NULL AND n <= 1 THEN 'replaced' ELSE 'name' END AS fate
         FROM up LEFT JOIN refs ON refs.uri = prev_uri WHERE leads),
held AS (SELECT cast(a.name AS date) AS day, i.file_name, arg_max(lower(i.archived_md5), concat('/album/', i.album_key, '/image/', i.image_key)) AS md5,
                max(concat('/album/', i.album_key, '/image/', i.image_key)) AS uri, max(i.album_key) AS album_key
         FROM v_images i JOIN v_albums a ON a.album_key = i.album_key GROUP BY a.name, i.file_name),
asking AS (SELECT l.*, h.md5 AS held_md5, h.uri AS held_uri, h.album_key AS held_key,
                  path = min(path) OVER (PARTITION BY l.day, send_name) AS first_of_name FROM lead l LEFT JOIN held h ON h.day = l.day AND h.file_name = send_name WHERE fate = 'name'),
named AS (SELECT *, CASE WHEN held_uri IS NULL AND first_of_name THEN 'uploaded' WHEN held_md5 = md5 THEN 'linked' ELSE 'uploaded' END AS outcome,
                 CASE WHEN held_uri IS NULL AND first_of_name THEN send_name
                      ELSE concat(regexp_extract(send_name, '^(.*)\\.[^.]*$', 1), '~', substr(md5, 1, 8), regexp_extract(send_name, '\\.[^.]*$')) END AS target FROM asking),
led AS (SELECT path, day, date_source, size, sha256, outcome, CASE WHEN outcome = 'uploaded' THEN target END AS target,
               CASE WHEN outcome = 'linked' THEN held_uri END AS uri, CASE WHEN outcome = 'linked' THEN held_key END AS album_key, NULL AS reason FROM named
        UNION ALL SELECT path, day, date_source, size, sha256, fate, CASE WHEN fate = 'replaced' THEN send_name END, CASE WHEN fate = 'replaced' THEN prev_uri END, NULL, video_problem
        FROM lead WHERE fate <> 'name'),
placings AS (SELECT path, day, date_source, size, sha256, known_uri AS uri, known_key AS album_key, NULL AS leader, CAST(NULL AS date) AS leader_day FROM kinds WHERE kind = 'known'
            UNION ALL SELECT u.path, u.day, u.date_source, u.size, u.sha256, l.uri, l.album_key, l.outcome, l.day FROM up u JOIN led l ON l.sha256 = u.sha256 WHERE NOT u.leads),
placed AS (SELECT p.*, CASE WHEN leader = 'refused' THEN 'failed' WHEN leader IN ('uploaded', 'linked') THEN CASE WHEN p.day = leader_day THEN 'linked' ELSE 'collected' END
                            WHEN a.album_key IS NOT NULL THEN 'linked' ELSE 'collected' END AS outcome
           FROM placings p LEFT JOIN v_albums a ON a.album_key = p.album_key AND cast(a.name AS date) = p.day),
takers AS (SELECT path, day, 0 AS late FROM led WHERE outcome = 'uploaded' UNION ALL SELECT path, day, 1 FROM placed WHERE outcome = 'collected'),
slots AS (SELECT t.path, t.day, CASE WHEN r <= room THEN 1 ELSE existing + cast(ceil((r - room) / 5.0) AS bigint) END AS n, existing
          FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY late, path) AS r FROM takers) t
          JOIN (SELECT s.day, CASE WHEN a.name IS NULL THEN 0 ELSE 1 END AS existing, CASE WHEN a.name IS NULL THEN 0 ELSE greatest(5 - image_count, 0) END AS room
                FROM (SELECT DISTINCT day FROM takers) s LEFT JOIN v_albums a ON cast(a.name AS date) = s.day) e ON e.day = t.day),
albums AS (SELECT path, CASE WHEN n = 1 THEN strftime(day, '%Y-%m-%d') ELSE concat(strftime(day, '%Y-%m-%d'), ' (', cast(n AS varchar), ')') END AS album_name, n > existing AS created FROM slots),
acts AS (
  SELECT path, kind AS action, NULL AS album_name, NULL AS target, prev_uri AS uri, NULL AS reason, size, day, date_source, false AS created, kind = 'unchanged' AND failed IS NOT NULL AS refused_before
  FROM kinds WHERE kind IN ('unchanged', 'touched')
  UNION ALL SELECT l.path, l.outcome, coalesce(s.album_name, b.name), l.target, l.uri, l.reason, l.size, l.day, l.date_source, coalesce(s.created, false), false
  FROM led l LEFT JOIN albums s ON s.path = l.path LEFT JOIN v_albums b ON b.album_key = l.album_key
  UNION ALL SELECT p.path, p.outcome, CASE WHEN p.outcome <> 'failed' THEN coalesce(s.album_name, ls.album_name, b.name) END, NULL, CASE WHEN p.outcome <> 'failed' THEN p.uri END,
         CASE WHEN p.outcome = 'failed' THEN 'an identical file failed to upload' END, p.size, p.day, p.date_source, coalesce(s.created, false), false
  FROM placed p LEFT JOIN albums s ON s.path = p.path
  LEFT JOIN led l ON l.sha256 = p.sha256 AND p.outcome = 'linked' AND p.leader = 'uploaded' LEFT JOIN albums ls ON ls.path = l.path LEFT JOIN v_albums b ON b.album_key = p.album_key)
"""


def _plan(t):
    return dated.plan_dated(inventory(t), t.state, t.hashes, t.albums, images(t), OPTIONS)


@check("plan_dated", _PLAN + """
SELECT path, action, coalesce(album_name, '') AS album_name, coalesce(target, '') AS target_name, coalesce(uri, '') AS image_uri, coalesce(reason, '') AS reason,
       size, strftime(day, '%Y-%m-%d') AS day, date_source, created FROM acts
""")
def _(t):
    def text(name):
        return F.coalesce(name, F.lit("")).alias(name)

    return _plan(t).select(
        "path", "action", text("album_name"), text("target_name"), text("image_uri"), text("reason"),
        "size", F.col("day").cast("string").alias("day"), "date_source", "created",
    )


@check("run_summary", _PLAN + """
SELECT count(*) AS scanned, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (refused_before) AS previously_refused,
       count(*) FILTER (action <> 'unchanged') AS to_process, cast(coalesce(sum(size) FILTER (action <> 'unchanged'), 0) AS bigint) AS bytes_to_process,
       count(*) FILTER (action = 'touched') AS touched, count(*) FILTER (action = 'uploaded') AS uploaded, count(*) FILTER (action = 'replaced') AS replaced,
       count(*) FILTER (action = 'linked') AS linked, count(*) FILTER (action = 'collected') AS collected, count(*) FILTER (action = 'failed') AS failed,
       count(*) FILTER (action = 'refused') AS refused, cast(coalesce(sum(size) FILTER (action IN ('uploaded', 'replaced')), 0) AS bigint) AS bytes_uploaded,
       count(DISTINCT CASE WHEN created THEN album_name END) AS albums_created,
       (SELECT count(*) FROM v_state WHERE image_uri IS NOT NULL AND length(path) % 5 > 1) AS captioned, (SELECT count(*) FROM v_state WHERE image_uri IS NOT NULL AND length(path) % 5 = 0) AS vanished,
       (SELECT count(*) FROM v_state WHERE image_uri IS NOT NULL AND length(path) % 5 = 1) AS caption_failed,
       (SELECT count(*) FROM v_files WHERE ext = 'xmp') AS unsupported, (SELECT count(*) FROM kept WHERE __RENDERS__) AS raw_rendered,
       cast(0 AS bigint) AS raw_skipped, (SELECT count(*) FROM listed) - (SELECT count(*) FROM kept) AS raw_skipped_with_sibling,
       (SELECT count(*) FROM kept WHERE ext IN ('mov','mp4') AND still IS NOT NULL) AS live_photo_videos, cast(0 AS bigint) AS live_photo_videos_skipped
FROM acts
""".replace("__RENDERS__", _RENDERS))
def _(t):
    kind = F.length("path") % 5
    captions = t.state.where("image_uri IS NOT NULL").select(F.when(kind == 0, "gone").when(kind == 1, "failed").otherwise("ok").alias("outcome"))
    return dated.run_report(inventory(t), _plan(t), OPTIONS, captions=captions)


# The state that a plan leads to, planned against once more: nothing is left to do but what failed.
@check("plan_again", _PLAN + """
SELECT path, CASE WHEN action = 'failed' THEN 'retried' ELSE 'unchanged' END AS again FROM acts
""")
def _(t):
    files = inventory(t)
    actions = cut(dated.with_album_keys(_plan(t), t.albums), "first-plan")
    after = change.apply_outcomes(t.state, dated.outcomes_of(actions))
    hashes = change.apply_hash_outcomes(t.hashes.withColumn("original_path", F.lit(None).cast("string")), dated.hash_outcomes_of(actions))
    albums, sent = dated.catalog_changes(actions, t.albums)
    counts = t.albums.select("album_key", "name", "image_count").unionByName(albums)
    counts = counts.groupBy("album_key").agg(F.min("name").alias("name"), F.sum("image_count").alias("image_count"))
    kept = images(t).join(sent.select("uri"), "uri", "left_anti").unionByName(sent)
    again = dated.plan_dated(files, after, hashes, counts, kept, OPTIONS).select("path", F.col("action").alias("_again"))
    told = F.when(F.col("action") == "failed", "retried").otherwise(F.col("_again"))
    return actions.select("path", "action").join(again, "path").select("path", told.alias("again"))


@check("summary_maps", _PLAN + """
SELECT (SELECT string_agg(concat(date_source, '=', cast(n AS varchar)), ';' ORDER BY date_source)
        FROM (SELECT date_source, count(*) AS n FROM acts WHERE action <> 'unchanged' GROUP BY date_source) s) AS date_sources,
       (SELECT string_agg(concat(day, '=', cast(n AS varchar)), ';' ORDER BY day)
        FROM (SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM acts WHERE action <> 'unchanged' GROUP BY day) s) AS days
""")
def _(t):
    def text(name):
        entries = F.array_sort(F.map_entries(name))
        return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias(name)

    return reports.summary_maps(_plan(t)).select(text("date_sources"), text("days"))


@check("scan_summary", f"""
WITH {_DATED}
SELECT (SELECT count(*) FROM v_files WHERE ext = 'xmp') AS unsupported, (SELECT count(*) FROM kept WHERE {_RENDERS}) AS raw_rendered,
       cast(0 AS bigint) AS raw_skipped, (SELECT count(*) FROM listed) - (SELECT count(*) FROM kept) AS raw_skipped_with_sibling,
       (SELECT count(*) FROM kept WHERE ext IN ('mov','mp4') AND still IS NOT NULL) AS live_photo_videos, cast(0 AS bigint) AS live_photo_videos_skipped
""")
def _(t):
    return dated.scan_summary(t.files.select("path", "size"), OPTIONS)


@check("plan_preview", f"WITH {_DATED} SELECT path, strftime(day, '%Y-%m-%d') AS day, date_source FROM checked WHERE NOT unchanged")
def _(t):
    preview = dated.plan_preview(inventory(t), t.state, OPTIONS)
    return preview.select("path", F.col("day").cast("string").alias("day"), "date_source")


@check("preview_day_counts", f"""
WITH {_DATED}
SELECT strftime(day, '%Y') AS year, strftime(day, '%Y-%m-%d') AS day, count(*) AS files FROM checked WHERE NOT unchanged GROUP BY day
UNION ALL SELECT strftime(day, '%Y'), 'all', count(*) FROM checked WHERE NOT unchanged GROUP BY strftime(day, '%Y')
""")
def _(t):
    counts = reports.day_counts(dated.plan_preview(inventory(t), t.state, OPTIONS))
    return counts.select(
        F.col("year").cast("string").alias("year"), F.coalesce(F.col("day").cast("string"), F.lit("all")).alias("day"), "files"
    )


# A target series of two albums, each holding every image of one kind of day.
_FLAT_ALBUMS = """
SELECT 'Holiday' AS series, 1 + ymd % 2 AS n, count(*) AS cnt, concat('A', cast(max(ymd) AS varchar)) AS album_key FROM v_files GROUP BY ymd % 2
"""


@check("plan_flat", f"""
WITH a AS ({_FLAT_ALBUMS}),
i AS (SELECT i.file_name, lower(i.archived_md5) AS md5, concat('/i/', i.image_key) AS uri, a.n, i.album_key FROM v_images i JOIN a ON a.album_key = i.album_key),
held AS (SELECT file_name, md5, uri FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY n DESC, uri DESC) AS r FROM i) x WHERE r = 1),
listed AS (SELECT f.*, {_RENDERS} AS renders, min(CASE WHEN {_RENDERS} THEN path END) OVER s AS first_render, bool_or(ext IN ('jpg','jpeg','heic','heif')) OVER s AS camera
           FROM v_files f WHERE ext <> 'xmp' WINDOW s AS (PARTITION BY dir, stem_lc)),
kept AS (SELECT *, CASE WHEN renders THEN concat(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '.jpg') ELSE file_name END AS send_name
         FROM listed WHERE NOT renders OR (NOT camera AND path = first_render)),
j AS (SELECT k.*, h.uri AS known_uri, ha.album_key IS NOT NULL AS known_here, o.file_name IS NOT NULL AS named, o.md5 AS held_md5, o.uri AS held_uri,
             s.file_name IS NOT NULL AS send_held, NOT k.renders AND k.md5 IN (SELECT md5 FROM i) AS content_held
      FROM kept k LEFT JOIN v_hashes h ON h.sha256 = k.sha256 LEFT JOIN a ha ON ha.album_key = h.album_key
      LEFT JOIN held o ON o.file_name = k.file_name LEFT JOIN held s ON s.file_name = k.send_name),
d AS (SELECT *, CASE WHEN known_uri IS NOT NULL AND NOT known_here AND NOT named THEN 'collected' WHEN known_uri IS NOT NULL OR (renders AND send_held) OR content_held OR (NOT renders AND held_md5 = md5) THEN 'skipped'
                     WHEN NOT renders AND named THEN 'replaced' ELSE 'uploaded' END AS act FROM j),
e AS (SELECT *, CASE WHEN act IN ('uploaded', 'replaced') AND path <> min(path) FILTER (act IN ('uploaded', 'replaced')) OVER (PARTITION BY sha256) THEN 'skipped' ELSE act END AS action FROM d),
room AS (SELECT sum(greatest(10000 - cnt, 0)) AS total, max(n) AS existing, max(CASE WHEN n = 1 THEN greatest(10000 - cnt, 0) END) AS first FROM a),
t AS (SELECT path, row_number() OVER (ORDER BY action DESC = 'x', CASE action WHEN 'collected' THEN 0 ELSE 1 END, path) AS r FROM e WHERE action IN ('collected', 'uploaded'))
SELECT e.path, e.action,
       CASE WHEN t.r IS NULL THEN '' WHEN r <= room.first THEN 'Holiday' WHEN r <= room.total THEN 'Holiday (2)'
            ELSE concat('Holiday (', cast(existing + cast(ceil((r - total) / 10000.0) AS bigint) AS varchar), ')') END AS album_name,
       CASE WHEN e.action IN ('uploaded', 'replaced') THEN send_name ELSE '' END AS target_name,
       CASE e.action WHEN 'collected' THEN known_uri WHEN 'replaced' THEN held_uri ELSE '' END AS image_uri
FROM e LEFT JOIN t ON t.path = e.path, room
""".replace("action DESC = 'x', ", ""))
def _(t):
    listed = t.images.select(
        "album_key", "file_name", F.col("archived_md5").alias("md5"), F.concat(F.lit("/i/"), "image_key").alias("uri")
    )
    options = flat.FlatOptions(series="Holiday", check_remote=True, capacity=10000)
    planned = flat.plan_flat(t.files, t.sql(_FLAT_ALBUMS), listed, t.hashes, options)

    def text(name):
        return F.coalesce(name, F.lit("")).alias(name)

    return planned.select("path", "action", text("album_name"), text("target_name"), text("image_uri"))


# Every directory has a series of its own, of one album with those images of the directory's files that are listed.
_DIR_ALBUMS = "SELECT concat('/lib/', dir) AS series, 1 AS n, count(*) AS cnt, concat('D', dir) AS album_key FROM v_files WHERE doc_id % 3 <> 2 GROUP BY dir"
_DIR_IMAGES = """
SELECT concat('D', f.dir) AS album_key, i.file_name, i.archived_md5 AS md5, concat('/i/', i.image_key) AS uri
FROM v_images i JOIN v_files f ON concat(cast(f.doc_id AS varchar), '-0') = i.image_key
"""
_DIR_HASHES = "SELECT h.sha256, h.uri, concat('D', min(f.dir)) AS album_key FROM v_hashes h JOIN v_files f ON f.sha256 = h.sha256 GROUP BY h.sha256, h.uri"


@check("plan_mirrored", f"""
WITH a AS ({_DIR_ALBUMS}), di AS ({_DIR_IMAGES}), dh AS ({_DIR_HASHES}),
i AS (SELECT a.series, di.file_name, lower(di.md5) AS md5, di.uri FROM di JOIN a ON a.album_key = di.album_key),
held AS (SELECT series, file_name, md5, uri FROM (SELECT *, row_number() OVER (PARTITION BY series, file_name ORDER BY uri DESC) AS r FROM i) x WHERE r = 1),
listed AS (SELECT f.*, concat('/lib/', dir) AS series, {_RENDERS} AS renders, min(CASE WHEN {_RENDERS} THEN path END) OVER s AS first_render, bool_or(ext IN ('jpg','jpeg','heic','heif')) OVER s AS camera
           FROM v_files f WHERE ext <> 'xmp' WINDOW s AS (PARTITION BY dir, stem_lc)),
kept AS (SELECT *, CASE WHEN renders THEN concat(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '.jpg') ELSE file_name END AS send_name
         FROM listed WHERE NOT renders OR (NOT camera AND path = first_render)),
j AS (SELECT k.*, h.uri AS known_uri, coalesce(ha.series = k.series, false) AS known_here, o.file_name IS NOT NULL AS named, o.md5 AS held_md5, o.uri AS held_uri, s.file_name IS NOT NULL AS send_held
      FROM kept k LEFT JOIN dh h ON h.sha256 = k.sha256 LEFT JOIN a ha ON ha.album_key = h.album_key
      LEFT JOIN held o ON o.series = k.series AND o.file_name = k.file_name LEFT JOIN held s ON s.series = k.series AND s.file_name = k.send_name),
d AS (SELECT *, CASE WHEN known_uri IS NOT NULL AND NOT known_here AND NOT named THEN 'collected' WHEN known_uri IS NOT NULL OR (renders AND send_held) OR (NOT renders AND held_md5 = md5) THEN 'skipped'
                     WHEN NOT renders AND named THEN 'replaced' ELSE 'uploaded' END AS act FROM j),
e AS (SELECT *, CASE WHEN act IN ('uploaded', 'replaced') AND path <> min(path) FILTER (act IN ('uploaded', 'replaced')) OVER (PARTITION BY sha256) THEN 'skipped' ELSE act END AS action FROM d),
t AS (SELECT path, series, row_number() OVER (PARTITION BY series ORDER BY CASE action WHEN 'collected' THEN 0 ELSE 1 END, path) AS r FROM e WHERE action IN ('collected', 'uploaded')),
room AS (SELECT t.path, r, CASE WHEN a.series IS NULL THEN 0 ELSE 1 END AS existing, CASE WHEN a.series IS NULL THEN 0 ELSE greatest(60 - cnt, 0) END AS room FROM t LEFT JOIN a ON a.series = t.series),
slot AS (SELECT path, CASE WHEN r <= room THEN 1 ELSE existing + cast(ceil((r - room) / 60.0) AS bigint) END AS n FROM room)
SELECT e.path, e.action, CASE WHEN slot.n IS NULL THEN '' WHEN slot.n = 1 THEN e.series ELSE concat(e.series, ' (', cast(slot.n AS varchar), ')') END AS album_name,
       CASE WHEN e.action IN ('uploaded', 'replaced') THEN send_name ELSE '' END AS target_name,
       CASE e.action WHEN 'collected' THEN known_uri WHEN 'replaced' THEN held_uri ELSE '' END AS image_uri
FROM e LEFT JOIN slot ON slot.path = e.path
""")
def _(t):
    planned = flat.plan_mirrored(t.files, t.sql(_DIR_ALBUMS), t.sql(_DIR_IMAGES), t.sql(_DIR_HASHES), flat.FlatOptions(capacity=60))

    def text(name):
        return F.coalesce(name, F.lit("")).alias(name)

    return planned.select("path", "action", text("album_name"), text("target_name"), text("image_uri"))


_DETAILS = "SELECT image_key, upload_seq % 3 AS has FROM v_images"


def _downloads(t):
    return t.images.select(
        "image_key", "album_key", "file_name", F.lower("format").alias("format"), F.col("upload_seq").alias("seq"),
        F.concat(F.lit("https://x/"), "image_key").alias("archived_uri"),
    )


# The first image of a name keeps it; no name has a counted form of its own here.
_COUNTED = "list_reduce(list_transform(range(1, r), lambda i: concat('_', cast(i AS varchar))), lambda a, b: concat(a, b))"
_CHAINED = f"concat(regexp_extract(name, '^(.*)\\.[^.]*$', 1), {_COUNTED}, regexp_extract(name, '\\.[^.]*$'))"
_NAMED = f"""
SELECT image_key, url, CASE WHEN r = 1 THEN name WHEN r <= 90 AND length({_CHAINED}) <= 255 THEN {_CHAINED}
  ELSE concat(left(regexp_extract(name, '^(.*)\\.[^.]*$', 1), 40), '_', md5(concat_ws('|', name, cast(upload_seq AS varchar), image_key)), left(regexp_extract(name, '\\.[^.]*$'), 10)) END AS target_name
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY upload_seq, image_key) AS r FROM w) x
"""
_ALLOWED = "SELECT i.* FROM v_images i JOIN v_albums a ON a.album_key = i.album_key WHERE coalesce(a.allow_downloads, true)"


@check("plan_downloads", f"""
WITH w AS (SELECT image_key, upload_seq, concat('https://x/', image_key) AS url, file_name AS name FROM ({_ALLOWED}) i) {_NAMED}
""")
def _(t):
    planned = transfers.plan_downloads(_downloads(t), t.albums)
    return planned.select("image_key", "url", F.coalesce("target_name", F.lit("none")).alias("target_name"))


@check("plan_sized_downloads", f"""
WITH w AS (SELECT image_key, upload_seq,
  CASE WHEN format IN ('MOV', 'MP4') THEN concat('https://x/', image_key) WHEN upload_seq % 3 = 0 THEN concat('u/', image_key, '/Large') ELSE concat('u/', image_key, '/Small') END AS url,
  CASE WHEN format IN ('MOV', 'MP4') THEN file_name ELSE concat(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '.jpg') END AS name FROM ({_ALLOWED}) i) {_NAMED}
""")
def _(t):
    def entry(size):
        return F.struct(F.concat(F.lit("u/"), "image_key", F.lit(f"/{size}")).alias("url"), F.lit("jpg").alias("ext"))

    has_large = F.col("upload_seq") % 3 == 0
    details = t.images.select(
        "image_key",
        F.when(has_large, F.array(F.lit("ImageSizeSmall"), F.lit("ImageSizeLarge"))).otherwise(F.array(F.lit("ImageSizeSmall"))).alias("usable"),
        F.lit("ImageSizeSmall").alias("largest"),
        F.create_map(F.lit("ImageSizeSmall"), entry("Small"), F.lit("ImageSizeLarge"), entry("Large")).alias("sizes"),
    )
    planned = transfers.plan_downloads(_downloads(t), t.albums, details, "Large")
    return planned.select("image_key", "url", F.coalesce("target_name", F.lit("none")).alias("target_name"))


@check("plan_url_ingest", """
SELECT page_id AS pos, url, CASE WHEN r <= 3 THEN 'Web' ELSE concat('Web (', cast(1 + cast(ceil((r - 3) / 20.0) AS bigint) AS varchar), ')') END AS album_name
FROM (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS r FROM pages) p
""")
def _(t):
    albums = t.region.agg(F.lit("Web").alias("series"), F.lit(1).alias("n"), F.lit(17).cast("bigint").alias("cnt"))
    planned = transfers.plan_url_ingest(t.pages.select(F.col("page_id").alias("pos"), "url"), albums, "Web", capacity=20)
    return planned.select("pos", "url", "album_name")


@check("plan_url_ingest_with_a_bad_address", """
SELECT page_id AS pos, 'none' AS album_name, CASE WHEN starts_with(url, 'https') THEN 'another address is bad' ELSE 'not an http(s) address' END AS problem FROM pages
""")
def _(t):
    albums = t.region.agg(F.lit("Web").alias("series"), F.lit(1).alias("n"), F.lit(17).cast("bigint").alias("cnt"))
    urls = t.pages.select(F.col("page_id").alias("pos"), F.regexp_replace("url", "^http://", "ftp://").alias("url"))
    planned = transfers.plan_url_ingest(urls, albums, "Web")
    return planned.select("pos", F.coalesce("album_name", F.lit("none")).alias("album_name"), "problem")
