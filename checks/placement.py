"""Series, slots, names, batches and matching against the remote catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from shelfmark.functions.paths import rendered_name
from shelfmark.operators import naming, remote, series

_ALBUMS = "SELECT base AS series, n, cnt FROM v_orders_albums"
_PREFIX = """
SELECT base AS series, n, cnt FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY n) AS place FROM v_orders_albums) a WHERE place = n
"""


def _albums(t):
    return t.sql(_ALBUMS).withColumn("cnt", F.col("cnt").cast("bigint"))


def _files(t):
    return t.orders_files.select("path", F.col("day").cast("string").alias("series"))


@check("series_prefix", f"SELECT series, cast(n AS bigint) AS n, cast(cnt AS bigint) AS cnt FROM ({_PREFIX}) p")
def _(t):
    return series.series_prefix(_albums(t)).select("series", F.col("n").cast("bigint").alias("n"), "cnt")


# In every series at most one album counts, as number 2 never exists.
_SLOTS = f"""
SELECT f.path, f.series, cast(CASE WHEN r <= room THEN 1 ELSE existing + cast(ceil((r - room) / 5.0) AS bigint) END AS bigint) AS n, existing
FROM (SELECT path, cast(day AS varchar) AS series, row_number() OVER (PARTITION BY day ORDER BY path) AS r FROM v_orders_files) f
JOIN (SELECT s.series, coalesce(p.n, 0) AS existing, coalesce(greatest(5 - p.cnt, 0), 0) AS room
      FROM (SELECT DISTINCT cast(day AS varchar) AS series FROM v_orders_files) s LEFT JOIN ({_PREFIX}) p ON p.series = s.series) e
  ON e.series = f.series
"""


@check("assign_slots", f"""
SELECT path, n, CASE WHEN n = 1 THEN series ELSE concat(series, ' (', cast(n AS varchar), ')') END AS album_name, n > existing AS created
FROM ({_SLOTS}) s
""")
def _(t):
    placed = series.assign_slots(_files(t), _albums(t), capacity=5)
    return placed.select("path", F.col("n").cast("bigint").alias("n"), "album_name", "created")


# Albums of every length of series, against filling them one file at a time.
_LONG_ALBUMS = """
SELECT cast(day AS varchar) AS series, m AS n, id % 6 AS cnt
FROM (SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY id) AS m FROM v_orders_files) x WHERE m <= 3
"""


@check("assign_slots_long_series", f"""
WITH a AS (SELECT series, n, greatest(5 - cnt, 0) AS free FROM ({_LONG_ALBUMS}) x),
e AS (SELECT series, n, sum(free) OVER (PARTITION BY series ORDER BY n) AS upto, sum(free) OVER (PARTITION BY series ORDER BY n) - free AS downto FROM a),
s AS (SELECT series, max(n) AS existing, max(upto) AS room FROM e GROUP BY series),
f AS (SELECT path, cast(day AS varchar) AS series, row_number() OVER (PARTITION BY day ORDER BY path) AS r FROM v_orders_files)
SELECT f.path, cast(coalesce(e.n, s.existing + cast(ceil((f.r - s.room) / 5.0) AS bigint)) AS bigint) AS n
FROM f JOIN s ON s.series = f.series LEFT JOIN e ON e.series = f.series AND f.r > e.downto AND f.r <= e.upto
""")
def _(t):
    placed = series.assign_slots(_files(t), t.sql(_LONG_ALBUMS), capacity=5, hot_rows=3)
    return placed.select("path", F.col("n").cast("bigint").alias("n"))


@check("series_usage", f"""
WITH u AS (SELECT series, n, max(existing) AS existing, count(*) AS claimed FROM ({_SLOTS}) s GROUP BY series, n)
SELECT u.series, u.n, u.claimed, u.n > u.existing AS created, cast(u.claimed + coalesce(p.cnt, 0) AS bigint) AS count
FROM u LEFT JOIN ({_PREFIX}) p ON p.series = u.series AND p.n = u.n
""")
def _(t):
    placed = series.assign_slots(_files(t), _albums(t), capacity=5)
    return series.series_usage(placed, _albums(t)).select(
        "series", F.col("n").cast("bigint").alias("n"), "claimed", "created", "count"
    )


# Images of a series spread over five albums, many sharing a name.
_SERIES_IMAGES = """
SELECT format AS series, 1 + upload_seq % 5 AS n, concat('IMG_', cast(upload_seq % 37 AS varchar)) AS file_name, image_key, lower(archived_md5) AS md5 FROM v_images
"""


@check("latest_by_name", f"""
SELECT series, file_name, image_key, md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY series, file_name ORDER BY n DESC, image_key DESC) AS r FROM ({_SERIES_IMAGES}) i) x WHERE r = 1
""")
def _(t):
    return naming.latest_by_name(t.sql(_SERIES_IMAGES)).select("series", "file_name", "image_key", "md5")


@check("union_catalogs", f"""
SELECT series, file_name, image_key FROM (
  SELECT *, row_number() OVER (PARTITION BY series, file_name ORDER BY n DESC, image_key DESC) AS r
  FROM (SELECT * FROM ({_SERIES_IMAGES}) i UNION ALL SELECT series, n + 1, file_name, concat('x', image_key), md5 FROM ({_SERIES_IMAGES}) j) u) x WHERE r = 1
""")
def _(t):
    images = t.sql(_SERIES_IMAGES)
    moved = images.withColumns({"n": F.col("n") + 1, "image_key": F.concat(F.lit("x"), "image_key")})
    return remote.union_catalogs([images, moved]).select("series", "file_name", "image_key")


# Rivals for few names on each day; the remote holds plain and tagged ones.
_NAME_FILES = """
SELECT day_text AS series, path, concat('IMG_', cast(doc_id % 3 AS varchar), '.jpg') AS file_name, md5 FROM v_files
"""
_NAME_REMOTE = """
SELECT series, file_name, min(md5) AS md5, concat('/r/', series, '/', file_name) AS uri, concat('A', series) AS album_key
FROM (SELECT day_text AS series, CASE doc_id % 5 WHEN 0 THEN concat('IMG_', cast(doc_id % 3 AS varchar), '.jpg')
             WHEN 1 THEN concat('IMG_', cast(doc_id % 3 AS varchar), '~', substr(md5, 1, 8), '.jpg')
             WHEN 2 THEN concat('IMG_', cast(doc_id % 3 AS varchar), '~', substr(md5, 1, 8), '-2.jpg') ELSE 'OTHER.jpg' END AS file_name,
             CASE WHEN doc_id % 2 = 0 THEN md5 ELSE md5(path) END AS md5 FROM v_files) x GROUP BY series, file_name
"""


@check("resolve_names", f"""
WITH f AS ({_NAME_FILES}), r AS ({_NAME_REMOTE}),
first AS (SELECT series, file_name, min(path) AS path FROM f GROUP BY series, file_name),
held AS (SELECT coalesce(a.series, r.series) AS series, coalesce(a.file_name, r.file_name) AS file_name,
                CASE WHEN r.series IS NULL THEN x.md5 ELSE r.md5 END AS md5, r.uri, CASE WHEN r.series IS NULL THEN a.path END AS holder
         FROM first a JOIN f x ON x.path = a.path FULL OUTER JOIN r ON r.series = a.series AND r.file_name = a.file_name),
own AS (SELECT f.*, h.holder, h.uri, CASE WHEN h.holder = f.path THEN 'own' WHEN h.md5 = f.md5 THEN 'present' ELSE 'taken' END AS own
        FROM f JOIN held h ON h.series = f.series AND h.file_name = f.file_name),
lead AS (SELECT series, file_name, md5, min(path) AS lead, concat(substr(file_name, 1, length(file_name) - 4), '~', substr(md5, 1, 8)) AS t
         FROM own WHERE own = 'taken' GROUP BY series, file_name, md5),
tag AS (SELECT l.*, a.md5 AS m1, a.uri AS u1, b.md5 AS m2, b.uri AS u2 FROM lead l
        LEFT JOIN held a ON a.series = l.series AND a.file_name = concat(l.t, '.jpg')
        LEFT JOIN held b ON b.series = l.series AND b.file_name = concat(l.t, '-2.jpg'))
SELECT o.path,
       CASE WHEN o.own <> 'taken' THEN o.own WHEN g.m1 = o.md5 OR g.m2 = o.md5 THEN 'present' WHEN o.path = g.lead THEN 'tagged' ELSE 'present' END AS name_action,
       CASE WHEN o.own = 'own' THEN o.file_name WHEN o.own = 'present' OR coalesce(g.m1 = o.md5, false) OR coalesce(g.m2 = o.md5, false) OR o.path <> g.lead THEN ''
            WHEN g.m1 IS NULL THEN concat(g.t, '.jpg') WHEN g.m2 IS NULL THEN concat(g.t, '-2.jpg') ELSE concat(g.t, '-3.jpg') END AS target_name,
       CASE WHEN o.own = 'present' THEN coalesce(o.uri, o.holder) WHEN o.own = 'own' THEN ''
            WHEN g.m1 = o.md5 THEN g.u1 WHEN g.m2 = o.md5 THEN g.u2 WHEN o.path <> g.lead THEN g.lead ELSE '' END AS image_of
FROM own o LEFT JOIN tag g ON g.series = o.series AND g.file_name = o.file_name AND g.md5 = o.md5 AND o.own = 'taken'
""")
def _(t):
    named = naming.resolve_names(t.sql(_NAME_FILES), t.sql(_NAME_REMOTE))
    return named.select(
        "path", "name_action", F.coalesce("target_name", F.lit("")).alias("target_name"),
        F.coalesce("present_uri", "present_path", F.lit("")).alias("image_of"),
    )


@check("batches", """
SELECT dir AS album_key, (r - 1) // 100 AS batch, string_agg(uri, '|' ORDER BY r) AS uris
FROM (SELECT dir, uri, row_number() OVER (PARTITION BY dir ORDER BY first, uri) AS r
      FROM (SELECT dir, substr(sha256, 1, 12) AS uri, min(path) AS first FROM v_files GROUP BY dir, substr(sha256, 1, 12)) d) x
GROUP BY dir, (r - 1) // 100
""")
def _(t):
    items = t.files.select(F.col("dir").alias("album_key"), F.substring("sha256", 1, 12).alias("image_uri"), "path")
    return naming.batches(items).withColumn("uris", F.array_join("uris", "|"))


# Few names, some of which stand in the chain of another.
_DOWNLOADS = """
SELECT image_key, upload_seq AS seq, CASE upload_seq % 7 WHEN 0 THEN 'b_1.jpg' WHEN 1 THEN 'b_1_2.jpg' WHEN 2 THEN 'noext' WHEN 3 THEN lower(file_name)
       ELSE concat('b', substr('cde', cast(1 + upload_seq % 3 AS int), cast(upload_seq % 2 AS int)), '.jpg') END AS file_name
FROM v_images
"""
_COUNTED = "list_reduce(list_transform(range(1, k + 1), lambda i: concat('_', cast(i AS varchar))), lambda a, b: concat(a, b))"


@check("unique_download_names", f"""
WITH d AS ({_DOWNLOADS}),
f AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY seq) - 1 AS r,
             CASE WHEN contains(file_name, '.') THEN regexp_extract(file_name, '^(.*)\\.[^.]*$', 1) ELSE file_name END AS stem,
             CASE WHEN contains(file_name, '.') THEN regexp_extract(file_name, '\\.[^.]*$') ELSE '' END AS dot FROM d),
c AS (SELECT DISTINCT f.stem, f.dot, k, concat(f.stem, {_COUNTED}, f.dot) AS name FROM f, (SELECT unnest(range(1, 101)) AS k) n WHERE r > 0),
free AS (SELECT stem, dot, name, row_number() OVER (PARTITION BY stem, dot ORDER BY k) AS r FROM c WHERE name NOT IN (SELECT file_name FROM d))
SELECT f.image_key, CASE WHEN f.r = 0 THEN f.file_name WHEN length(coalesce(free.name, repeat('x', 300))) <= 255 THEN free.name
  ELSE concat(left(f.stem, 40), '_', md5(concat_ws('|', f.file_name, cast(f.seq AS varchar), f.image_key)), left(f.dot, 10)) END AS target_name
FROM f LEFT JOIN free ON free.stem = f.stem AND free.dot = f.dot AND free.r = f.r AND f.r > 0
""")
def _(t):
    named = naming.unique_download_names(t.sql(_DOWNLOADS), ["seq", "image_key"])
    return named.select("image_key", "target_name")


_LISTED = """
SELECT file_name, arg_max(md5, image_key) AS md5, arg_max(uri, image_key) AS uri
FROM (SELECT file_name, archived_md5 AS md5, concat('/i/', image_key) AS uri, image_key FROM v_images) i GROUP BY file_name
"""


def _listed(t):
    images = t.images.select(
        "file_name", F.col("archived_md5").alias("md5"), F.concat(F.lit("/i/"), "image_key").alias("uri"), "image_key"
    )
    latest = naming.latest_by_name(images.withColumns({"series": F.lit("all"), "n": F.lit(1)}))
    return latest.select("file_name", "md5", "uri")


@check("match_remote_name", f"""
SELECT f.path, CASE WHEN r.file_name IS NULL THEN 'none' WHEN lower(r.md5) = f.md5 THEN 'skip' ELSE 'replace' END AS name_match,
       CASE WHEN r.file_name IS NOT NULL AND lower(r.md5) <> f.md5 THEN r.uri ELSE '' END AS replaces_uri
FROM v_files f LEFT JOIN ({_LISTED}) r ON r.file_name = f.file_name
""")
def _(t):
    matched = remote.match_remote_name(t.files, _listed(t))
    return matched.select("path", "name_match", F.coalesce("replaces_uri", F.lit("")).alias("replaces_uri"))


@check("match_remote_content", "SELECT path FROM v_files WHERE md5 IN (SELECT lower(archived_md5) FROM v_images)")
def _(t):
    return remote.match_remote_content(t.files, t.images.select(F.col("archived_md5").alias("md5"))).select("path")


# A file's target is the album of its day, or for every other two of the day after, so that some names and contents are there and some not.
@check("plan_collects", """
WITH f AS (SELECT path, file_name, sha256, concat('A', strftime(cast(day_text AS date) + cast(doc_id % 4 > 1 AS int), '%Y%m%d')) AS target FROM v_files)
SELECT f.path, CASE WHEN n.file_name IS NULL AND a.album_key IS NULL AND h.uri IS NOT NULL THEN h.uri ELSE '' END AS collect_uri
FROM f LEFT JOIN (SELECT DISTINCT album_key, file_name FROM v_images) n ON n.file_name = f.file_name AND n.album_key = f.target
LEFT JOIN v_hashes h ON h.sha256 = f.sha256 LEFT JOIN v_albums a ON a.album_key = h.album_key AND a.album_key = f.target
""")
def _(t):
    target = F.concat(F.lit("A"), F.date_format(F.date_add(F.col("day_text").cast("date"), (F.col("doc_id") % 4 > 1).cast("int")), "yyyyMMdd"))
    files = t.files.select("path", "file_name", "sha256", target.alias("target"))
    albums = t.albums.select("album_key", F.col("album_key").alias("target"))
    names = t.images.select(F.col("album_key").alias("target"), "file_name")
    planned = remote.plan_collects(files, albums, names, t.hashes, within=["target"])
    return planned.select("path", F.coalesce("collect_uri", F.lit("")).alias("collect_uri"))


@check("images_with_album_name", """
SELECT i.image_key, coalesce(a.name, i.album_key) AS album_name, CASE WHEN i.upload_seq % 5 = 0 THEN i.image_key ELSE i.file_name END AS shown_name
FROM v_images i LEFT JOIN v_albums a ON a.album_key = i.album_key
""")
def _(t):
    images = t.images.withColumn("file_name", F.when(F.col("upload_seq") % 5 == 0, "").otherwise(F.col("file_name")))
    return remote.images_with_album_name(images, t.albums).select("image_key", "album_name", "shown_name")


@check("search_hit_albums", "SELECT image_key, CASE WHEN upload_seq % 4 = 0 THEN 'none' ELSE album_key END AS album_key FROM v_images")
def _(t):
    uri = F.when(F.col("upload_seq") % 4 == 0, "").otherwise(F.concat(F.lit("/api/v2/album/"), "album_key"))
    link = F.struct(F.struct(uri.alias("Uri")).alias("ImageAlbum"))
    return t.images.select("image_key", F.coalesce(remote.album_key_of(link), F.lit("none")).alias("album_key"))


@check("downloadable", """
SELECT i.image_key FROM v_images i JOIN v_albums a ON a.album_key = i.album_key WHERE coalesce(a.allow_downloads, true)
""")
def _(t):
    return remote.downloadable(t.images, t.albums).select("image_key")


# Part names differ in case only here and there, and many repeat.
_NAMES = "SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey AS pos, p_brand AS brand FROM part"
_WANTED = "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE concat(p_name, '!') END AS name FROM supplier JOIN part ON p_partkey = s_suppkey"


@check("pick_by_name", f"""
SELECT w.id, w.name, coalesce(cast(coalesce(e.pos, l.pos) AS varchar), 'none') AS pos
FROM ({_WANTED}) w LEFT JOIN (SELECT name, min(pos) AS pos FROM ({_NAMES}) n GROUP BY name) e ON e.name = w.name
LEFT JOIN (SELECT lower(name) AS name, min(pos) AS pos FROM ({_NAMES}) n GROUP BY lower(name)) l ON l.name = lower(w.name)
""")
def _(t):
    picked = remote.pick_by_name(t.sql(_NAMES), t.sql(_WANTED))
    return picked.select("id", "name", F.coalesce(F.col("pos").cast("string"), F.lit("none")).alias("pos"))


@check("pick_by_name_ignoring_case", f"""
SELECT w.id, coalesce(cast(l.pos AS varchar), 'none') AS pos
FROM ({_WANTED}) w LEFT JOIN (SELECT lower(name) AS name, min(pos) AS pos FROM ({_NAMES}) n GROUP BY lower(name)) l ON l.name = lower(w.name)
""")
def _(t):
    picked = remote.pick_by_name(t.sql(_NAMES), t.sql(_WANTED), exact_first=False)
    return picked.select("id", F.coalesce(F.col("pos").cast("string"), F.lit("none")).alias("pos"))


@check("pick_album_by_name_or_key", """
SELECT i.image_key, coalesce(a.album_key, 'none') AS album_key
FROM (SELECT image_key, CASE upload_seq % 3 WHEN 0 THEN album_key WHEN 1 THEN strftime(taken, '%Y-%m-%d') ELSE 'nowhere' END AS name FROM v_images) i
LEFT JOIN v_albums a ON a.name = i.name OR a.album_key = i.name
""")
def _(t):
    asked = t.images.select(
        "image_key",
        F.when(F.col("upload_seq") % 3 == 0, F.col("album_key"))
        .when(F.col("upload_seq") % 3 == 1, F.date_format("taken", "yyyy-MM-dd")).otherwise("nowhere").alias("name"),
    )
    albums = t.albums.select("name", "album_key", F.col("album_key").alias("pos"))
    picked = remote.pick_by_name(albums, asked, or_key="album_key")
    return picked.select("image_key", F.coalesce("album_key", F.lit("none")).alias("album_key"))


@check("rendered_names", "SELECT path, concat(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '.jpg') AS name FROM v_files WHERE ext IN ('cr2', 'nef', 'tif')")
def _(t):
    return t.files.where("ext IN ('cr2', 'nef', 'tif')").select("path", rendered_name(F.col("path")).alias("name"))
