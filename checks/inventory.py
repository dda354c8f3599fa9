"""Inventory, filters, siblings, change detection and copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from shelfmark.operators import change, copies, reports, scanning, siblings
from shelfmark.session import scratch_dir
from shelfmark.skew import ranked
from shelfmark.sources.inventory import read_manifest, write_inventory

_SUPPORTED = "ext <> 'xmp'"
_RAW = "('raw','dng','cr2','cr3','nef','arw','orf','raf','rw2','pef','srw','erf','mrw','3fr','fff','iiq')"


@check("merge_sources", "SELECT path, size, mtime_ns FROM v_files")
def _(t):
    listing = t.files.select("path", "size", "mtime_ns")
    raws = listing.where(F.col("path").endswith(".CR2"))
    return scanning.merge_sources([listing, raws, listing])


@check("sort_dedup_paths", "SELECT DISTINCT concat('/lib/', dir, '/', stem_lc) AS path FROM v_files")
def _(t):
    stems = t.files.select(F.concat(F.lit("/lib/"), "dir", F.lit("/"), "stem_lc").alias("path"))
    return scanning.sort_dedup_paths(stems)


@check("filter_supported", f"SELECT path FROM v_files WHERE {_SUPPORTED}")
def _(t):
    return scanning.filter_supported(t.files).select("path")


@check("count_unsupported", f"SELECT count(*) FILTER ({_SUPPORTED}) AS supported, count(*) FILTER (ext = 'xmp') AS unsupported FROM v_files")
def _(t):
    return scanning.count_unsupported(t.files)


# The library with hidden and system names put into some paths.
_HIDDEN = """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN replace(path, '/lib/', '/lib/.trash/') WHEN 1 THEN replace(path, '/lib/', '/lib/@eaDir/')
       WHEN 2 THEN concat('/lib/', dir, '/._', file_name) WHEN 3 THEN replace(path, '/lib/', '/lib/a/#recycle/')
       WHEN 4 THEN replace(path, '/lib/', '/lib/$RECYCLE.BIN/') WHEN 5 THEN concat('/lib/', dir, '/#snapshot')
       WHEN 6 THEN replace(path, '/lib/', '/lib/a.b/') ELSE path END AS path
FROM v_files
"""


@check("read_manifest", f"SELECT doc_id, path, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS size FROM ({_HIDDEN}) h")
def _(t):
    size = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("doc_id")).cast("bigint")
    folder = scratch_dir(t.spark, "inventory")
    write_inventory(t.sql(_HIDDEN).select("doc_id", "path", size.alias("size")), folder)
    return read_manifest(t.spark, folder, checksums=True)


@check("filter_hidden_and_system", f"SELECT doc_id, path FROM ({_HIDDEN}) h WHERE doc_id % 9 > 4")
def _(t):
    return scanning.filter_hidden_and_system(t.sql(_HIDDEN), "/lib").select("doc_id", "path")


@check("filter_excludes", """
SELECT path FROM v_files
WHERE NOT (ext = 'gif' OR dir = 'd1' OR dir LIKE 'd2_' OR regexp_matches(file_name, '^DSC[0-35-9].\\.') OR (dir = 'd0' AND ext = 'png'))
""")
def _(t):
    patterns = ["*.gif", "/d1/", "d2?/", "DSC[!4]?.*", "d0/**/*.png", "/d3", "# not a comment", "nothing/"]
    patterns.remove("/d3")
    return scanning.filter_excludes(t.files, patterns, "/lib").select("path")


_RULES = [
    ("/lib", 1, "*.gif"), ("/lib", 2, "!IMG_2014*.gif"), ("/lib", 3, "*.png"), ("/lib", 4, "/d2/"),
    ("/lib/d0", 1, "!*.png"), ("/lib/d0", 2, "DSC*"), ("/lib/d0", 3, "# DSC"), ("/lib/d2", 1, "!*"),
    ("/lib/d1", 1, "*.heic"), ("/lib/d1", 2, "nothing/"),
]


@check("filter_ignore_files", """
SELECT path FROM v_files
WHERE NOT (dir = 'd2' OR (ext = 'gif' AND NOT (stem_lc LIKE 'img!_2014%' ESCAPE '!') ) OR (ext = 'png' AND dir <> 'd0')
           OR (dir = 'd0' AND stem_lc LIKE 'dsc%' AND ext <> 'png') OR (dir = 'd0' AND stem_lc LIKE 'dsc%' AND ext = 'png')
           OR (dir = 'd1' AND ext = 'heic'))
""")
def _(t):
    lines = t.spark.createDataFrame(_RULES, "dir string, seq int, line string")
    return scanning.filter_ignore_files(t.files, scanning.compile_ignore_rules(lines)).select("path")


_RAW_OUTCOME = f"""
SELECT f.path, CASE WHEN NOT renders THEN 'kept' WHEN g.taken OR f.path <> g.first THEN 'skipped_with_sibling' ELSE 'rendered' END AS raw_outcome
FROM (SELECT *, ext IN {_RAW} OR ext IN ('tif','tiff','bmp') AS renders FROM v_files WHERE {_SUPPORTED}) f
LEFT JOIN (SELECT dir, stem_lc, bool_or(ext IN ('jpg','jpeg','heic','heif')) AS taken,
                  min(CASE WHEN ext IN {_RAW} OR ext IN ('tif','tiff','bmp') THEN path END) AS first
           FROM v_files WHERE {_SUPPORTED} GROUP BY dir, stem_lc) g ON g.dir = f.dir AND g.stem_lc = f.stem_lc
"""


@check("suppress_raw_siblings", _RAW_OUTCOME)
def _(t):
    return siblings.raw_selection(scanning.filter_supported(t.files)).select("path", "raw_outcome")


@check("raw_selection_counts", f"""
SELECT count(*) FILTER (raw_outcome = 'rendered') AS rendered, count(*) FILTER (raw_outcome = 'skipped') AS skipped,
       count(*) FILTER (raw_outcome = 'skipped_with_sibling') AS skipped_with_sibling FROM ({_RAW_OUTCOME}) r
""")
def _(t):
    return siblings.raw_selection_counts(scanning.filter_supported(t.files))


@check("skip_raw_files", f"SELECT path FROM v_files WHERE {_SUPPORTED} AND ext NOT IN {_RAW}")
def _(t):
    return siblings.suppress_raw_siblings(scanning.filter_supported(t.files), "skip").select("path")


@check("first_per_stem", "SELECT min(path) AS path, dir, stem_lc FROM v_files GROUP BY dir, stem_lc")
def _(t):
    return siblings.first_per_stem(t.files.select("path", "dir", "stem_lc"))


_PAIRED = f"""
SELECT f.path, CASE WHEN f.ext IN ('mov','mp4') THEN s.still END AS live_photo_of
FROM v_files f LEFT JOIN (SELECT dir, stem_lc, max(path) AS still FROM v_files
                          WHERE ext IN ('jpg','jpeg','heic','heif','png') OR ext IN {_RAW} GROUP BY dir, stem_lc) s
  ON s.dir = f.dir AND s.stem_lc = f.stem_lc
WHERE f.ext <> 'xmp'
"""


@check("pair_live_photos", f"SELECT path, coalesce(live_photo_of, '') AS live_photo_of FROM ({_PAIRED}) p")
def _(t):
    paired = siblings.pair_live_photos(scanning.filter_supported(t.files))
    return paired.select("path", F.coalesce("live_photo_of", F.lit("")).alias("live_photo_of"))


@check("skip_live_videos", f"SELECT path FROM ({_PAIRED}) p WHERE live_photo_of IS NULL")
def _(t):
    return siblings.skip_live_videos(siblings.pair_live_photos(scanning.filter_supported(t.files))).select("path")


_STATUS = """
SELECT f.path, CASE WHEN s.path IS NULL THEN 'new'
         WHEN s.size = f.size AND s.mtime_ns = f.mtime_ns AND (s.image_uri IS NOT NULL OR s.failed IS NOT NULL) THEN 'unchanged'
         ELSE 'changed' END AS status,
       coalesce(s.size = f.size AND s.mtime_ns = f.mtime_ns AND s.failed IS NOT NULL, false) AS previously_refused,
       coalesce(s.sha256 = f.sha256 AND (s.image_uri IS NOT NULL OR s.failed IS NOT NULL), false) AS same_content,
       s.image_uri, s.captioned
FROM v_files f LEFT JOIN v_state s ON s.path = f.path
"""


@check("detect_unchanged", f"SELECT path, status, previously_refused FROM ({_STATUS}) s")
def _(t):
    return change.detect_unchanged(t.files, t.state).select("path", "status", "previously_refused")


@check("detect_unchanged_without_cache", "SELECT path, path IN (SELECT path FROM v_state) AS known, false AS unchanged FROM v_files")
def _(t):
    status = F.col("status")
    checked = change.detect_unchanged(t.files, t.state, no_cache=True)
    return checked.select("path", (status == "changed").alias("known"), (status == "unchanged").alias("unchanged"))


@check("detect_touched", f"SELECT path, CASE WHEN status = 'changed' AND same_content THEN 'touched' ELSE status END AS status FROM ({_STATUS}) s")
def _(t):
    return change.detect_touched(t.files, t.state).select("path", "status")


@check("lookup_known", """
SELECT f.path, coalesce(h.uri, '') AS known_uri, coalesce(h.album_key, '') AS known_album_key
FROM v_files f LEFT JOIN v_hashes h ON h.sha256 = f.sha256
""")
def _(t):
    known = change.lookup_known(t.files, t.hashes)
    return known.select(
        "path", F.coalesce("known_uri", F.lit("")).alias("known_uri"),
        F.coalesce("known_album_key", F.lit("")).alias("known_album_key"),
    )


@check("place_known", """
SELECT d.path, CASE WHEN h.uri IS NULL THEN 'unknown' WHEN a.album_key IS NOT NULL THEN 'linked' ELSE 'collected' END AS placement
FROM v_dated d LEFT JOIN v_hashes h ON h.sha256 = d.sha256
LEFT JOIN v_albums a ON a.album_key = h.album_key AND cast(a.name AS date) = d.day
""")
def _(t):
    days = t.albums.select(F.col("name").cast("date").alias("day"), "album_key")
    placed = change.place_known(change.lookup_known(t.dated, t.hashes), days)
    return placed.select("path", F.coalesce("placement", F.lit("unknown")).alias("placement"))


@check("image_refs", "SELECT image_uri, count(*) AS refs FROM v_state WHERE image_uri IS NOT NULL GROUP BY image_uri")
def _(t):
    return change.image_refs(t.state)


@check("caption_jobs", f"""
SELECT image_uri, cast(0 AS bigint) AS part, string_agg(path, chr(10) ORDER BY path) AS caption
FROM ({_STATUS}) s WHERE status = 'unchanged' AND image_uri IS NOT NULL GROUP BY image_uri HAVING bool_or(NOT captioned)
""")
def _(t):
    return change.caption_jobs(t.files, t.state)


# Outcomes of a run over the known files: replaced content gets a new image.
_OUTCOMES = """
SELECT f.path, f.size + 10 AS size, f.mtime_ns + 1 AS mtime_ns, f.sha256, f.md5 AS uploaded_md5, cast(f.day_text AS date) AS capture_date,
       concat('/new/', f.md5) AS image_uri, concat('error ', cast(f.doc_id % 10 AS varchar)) AS failed, f.doc_id % 2 = 0 AS captioned,
       CASE f.doc_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'refused' WHEN 2 THEN 'touched' ELSE 'ok' END AS outcome
FROM v_files f WHERE ext <> 'xmp'
"""


@check("apply_outcomes", f"""
SELECT coalesce(o.path, s.path) AS path,
       cast(CASE WHEN o.outcome IS NULL THEN s.size ELSE o.size END AS bigint) AS size,
       CASE WHEN o.outcome IS NULL THEN s.mtime_ns ELSE o.mtime_ns END AS mtime_ns,
       CASE WHEN o.outcome IS NULL OR (o.outcome = 'touched' AND s.path IS NOT NULL) THEN s.sha256 ELSE o.sha256 END AS sha256,
       coalesce(CASE WHEN o.outcome IS NULL OR (o.outcome = 'touched' AND s.path IS NOT NULL) THEN s.image_uri
                     WHEN o.outcome = 'refused' THEN NULL ELSE o.image_uri END, '') AS image_uri,
       coalesce(CASE WHEN o.outcome IS NULL OR (o.outcome = 'touched' AND s.path IS NOT NULL) THEN s.failed
                     WHEN o.outcome = 'refused' THEN o.failed END, '') AS failed,
       CASE WHEN o.outcome IS NULL OR (o.outcome = 'touched' AND s.path IS NOT NULL) THEN s.captioned
            WHEN o.outcome = 'ok' THEN o.captioned ELSE false END AS captioned
FROM v_state s FULL OUTER JOIN (SELECT * FROM ({_OUTCOMES}) x WHERE outcome <> 'failed') o ON o.path = s.path
""")
def _(t):
    after = change.apply_outcomes(t.state, t.sql(_OUTCOMES))
    return after.select(
        "path", "size", "mtime_ns", "sha256", F.coalesce("image_uri", F.lit("")).alias("image_uri"),
        F.coalesce("failed", F.lit("")).alias("failed"), "captioned",
    )


_HASH_OUTCOMES = """
SELECT f.path, f.sha256, concat('/new/', f.md5) AS uri, 'NEW' AS album_key, f.size AS file_size,
       CASE WHEN f.doc_id % 3 = 0 THEN h.sha256 END AS old_sha256,
       CASE WHEN f.doc_id % 6 = 0 THEN h.uri WHEN f.doc_id % 3 = 0 THEN '/other' END AS old_uri
FROM v_files f LEFT JOIN v_hashes h ON h.sha256 = f.sha256 WHERE f.ext = 'jpg' OR f.ext = 'tif'
"""


@check("apply_hash_outcomes", f"""
WITH o AS ({_HASH_OUTCOMES}),
kept AS (SELECT * FROM v_hashes h WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.old_sha256 = h.sha256 AND o.old_uri = h.uri)),
added AS (SELECT sha256, arg_min(uri, path) AS uri, arg_min(file_size, path) AS file_size FROM o GROUP BY sha256)
SELECT sha256, uri, cast(file_size AS bigint) AS file_size FROM added
UNION ALL SELECT sha256, uri, file_size FROM kept WHERE sha256 NOT IN (SELECT sha256 FROM added)
""")
def _(t):
    return change.apply_hash_outcomes(t.hashes, t.sql(_HASH_OUTCOMES)).select("sha256", "uri", "file_size")


# A third of the collects find no image any more: their content is forgotten if it points there.
@check("refused_collects", """
WITH o AS (SELECT f.sha256, h.uri, f.doc_id % 9 = 0 AS lost FROM v_files f JOIN v_hashes h ON h.sha256 = f.sha256)
SELECT sha256, uri FROM v_hashes WHERE sha256 NOT IN (SELECT sha256 FROM o WHERE lost)
""")
def _(t):
    known = t.hashes.select("sha256", "uri")
    collects = t.files.join(known, "sha256").select(
        "path", "sha256", F.when(F.col("doc_id") % 9 == 0, F.col("uri")).alias("uri"), F.lit(None).cast("string").alias("old_sha256"), F.lit(None).cast("string").alias("old_uri"),
        F.when(F.col("doc_id") % 9 == 0, "collect_refused").otherwise("ok").alias("outcome"),
    )
    return change.apply_hash_outcomes(known, collects).select("sha256", "uri")


@check("upsert_state", """
SELECT path, size + 1 AS size FROM v_files WHERE ext = 'jpg'
UNION ALL SELECT path, size FROM v_state WHERE path NOT IN (SELECT path FROM v_files WHERE ext = 'jpg')
""")
def _(t):
    updates = t.files.where("ext = 'jpg'").select("path", (F.col("size") + 1).alias("size"))
    return change.upsert(t.state.select("path", "size"), updates, "path")


@check("mark_gone", """
WITH gone AS (SELECT DISTINCT concat('/album/', album_key, '/image/', image_key) AS image_uri FROM v_images WHERE format IN ('JPG', 'TIF', 'PNG'))
SELECT path, CASE WHEN image_uri IN (SELECT image_uri FROM gone) THEN '' ELSE coalesce(image_uri, '') END AS image_uri,
       CASE WHEN image_uri IN (SELECT image_uri FROM gone) THEN 'the image is no longer in the catalog' ELSE coalesce(failed, '') END AS failed,
       captioned AND coalesce(image_uri NOT IN (SELECT image_uri FROM gone), true) AS captioned
FROM v_state
""")
def _(t):
    uri = F.concat(F.lit("/album/"), "album_key", F.lit("/image/"), "image_key").alias("image_uri")
    gone = t.images.where(F.col("format").isin("JPG", "TIF", "PNG")).select(uri)
    return change.mark_gone(t.state, gone).select(
        "path", F.coalesce("image_uri", F.lit("")).alias("image_uri"), F.coalesce("failed", F.lit("")).alias("failed"), "captioned"
    )


@check("orphans", f"SELECT path FROM v_state WHERE path NOT IN (SELECT path FROM v_files WHERE ext NOT IN {_RAW})")
def _(t):
    developed = siblings.suppress_raw_siblings(t.files, "skip")
    return change.orphans(t.state, developed).select("path")


@check("files_still_backed_up", "SELECT path FROM v_state WHERE path IN (SELECT path FROM v_dated)")
def _(t):
    return change.files_still_backed_up(t.state, t.dated).select("path")


@check("elect_copies", """
SELECT path, min(path) OVER (PARTITION BY sha256) AS leader, path = min(path) OVER (PARTITION BY sha256) AS is_leader FROM v_files
""")
def _(t):
    return copies.elect_copies(t.files).select("path", "leader", "is_leader")


@check("follow_leaders", """
WITH e AS (SELECT *, min(path) OVER (PARTITION BY sha256) AS leader FROM v_dated),
o AS (SELECT path, CASE WHEN status = 413 OR code IN (71, 6) THEN 'refused' WHEN status <> 200 OR code IS NOT NULL THEN 'failed' ELSE 'ok' END AS outcome FROM v_outcomes)
SELECT e.path, CASE WHEN e.path = e.leader THEN 'leader' WHEN coalesce(o.outcome, 'ok') <> 'ok' THEN 'failed'
                    WHEN l.day = e.day THEN 'linked' ELSE 'collected' END AS copy_action
FROM e JOIN v_dated l ON l.path = e.leader LEFT JOIN o ON o.path = e.leader
""")
def _(t):
    from shelfmark.functions.media import outcome_class

    told = t.outcomes.select("path", outcome_class(F.col("status"), F.col("code")).alias("told"))
    outcomes = t.dated.join(told, "path", "left").select("path", "day", F.coalesce("told", F.lit("ok")).alias("outcome"))
    return copies.follow_leaders(copies.elect_copies(t.dated), outcomes).select("path", "copy_action")


@check("duplicate_groups", """
SELECT sha256, count(*) AS copies, cast(sum(size) - min(size) AS bigint) AS wasted_bytes, cast(0 AS bigint) AS part,
       string_agg(path, '|' ORDER BY path) AS paths
FROM v_files GROUP BY sha256 HAVING count(*) > 1
""")
def _(t):
    return copies.duplicate_groups(t.files).withColumn("paths", F.array_join("paths", "|"))


# The same groups in parts of two, as a group too large for one row is given.
@check("duplicate_groups_in_parts", """
SELECT sha256, part, string_agg(path, '|' ORDER BY path) AS paths
FROM (SELECT sha256, path, (row_number() OVER (PARTITION BY sha256 ORDER BY path) - 1) // 2 AS part,
             count(*) OVER (PARTITION BY sha256) AS copies FROM v_files) g
WHERE copies > 1 GROUP BY sha256, part
""")
def _(t):
    parts = copies.duplicate_groups(t.files, chunk=2)
    return parts.select("sha256", "part", F.array_join("paths", "|").alias("paths"))


@check("files_per_directory", "SELECT concat('/lib/', dir) AS directory, count(*) AS files, cast(sum(size) AS bigint) AS bytes FROM v_files GROUP BY dir")
def _(t):
    return reports.files_per_directory(t.files)


# Numbering with every key of more than five rows treated as hot.
@check("rank_hot_keys", "SELECT path, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS n, row_number() OVER (PARTITION BY dir ORDER BY path) AS m FROM v_files")
def _(t):
    by_content = ranked(t.files.select("path", "sha256", "dir"), ["sha256"], ["path"], "n", hot_rows=5)
    return ranked(by_content, ["dir"], ["path"], "m", hot_rows=5).select(
        "path", F.col("n").cast("bigint").alias("n"), F.col("m").cast("bigint").alias("m")
    )
