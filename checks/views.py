"""The tables every check runs on, derived from the driver's tables.

The SQL is the one `FIXTURES.md` gives; it runs in both engines.  Rows are
told apart by `doc_id` only to make some files known, changed, copied or
refused: each view covers its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_files": """
SELECT concat('/lib/d', cast(sn_dir AS varchar), '/', stem, '.', ext) AS path,
       concat('d', cast(sn_dir AS varchar)) AS dir, concat(stem, '.', ext) AS file_name,
       lower(stem) AS stem_lc, lower(ext) AS ext, cast(n_chars AS bigint) AS size,
       1400000000000000000 + doc_id * 86400000000000 AS mtime_ns,
       sha256(text) AS sha256, md5(text) AS md5, doc_id, lang, source,
       y * 10000 + m * 100 + dd AS ymd,
       concat(cast(y AS varchar), '-', lpad(cast(m AS varchar), 2, '0'), '-', lpad(cast(dd AS varchar), 2, '0')) AS day_text
FROM (SELECT *, CASE WHEN k % 4 <> 3 THEN concat('IMG_', cast(y * 10000 + m * 100 + dd AS varchar), '_', cast(k AS varchar))
                     ELSE concat('DSC', cast(k AS varchar)) END AS stem
      FROM (SELECT doc_id, text, n_chars, lang, source, k, cast(floor(sn / 40.0) AS bigint) AS sn_dir,
                   2014 + k % 3 AS y, 1 + k % 12 AS m, 1 + k % 28 AS dd,
                   CASE doc_id % 8 WHEN 0 THEN CASE WHEN k % 5 = 4 THEN 'gif' ELSE 'jpg' END
                        WHEN 1 THEN 'CR2' WHEN 2 THEN 'MOV' WHEN 3 THEN 'xmp'
                        WHEN 4 THEN CASE WHEN k % 2 = 0 AND k % 5 <> 4 THEN 'heic' ELSE 'nef' END
                        WHEN 5 THEN 'tif' WHEN 6 THEN 'png' ELSE 'mp4' END AS ext
            FROM (SELECT *, cast(floor(doc_id / 8.0) AS bigint) AS sn,
                         cast(floor(doc_id / 8.0) AS bigint) % 40 AS k FROM documents) a) b) c
""",
    "v_state": """
SELECT path, CASE WHEN doc_id % 5 = 1 THEN size + 1 ELSE size END AS size,
       CASE WHEN doc_id % 5 = 2 THEN mtime_ns - 1 ELSE mtime_ns END AS mtime_ns,
       CASE WHEN doc_id % 5 = 1 THEN md5('old') ELSE sha256 END AS sha256, md5 AS uploaded_md5,
       cast(day_text AS date) AS capture_date,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('/album/A', cast(ymd AS varchar), '/image/', cast(doc_id - doc_id % 3 AS varchar), '-0') END AS image_uri,
       CASE WHEN doc_id % 11 = 0 AND doc_id % 2 = 0 THEN 'refused' ELSE NULL END AS failed,
       doc_id % 7 <> 0 AS captioned
FROM v_files WHERE doc_id % 4 <> 3
""",
    "v_hashes": """
SELECT sha256, max(concat('/album/A', cast(ymd AS varchar), '/image/', cast(doc_id AS varchar), '-0')) AS uri,
       max(CASE WHEN doc_id % 4 = 2 THEN concat('A', cast(ymd AS varchar)) ELSE 'ELSEWHERE' END) AS album_key,
       max(size) AS file_size, max(cast(day_text AS date)) AS uploaded_day
FROM v_files WHERE doc_id % 6 = 0 GROUP BY sha256
""",
    "v_dated": """
SELECT path, file_name, dir, stem_lc, ext, sha256, md5, size, cast(day_text AS date) AS day,
       CASE WHEN stem_lc LIKE 'img_%' THEN 'file name' ELSE 'file modified time' END AS date_source
FROM v_files WHERE ext <> 'xmp'
""",
    "v_albums": """
SELECT concat('A', cast(ymd AS varchar)) AS album_key, max(day_text) AS name, count(*) AS image_count,
       CASE max(ymd) % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS allow_downloads
FROM v_files WHERE doc_id % 2 = 0 GROUP BY ymd
""",
    "v_images": """
SELECT concat(cast(doc_id AS varchar), '-0') AS image_key, concat('A', cast(ymd AS varchar)) AS album_key, file_name,
       upper(ext) AS format, size AS file_size,
       CASE doc_id % 3 WHEN 0 THEN upper(md5) ELSE md5(path) END AS archived_md5,
       concat(lang, '; ', source, CASE WHEN doc_id % 4 = 0 THEN ', Beach ' WHEN doc_id % 4 = 1 THEN ';beach' ELSE ';' END) AS keywords,
       concat('Photo ', cast(doc_id AS varchar)) AS title, concat('from ', dir) AS caption,
       cast(concat(day_text, ' 12:00:00') AS timestamp) AS taken, doc_id AS upload_seq
FROM v_files WHERE doc_id % 3 <> 2
""",
    "v_nodes": """
SELECT '/n/root' AS uri, cast(NULL AS varchar) AS parent_uri, '' AS name, 'Folder' AS node_type, 0 AS pos, 'Name' AS sort_method
UNION ALL SELECT concat('/n/r', cast(r_regionkey AS varchar)), '/n/root', r_name, 'Folder', r_regionkey, 'Name' FROM region
UNION ALL SELECT concat('/n/c', cast(n_nationkey AS varchar)), concat('/n/r', cast(n_regionkey AS varchar)), n_name,
       CASE WHEN n_nationkey % 9 = 8 THEN 'Page' ELSE 'Folder' END, n_nationkey,
       CASE WHEN n_nationkey % 2 = 0 THEN 'Name' ELSE 'DateModified' END FROM nation
UNION ALL SELECT concat('/n/a', cast(s_suppkey AS varchar)), concat('/n/c', cast(s_nationkey AS varchar)),
       concat('Album ', cast(s_suppkey % 40 AS varchar)), 'Album', cast(s_suppkey AS int),
       CASE WHEN s_suppkey % 3 = 0 THEN 'Date Taken' ELSE 'Position' END FROM supplier WHERE s_nationkey % 9 <> 8
""",
    "v_comments": """
SELECT conv_id, turn, CASE WHEN conv_id % 13 = 0 THEN '' ELSE text END AS text,
       CASE WHEN conv_id % 17 = 0 THEN lpad('n', 51, 'n') ELSE role END AS name,
       cast((conv_id * 7 + turn) % 8 AS int) AS rating FROM conversations
""",
    "v_outcomes": """
SELECT path, size, doc_id % 5 = 0 AS is_replace,
       CASE doc_id % 10 WHEN 0 THEN 413 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 200 END AS status,
       CASE doc_id % 10 WHEN 4 THEN 71 WHEN 5 THEN 6 WHEN 6 THEN 5 ELSE cast(NULL AS int) END AS code
FROM v_files WHERE doc_id % 4 <> 3
""",
    "v_meta": """
SELECT path, CASE doc_id % 6 WHEN 0 THEN concat(replace(day_text, '-', ':'), ' 10:00:00') WHEN 1 THEN '0000:00:00 00:00:00'
            WHEN 2 THEN concat(replace(day_text, '-', '/'), ' 10:00:00') WHEN 3 THEN '2016:05-01 00:00:00' ELSE NULL END AS exif_original,
       CASE WHEN doc_id % 4 = 0 THEN '2021:05:05 10:00:00' ELSE NULL END AS exif_modified
FROM v_files WHERE ext NOT IN ('mov', 'mp4', 'xmp')
""",
    "v_video_meta": """
SELECT path, CASE WHEN doc_id % 3 = 0 THEN concat(day_text, 'T23:30:00-0500') ELSE NULL END AS apple_date,
       CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 3482844800 + doc_id * 3600 END AS mvhd_seconds,
       cast(doc_id % 30 * 60 AS double) AS duration_s,
       CASE WHEN doc_id % 7 = 0 THEN 236 ELSE 1080 END AS short_side, doc_id % 11 = 0 AS unfinished
FROM v_files WHERE ext IN ('mov', 'mp4')
""",
    "v_orders_files": """
SELECT concat('/o/', cast(o_orderkey AS varchar), '.jpg') AS path, cast(o_orderdate AS date) AS day, o_orderkey AS id FROM orders
""",
    "v_orders_albums": """
SELECT cast(day AS varchar) AS base, 1 AS n, max(id) % 6 AS cnt FROM v_orders_files GROUP BY day HAVING max(id) % 3 = 0
UNION ALL SELECT cast(day AS varchar), 3, 2 FROM v_orders_files GROUP BY day HAVING max(id) % 6 = 0
""",
}

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


# Nanoseconds of a day to each document: a long holds them for these ids.  Spark and DuckDB
# refuse others, and the SQL gives no row then; theirs begin again with the first day.
_DAYS = "doc_id * 86400000000000"
_DAYS_OF_ANY_ID = "(CASE WHEN doc_id BETWEEN -106751 AND 90548 THEN doc_id ELSE doc_id % 90549 END) * 86400000000000"


def _used(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """`sql` for DuckDB, the views it uses put in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for view in _used(text):
            if view not in needed:
                need(VIEWS[view])
                needed.append(view)

    need(sql)
    parts = [f"{view} AS ({VIEWS[view].strip()})" for view in needed]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*parts, body[15:]])}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join([*parts, body[5:]])}"
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Tables:
    """The driver's tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in _TABLES:
                self._known[name] = self.spark.read.parquet(f"{self._folder}/{name}.parquet")
            elif f"v_{name}" in VIEWS:
                self._known[name] = self.sql(VIEWS[f"v_{name}"])
            else:
                raise AttributeError(name)
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL over tables and views, written as in `VIEWS`."""
        text = text.replace("sha256(text)", "sha2(text, 256)").replace(_DAYS, _DAYS_OF_ANY_ID)
        text = re.sub(r"\bvarchar\b", "string", text)
        frames = {}
        for name in [*_TABLES, *VIEWS]:
            if re.search(rf"\b(FROM|JOIN) {name}\b", text):
                frames[name] = getattr(self, name.removeprefix("v_"))
                text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **frames)
