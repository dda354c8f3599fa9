"""The folder tree, search, listings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from shelfmark.operators import reports, search, tree
from shelfmark.session import scratch_dir
from shelfmark.sources.listing import listing_items
from shelfmark.sources.text_index import TextIndex

_CLOSURE = """
closure AS (
  SELECT uri, parent_uri, name, node_type, pos, sort_method, 0 AS depth, '' AS path, '' AS order_key FROM v_nodes WHERE parent_uri IS NULL
  UNION ALL
  SELECT n.uri, n.parent_uri, n.name, n.node_type, n.pos, n.sort_method, c.depth + 1,
         CASE WHEN c.depth = 0 THEN n.name ELSE concat(c.path, '/', n.name) END,
         concat(c.order_key, '/', lpad(cast(n.pos AS varchar), 9, '0'))
  FROM closure c JOIN v_nodes n ON n.parent_uri = c.uri)
"""


def _closed(t):
    return tree.node_closure(t.nodes)


@check("node_closure", f"WITH RECURSIVE {_CLOSURE} SELECT uri, cast(depth AS bigint) AS depth, path FROM closure")
def _(t):
    return _closed(t).select("uri", F.col("depth").cast("bigint").alias("depth"), "path")


# Suppliers as folders one inside the other, each with an album.
@check("node_closure_of_a_long_chain", """
SELECT concat('/c/', cast(s_suppkey + 1 AS varchar)) AS uri, s_suppkey + 1 AS depth, s_suppkey + 2 AS links FROM supplier
UNION ALL SELECT concat('/c/a', cast(s_suppkey + 1 AS varchar)), s_suppkey + 2, s_suppkey + 3 FROM supplier
UNION ALL SELECT '/c/0', 0, 1
""")
def _(t):
    key = (F.col("s_suppkey") + 1).cast("string")
    node = lambda uri, parent, kind: t.supplier.select(uri.alias("uri"), parent.alias("parent_uri"), "s_name", F.lit(kind).alias("node_type"))
    nodes = (
        node(F.concat(F.lit("/c/"), key), F.concat(F.lit("/c/"), F.col("s_suppkey").cast("string")), "Folder")
        .unionByName(node(F.concat(F.lit("/c/a"), key), F.concat(F.lit("/c/"), key), "Album"))
        .unionByName(t.supplier.agg(F.lit("/c/0").alias("uri"), F.lit(None).cast("string").alias("parent_uri"), F.lit("").alias("s_name"), F.lit("Folder").alias("node_type")))
        .withColumnRenamed("s_name", "name").withColumn("pos", F.lit(0))
    )
    return tree.node_closure(nodes).select("uri", F.col("depth").cast("bigint").alias("depth"), F.size("chain").cast("bigint").alias("links"))


@check("tree_order", f"""
WITH RECURSIVE {_CLOSURE}
SELECT uri, order_key, row_number() OVER (PARTITION BY parent_uri ORDER BY pos DESC, uri DESC) = 1 AS is_last FROM closure
""")
def _(t):
    key = F.array_join(F.transform(F.slice("places", F.lit(2), F.size("places")), lambda p: F.lpad(p["pos"].cast("string"), 9, "0")), "/")
    shown = F.when(F.col("depth") == 0, "").otherwise(F.concat(F.lit("/"), key))
    return tree.tree_order(_closed(t)).select("uri", shown.alias("order_key"), "is_last").orderBy("order_key")


@check("folder_contents", """
SELECT f.uri, f.name, count(c.uri) FILTER (c.node_type = 'Folder') AS folders, count(c.uri) FILTER (c.node_type = 'Album') AS albums,
       count(c.uri) FILTER (c.node_type = 'Page') AS pages
FROM v_nodes f LEFT JOIN v_nodes c ON c.parent_uri = f.uri WHERE f.node_type = 'Folder' GROUP BY f.uri, f.name
""")
def _(t):
    return tree.folder_contents(t.nodes)


# Paths asked for: every node's own, and ones with a wrong end.
_ASKED = """
SELECT uri AS request_id, path FROM closure UNION ALL SELECT concat(uri, '!'), concat('/', path, '//nothing/') FROM closure
"""


@check("resolve_paths", f"""
WITH RECURSIVE {_CLOSURE},
named AS (SELECT path, count(*) FILTER (node_type = 'Folder') AS folders, count(*) AS nodes, min(uri) AS uri FROM closure WHERE node_type <> 'Page' AND depth > 0 GROUP BY path),
own AS (SELECT c.uri AS request_id, c.path, coalesce(n.nodes, 0) AS nodes, n.folders, n.uri FROM closure c LEFT JOIN named n ON n.path = c.path)
SELECT request_id, CASE WHEN path = '' THEN 'empty' WHEN nodes = 1 THEN 'ok' WHEN nodes = 0 THEN 'missing' ELSE 'ambiguous' END AS status,
       path AS at, CASE WHEN path <> '' AND nodes = 1 THEN uri ELSE '' END AS uri
FROM own
UNION ALL
SELECT concat(request_id, '!'), CASE WHEN path = '' OR folders = 1 THEN 'missing' WHEN coalesce(folders, 0) = 0 THEN 'missing' ELSE 'ambiguous' END,
       CASE WHEN path = '' THEN 'nothing' WHEN folders = 1 THEN concat(path, '/nothing') ELSE path END, ''
FROM own
""")
def _(t):
    closure = _closed(t)
    own = closure.select(F.col("uri").alias("request_id"), "path")
    wrong = closure.select(
        F.concat("uri", F.lit("!")).alias("request_id"), F.concat(F.lit("/"), "path", F.lit("//nothing/")).alias("path")
    )
    found = tree.resolve_paths(closure, own.unionByName(wrong))
    return found.select("request_id", "status", "at", F.coalesce("node.uri", F.lit("")).alias("uri"))


# A move of every node: into the next region, into its own parent, into
# itself, to the top, or to a place that is none.
_MOVES = """
SELECT c.uri AS request_id, c.path, CASE WHEN c.pos % 3 = 0 THEN 'either' WHEN c.pos % 3 = 1 THEN 'album' ELSE 'folder' END AS kind,
       CASE c.pos % 5 WHEN 0 THEN coalesce(r.name, 'gone') WHEN 1 THEN coalesce(p.path, '') WHEN 2 THEN concat(c.path, '/x') WHEN 3 THEN '' ELSE 'AFRICA/nowhere' END AS destination,
       c.parent_uri, c.name, c.node_type
FROM closure c LEFT JOIN closure p ON p.uri = c.parent_uri
LEFT JOIN v_nodes r ON r.uri = concat('/n/r', cast(c.pos % 7 AS varchar))
"""


@check("validate_moves", f"""
WITH RECURSIVE {_CLOSURE}, m AS ({_MOVES}),
named AS (SELECT path, count(*) AS nodes, count(*) FILTER (node_type = 'Folder') AS folders, min(uri) AS uri, min(node_type) AS node_type FROM closure WHERE node_type <> 'Page' AND depth > 0 GROUP BY path),
x AS (SELECT m.*, coalesce(s.nodes, 0) AS nodes, s.node_type AS found_type, s.uri AS found,
             coalesce(d.nodes, 0) AS to_nodes, d.node_type AS to_type, CASE WHEN m.destination = '' THEN '/n/root' ELSE d.uri END AS to_uri
      FROM m LEFT JOIN named s ON s.path = m.path LEFT JOIN named d ON d.path = m.destination)
SELECT request_id, CASE
  WHEN path = '' THEN 'empty' WHEN nodes = 0 THEN 'missing' WHEN nodes > 1 THEN 'ambiguous'
  WHEN kind = 'folder' AND found_type <> 'Folder' THEN 'wrong kind' WHEN kind = 'album' AND found_type = 'Folder' THEN 'wrong kind'
  WHEN found_type = 'Folder' AND (destination = path OR starts_with(destination, concat(path, '/'))) THEN 'into itself'
  WHEN destination <> '' AND to_nodes <> 1 THEN CASE WHEN to_nodes = 0 THEN 'destination missing' ELSE 'destination ambiguous' END
  WHEN destination <> '' AND to_type <> 'Folder' THEN 'destination wrong kind'
  WHEN parent_uri = to_uri THEN 'already there'
  WHEN EXISTS (SELECT 1 FROM v_nodes n WHERE n.parent_uri = x.to_uri AND n.name = x.name) THEN 'name taken'
  ELSE 'ok' END AS verdict
FROM x
""")
def _(t):
    closure = _closed(t)
    parents = closure.select(F.col("uri").alias("parent_uri"), F.col("path").alias("up"))
    regions = t.nodes.select(F.col("uri").alias("region"), F.col("name").alias("region_name"))
    pos = F.col("pos")
    requests = (
        closure.join(parents, "parent_uri", "left")
        .withColumn("region", F.concat(F.lit("/n/r"), (pos % 7).cast("string"))).join(regions, "region", "left")
        .select(
            F.col("uri").alias("request_id"), "path",
            F.when(pos % 3 == 0, "either").when(pos % 3 == 1, "album").otherwise("folder").alias("kind"),
            F.when(pos % 5 == 0, F.coalesce("region_name", F.lit("gone")))
            .when(pos % 5 == 1, F.coalesce("up", F.lit("")))
            .when(pos % 5 == 2, F.concat("path", F.lit("/x")))
            .when(pos % 5 == 3, "").otherwise("AFRICA/nowhere").alias("destination"),
        )
    )
    return tree.validate_moves(closure, requests).select("request_id", "verdict")


@check("validate_renames", f"""
WITH RECURSIVE {_CLOSURE},
r AS (SELECT uri AS request_id, path, parent_uri, name, CASE pos % 8 WHEN 0 THEN name WHEN 1 THEN '  ' WHEN 2 THEN 'a/b' WHEN 3 THEN 'Album 3' WHEN 4 THEN repeat('n', 255) ELSE concat(name, '!') END AS new_name,
             CASE pos % 6 WHEN 0 THEN 'Good-Name1' WHEN 1 THEN 'bad' ELSE NULL END AS url_name FROM closure),
named AS (SELECT path, count(*) AS nodes FROM closure WHERE node_type <> 'Page' AND depth > 0 GROUP BY path)
SELECT request_id, CASE
  WHEN trim(new_name) = '' THEN 'name empty' WHEN contains(new_name, '/') THEN 'name has a slash' WHEN length(new_name) > 254 THEN 'name too long'
  WHEN url_name = 'bad' THEN 'url name invalid'
  WHEN r.path = '' THEN 'empty' WHEN coalesce(nodes, 0) = 0 THEN 'missing' WHEN nodes > 1 THEN 'ambiguous'
  WHEN name = new_name AND url_name IS NULL THEN 'same name'
  WHEN EXISTS (SELECT 1 FROM v_nodes n WHERE n.parent_uri = r.parent_uri AND n.name = r.new_name AND n.uri <> r.request_id) THEN 'name taken'
  ELSE 'ok' END AS verdict
FROM r LEFT JOIN named ON named.path = r.path
""")
def _(t):
    closure = _closed(t)
    pos, name = F.col("pos"), F.col("name")
    requests = closure.select(
        F.col("uri").alias("request_id"), "path",
        F.when(pos % 8 == 0, name).when(pos % 8 == 1, "  ").when(pos % 8 == 2, "a/b").when(pos % 8 == 3, "Album 3")
        .when(pos % 8 == 4, F.repeat(F.lit("n"), F.lit(255))).otherwise(F.concat(name, F.lit("!"))).alias("new_name"),
        F.when(pos % 6 == 0, "Good-Name1").when(pos % 6 == 1, "bad").alias("url_name"),
    )
    return tree.validate_renames(closure, requests).select("request_id", "verdict")


_DRIFT = f"""
WITH RECURSIVE {_CLOSURE}
SELECT path, node_type, sort_method,
       CASE WHEN (node_type = 'Folder' AND sort_method = 'Name') OR (node_type = 'Album' AND sort_method = 'Date Taken') THEN 'already' ELSE 'changed' END AS status
FROM closure WHERE node_type <> 'Page' AND (path = (SELECT min(r_name) FROM region) OR starts_with(path, concat((SELECT min(r_name) FROM region), '/')))
"""


def _first_region(t):
    return t.region.agg(F.min("r_name")).first()[0]


@check("sort_drift", _DRIFT)
def _(t):
    return tree.sort_drift(_closed(t), _first_region(t), folders_by="name", albums_by="taken", recursive=True)


@check("sort_drift_counts", _DRIFT.replace("SELECT path, node_type, sort_method,", ", drift AS (SELECT path, node_type, sort_method,", 1) + """)
SELECT count(*) FILTER (node_type = 'Folder' AND status = 'changed') AS folders_changed, count(*) FILTER (node_type = 'Folder' AND status = 'already') AS folders_already,
       count(*) FILTER (node_type = 'Album' AND status = 'changed') AS albums_changed, count(*) FILTER (node_type = 'Album' AND status = 'already') AS albums_already
FROM drift
""")
def _(t):
    drift = tree.sort_drift(_closed(t), _first_region(t), folders_by="name", albums_by="taken", recursive=True)
    return tree.sort_drift_counts(drift)


@check("plan_structure", """
WITH d AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN dir WHEN doc_id % 3 = 1 THEN concat(dir, '/', lang) ELSE concat(dir, '/', lang, '/', source) END AS path FROM v_files),
f AS (SELECT DISTINCT split_part(path, '/', 1) AS path FROM d WHERE contains(path, '/')
      UNION SELECT DISTINCT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) FROM d WHERE length(path) - length(replace(path, '/', '')) = 2),
a AS (SELECT path, 'Album' AS kind FROM d UNION ALL SELECT path, 'Folder' FROM f)
SELECT path, kind, regexp_extract(path, '[^/]*$') AS name, path IN (SELECT path FROM d) AND path IN (SELECT path FROM f) AS both FROM a
""")
def _(t):
    place = F.when(F.col("doc_id") % 3 == 0, F.col("dir")).when(
        F.col("doc_id") % 3 == 1, F.concat_ws("/", "dir", "lang")
    ).otherwise(F.concat_ws("/", "dir", "lang", "source"))
    files = t.files.select(F.concat(F.lit("/lib/"), place, F.lit("/"), "file_name").alias("path"))
    return tree.plan_structure(files, "/lib")


# Directories named like the tree's regions and nations, some of them there.
@check("missing_structure", """
SELECT path, kind FROM (
  SELECT DISTINCT r_name AS path, 'Folder' AS kind FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT DISTINCT concat(r_name, '/', n_name), 'Album' FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT DISTINCT '', 'Album' FROM region
  UNION ALL SELECT DISTINCT concat('NEW_', r_name), 'Folder' FROM region
  UNION ALL SELECT DISTINCT concat('NEW_', r_name, '/', cast(r_regionkey AS varchar)), 'Album' FROM region) w
WHERE NOT (kind = 'Folder' AND path IN (SELECT r_name FROM region))
""")
def _(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("d"))
    fresh = t.region.select(F.concat(F.lit("NEW_"), "r_name", F.lit("/"), F.col("r_regionkey").cast("string")).alias("d"))
    files = places.unionByName(fresh).select(F.concat(F.lit("/lib/"), "d", F.lit("/x.jpg")).alias("path"))
    root = t.region.select(F.concat(F.lit("/lib/"), "r_name", F.lit(".jpg")).alias("path"))
    wanted = tree.plan_structure(files.unionByName(root), "/lib")
    return tree.missing_structure(wanted, _closed(t)).select("path", "kind")


# The tree has the year folders of every second year.
@check("new_directories", """
WITH w AS (SELECT strftime(day, '%Y') AS path, 1 AS depth FROM v_dated UNION SELECT strftime(day, '%Y/%m'), 2 FROM v_dated UNION SELECT strftime(day, '%Y/%m/%Y-%m-%d'), 3 FROM v_dated)
SELECT path, cast(depth AS bigint) AS depth FROM w WHERE NOT (depth = 1 AND path IN (SELECT cast(2014 + 2 * (n_nationkey % 2) AS varchar) FROM nation))
""")
def _(t):
    years = t.nation.select(
        F.concat(F.lit("/n/y"), F.col("n_nationkey").cast("string")).alias("uri"), F.lit("/n/root").alias("parent_uri"),
        (2014 + 2 * (F.col("n_nationkey") % 2)).cast("string").alias("name"), F.lit("Folder").alias("node_type"),
        F.col("n_nationkey").alias("pos"), F.lit("Name").alias("sort_method"),
    )
    closure = tree.node_closure(t.nodes.unionByName(years))
    return tree.new_directories(t.dated, closure).select("path", F.col("depth").cast("bigint").alias("depth"))


_TAKEN = "cast(taken AS timestamp)"


_BY_TEXT = """
SELECT image_key, title FROM v_images
WHERE (contains(lower(title), 'photo') OR contains(lower(caption), 'photo') OR contains(lower(keywords), 'photo') OR contains(lower(file_name), 'photo'))
  AND (contains(lower(title), 'd0') OR contains(lower(caption), 'd0') OR contains(lower(keywords), 'd0') OR contains(lower(file_name), 'd0'))
ORDER BY taken DESC, image_key LIMIT 100
"""


@check("search_by_text", _BY_TEXT)
def _(t):
    return search.search_images(_images(t), text="PHOTO d0").select("image_key", "title")


@check("search_by_text_index", _BY_TEXT)
def _(t):
    images = _images(t)
    index = TextIndex(t.spark, scratch_dir(t.spark, "text-index"))
    index.write(0, images)
    return index.search(images, "PHOTO d0").select("image_key", "title")


@check("search_by_keyword", """
SELECT image_key FROM v_images WHERE upload_seq % 4 < 2 AND starts_with(keywords, 'en;') ORDER BY taken DESC, image_key LIMIT 20
""")
def _(t):
    return search.search_images(_images(t), keywords=["BEACH ", "en"], limit=20).select("image_key")


@check("search_by_date", f"""
SELECT image_key, strftime(taken, '%Y-%m-%d') AS day FROM v_images
WHERE taken >= TIMESTAMP '2015-03-08 10:00:00' AND taken <= TIMESTAMP '2016-07-15 19:30:59'
""")
def _(t):
    # 02:00 on the first day was skipped, so it begins an hour later.
    found = search.search_images(_images(t), taken_from="2015-03-08 02:00:00", taken_to=" 2016-07-15T12:30", limit=0)
    return found.select("image_key", F.date_format("taken", "yyyy-MM-dd").alias("day"))


def _images(t):
    return t.images.withColumn("taken", F.col("taken").cast("timestamp_ntz"))


@check("recent_images", "SELECT image_key, upload_seq FROM v_images ORDER BY upload_seq DESC, image_key LIMIT 20")
def _(t):
    return search.recent_images(t.images).select("image_key", "upload_seq")


@check("listing_order", "SELECT image_key, file_name, row_number() OVER (ORDER BY file_name DESC, image_key) AS position FROM v_images")
def _(t):
    listed = search.with_position(search.listing_order(t.images, "Filename", "Descending"))
    return listed.select("image_key", "file_name", "position")


@check("listing_order_by_date_taken", "SELECT image_key, row_number() OVER (ORDER BY taken, image_key) AS position FROM v_images")
def _(t):
    return search.with_position(search.listing_order(t.images, "Date Taken")).select("image_key", "position")


@check("folder_listing_order", "SELECT uri, name, row_number() OVER (ORDER BY name, uri) AS position FROM v_nodes")
def _(t):
    return search.with_position(search.folder_listing_order(t.nodes)).select("uri", "name", "position")


_KEYWORDS = """
SELECT keyword, count(DISTINCT image_key) AS images
FROM (SELECT image_key, lower(trim(unnest(string_split(replace(keywords, ',', ';'), ';')))) AS keyword FROM v_images) k WHERE keyword <> '' GROUP BY keyword
"""


@check("top_keywords", f"SELECT * FROM ({_KEYWORDS}) k ORDER BY images DESC, keyword LIMIT 5")
def _(t):
    return search.top_keywords(t.images, 5)


@check("all_keywords", _KEYWORDS)
def _(t):
    return search.top_keywords(t.images)


@check("state_stats", """
SELECT count(*) AS entries, cast(coalesce(sum(file_size), 0) AS bigint) AS total_size, strftime(min(uploaded_day), '%Y-%m-%d') AS oldest, strftime(max(uploaded_day), '%Y-%m-%d') AS newest FROM v_hashes
""")
def _(t):
    stats = reports.state_stats(t.hashes, "uploaded_day")
    return stats.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("oldest", "newest")})


@check("date_source_counts", "SELECT date_source, count(*) AS files FROM v_dated GROUP BY date_source")
def _(t):
    return reports.date_source_counts(t.dated)


@check("day_counts", """
SELECT strftime(day, '%Y') AS year, strftime(day, '%Y-%m-%d') AS day, count(*) AS files FROM v_dated GROUP BY day
UNION ALL SELECT strftime(day, '%Y'), 'all', count(*) FROM v_dated GROUP BY strftime(day, '%Y')
""")
def _(t):
    return reports.day_counts(t.dated).select(
        F.col("year").cast("string").alias("year"), F.coalesce(F.col("day").cast("string"), F.lit("all")).alias("day"), "files"
    )


@check("busiest_days", """
SELECT strftime(day, '%Y-%m-%d') AS day, files, files > 20 AS several_albums
FROM (SELECT day, count(*) AS files FROM v_dated GROUP BY day ORDER BY files DESC, day LIMIT 5) d WHERE files > 2
""")
def _(t):
    busy = reports.busiest_days(t.dated, minimum=2, capacity=20)
    return busy.withColumn("day", F.col("day").cast("string"))


@check("transfer_summary", """
SELECT count(*) AS total, count(*) FILTER (status = 200 AND code IS NULL) AS done, count(*) FILTER (NOT (status = 200 AND code IS NULL)) AS failed,
       cast(coalesce(sum(size) FILTER (status = 200 AND code IS NULL), 0) AS bigint) AS bytes FROM v_outcomes
""")
def _(t):
    return reports.transfer_summary(t.outcomes)


@check("first_errors", """
SELECT path, concat(path, ': status ', cast(status AS varchar)) AS message FROM v_outcomes WHERE status <> 200 ORDER BY path LIMIT 20
""")
def _(t):
    actions = t.outcomes.select(
        "path", F.when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string"))).alias("reason"),
        F.when(F.col("status") == 413, "refused").otherwise("failed").alias("action"),
    )
    return reports.first_errors(actions)


# Pages of a listing written from customers, 40 to a page; some lack the array.
def _pages(t):
    item = F.struct(F.col("c_custkey").alias("Key"), F.col("c_name").alias("Name"))
    grouped = t.customer.groupBy(F.floor(F.col("c_custkey") / 40).alias("page")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    bare = F.struct(F.col("page").alias("Pages"))
    full = F.struct(F.struct(F.col("items").alias("Node")).alias("Response"))
    return grouped.select("page", F.when(F.col("page") % 5 == 4, F.to_json(F.struct(bare.alias("Response")))).otherwise(F.to_json(full)).alias("json"))


# Names without padding, of which the tenth comes after the ninth.
@check("limit_pages_by_number", "SELECT c_custkey AS \"Key\" FROM customer WHERE (c_custkey // 10) % 5 <> 4 ORDER BY c_custkey LIMIT 99")
def _(t):
    item = F.struct(F.col("c_custkey").alias("Key"), F.struct(F.col("c_acctbal").cast("decimal(10,2)").alias("Sum")).alias("Account"))
    pages = t.customer.groupBy(F.floor(F.col("c_custkey") / 10).alias("n")).agg(F.sort_array(F.collect_list(item)).alias("Node")).where("n % 5 <> 4")
    held = pages.select(F.concat(F.lit("page-"), F.col("n").cast("string"), F.lit(".json")).alias("page"), F.to_json(F.struct(F.struct("Node").alias("Response"))).alias("json"))
    return listing_items(held, "Node", "Key bigint, Account struct<Sum: decimal(10,2)>", limit=99).select("Key")


@check("listing_pages", "SELECT c_custkey AS \"Key\", c_name AS \"Name\" FROM customer WHERE (c_custkey // 40) % 5 <> 4")
def _(t):
    return listing_items(_pages(t), "Node", "Key bigint, Name string").select("Key", "Name")


@check("limit_pages", "SELECT c_custkey AS \"Key\" FROM customer WHERE (c_custkey // 40) % 5 <> 4 ORDER BY c_custkey LIMIT 45")
def _(t):
    return listing_items(_pages(t), "Node", "Key bigint, Name string", limit=45).select("Key")


# Sizes of an image described as the service does, written from parts.
@check("pick_variant", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'u/X2Large' WHEN p_size % 3 = 0 THEN 'none' ELSE 'u/Medium' END AS url FROM part
""")
def _(t):
    from shelfmark.operators.remote import pick_variant
    from shelfmark.sources.listing import size_details

    def entry(name):
        return F.struct(F.lit(f"u/{name}").alias("Url"), F.lit("jpg").alias("Ext"), F.lit(100).alias("Width"), F.lit(50).alias("Height"))

    even = F.col("p_size") % 2 == 0
    usable = F.when(even, F.array(F.lit("ImageSizeMedium"), F.lit("ImageSizeX2Large"))).otherwise(F.array(F.lit("ImageSizeMedium")))
    text = F.to_json(F.struct(
        usable.alias("UsableSizes"),
        F.when(F.col("p_size") % 3 == 0, "ImageSizeTiny").otherwise("ImageSizeMedium").alias("LargestImageSize"),
        entry("Medium").alias("ImageSizeMedium"), F.when(even, entry("X2Large")).alias("ImageSizeX2Large"),
    ))
    picked = pick_variant(size_details(t.part.select("p_partkey", text.alias("json"))), "X2Large")
    return picked.select("p_partkey", F.coalesce("picked.url", F.lit("none")).alias("url"))
