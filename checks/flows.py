"""Sources, sinks and streams over the driver's tables, written to shared storage first."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import _DRIFT, _closed, _first_region
from checks.columns import AS_OF
from checks.plans import images as listed_images
from checks.plans import inventory as inventory_with_content
from checks.registry import check
from shelfmark.operators import change, reports, tree
from shelfmark.plans import dated
from shelfmark.session import scratch_dir
from shelfmark.sources import inventory, listing, state
from shelfmark.streaming import jobs


@check("inventory_table", "SELECT path, size, CASE WHEN doc_id % 4 > 1 THEN mtime_ns ELSE 0 END AS mtime_ns FROM v_files")
def _(t):
    mtime = F.when(F.col("doc_id") % 4 == 0, -F.col("mtime_ns")).when(F.col("doc_id") % 4 > 1, F.col("mtime_ns"))
    return inventory.inventory_table(t.files.select("path", "size", mtime.alias("mtime_ns")))


@check("read_listing_pages", 'SELECT n_nationkey AS "Key", n_name AS "Name" FROM nation')
def _(t):
    folder = scratch_dir(t.spark, "pages")
    item = F.struct(F.col("n_nationkey").alias("Key"), F.col("n_name").alias("Name"))
    pages = t.nation.groupBy("n_regionkey").agg(F.collect_list(item).alias("items"))
    pages.select(F.struct(F.col("items").alias("Node")).alias("Response")).repartition(1).write.option("maxRecordsPerFile", 1).json(folder)
    return listing.read_listing_pages(t.spark, folder, "Node", "Key int, Name string").select("Key", "Name")


@check("state_snapshots", """
SELECT path, size, coalesce(image_uri, '') AS image_uri, captioned FROM v_state
""")
def _(t):
    folder = scratch_dir(t.spark, "state")
    full = change.complete_state(t.state)
    none = t.spark.createDataFrame([], state.HASHES_SCHEMA)
    state.write_state(t.spark, folder, full.where("captioned"), none)
    before, hashes = state.read_state(t.spark, folder)
    state.write_state(t.spark, folder, change.upsert(before, full, "path"), hashes)
    files, _ = state.read_state(t.spark, folder)
    return files.select("path", "size", F.coalesce("image_uri", F.lit("")).alias("image_uri"), "captioned")


# Records written in many versions, a part of the paths in each, some of them twice and some gone again.
@check("state_deltas", """
WITH w AS (SELECT s.* FROM v_state s JOIN v_files f ON f.path = s.path WHERE f.doc_id % 9 <> 4)
SELECT path, size, coalesce(image_uri, '') AS image_uri, coalesce(refs, 0) AS refs
FROM w LEFT JOIN (SELECT image_uri AS uri, count(*) AS refs FROM w GROUP BY image_uri) r ON r.uri = w.image_uri
""")
def _(t):
    folder = scratch_dir(t.spark, "state")
    full = change.complete_state(t.state).join(t.files.select("path", "doc_id"), "path")
    none = t.spark.createDataFrame([], state.HASHES_SCHEMA)
    stale = full.withColumns({"size": -F.col("size"), "image_uri": F.concat(F.lit("old"), "path")})
    for part in range(3):
        mine = F.col("doc_id") % 3 == part
        earlier = stale.where(F.col("doc_id") % 3 == (part + 1) % 3) if part < 2 else stale.limit(0)
        state.append_state(t.spark, folder, full.where(mine).unionByName(earlier), none)
    state.append_state(t.spark, folder, full.limit(0), none, gone_files=full.where("doc_id % 9 = 4").select("path"))
    files, _ = state.read_state(t.spark, folder)
    refs = state.state_log(t.spark, folder).read("refs")
    return files.join(refs, "image_uri", "left").select("path", "size", F.coalesce("image_uri", F.lit("")).alias("image_uri"), F.coalesce("refs", F.lit(0)).alias("refs"))


@check("run_summary_document", """
SELECT count(*) AS total, count(*) FILTER (status = 200 AND code IS NULL) AS done, count(*) FILTER (NOT (status = 200 AND code IS NULL)) AS failed,
       cast(coalesce(sum(size) FILTER (status = 200 AND code IS NULL), 0) AS bigint) AS bytes FROM v_outcomes
""")
def _(t):
    folder = scratch_dir(t.spark, "summary")
    state.write_run_summary(reports.transfer_summary(t.outcomes), folder)
    return t.spark.read.schema("total bigint, done bigint, failed bigint, bytes bigint").json(folder)


@check("examples", _DRIFT.replace("SELECT path, node_type, sort_method,", ", drift AS (SELECT path, node_type, sort_method,", 1) + """)
SELECT path FROM drift WHERE status = 'changed' ORDER BY path LIMIT 10
""")
def _(t):
    drift = tree.sort_drift(_closed(t), _first_region(t), folders_by="name", albums_by="taken", recursive=True)
    return reports.examples(drift)


def _stream(t, frame, files=3):
    """`frame` as a stream of one file to a batch."""
    folder = scratch_dir(t.spark, "arriving")
    frame.repartition(files, "path").write.parquet(folder)
    return t.spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _collected(t, stream, mode="append"):
    """What the stream has given once all there is has arrived."""
    out, checkpoint = scratch_dir(t.spark, "given"), scratch_dir(t.spark, "progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return t.spark.read.parquet(out)


def _folders(t, *names):
    return [scratch_dir(t.spark, name) for name in names]


# Which path leads follows the order of arrival; that one leads, and all follow it, does not.
@check("stream_dedup", """
SELECT path, sha256, cast(1 AS bigint) AS leaders, count(*) OVER (PARTITION BY sha256) AS told FROM v_dated
""")
def _(t):
    leaders, told, progress = _folders(t, "leaders", "told", "progress")
    jobs.stream_dedup(_stream(t, t.dated.select("path", "sha256")), leaders, told, progress).awaitTermination()
    rows = t.spark.read.parquet(told)
    groups = rows.groupBy("sha256").agg(
        F.count_distinct("leader").alias("leaders"), F.count("*").alias("told"), F.sum(F.col("is_leader").cast("int")).alias("_leading"),
    ).where("_leading = 1")
    return rows.join(groups, "sha256").select("path", "sha256", "leaders", "told")


@check("stream_day_counts", """
SELECT strftime(day, '%Y-%m-%d') AS day, date_source, count(*) AS files FROM v_dated GROUP BY day, date_source
""")
def _(t):
    # In steps, the newest days first, each batch giving what it changed.
    days = t.dated.select("path", "day", "date_source")
    folder, out, progress = _folders(t, "arriving", "given", "progress")
    for low, high in ((2016, 9999), (2015, 2016), (0, 2015)):
        days.where((F.year("day") >= low) & (F.year("day") < high)).write.mode("append").parquet(folder)
        counts = jobs.stream_day_counts(t.spark.readStream.schema(days.schema).parquet(folder))
        writer = counts.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True)
        writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    last = t.spark.read.parquet(out).groupBy("day", "date_source").agg(F.max_by("files", "batch").alias("files"))
    return last.withColumn("day", F.col("day").cast("string"))


# Each file arrives as it is recorded, some having been refused, and then as it is now.
@check("stream_change_detect", """
SELECT f.path, CASE WHEN s.path IS NULL THEN 'new' WHEN s.size = f.size AND s.mtime_ns = f.mtime_ns THEN CASE WHEN s.failed IS NULL THEN 'unchanged' ELSE 'refused' END
                    WHEN s.sha256 = f.sha256 THEN 'touched' ELSE 'changed' END AS status
FROM v_files f LEFT JOIN v_state s ON s.path = f.path
UNION ALL SELECT path, 'new' FROM v_state
""")
def _(t):
    columns = ["path", "size", "mtime_ns", "sha256", "failed"]
    folder, records, told, progress = _folders(t, "arriving", "records", "told", "progress")
    for part in (t.state.select(*columns), t.files.withColumn("failed", F.lit(None).cast("string")).select(*columns)):
        part.write.mode("append").parquet(folder)
        source = t.spark.readStream.schema(part.schema).parquet(folder)
        jobs.stream_change_detect(source, records, told, progress).awaitTermination()
    return t.spark.read.parquet(told).select("path", "status")


# Which batch a file comes in decides its album and name; what no order may break does not.
@check("stream_plan", """
SELECT count(*) AS files, cast(0 AS bigint) AS names_given_twice, cast(0 AS bigint) AS albums_overfull, cast(0 AS bigint) AS contents_sent_twice, cast(0 AS bigint) AS copies_collected_to_their_own_day
FROM v_files WHERE ext <> 'xmp'
""")
def _(t):
    state_folder, actions_folder, progress = _folders(t, "state", "actions", "progress")
    options = dated.DatedOptions(as_of=AS_OF, root="/lib", capacity=5, raw_handling="upload")
    albums = t.albums.select("album_key", "name", F.least("image_count", F.lit(3)).alias("image_count"))
    source = _stream(t, inventory_with_content(t), files=2)
    jobs.stream_plan(source, state_folder, actions_folder, albums, listed_images(t), options, progress).awaitTermination()
    done = t.spark.read.parquet(actions_folder)
    sent = done.where("action = 'uploaded'")
    held = sent.select("album_name", "target_name").unionByName(
        listed_images(t).join(albums, "album_key").select(F.col("name").alias("album_name"), F.col("file_name").alias("target_name")).distinct())
    twice = held.groupBy("album_name", "target_name").count().where("count > 1")
    filled = done.where("action IN ('uploaded', 'collected')").groupBy("album_name").count().join(
        albums.groupBy(F.col("name").alias("album_name")).agg(F.max("image_count").alias("_had")), "album_name", "left"
    ).where("count + coalesce(_had, 0) > 5")
    again = sent.groupBy("sha256").count().where("count > 1")
    own_day = done.where("action = 'collected'").join(sent.select("sha256", "day"), ["sha256", "day"], "left_semi")
    one = lambda frame: frame.agg(F.count("*")).scalar()
    return done.agg(F.count("*").alias("files")).select(
        "files", one(twice).alias("names_given_twice"), one(filled).alias("albums_overfull"),
        one(again).alias("contents_sent_twice"), one(own_day).alias("copies_collected_to_their_own_day"),
    )


@check("stream_assign_slots", """
SELECT series, cast(n AS bigint) AS n, least(5, files - 5 * (n - 1)) AS files
FROM (SELECT cast(day AS varchar) AS series, count(*) AS files, unnest(range(1, cast(ceil(count(*) / 5.0) AS bigint) + 1)) AS n FROM v_orders_files GROUP BY day) s
""")
def _(t):
    arriving = _stream(t, t.orders_files.select("path", F.col("day").cast("string").alias("series")))
    placed, counts = scratch_dir(t.spark, "placed"), scratch_dir(t.spark, "counts")
    query = jobs.stream_assign_slots(arriving, counts, placed, scratch_dir(t.spark, "progress"), capacity=5)
    query.awaitTermination()
    # Which file gets which slot follows the order of arrival; how full each album is does not.
    found = t.spark.read.parquet(placed).groupBy("series", "n").agg(F.count("*").alias("files"))
    return found.withColumn("n", F.col("n").cast("bigint"))
