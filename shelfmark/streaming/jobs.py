"""Streaming forms of planning, deduplication, change detection and placement.

State is kept in tables and changed by batch operators in `foreachBatch`, which
split hot keys (the albums of one busy series, the copies of one content).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from shelfmark import constants as C
from shelfmark.operators import change, copies, series
from shelfmark.plans import dated
from shelfmark.session import cut
from shelfmark.skew import salted_join
from shelfmark.sources import state as stored
from shelfmark.sources.log import Log, Table


def _run(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Without an interval, all there is now and then stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def stream_plan(
    files: DataFrame,
    state_folder: str,
    actions_folder: str,
    albums: DataFrame,
    images: DataFrame,
    options: dated.DatedOptions,
    checkpoint: str,
    interval: str | None = None,
    outcomes_folder: str | None = None,
) -> StreamingQuery:
    """Plan each batch of arriving files and keep the state it leads to.

    Batches never overlap.  A batch reads the records of its own paths, contents
    and images, and writes as a version of the state what it changes, so both
    follow the batch; done again after a failure it gives the same version.
    The newest KEPT_VERSIONS stay.  Albums filled and names given by a batch
    are part of the catalog that the next one plans against.

    Actions are recorded as if all had gone well.  With `outcomes_folder`, which
    `stream_outcomes` fills, those that didn't are taken back before the next
    batch is planned: their records, contents, slots and names, and the copies
    that followed them (`_taken_back`).  Then batch n writes version 2n + 2 and
    the corrections before it are version 2n + 1.

    The folder belongs to this stream and its checkpoint: to go on from other
    state, write that as version 0 before the first start.
    """
    spark = files.sparkSession
    log, catalog = stored.state_log(spark, state_folder), Log(spark, f"{state_folder}/catalog", _CATALOG)
    steps = 2 if outcomes_folder else 1
    feed = _Feed(log, catalog, state_folder, actions_folder, outcomes_folder)

    def plan(batch: DataFrame, batch_id: int) -> None:
        if outcomes_folder:
            feed.correct(batch_id)
        version, written = steps * batch_id + steps - 1, steps * (batch_id + 1)
        current = _read(log, "files", version, batch.select("path"))
        contents = batch.select("sha256").unionByName(current.select("sha256"))
        hashes = _read(log, "hashes", version, contents)
        refs = _read(log, "refs", version, current.select("image_uri"))
        albums_now, images_now = _catalog(catalog, version, albums, images)
        planned = dated.plan_dated(batch, current, hashes, albums_now, images_now, options, image_refs=refs)
        actions = cut(_named_images(dated.with_album_keys(planned, albums_now), batch_id), "actions")
        actions.write.mode("overwrite").parquet(f"{actions_folder}/batch={batch_id}")

        filled, sent = dated.catalog_changes(actions, albums_now)
        had = _read(catalog, "albums", version, filled)
        more = had.unionByName(filled).groupBy("album_key").agg(F.min("name").alias("name"), F.sum("image_count").alias("image_count"))
        catalog.write(written, {"albums": more, "images": sent}, before=bool(outcomes_folder))
        outcomes = dated.outcomes_of(actions, options.caption_source)
        done = outcomes.where(F.col("outcome") != "failed").select("path")
        records = change.apply_outcomes(current, outcomes).join(done, "path", "left_semi")
        after = cut(change.apply_hash_outcomes(hashes, dated.hash_outcomes_of(actions)), "hashes")
        stored.append_state(
            spark, state_folder, records, after.join(hashes, ["sha256", "uri"], "left_anti"),
            gone_hashes=hashes.join(after, "sha256", "left_anti"), version=written, before=bool(outcomes_folder),
        )
        for kept in (log, catalog):
            kept.drop(steps * KEPT_VERSIONS)

    return _run(files.writeStream.foreachBatch(plan), checkpoint, interval)


# Versions of the state kept: one to read, one that a batch done again may need, and spares.
KEPT_VERSIONS = 4
# What batches have put into the catalog: images to an album, images by name, and actions taken back.
_CATALOG = {
    "albums": Table("album_key string, name string, image_count bigint", ("album_key",)),
    "images": Table("album_key string, file_name string, md5 string, uri string", ("uri",)),
    "undone": Table("batch bigint, path string", ("batch", "path"), "path"),
}
_OUTCOMES = {"": Table("batch bigint, path string, outcome string, reason string", ("batch", "path"), "path")}


def _read(log: Log, name: str, version: int, of: DataFrame | None = None) -> DataFrame:
    """The table as of the newest version up to `version`; empty before the first."""
    known = log.newest(version)
    return log.spark.createDataFrame([], log.tables[name].schema) if known is None else log.read(name, known, of)


def _catalog(catalog: Log, version: int, albums: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listed catalog and what earlier batches have put there since: the newest of each
    image, and how many more images each album has."""
    added = _read(catalog, "albums", version)
    listed = albums.select("album_key", "name", F.coalesce("image_count", F.lit(0)).cast("bigint").alias("image_count"))
    rest = [c for c in albums.columns if c not in ("album_key", "name", "image_count")]
    counts = listed.unionByName(added).groupBy("album_key").agg(F.min("name").alias("name"), F.sum("image_count").alias("image_count"))
    if rest:
        counts = counts.join(albums.select("album_key", *rest), "album_key", "left")
    # A replaced image has its new content from then on.
    held = _read(catalog, "images", version)
    kept = images.select("album_key", "file_name", "md5", "uri").join(held.select("uri"), "uri", "left_anti")
    return counts, kept.unionByName(held)


def _named_images(actions: DataFrame, batch_id: int) -> DataFrame:
    """An image without a URI is called by the batch that sends it and its content: the same
    content may be sent again later, when the first image holds another."""
    placed = F.col("action").isin("uploaded", "linked", "collected")
    uri = F.coalesce("image_uri", F.when(placed, F.concat(F.lit(f"planned:{batch_id}:"), "sha256")))
    return actions.withColumn("image_uri", uri)


def stream_outcomes(outcomes: DataFrame, outcomes_folder: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Record what became of planned actions: (batch, path, outcome, reason).

    `outcome` is ok, failed, refused (with the reason; the file is left alone until
    it changes) or collect_refused (the remote no longer has the image).  An outcome told
    again changes nothing; of two in one batch the first by name counts.
    """
    log = Log(outcomes.sparkSession, outcomes_folder, _OUTCOMES, prefix="arrived")

    def record(batch: DataFrame, batch_id: int) -> None:
        told = batch.groupBy("batch", "path").agg(F.min(F.struct("outcome", "reason")).alias("_o"))
        log.write(batch_id, {"": told.select("batch", "path", "_o.outcome", "_o.reason")})

    return _run(outcomes.writeStream.foreachBatch(record), checkpoint, interval)


class _Feed:
    """Takes back, before a batch is planned, what outcomes told since the one before say failed."""

    def __init__(self, log: Log, catalog: Log, state_folder: str, actions_folder: str, outcomes_folder: str | None):
        self.log, self.catalog, self.state_folder, self.actions_folder = log, catalog, state_folder, actions_folder
        self.told = Log(log.spark, outcomes_folder, _OUTCOMES, prefix="arrived") if outcomes_folder else None
        # Which outcomes a batch has seen is settled once: done again, it sees the same.
        self.seen = Log(log.spark, f"{state_folder}/seen", {"": Table("k int, upto bigint", ("k",))}, buckets=1, prefix="batch")

    def _upto(self, batch_id: int) -> int:
        if batch_id < 0:
            return -1
        if batch_id in self.seen.versions():
            return self.seen.read("", batch_id).first()["upto"]
        upto = max(self.told.versions(), default=-1)
        self.seen.write(batch_id, {"": self.log.spark.createDataFrame([(0, upto)], "k int, upto bigint")})
        self.seen.drop(4)
        return upto

    def correct(self, batch_id: int) -> None:
        """Version 2n + 1 of the state and the catalog, where there is anything to take back."""
        after, upto = self._upto(batch_id - 1), self._upto(batch_id)
        if upto <= after:
            return
        news = self.told.since("", after, upto).where(F.col("outcome") != "ok").select("batch", "path", "outcome", "reason")
        version = 2 * batch_id
        undone = _read(self.catalog, "undone", version, news.select("path"))
        news = cut(news.join(undone, ["batch", "path"], "left_anti"), "news")
        # Numbers of batches, few for all their outcomes.
        batches = sorted(r[0] for r in news.select("batch").distinct().collect() if r[0] is not None and r[0] < batch_id)
        if not batches:
            return
        done = self.log.spark.read.option("basePath", self.actions_folder).parquet(*[f"{self.actions_folder}/batch={b}" for b in range(batches[0], batch_id)])
        done = done.withColumn("batch", F.col("batch").cast("bigint"))
        bad = cut(self._taken_back(done, news, version), "taken-back")
        self._write(bad, sorted(r[0] for r in bad.select("batch").distinct().collect()), version)

    def _taken_back(self, done: DataFrame, news: DataFrame, version: int) -> DataFrame:
        """The actions that failed, and those that placed a copy of what wasn't sent."""
        columns = [c for c in done.columns if c != "reason"] + ["outcome", "reason"]
        direct = done.drop("reason").join(news, ["batch", "path"]).select(*columns)
        lost = direct.where(F.col("action") == "uploaded").select("image_uri").distinct()
        followed = done.where(F.col("action").isin("linked", "collected")).join(lost, "image_uri", "left_semi")
        undone = _read(self.catalog, "undone", version, followed.select("path"))
        followed = followed.join(news, ["batch", "path"], "left_anti").join(undone, ["batch", "path"], "left_anti")
        return direct.unionByName(followed.withColumns({"outcome": F.lit("failed"), "reason": F.lit(C.REASON_COPY_FAILED)}).select(*columns))

    def _write(self, bad: DataFrame, batches: list[int], version: int) -> None:
        spark = self.log.spark
        state_now, catalog_now = self.log.newest(version), self.catalog.newest(version)
        sent = F.col("action").isin("uploaded", "replaced")
        pairs = {"files": [], "hashes": [], "images": []}
        for b in batches:
            mine, written = bad.where(F.col("batch") == b), 2 * b + 2
            contents = mine.where(sent).select(F.explode(F.array("sha256", "old_sha256")).alias("sha256")).where("sha256 is not null")
            pairs["files"].append(self.log.reverted("files", written, mine.select("path"), state_now))
            pairs["hashes"].append(self.log.reverted("hashes", written, contents, state_now))
            pairs["images"].append(self.catalog.reverted("images", written, mine.where(sent).select(F.col("image_uri").alias("uri")), catalog_now))
        back = {k: tuple(cut(reduce(DataFrame.unionByName, side), k) for side in zip(*v, strict=True)) for k, v in pairs.items()}

        # A refused file is recorded as such, unless it has changed since.
        refused = bad.where(F.col("outcome") == "refused").join(
            back["files"][0].select("path").unionByName(back["files"][1].select("path")), "path", "left_semi"
        ).select("path", "size", "mtime_ns", "sha256", F.col("day").alias("capture_date"), "date_source", F.col("reason").alias("failed"), F.lit("refused").alias("outcome"))
        marked = change.apply_outcomes(self.log.read("files", state_now, refused.select("path")), refused)
        files = change.upsert(change.complete_state(back["files"][0]), marked, "path")
        gone_files = back["files"][1].join(refused.select("path"), "path", "left_anti")
        # Content whose image is no longer there is forgotten, so its next file is sent.
        lost = bad.where(F.col("outcome") == "collect_refused").select("sha256", F.col("image_uri").alias("uri")).distinct()
        known = self.log.read("hashes", state_now, lost.select("sha256"))
        hashes = back["hashes"][0].join(lost, ["sha256", "uri"], "left_anti")
        gone_hashes = back["hashes"][1].unionByName(known.join(lost, ["sha256", "uri"], "left_semi").select("sha256")).distinct().join(hashes, "sha256", "left_anti")
        fewer = bad.where(F.col("action").isin("uploaded", "collected")).groupBy("album_key").agg(
            F.min("album_name").alias("name"), (-F.count("*")).alias("image_count")
        )
        had = self.catalog.read("albums", catalog_now, fewer)
        counts = had.unionByName(fewer).groupBy("album_key").agg(F.max("name").alias("name"), F.sum("image_count").alias("image_count"))
        self.catalog.write(
            version + 1, {"albums": counts, "images": back["images"][0], "undone": bad.select("batch", "path")}, {"images": back["images"][1]}, before=True
        )
        stored.append_state(spark, self.state_folder, files, hashes, gone_files, gone_hashes, version + 1, before=True)


def _leaders(spark: SparkSession, folder: str) -> Log:
    return Log(spark, folder, {"": Table("sha256 string, leader string", ("sha256",))}, prefix="batch")


def _write_batch(frame: DataFrame, folder: str, batch_id: int) -> None:
    frame.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def stream_dedup(
    files: DataFrame, leaders_folder: str, told_folder: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Every arriving file (path, sha256) with its `leader`, and whether it is that.

    The first path of a content's first batch leads; all later ones follow it.
    A batch looks up the leaders of its own contents, in their buckets alone,
    and writes those it adds, so what it reads and writes follows the batch.
    """
    leaders = _leaders(files.sparkSession, leaders_folder)

    def tell(batch: DataFrame, batch_id: int) -> None:
        known = _read(leaders, "", batch_id - 1, batch.select("sha256"))
        elected = copies.elect_copies(batch)
        joined = salted_join(elected, known.withColumnRenamed("leader", "_led"), ["sha256"], "left", spread=["path"])
        told = cut(joined.select(
            *batch.columns, F.coalesce("_led", "leader").alias("leader"),
            (F.col("_led").isNull() & F.col("is_leader")).alias("is_leader"),
        ), "told")
        _write_batch(told, told_folder, batch_id)
        leaders.write(batch_id, {"": told.where("is_leader").select("sha256", "leader")})
        leaders.drop(KEPT_VERSIONS)

    return _run(files.writeStream.foreachBatch(tell), checkpoint, interval)


def stream_change_detect(
    files: DataFrame, records_folder: str, told_folder: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """(path, status, mtime_ns) of every arrival, against the one before.

    `files` holds path, size, mtime_ns, sha256 and, where an arrival was
    refused, `failed`.  Status is new, changed, touched, unchanged or refused:
    a refused file stays so until its size or time changes.  A batch looks up
    its own paths, in their buckets alone, and writes the last record of each;
    the newest of a path counts.
    """
    record = "path string, size bigint, mtime_ns bigint, sha256 string, failed string"
    records = Log(files.sparkSession, records_folder, {"": Table(record, ("path",))}, prefix="batch")

    def detect(batch: DataFrame, batch_id: int) -> None:
        if "failed" not in batch.columns:
            batch = batch.withColumn("failed", F.lit(None).cast("string"))
        last = _read(records, "", batch_id - 1, batch.select("path")).select("path", F.struct("size", "mtime_ns", "sha256", "failed").alias("_known"))
        arrived = batch.select("path", F.struct("size", "mtime_ns", "sha256", "failed").alias("_now"))
        # A batch brings a path a few times at most.
        order = Window.partitionBy("path").orderBy("_now.mtime_ns", "_now.size", "_now.sha256")
        paired = arrived.withColumns({"_last": F.lag("_now").over(order), "_next": F.lead("_now").over(order)}).join(last, "path", "left")
        before = F.coalesce("_last", "_known")
        same = (before["size"] == F.col("_now.size")) & (before["mtime_ns"] == F.col("_now.mtime_ns"))
        told = cut(paired.select(
            "path",
            F.when(before.isNull(), "new")
            .when(same & before["failed"].isNotNull(), "refused")
            .when(same, "unchanged")
            .when(F.col("_now.sha256") == before["sha256"], "touched")
            .otherwise("changed").alias("status"),
            F.col("_now.mtime_ns").alias("mtime_ns"), "_now", F.col("_next").isNull().alias("_newest"),
            # Refusal lasts while nothing changes.
            F.coalesce("_now.failed", F.when(same, before["failed"])).alias("_failed"),
        ), "told")
        _write_batch(told.select("path", "status", "mtime_ns"), told_folder, batch_id)
        newest = told.where("_newest").select(
            "path", "_now.size", "_now.mtime_ns", "_now.sha256", F.col("_failed").alias("failed")
        )
        records.write(batch_id, {"": newest})
        records.drop(KEPT_VERSIONS)

    return _run(files.writeStream.foreachBatch(detect), checkpoint, interval)


def stream_assign_slots(
    files: DataFrame, albums_folder: str, placed_folder: str, checkpoint: str,
    capacity: int = C.ALBUM_CAPACITY, interval: str | None = None,
    albums: DataFrame | None = None,
) -> StreamingQuery:
    """Place arriving files (path, series) into album series.

    The albums' counts are a log: a batch reads the albums of its own series
    and writes those it fills.  `albums` (series, n, cnt) are those there before.
    """
    counts = Log(files.sparkSession, albums_folder, {"": Table("series string, n int, cnt bigint", ("series", "n"))})

    def place(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0 and albums is not None:
            counts.write(0, {"": albums}, whole=True)
        before = cut(_read(counts, "", batch_id, batch.select("series")), "albums")
        assigned = cut(series.assign_slots(batch, before, capacity), "slots")
        assigned.write.mode("overwrite").parquet(f"{placed_folder}/batch={batch_id}")
        claimed = assigned.where(F.col("n").isNotNull()).groupBy("series", "n").agg(F.count("*").alias("cnt"))
        after = before.join(claimed.select("series", "n"), ["series", "n"], "left_semi").unionByName(claimed)
        counts.write(batch_id + 1, {"": after.groupBy("series", "n").agg(F.sum("cnt").cast("bigint").alias("cnt"))})
        counts.drop(KEPT_VERSIONS)

    return _run(files.writeStream.foreachBatch(place), checkpoint, interval)


def stream_day_counts(files: DataFrame) -> DataFrame:
    """(day, date_source, files) over files with `day`, however old the day.

    Photos arrive in no order of date, so nothing is too late; what is kept
    are the days and ways of dating, which are few however many the files.
    """
    return files.groupBy("day", "date_source").agg(F.count("*").alias("files"))


def run_repeatedly(start: Callable[[], StreamingQuery], rounds: int) -> list[str | None]:
    """Run an available-now query `rounds` times, one after another; a run that
    fails is reported and the next one still happens."""
    failures: list[str | None] = []
    for _ in range(rounds):
        try:
            start().awaitTermination()
            failures.append(None)
        except Exception as error:  # noqa: BLE001 - reported, not hidden
            failures.append(str(error))
    return failures
