"""Counts, summaries and checks over plans and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.media import outcome_class
from shelfmark.functions.paths import dir_name


def state_stats(hashes: DataFrame, uploaded: str = "uploaded_at") -> DataFrame:
    return hashes.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size"),
        F.min(uploaded).alias("oldest"),
        F.max(uploaded).alias("newest"),
    )


def date_source_counts(dated: DataFrame) -> DataFrame:
    return dated.groupBy("date_source").agg(F.count("*").alias("files"))


def day_counts(dated: DataFrame) -> DataFrame:
    """(year, day, files): per day, with a row of null day for each year."""
    return (
        dated.select(F.year("day").alias("year"), "day")
        .rollup("year", "day").agg(F.count("*").alias("files"), F.grouping_id().alias("_level"))
        .where(F.col("_level") < 3).drop("_level")
    )


def busiest_days(
    dated: DataFrame, k: int = C.BUSY_DAYS, minimum: int = C.BUSY_DAY_FILES, capacity: int = C.ALBUM_CAPACITY
) -> DataFrame:
    """The k busiest days, of which those above `minimum` are shown."""
    top = dated.groupBy("day").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "day").limit(k)
    return top.where(F.col("files") > minimum).withColumn("several_albums", F.col("files") > capacity)


def files_per_directory(files: DataFrame) -> DataFrame:
    return files.groupBy(dir_name(F.col("path")).alias("directory")).agg(
        F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes")
    )


def _total(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")


def run_summary(actions: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """One row of counters from a plan's actions, in one pass.

    `captions` has a row per image whose caption was set, with `outcome` ok,
    gone (the image has vanished) or failed.
    """
    action = F.col("action")
    processed = action != "unchanged"
    counted = ["touched", "uploaded", "replaced", "linked", "collected", "failed", "refused"]
    created = F.count_distinct(F.when(F.col("created"), F.col("album_name")))
    counts = actions.agg(
        F.count("*").alias("scanned"),
        F.count_if(action == "unchanged").alias("unchanged"),
        F.count_if((action == "unchanged") & F.col("previously_refused")).alias("previously_refused"),
        F.count_if(processed).alias("to_process"),
        _total(processed, F.col("size")).alias("bytes_to_process"),
        *[F.count_if(action == name).alias(name) for name in counted],
        _total(action.isin("uploaded", "replaced"), F.col("size")).alias("bytes_uploaded"),
        created.alias("albums_created"),
    )
    named = {"captioned": "ok", "vanished": "gone", "caption_failed": "failed"}
    if captions is None:
        return counts.withColumns({name: F.lit(0).cast("bigint") for name in named})
    told = captions.agg(F.struct(*[F.count_if(F.col("outcome") == kind).alias(name) for name, kind in named.items()]))
    return counts.withColumn("_told", told.scalar()).select("*", "_told.*").drop("_told")


def summary_maps(actions: DataFrame) -> DataFrame:
    """One row: processed files per way of dating and per day, as maps."""
    processed = actions.where((F.col("action") != "unchanged") & F.col("day").isNotNull())

    def as_map(key: Column, name: str) -> DataFrame:
        # Ways of dating and days are few however many the files.
        counts = processed.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"))
        entries = F.sort_array(F.collect_list(F.struct("_key", "_n")))
        return counts.agg(F.map_from_entries(entries).alias(name))

    sources = as_map(F.col("date_source"), "date_sources")
    days = as_map(F.date_format("day", "yyyy-MM-dd"), "days")
    return sources.withColumn("days", days.scalar())


def first_errors(actions: DataFrame, limit: int = C.ERROR_LIMIT) -> DataFrame:
    """The first messages, in path order, of a report that shows only some."""
    failed = actions.where(F.col("reason").isNotNull() & F.col("action").isin("failed", "refused"))
    return failed.select("path", F.concat("path", F.lit(": "), "reason").alias("message")).orderBy("path").limit(limit)


def examples(drift: DataFrame, limit: int = C.EXAMPLE_LIMIT) -> DataFrame:
    return drift.where(F.col("status") == "changed").select("path").orderBy("path").limit(limit)


def transfer_summary(outcomes: DataFrame) -> DataFrame:
    """(total, done, failed, bytes) of transfers with a status and code."""
    ok = outcome_class(F.col("status"), F.col("code")) == "ok"
    return outcomes.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("done"),
        F.count_if(~ok).alias("failed"),
        _total(ok, F.col("size")).alias("bytes"),
    )


def comment_problem(text: Column, name: Column, email: Column, rating: Column) -> Column:
    return (
        F.when(F.octet_length(text) == 0, "text empty")
        .when(F.octet_length(text) > C.MAX_COMMENT_BYTES, "text too long")
        .when(F.octet_length(name) > C.MAX_COMMENT_FIELD_BYTES, "name too long")
        .when(F.octet_length(email) > C.MAX_COMMENT_FIELD_BYTES, "email too long")
        .when(rating > C.MAX_RATING, "rating out of range")
    )


def quarantine_comments(comments: DataFrame) -> DataFrame:
    """Adds `problem`: the first reason to reject a comment, null to accept it."""
    def column(name: str) -> Column:
        return F.col(name) if name in comments.columns else F.lit(None).cast("string")

    return comments.withColumn(
        "problem", comment_problem(F.coalesce(column("text"), F.lit("")), column("name"), column("email"), column("rating"))
    )
