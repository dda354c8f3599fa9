"""State between runs: versions of a log, and run summaries.

A version holds the records of paths ("files"), of content ("hashes") and how many paths each
image has ("refs"), which follows from the first.  `write_state` writes all of a version,
`append_state` what a run changes; a version counts once its marker is written, which is last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import cut
from shelfmark.sources.log import Log, Table

STATE_SCHEMA = (
    "path string, size bigint, mtime_ns bigint, sha256 string, uploaded_md5 string, capture_date date, "
    "date_source string, image_uri string, album_key string, failed string, captioned boolean"
)
HASHES_SCHEMA = (
    "sha256 string, uri string, album_key string, image_key string, uploaded_at timestamp, "
    "file_size bigint, original_path string"
)
REFS_SCHEMA = "image_uri string, refs bigint"
_TABLES = {"files": Table(STATE_SCHEMA, ("path",)), "hashes": Table(HASHES_SCHEMA, ("sha256",)), "refs": Table(REFS_SCHEMA, ("image_uri",))}


def state_log(spark: SparkSession, folder: str) -> Log:
    return Log(spark, folder, _TABLES)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions, oldest first."""
    return state_log(spark, folder).versions()


def read_state(spark: SparkSession, folder: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, hashes) of a version, the last by default; empty before the first."""
    log = state_log(spark, folder)
    return log.read("files", version), log.read("hashes", version)


def _next(log: Log, version: int | None) -> int:
    known = log.versions()
    return version if version is not None else known[-1] + 1 if known else 0


def write_state(
    spark: SparkSession, folder: str, files: DataFrame, hashes: DataFrame, version: int | None = None
) -> int:
    """Write both tables whole as one version; the number after the last by default."""
    log = state_log(spark, folder)
    version = _next(log, version)
    image = F.col("image_uri")
    refs = files.where(image.isNotNull()).groupBy("image_uri").agg(F.count("*").alias("refs"))
    log.write(version, {"files": files, "hashes": hashes, "refs": refs}, whole=True)
    return version


def append_state(
    spark: SparkSession, folder: str, files: DataFrame, hashes: DataFrame, gone_files: DataFrame | None = None,
    gone_hashes: DataFrame | None = None, version: int | None = None, before: bool = False,
) -> int:
    """Write a version that differs from the newest below it by these records and vanished keys.

    A record stands once in `files` (by path) and `hashes` (by sha256), and not among the
    vanished too.  With `before`, records as they were are kept for `Log.reverted`.
    """
    log = state_log(spark, folder)
    version = _next(log, version)
    below = [v for v in log.versions() if v < version]
    files = cut(files.select("path", *[c for c in files.columns if c != "path"]), "records")
    paths = files.select("path") if gone_files is None else files.select("path").unionByName(gone_files.select("path"))
    count = lambda frame, n: frame.where("image_uri is not null").select("image_uri", F.lit(n).cast("bigint").alias("refs"))
    moved = count(files, 1)
    if below:
        moved = moved.unionByName(count(log.read("files", below[-1], of=paths), -1))
    moved = cut(moved.groupBy("image_uri").agg(F.sum("refs").alias("refs")).where("refs <> 0"), "refs")
    refs = moved if not below else moved.unionByName(log.read("refs", below[-1], of=moved)).groupBy("image_uri").agg(F.sum("refs").alias("refs"))
    refs = cut(refs, "refs")
    gone = {"refs": refs.where("refs <= 0")}
    gone |= {"files": gone_files} if gone_files is not None else {}
    gone |= {"hashes": gone_hashes} if gone_hashes is not None else {}
    log.write(version, {"files": files, "hashes": hashes, "refs": refs.where("refs > 0")}, gone, before=before)
    return version


def drop_versions(spark: SparkSession, folder: str, keep: int) -> None:
    """Remove all but the newest `keep` versions."""
    state_log(spark, folder).drop(keep)


def clear_state(spark: SparkSession, folder: str) -> int:
    """Forget everything: a version with all tables empty."""
    empty = [spark.createDataFrame([], schema) for schema in (STATE_SCHEMA, HASHES_SCHEMA)]
    return write_state(spark, folder, *empty)


def write_run_summary(summary: DataFrame, folder: str) -> None:
    """One JSON document; `summary` is one row."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(folder)
