"""File inventories: from a table, from one that a manifest vouches for, or from `binaryFile`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.scanning import merge_sources


def inventory_table(listing: DataFrame) -> DataFrame:
    """An inventory kept as a table; an unknown or pre-1970 time is 0."""
    known = F.greatest(F.coalesce("mtime_ns", F.lit(0)), F.lit(0))
    return listing.withColumn("mtime_ns", known)


def read_inventory(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """Files below `sources` (folders or single files), contents never read.

    `content` is left out, so the scan lists files and opens none; a source
    that is not there is an error.  Times come in milliseconds, and Spark leaves out
    empty files and names starting with `_` or `.`: where those matter, take the
    storage's own inventory as a table (`inventory_table`).
    """
    def one(source: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
        return found.select(
            F.regexp_replace("path", "^file:/+", "/").alias("path"),
            F.col("length").alias("size"),
            (F.unix_millis("modificationTime") * 1_000_000).alias("mtime_ns"),
        )

    return merge_sources([one(s) for s in sources])


# A part file of an inventory: its size, its rows, and a sum over them that does not depend on their order.
_MANIFEST = "part string, bytes bigint, row_count bigint, checksum decimal(38,0), schema string"


class BrokenInventory(ValueError):
    """A part that the manifest lists is missing, short or not what it was."""


def _parts(spark: SparkSession, files: Sequence[str], schema: str) -> DataFrame:
    """(part, bytes, row_count, checksum) of part files, in one pass."""
    rows = spark.read.schema(schema).parquet(*files)
    # Rows of a part are added up: equal rows count as often as they stand there.
    row = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]) if rows.columns else F.lit(0)
    return rows.select(
        F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_size").alias("bytes"), row.cast("decimal(38,0)").alias("_row")
    ).groupBy("part").agg(F.first("bytes").alias("bytes"), F.count("*").alias("row_count"), F.sum("_row").cast("decimal(38,0)").alias("checksum"))


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{folder}/manifest")


def write_inventory(listing: DataFrame, folder: str) -> None:
    """Keep an inventory as part files and, written last, the manifest that lists them.

    What a failed or repeated attempt leaves beside them is not listed, so it is never read.
    The folder must not hold an inventory already.
    """
    spark, folder = listing.sparkSession, folder.rstrip("/")
    listing.write.parquet(f"{folder}/parts")
    parts = _parts(spark, [f"{folder}/parts"], listing.schema.toDDL())
    # A row for each part file; an empty inventory has a row without a part, which keeps the schema.
    none = spark.range(1).select(F.lit(listing.schema.toDDL()).alias("schema"))
    listed = none.join(parts, F.lit(True), "left").select(*[c.split(" ")[0] for c in _MANIFEST.split(", ")])
    listed.write.json(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str, checksums: bool = False) -> DataFrame:
    """The inventory kept by `write_inventory`: all of its rows, or `BrokenInventory`.

    Sizes are compared before anything is read; with `checksums`, every part's rows are
    read once and compared too.  Any name and size may stand in a row: nothing is hidden.
    """
    folder = folder.rstrip("/")
    try:
        listed = _manifest(spark, folder).collect()  # A row for each part file, as any reader's driver lists.
    except AnalysisException as error:
        raise BrokenInventory(f"{folder} has no manifest") from error
    if not listed:
        raise BrokenInventory(f"the manifest of {folder} is empty")
    schema, wanted = listed[0]["schema"], {r["part"]: r for r in listed if r["part"] is not None}
    if not wanted:
        return spark.createDataFrame([], schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/parts")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {e.getPath().getName(): e.getLen() for e in files.listStatus(place)} if files.exists(place) else {}
    wrong = sorted(p for p, r in wanted.items() if there.get(p) != r["bytes"])
    paths = [f"{folder}/parts/{p}" for p in sorted(wanted)]
    if checksums and not wrong:
        now = {r["part"]: r for r in _parts(spark, paths, schema).collect()}
        wrong = sorted(p for p, r in wanted.items() if p not in now or (now[p]["row_count"], now[p]["checksum"]) != (r["row_count"], r["checksum"]))
    if wrong:
        raise BrokenInventory(f"{len(wrong)} of {len(wanted)} parts of {folder} are missing or changed: {', '.join(wrong[:5])}")
    return spark.read.schema(schema).parquet(*paths)
