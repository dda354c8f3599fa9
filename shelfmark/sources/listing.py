"""Pages of a listing and descriptions of sizes, kept as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_listing_pages(
    spark: SparkSession, path: str, locator: str, item_schema: str, limit: int | None = None
) -> DataFrame:
    """Every item of `Response.<locator>` of every page file under `path`.

    Pages are taken by the number their file name ends in; one without the array gives no rows.
    """
    pages = spark.read.schema(_response(locator, item_schema)).option(
        "multiLine", True
    ).json(path).select(F.col("_metadata.file_path").alias("page"), F.col(f"Response.`{locator}`").alias("_items"))
    return _exploded(pages, limit)


def listing_items(pages: DataFrame, locator: str, item_schema: str, limit: int | None = None) -> DataFrame:
    """The same over pages held as text: (page, json)."""
    parsed = F.from_json("json", _response(locator, item_schema))
    return _exploded(pages.select("page", parsed["Response"][locator].alias("_items")), limit)


def _response(locator: str, item_schema: str) -> StructType:
    """The schema of a page whose items have the fields `Key bigint, Name string`."""
    items = ArrayType(StructType.fromDDL(item_schema))
    return StructType().add("Response", StructType().add(locator, items))


def _exploded(pages: DataFrame, limit: int | None) -> DataFrame:
    items = pages.select("page", F.posexplode("_items").alias("place", "_item")).select("page", "place", "_item.*")
    # A limit needs the listing's order; without one nothing is sorted.
    number = F.regexp_extract("page", r"([0-9]+)[^0-9/]*$", 1).try_cast("decimal(38,0)")
    return items if limit is None else items.orderBy(number.asc_nulls_first(), "page", "place").limit(limit)


def size_details(described: DataFrame) -> DataFrame:
    """(..., json) -> (..., usable, largest, sizes) for `pick_variant`."""
    fixed = F.from_json("json", "UsableSizes array<string>, LargestImageSize string")
    members = F.from_json("json", "map<string,string>")
    size = "Url string, Ext string, Width int, Height int"
    sizes = F.transform_values(
        F.map_filter(members, lambda k, v: k.startswith("ImageSize") & v.startswith("{")),
        lambda k, v: F.from_json(v, size),
    )
    return described.withColumns({
        "usable": fixed["UsableSizes"], "largest": fixed["LargestImageSize"], "sizes": sizes,
    }).drop("json")
