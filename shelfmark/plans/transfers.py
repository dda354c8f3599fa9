"""Plans for downloads and for images fetched from URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.media import is_video_format
from shelfmark.functions.paths import fetchable, sized_name, url_file_name
from shelfmark.operators.naming import unique_download_names
from shelfmark.operators.remote import downloadable, pick_variant
from shelfmark.operators.series import assign_slots


def plan_downloads(
    images: DataFrame, albums: DataFrame, details: DataFrame | None = None, size: str = "Original"
) -> DataFrame:
    """(image_key, url, target_name, problem) of every image one may download.

    `images` holds (image_key, album_key, file_name, format, archived_uri, seq);
    `details` (image_key, usable, largest, sizes).  Videos, and all images at
    size Original, come from the archived file.
    """
    allowed = downloadable(images, albums)
    if size == "Original" or details is None:
        wanted = allowed.withColumns({"url": F.col("archived_uri"), "_name": F.col("file_name")})
    else:
        picked = pick_variant(details, size).select("image_key", "picked")
        sized = allowed.join(picked, "image_key", "left")
        archived = is_video_format(F.col("format"))
        wanted = sized.withColumns({
            "url": F.when(archived, F.col("archived_uri")).otherwise(F.col("picked.url")),
            "_name": F.when(archived, F.col("file_name")).otherwise(
                sized_name(F.col("file_name"), F.col("picked.ext"))
            ),
        })
    missing = F.when(F.col("url").isNull(), "no such size")
    # Only what can be fetched takes a name.
    fetched = unique_download_names(wanted.where(F.col("url").isNotNull()), ["seq", "image_key"], name="_name")
    lost = wanted.where(F.col("url").isNull()).withColumn("target_name", F.lit(None).cast("string"))
    return fetched.unionByName(lost).select("image_key", "url", "target_name", missing.alias("problem"))


def plan_url_ingest(
    urls: DataFrame, albums: DataFrame, series: str, capacity: int = C.ALBUM_CAPACITY
) -> DataFrame:
    """(pos, url, file_name, album_name, problem): each URL takes a slot, in order.

    One bad address fails the whole request up front.
    """
    checked = urls.withColumns({
        "file_name": url_file_name(F.col("url")),
        "series": F.lit(series),
        "problem": F.when(~fetchable(F.col("url")), "not an http(s) address"),
    })
    all_good = checked.agg(F.count("problem") == 0).scalar()
    slotted = assign_slots(checked.where(all_good), albums, capacity, order=["pos", "url"])
    placed = slotted.select("pos", "url", "file_name", "album_name", F.coalesce("problem", "slot_error").alias("problem"))
    stopped = checked.where(~all_good).select(
        "pos", "url", "file_name", F.lit(None).cast("string").alias("album_name"),
        F.coalesce("problem", F.lit("another address is bad")).alias("problem"),
    )
    return placed.unionByName(stopped)

