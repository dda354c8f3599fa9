"""Files that belong together: RAW+JPEG, first of a stem, live photos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import media
from shelfmark.functions.paths import dir_name, stem
from shelfmark.skew import UNCOUNTED, elected, hot_keys, salted_join

STEM_KEY = ["_dir", "_stem"]


def with_stem(files: DataFrame) -> DataFrame:
    return files.withColumns({"_dir": dir_name(F.col("path")), "_stem": F.lower(stem(F.col("path")))})


def hot_stems(files: DataFrame) -> DataFrame | None:
    """Counted once for the functions below, which share their key."""
    return hot_keys(with_stem(files), STEM_KEY)


def raw_selection(
    files: DataFrame, handling: str = "render", hot: DataFrame | None | object = UNCOUNTED
) -> DataFrame:
    """Adds `raw_outcome`: kept, rendered, skipped or skipped_with_sibling."""
    path = F.col("path")
    if handling == "upload":
        return files.withColumn("raw_outcome", F.lit("kept"))
    if handling == "skip":
        return files.withColumn("raw_outcome", F.when(media.is_raw(path), "skipped").otherwise("kept"))
    if handling != "render":
        raise ValueError(f"unknown RAW handling {handling!r}")
    keyed = with_stem(files)
    groups = (
        keyed.where(media.is_renderable(path) | media.is_camera_jpeg(path))
        .groupBy(*STEM_KEY)
        .agg(
            F.max(media.is_camera_jpeg(path)).alias("_taken"),
            F.min(F.when(media.is_renderable(path), path)).alias("_first"),
        )
    )
    joined = salted_join(keyed, groups, STEM_KEY, "left", hot=hot, spread=["path"])
    outcome = (
        F.when(~media.is_renderable(path), "kept")
        .when(~F.col("_taken") & (path == F.col("_first")), "rendered")
        .otherwise("skipped_with_sibling")
    )
    return joined.withColumn("raw_outcome", outcome).select(*files.columns, "raw_outcome")


def suppress_raw_siblings(
    files: DataFrame, handling: str = "render", hot: DataFrame | None | object = UNCOUNTED
) -> DataFrame:
    kept = raw_selection(files, handling, hot).where(F.col("raw_outcome").isin("kept", "rendered"))
    return kept.drop("raw_outcome")


def raw_selection_counts(files: DataFrame, handling: str = "render") -> DataFrame:
    outcome = F.col("raw_outcome")
    return raw_selection(files, handling).agg(
        F.count_if(outcome == "rendered").alias("rendered"),
        F.count_if(outcome == "skipped").alias("skipped"),
        F.count_if(outcome == "skipped_with_sibling").alias("skipped_with_sibling"),
    )


def first_per_stem(files: DataFrame) -> DataFrame:
    """The first file, in path order, of each directory and stem."""
    return elected(with_stem(files), STEM_KEY, ["path"]).select(*files.columns)


def pair_live_photos(files: DataFrame, hot: DataFrame | None | object = UNCOUNTED) -> DataFrame:
    """Sets `live_photo_of` on each video beside a photo of the same stem.

    With several photos the last in path order counts.
    """
    path = F.col("path")
    keyed = with_stem(files.drop("live_photo_of"))
    stills = keyed.where(media.is_still(path)).groupBy(*STEM_KEY).agg(F.max("path").alias("_still"))
    joined = salted_join(keyed, stills, STEM_KEY, "left", hot=hot, spread=["path"])
    return joined.withColumn(
        "live_photo_of", F.when(media.is_live_video(path), F.col("_still"))
    ).drop("_still", *STEM_KEY)


def skip_live_videos(paired: DataFrame) -> DataFrame:
    return paired.where(F.col("live_photo_of").isNull())


def select_siblings(
    files: DataFrame, handling: str = "render", carry: Sequence[str] = (),
    hot: DataFrame | None | object = UNCOUNTED,
) -> DataFrame:
    """`raw_selection` and `pair_live_photos` of what it keeps, in one pass.

    Adds `raw_outcome`, `live_photo_of` and `photo`, the photo's `carry`
    columns.  Both choices are minima and maxima of the same groups, so one
    aggregation with map-side combine and one join give both.
    """
    path = F.col("path")
    row = F.struct("path", *carry)
    renders, raw, still = media.is_renderable(path), media.is_raw(path), media.is_still(path)
    photo_stays = {"render": still & ~renders, "skip": still & ~raw, "upload": still}[handling]
    keyed = with_stem(files)
    groups = keyed.where(renders | still).groupBy(*STEM_KEY).agg(
        F.max(media.is_camera_jpeg(path)).alias("_taken"),
        F.min(F.when(renders, row)).alias("_first"),
        F.max(F.when(photo_stays, row)).alias("_photo"),
    )
    if handling == "render":
        rendered_photo = F.when(~F.col("_taken") & media.is_still(F.col("_first.path")), F.col("_first"))
        groups = groups.withColumn("_photo", F.greatest("_photo", rendered_photo))
        outcome = (
            F.when(~renders, "kept")
            .when(~F.col("_taken") & (path == F.col("_first.path")), "rendered")
            .otherwise("skipped_with_sibling")
        )
    else:
        outcome = F.when(raw & F.lit(handling == "skip"), "skipped").otherwise("kept")
    joined = salted_join(keyed, groups, STEM_KEY, "left", hot=hot, spread=["path"])
    photo = F.when(media.is_live_video(path), F.col("_photo"))
    return joined.select(
        *files.columns, outcome.alias("raw_outcome"), photo["path"].alias("live_photo_of"), photo.alias("photo")
    )
