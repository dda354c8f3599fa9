"""Uploading into album series: all files into one, or each directory into its own."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions import media
from shelfmark.functions.paths import dir_name, file_name, rendered_name
from shelfmark.operators import change, copies, naming, remote, scanning, series, siblings
from shelfmark.session import cut
from shelfmark.skew import hot_key_sets, hot_keys, salted_join

ACTION_COLUMNS = ["path", "action", "album_name", "target_name", "image_uri", "reason", "size"]


@dataclass(frozen=True)
class FlatOptions:
    """`series` is where all files go; without it, each file's own column `series` says."""

    series: str | None = None
    raw_handling: str = "render"
    check_remote: bool = False
    no_cache: bool = False
    capacity: int = C.ALBUM_CAPACITY


def plan_mirrored(
    files: DataFrame, albums: DataFrame, images: DataFrame, hashes: DataFrame, options: FlatOptions
) -> DataFrame:
    """`plan_flat` for all directories at once: each one's files go to the series that
    bears the directory's path, as `albums` name it."""
    return plan_flat(files.withColumn("series", dir_name(F.col("path"))), albums, images, hashes, replace(options, series=None))


def plan_flat(
    files: DataFrame, albums: DataFrame, images: DataFrame, hashes: DataFrame, options: FlatOptions
) -> DataFrame:
    """Exactly one action per supported file: collected, skipped, replaced or uploaded.

    `albums` holds (series, n, cnt, album_key), `images` (album_key, file_name,
    md5, uri).  Only the type filter applies; nothing hidden is left out.
    Names, content and room are those of a file's own series; copies are sent
    once over all of them.
    """
    if options.series is not None:
        files = files.withColumn("series", F.lit(options.series))
        albums = albums.where(F.col("series") == options.series)
    supported = scanning.filter_supported(scanning.merge_sources([files]))
    kept = siblings.suppress_raw_siblings(supported, options.raw_handling, siblings.hot_stems(supported))
    for column in ("rendered_md5", "render_error"):
        if column not in kept.columns:
            kept = kept.withColumn(column, F.lit(None).cast("string"))
    renders = media.is_renderable(F.col("path")) & F.lit(options.raw_handling == "render")
    listed = cut(kept.select(
        "path", "series", "size", "sha256", "md5", "rendered_md5", "render_error", renders.alias("renders"),
        file_name(F.col("path")).alias("file_name"),
        F.when(renders, rendered_name(F.col("path"))).otherwise(file_name(F.col("path"))).alias("send_name"),
        F.when(renders, F.col("rendered_md5")).otherwise(F.lower("md5")).alias("check_md5"),
    ), "listed")
    name, send, content = (["series", c] for c in ("file_name", "send_name", "check_md5"))
    hot = hot_key_sets(listed, {"name": name, "send": send, "sha": ["sha256"], "md5": content, "series": ["series"]})
    prefix = series.series_prefix(albums)
    in_series = salted_join(
        images, prefix.select("album_key", "series", "n"), ["album_key"], "inner", hot=hot_keys(images, ["album_key"]), spread=["uri"]
    )
    held = naming.latest_by_name(
        in_series.select("series", "file_name", "n", "md5", "uri", "album_key")
    ).select("series", "file_name", "md5", "uri")
    contents = in_series.where(F.col("md5").isNotNull()).select("series", F.lower("md5").alias("check_md5")).distinct()

    known = hashes.limit(0) if options.no_cache else hashes
    # One join with known content tells both whether it is known and where it is.
    collecting = remote.plan_collects(listed, prefix, held, known, hot["name"], hot["sha"], within=["series"])
    by_name = remote.match_remote_name(collecting, held, hot=hot["name"], within=["series"])
    rendered_held = held.select("series", F.col("file_name").alias("send_name"), F.lit(True).alias("rendered_held"))
    by_name = salted_join(by_name, rendered_held, send, "left", hot=hot["send"], spread=["path"])
    if options.check_remote:
        by_name = salted_join(
            by_name, contents.withColumn("content_held", F.lit(True)), content, "left", hot=hot["md5"], spread=["path"]
        )
    else:
        by_name = by_name.withColumn("content_held", F.lit(None).cast("boolean"))

    skipped_why = (
        F.when(F.col("cached"), "known content")
        .when(F.col("renders") & F.col("rendered_held"), "name present")
        .when(F.col("content_held"), "content present")
        .when(~F.col("renders") & (F.col("name_match") == "skip"), "name present")
    )
    decided = cut(
        by_name.withColumn("why", skipped_why).withColumn(
            "action",
            F.when(F.col("collect_uri").isNotNull(), "collected")
            .when(F.col("why").isNotNull(), "skipped")
            .when(F.col("renders") & F.col("render_error").isNotNull(), "failed")
            .when(~F.col("renders") & (F.col("name_match") == "replace"), "replaced")
            .otherwise("uploaded"),
        ).select(
            "path", "series", "size", "sha256", "action", "send_name", "collect_uri", "replaces_uri",
            F.when(F.col("action") == "skipped", F.col("why"))
            .when(F.col("action") == "failed", F.col("render_error")).alias("reason"),
        ),
        "flat",
    )
    sending = F.col("action").isin("uploaded", "replaced")
    if not options.no_cache:
        # Once the first copy is sent its content is known, so the others are skipped.
        elected = copies.elect_copies(decided.where(sending), hot["sha"])
        sent = elected.withColumns({
            "reason": F.when(~F.col("is_leader"), "copy").otherwise(F.col("reason")),
            "action": F.when(F.col("is_leader"), F.col("action")).otherwise("skipped"),
        }).select(*decided.columns)
        decided = cut(decided.where(~sending).unionByName(sent), "flat-copies")

    # Collects claim their room before the uploads.
    takes_room = F.col("action").isin("collected", "uploaded")
    takers = decided.where(takes_room).withColumn("late", F.when(F.col("action") == "uploaded", 1).otherwise(0))
    slotted = series.assign_slots(takers, prefix, options.capacity, order=["late", "path"], hot=hot["series"])
    full = F.col("slot_error").isNotNull()
    placed = slotted.withColumns({
        "action": F.when(full, "failed").otherwise(F.col("action")), "reason": F.coalesce("slot_error", "reason"),
    }).select(*decided.columns, "album_name")
    rest = decided.where(~takes_room).withColumn("album_name", F.lit(None).cast("string"))
    sends = F.col("action").isin("uploaded", "replaced")
    return placed.unionByName(rest).select(
        "path", "action", "album_name",
        F.when(sends, F.col("send_name")).alias("target_name"),
        F.when(F.col("action") == "collected", F.col("collect_uri"))
        .when(F.col("action") == "replaced", F.col("replaces_uri")).alias("image_uri"),
        "reason", "size",
    )
