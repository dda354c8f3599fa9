"""Placing files into day albums: scan, preview and the full plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions import dates, media
from shelfmark.functions.paths import file_name, parse_series_name, rendered_name
from shelfmark.operators import change, copies, naming, reports, scanning, series, siblings
from shelfmark.session import cut
from shelfmark.skew import UNCOUNTED, hot_key_sets, hot_keys, merged, refined, salted_join

# Columns read from file contents; a table without one has it null.
METADATA_COLUMNS = {
    "sha256": "string", "md5": "string",
    "exif_original": "string", "exif_digitized": "string", "exif_modified": "string",
    "apple_date": "string", "mvhd_seconds": "bigint",
    "duration_s": "double", "short_side": "int", "unfinished": "boolean",
    "rendered_md5": "string", "rendered_size": "bigint", "render_error": "string",
}

ACTION_COLUMNS = [
    "path", "action", "album_name", "album_key", "target_name", "image_uri", "reason", "size",
    "day", "date_source", "sha256", "uploaded_md5", "mtime_ns", "created", "previously_refused",
    "old_sha256", "old_uri",
]


@dataclass(frozen=True)
class DatedOptions:
    as_of: dt.date | str
    root: str = "/"
    tz: str = "UTC"
    excludes: tuple[str, ...] = ()
    raw_handling: str = "render"
    live_videos: str = "upload"
    max_video_minutes: int = C.MAX_VIDEO_MINUTES
    capacity: int = C.ALBUM_CAPACITY
    no_cache: bool = False
    caption_source: bool = False


def not_excluded(files: DataFrame, options: DatedOptions, ignore_rules: DataFrame | None = None) -> DataFrame:
    below = scanning.relative(F.col("path"), options.root)
    found = files.where(~scanning.is_hidden_or_system(below)).where(
        ~scanning.exclude_condition(below, options.excludes)
    )
    return found if ignore_rules is None else scanning.filter_ignore_files(found, ignore_rules)


def listed(files: DataFrame, options: DatedOptions, ignore_rules: DataFrame | None = None) -> DataFrame:
    """Supported files that nothing excludes, each path once."""
    supported = scanning.filter_supported(files)
    return scanning.merge_sources([not_excluded(supported, options, ignore_rules)])


def listed_of(visible: DataFrame) -> DataFrame:
    """`listed`, of files that nothing excludes."""
    return scanning.merge_sources([scanning.filter_supported(visible)])


def with_metadata(files: DataFrame) -> DataFrame:
    return files.select(
        "path", "size", "mtime_ns",
        *[
            (F.col(name) if name in files.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in METADATA_COLUMNS.items()
        ],
    )


def scan(files: DataFrame, options: DatedOptions, hot: DataFrame | None | object = UNCOUNTED) -> DataFrame:
    """What a run looks at of listed files: siblings chosen, `live_photo_of` set."""
    carry = [c for c in _PHOTO_COLUMNS if c in files.columns]
    selected = siblings.select_siblings(files, options.raw_handling, carry, hot)
    kept = selected.where(F.col("raw_outcome").isin("kept", "rendered")).drop("raw_outcome")
    return siblings.skip_live_videos(kept) if options.live_videos == "skip" else kept


def scan_summary(files: DataFrame, options: DatedOptions, ignore_rules: DataFrame | None = None) -> DataFrame:
    """One row: files listed but not taken, by why, and live videos.

    The inventory is read once, for its paths: counts are taken from these as written, not
    by accumulators, which a task done again after a lost executor would add to twice.
    """
    visible = cut(not_excluded(files.select("path"), options, ignore_rules), "visible")
    unsupported = scanning.count_unsupported(visible).select("unsupported")
    selected = siblings.select_siblings(listed_of(visible), options.raw_handling)
    outcome = F.col("raw_outcome")
    live = outcome.isin("kept", "rendered") & F.col("live_photo_of").isNotNull()
    skips = F.lit(options.live_videos == "skip")
    return selected.agg(
        F.count_if(outcome == "rendered").alias("raw_rendered"),
        F.count_if(outcome == "skipped").alias("raw_skipped"),
        F.count_if(outcome == "skipped_with_sibling").alias("raw_skipped_with_sibling"),
        F.count_if(live & ~skips).alias("live_photo_videos"),
        F.count_if(live & skips).alias("live_photo_videos_skipped"),
    ).withColumn("unsupported", unsupported.scalar())


# What a live video needs to know of its photo.
_PHOTO_COLUMNS = ["prev_capture_date", "exif_original", "exif_digitized", "apple_date", "mvhd_seconds"]


def with_dates(scanned: DataFrame, options: DatedOptions) -> DataFrame:
    """Adds `day` and `date_source`.

    A paired video takes its photo's recorded date, else its photo's metadata
    date, else its own.
    """
    own = dates.capture_date(
        F.col("path"), F.col("mtime_ns"), F.col("exif_original"), F.col("exif_digitized"),
        F.col("exif_modified"), F.col("apple_date"), F.col("mvhd_seconds"), options.as_of, options.tz,
    )
    read = dates.metadata_date(
        F.col("photo.path"), F.col("photo.exif_original"), F.col("photo.exif_digitized"),
        F.col("photo.apple_date"), F.col("photo.mvhd_seconds"), options.as_of, options.tz,
    )
    by_photo = dates.dated_by(F.coalesce("photo.prev_capture_date", read), C.DATED_BY_LIVE_PHOTO)
    return scanned.withColumn("_dated", F.coalesce(by_photo, own)).withColumns({
        "day": F.col("_dated.day"), "date_source": F.col("_dated.date_source"),
    }).drop("_dated", "photo")


def checked_files(
    files: DataFrame, state: DataFrame, options: DatedOptions, ignore_rules: DataFrame | None = None
) -> DataFrame:
    """Listed files beside their records, written once: both tables are read
    once, and shuffled once by path."""
    found = listed(with_metadata(files), options, ignore_rules)
    return cut(change.detect_unchanged(found, state, options.no_cache), "checked")


def plan_preview(
    files: DataFrame, state: DataFrame, options: DatedOptions, ignore_rules: DataFrame | None = None
) -> DataFrame:
    """New or changed files with their day: no content, no remote tables."""
    pending = with_dates(scan(checked_files(files, state, options, ignore_rules), options), options)
    return pending.where(F.col("status") != "unchanged").select("path", "size", "day", "date_source", "status")


def day_series(albums: DataFrame) -> DataFrame:
    """(series, n, cnt, album_key, name) of the albums that count towards a series.

    `albums` holds (album_key, name, image_count).
    """
    parsed = parse_series_name(F.col("name"))
    numbered = albums.select(
        parsed["base"].alias("series"), parsed["n"].alias("n"),
        F.coalesce("image_count", F.lit(0)).alias("cnt"), "album_key", "name",
    )
    return series.series_prefix(numbered)


def series_images(
    images: DataFrame, prefix: DataFrame, hot: DataFrame | None | object = UNCOUNTED
) -> DataFrame:
    """(series, file_name, md5, uri, album_key): names held in each series.

    `images` holds (album_key, file_name, md5, uri).
    """
    placed = salted_join(
        images, prefix.select("album_key", "series", "n"), ["album_key"], "inner", hot=hot, spread=["uri"]
    )
    return naming.latest_by_name(placed.select("series", "file_name", "n", "md5", "uri", "album_key"))


def _classified(dated: DataFrame, hashes: DataFrame, options: DatedOptions, hot: DataFrame | None) -> DataFrame:
    """Adds `kind` (unchanged, touched, known, refused, same_render, upload) and what would be sent."""
    renders = media.is_renderable(F.col("path")) & F.lit(options.raw_handling == "render")
    known = change.lookup_known(dated, hashes, options.no_cache, hot)
    same_render = renders & F.coalesce(
        F.col("prev_image_uri").isNotNull() & (F.col("prev_uploaded_md5") == F.col("rendered_md5")), F.lit(False)
    ) & F.lit(not options.no_cache)
    kind = (
        F.when(F.col("status") == "unchanged", "unchanged")
        .when(change.is_touched() & F.lit(not options.no_cache), "touched")
        .when(F.col("known_uri").isNotNull(), "known")
        .when(renders & F.col("render_error").isNotNull(), "refused")
        .when(same_render, "same_render")
        .otherwise("upload")
    )
    return known.select(
        "path", "size", "mtime_ns", "sha256", "day", "date_source", "previously_refused",
        "prev_image_uri", "prev_album_key", "prev_sha256", "known_uri", "known_album_key",
        kind.alias("kind"),
        F.date_format("day", "yyyy-MM-dd").alias("series"),
        F.when(renders, rendered_name(F.col("path"))).otherwise(file_name(F.col("path"))).alias("file_name"),
        F.when(renders, F.coalesce("rendered_md5", "md5")).otherwise(F.col("md5")).alias("send_md5"),
        F.when(renders, F.coalesce("rendered_size", "size")).otherwise(F.col("size")).alias("send_size"),
        F.when(renders, F.col("render_error")).alias("render_error"),
        media.video_refusal(
            F.col("path"), F.col("unfinished"), F.col("duration_s"), F.col("short_side"), options.max_video_minutes
        )["reason"].alias("video_problem"),
    )


def _actions(rows: DataFrame, action: Column | str, **columns: Column | str) -> DataFrame:
    """`rows` as ACTION_COLUMNS; columns not named are null (or the row's own)."""
    own = {"path", "size", "day", "date_source", "sha256", "mtime_ns"}
    types = {"size": "bigint", "day": "date", "mtime_ns": "bigint", "created": "boolean", "previously_refused": "boolean"}
    given = {"action": F.lit(action) if isinstance(action, str) else action}
    given |= {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    for flag in ("created", "previously_refused"):
        given.setdefault(flag, F.lit(False))
    return rows.select(*[
        given.get(c, F.col(c) if c in own else F.lit(None)).cast(types.get(c, "string")).alias(c)
        for c in ACTION_COLUMNS
    ])


def plan_dated(
    files: DataFrame,
    state: DataFrame,
    hashes: DataFrame,
    albums: DataFrame,
    images: DataFrame,
    options: DatedOptions,
    ignore_rules: DataFrame | None = None,
    image_refs: DataFrame | None = None,
) -> DataFrame:
    """Exactly one action per scanned path (ACTION_COLUMNS).

    Rules in order: unchanged, touched, known content (linked or collected),
    unrenderable, copy of a file of this run, refused video, replacement of
    the path's own image, name already present, upload into a slot.

    `state` and `hashes` may hold the records of the scanned paths and contents alone where
    `image_refs` tells how many paths of the whole state each image has.
    """
    checked = checked_files(files, state, options, ignore_rules)
    hot_file = hot_key_sets(
        siblings.with_stem(checked), {"content": ["sha256"], "stem": siblings.STEM_KEY}
    )
    hot_content = hot_file["content"]
    scanned = with_dates(scan(checked, options, hot_file["stem"]), options)
    prepared = cut(_classified(scanned, hashes, options, hot_content), "prepared")
    prefix = cut(day_series(albums), "series")
    hot = hot_key_sets(prepared, {
        "day": ["series"], "previous": ["prev_image_uri"],
        "old_album": ["prev_album_key"], "known_album": ["known_album_key"],
    })
    hot_images = hot_keys(images, ["album_key"])
    hot_name = refined(hot["day"], prepared, ["series", "file_name"])
    uploads = prepared.where(F.col("kind") == "upload")
    leaders, followers = _led(uploads, hot_content)

    # An image that another path is, or will be linked to, is not overwritten.
    known = prepared.where(F.col("kind") == "known")
    will_link = known.where(~F.col("known_uri").eqNullSafe(F.col("prev_image_uri"))).groupBy(
        F.col("known_uri").alias("image_uri")
    ).agg(F.count("*").alias("refs"))
    refs = (
        (change.image_refs(change.complete_state(state)) if image_refs is None else image_refs).unionByName(will_link)
        .groupBy(F.col("image_uri").alias("prev_image_uri")).agg(F.sum("refs").alias("refs"))
    )
    no_previous = F.lit(options.no_cache)
    judged = cut(salted_join(leaders, refs, ["prev_image_uri"], "left", hot=hot["previous"], spread=["path"]).withColumn(
        "fate",
        F.when(F.col("video_problem").isNotNull(), "refused")
        .when(F.col("prev_image_uri").isNotNull() & (F.col("refs") <= 1) & ~no_previous, "replaced")
        .otherwise("name"),
    ).drop("refs"), "judged")
    remote = series_images(images, prefix, hot_images)
    named = naming.resolve_names(
        judged.where(F.col("fate") == "name").withColumnRenamed("send_md5", "md5"), remote, hot=hot_name
    ).withColumnRenamed("md5", "send_md5")
    fate = (
        F.when(F.col("name_action") == "present", "linked")
        .when(F.col("name_action") == "error", "failed")
        .otherwise("uploaded")
    )
    led = cut(
        judged.where(F.col("fate") != "name").unionByName(
            named.withColumn("fate", fate).drop("name_action"), allowMissingColumns=True
        ),
        "leaders",
    )

    # Copies: of a placed leader they are known content; of any other they fail.
    outcome = led.select(
        "sha256", F.col("fate").alias("leader_fate"), F.col("day").alias("leader_day"),
        F.col("path").alias("leader"),
        F.when(F.col("fate") == "replaced", F.col("prev_image_uri")).otherwise(F.col("present_uri")).alias("leader_uri"),
        F.when(F.col("fate") == "replaced", F.col("prev_album_key")).otherwise(F.col("present_album_key")).alias("leader_album"),
    )
    following = salted_join(followers, outcome, ["sha256"], "left", hot=hot_content, spread=["path"]).withColumns({
        "known_uri": F.col("leader_uri"), "known_album_key": F.col("leader_album"),
    }).drop("leader_uri", "leader_album")
    nothing = {c: F.lit(None).cast("string") for c in ("leader_fate", "leader")}
    placing = known.withColumns(nothing).withColumn("leader_day", F.lit(None).cast("date")).unionByName(following)
    of_day = prefix.select(F.col("series").try_cast("date").alias("day"), "album_key").where(F.col("day").isNotNull())
    placed = cut(
        change.place_known(
            placing, of_day, refined(hot["day"], placing, ["day", "known_album_key"])
        ).withColumns({
            "placement": F.when(F.col("leader_fate").isin("refused", "failed"), "failed")
            .when(F.col("leader_fate").isin("uploaded", "linked"),
                  F.when(F.col("day") == F.col("leader_day"), "linked").otherwise("collected"))
            .otherwise(F.col("placement")),
        }),
        "placed",
    )

    # Collects are sent in batches after the uploads that fill a day first.
    takers = led.where(F.col("fate") == "uploaded").withColumn("late", F.lit(0)).unionByName(
        placed.where(F.col("placement") == "collected").withColumn("late", F.lit(1)), allowMissingColumns=True
    )
    slotted = cut(
        series.assign_slots(takers, prefix, options.capacity, order=["late", "path"], hot=hot["day"]).select(
            *takers.columns, "n", "album_name", "created", "slot_error"
        ),
        "slots",
    )
    uploaded = slotted.where(F.col("late") == 0)

    # A linked copy is where its leader went, or fails with it.
    leader_slots = uploaded.select(
        "sha256", F.col("album_name").alias("leader_album_name"), F.col("slot_error").alias("leader_error")
    )
    beside = salted_join(
        placed.where(F.col("placement") == "linked"), leader_slots, ["sha256"], "left", hot=hot_content, spread=["path"]
    )
    copy_failed = F.lit(C.REASON_COPY_FAILED)
    full = F.col("slot_error").isNotNull()
    late = salted_join(
        slotted.where(F.col("late") == 1), leader_slots, ["sha256"], "left", hot=hot_content, spread=["path"]
    )
    late_reason = F.coalesce("slot_error", F.when(F.col("leader_error").isNotNull(), copy_failed))

    parts = [
        _actions(
            prepared.where(F.col("kind") == "unchanged"), "unchanged",
            image_uri="prev_image_uri", album_key="prev_album_key", previously_refused="previously_refused",
        ),
        _actions(
            prepared.where(F.col("kind") == "touched"), "touched",
            image_uri="prev_image_uri", album_key="prev_album_key", uploaded_md5="send_md5",
        ),
        # Other bytes that render to the image there is: `old_sha256` tells it from one that was only touched.
        _actions(
            prepared.where(F.col("kind") == "same_render"), "touched",
            image_uri="prev_image_uri", album_key="prev_album_key", uploaded_md5="send_md5", old_sha256="prev_sha256",
        ),
        _actions(prepared.where(F.col("kind") == "refused"), "refused", reason="render_error"),
        _actions(led.where(F.col("fate") == "refused"), "refused", reason="video_problem"),
        _actions(led.where(F.col("fate") == "failed"), "failed", reason=F.lit(C.REASON_NO_FREE_NAME)),
        _actions(
            led.where(F.col("fate") == "replaced"), "replaced",
            image_uri="prev_image_uri", album_key="prev_album_key", target_name="file_name", size="send_size",
            uploaded_md5="send_md5", old_sha256="prev_sha256", old_uri="prev_image_uri",
        ),
        _actions(
            led.where(F.col("fate") == "linked"), "linked",
            image_uri="present_uri", album_key="present_album_key", uploaded_md5="send_md5",
        ),
        _actions(
            beside, F.when(F.col("leader_error").isNotNull(), "failed").otherwise("linked"),
            image_uri="known_uri", album_key="known_album_key", album_name="leader_album_name",
            reason=F.when(F.col("leader_error").isNotNull(), copy_failed),
        ),
        _actions(placed.where(F.col("placement") == "failed"), "failed", reason=copy_failed),
        _actions(
            uploaded, F.when(full, "failed").otherwise("uploaded"), album_name="album_name",
            target_name=F.when(~full, F.col("target_name")), size="send_size", reason="slot_error",
            created=~full & F.col("created"), uploaded_md5=F.when(~full, F.col("send_md5")),
        ),
        _actions(
            late, F.when(late_reason.isNotNull(), "failed").otherwise("collected"),
            image_uri="known_uri", album_name="album_name", reason=late_reason,
            created=~full & F.col("created"),
        ),
    ]
    hot_album = merged("album_key", hot["old_album"], hot["known_album"], hot_images)
    return _with_album_names(reduce(DataFrame.unionByName, parts), albums, hot_album)


def _led(uploads: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The first path of each content, and the other copies."""
    elected = copies.elect_copies(uploads, hot)
    return (
        elected.where("is_leader").drop("leader", "is_leader"),
        elected.where(~F.col("is_leader")).drop("leader", "is_leader"),
    )


def _with_album_names(actions: DataFrame, albums: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Names the album of actions that only know its key; others skip the join."""
    names = albums.select("album_key", F.col("name").alias("_name"))
    unnamed = F.col("album_name").isNull() & F.col("album_key").isNotNull()
    joined = salted_join(
        actions.where(unnamed), names, ["album_key"], "left", hot=hot, spread=["path"]
    ).withColumn("album_name", F.col("_name"))
    return actions.where(~unnamed).unionByName(joined.select(*ACTION_COLUMNS))


# An album that a plan creates has no key yet; until a listing tells it, its name stands for it.
_PLANNED = "planned:"


def with_album_keys(actions: DataFrame, albums: DataFrame) -> DataFrame:
    """Actions that name their album get its key: that of the listed album, or one
    that follows from the name of an album this plan creates."""
    keys = albums.groupBy(F.col("name").alias("album_name")).agg(F.min("album_key").alias("_key"))
    unkeyed = F.col("album_key").isNull() & F.col("album_name").isNotNull()
    joined = salted_join(actions.where(unkeyed), keys, ["album_name"], "left", spread=["path"])
    keyed = joined.withColumn("album_key", F.coalesce("_key", F.concat(F.lit(_PLANNED), "album_name")))
    return actions.where(~unkeyed).unionByName(keyed.select(*actions.columns))


def catalog_changes(actions: DataFrame, albums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a plan's actions, given `with_album_keys`, add to the catalog: (album_key, name,
    image_count) by how many more images, and (album_key, file_name, md5, uri) of images
    sent.  A collected image keeps its own name, which the plan does not know."""
    taking = actions.where(F.col("action").isin("uploaded", "collected"))
    filled = taking.groupBy("album_key").agg(F.min("album_name").alias("name"), F.count("*").alias("image_count"))
    sent = actions.where(F.col("action").isin("uploaded", "replaced")).select(
        "album_key", F.col("target_name").alias("file_name"), F.col("uploaded_md5").alias("md5"), _image(F.col("image_uri")).alias("uri")
    )
    return filled, sent


def _image(uri: Column) -> Column:
    """An image to be sent is known by its content until it has a URI."""
    return F.coalesce(uri, F.concat(F.lit(_PLANNED), "sha256"))


def _album() -> Column:
    return F.coalesce("album_key", F.concat(F.lit(_PLANNED), "album_name"))


def outcomes_of(actions: DataFrame, caption_source: bool = False) -> DataFrame:
    """Planned actions as if all had gone well, for `change.apply_outcomes`.

    With `caption_source` an upload is captioned by its path as it is sent.
    """
    action = F.col("action")
    rerendered = (action == "touched") & F.col("old_sha256").isNotNull()
    placed = action.isin("uploaded", "linked", "collected", "replaced") | rerendered
    return actions.where(action != "unchanged").select(
        "path", "size", "mtime_ns", "sha256", "uploaded_md5", F.col("day").alias("capture_date"), "date_source",
        F.when(placed, _image(F.col("image_uri"))).alias("image_uri"),
        F.when(placed, _album()).alias("album_key"),
        F.when(action == "refused", F.col("reason")).alias("failed"),
        ((action == "uploaded") & F.lit(caption_source)).alias("captioned"),
        F.when(rerendered, "ok").when(action.isin("refused", "failed", "touched"), action).otherwise("ok").alias("outcome"),
    )


def hash_outcomes_of(actions: DataFrame) -> DataFrame:
    """What a plan's actions add to the "hashes" table, for `change.apply_hash_outcomes`:
    content sent, content found present under its name, and other bytes of a same render."""
    action = F.col("action")
    present = (action == "linked") & F.col("uploaded_md5").isNotNull()
    rerendered = (action == "touched") & F.col("old_sha256").isNotNull()
    replaced = action == "replaced"
    return actions.where(action.isin("uploaded", "replaced") | present | rerendered).select(
        "path", "sha256", _image(F.col("image_uri")).alias("uri"), _album().alias("album_key"),
        F.col("size").alias("file_size"), F.col("path").alias("original_path"),
        F.when(replaced, F.col("old_sha256")).alias("old_sha256"), F.when(replaced, F.col("old_uri")).alias("old_uri"),
    )


def run_report(
    files: DataFrame, actions: DataFrame, options: DatedOptions, ignore_rules: DataFrame | None = None,
    captions: DataFrame | None = None,
) -> DataFrame:
    """One row of all counters of a run: what the scan left out, what the plan does, and
    how captioning went."""
    scanned = scan_summary(files, options, ignore_rules)
    row = reports.run_summary(actions, captions).withColumn("_scan", scanned.select(F.struct(*scanned.columns)).scalar())
    return row.select("*", "_scan.*").drop("_scan")
