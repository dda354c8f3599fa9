"""Change detection against stored state, and the state after a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.skew import UNCOUNTED, chunked_lists, hot_keys, salted_join

STATE_COLUMNS = [
    "size", "mtime_ns", "sha256", "uploaded_md5", "capture_date", "date_source",
    "image_uri", "album_key", "failed", "captioned",
]
_STATE_TYPES = {
    "size": "bigint", "mtime_ns": "bigint", "capture_date": "date", "captioned": "boolean",
}


def complete_state(state: DataFrame) -> DataFrame:
    """`path` and all of STATE_COLUMNS, null where the table has none."""
    return state.select(
        "path",
        *[
            (F.col(c) if c in state.columns else F.lit(None)).cast(_STATE_TYPES.get(c, "string")).alias(c)
            for c in STATE_COLUMNS
        ],
    )


def _settled() -> Column:
    return F.col("prev_image_uri").isNotNull() | F.col("prev_failed").isNotNull()


def detect_unchanged(files: DataFrame, state: DataFrame, no_cache: bool = False) -> DataFrame:
    """Adds `status` (unchanged, changed, new), `previously_refused` and `prev_*`.

    Both tables hold a path once, so the join key cannot be hot.
    """
    previous = complete_state(state).select(
        "path", F.lit(True).alias("prev_known"), *[F.col(c).alias(f"prev_{c}") for c in STATE_COLUMNS]
    )
    joined = files.join(previous, "path", "left")
    same = (F.col("size") == F.col("prev_size")) & (F.col("mtime_ns") == F.col("prev_mtime_ns"))
    unchanged = F.coalesce(same & _settled(), F.lit(False)) & F.lit(not no_cache)
    return joined.withColumns({
        "status": F.when(unchanged, "unchanged").when(F.col("prev_known"), "changed").otherwise("new"),
        "previously_refused": unchanged & F.col("prev_failed").isNotNull(),
    })


def is_touched() -> Column:
    """Read again, but the content is that of a settled record."""
    return (F.col("status") == "changed") & F.coalesce(
        (F.col("sha256") == F.col("prev_sha256")) & _settled(), F.lit(False)
    )


def detect_touched(files: DataFrame, state: DataFrame) -> DataFrame:
    checked = detect_unchanged(files, state)
    return checked.withColumn("status", F.when(is_touched(), "touched").otherwise(F.col("status")))


def lookup_known(
    files: DataFrame, hashes: DataFrame, no_cache: bool = False, hot: DataFrame | None | object = UNCOUNTED
) -> DataFrame:
    """Adds `known_uri` and `known_album_key` of content already remote."""
    if no_cache:
        nothing = F.lit(None).cast("string")
        return files.withColumns({"known_uri": nothing, "known_album_key": nothing})
    known = hashes.select(
        "sha256", F.col("uri").alias("known_uri"), F.col("album_key").alias("known_album_key")
    )
    return salted_join(files, known, ["sha256"], "left", hot=hot, spread=["path"])


def place_known(
    files: DataFrame, day_albums: DataFrame, hot: DataFrame | None | object = UNCOUNTED
) -> DataFrame:
    """Adds `placement`: linked if the known album is one of the day's, else collected.

    `day_albums` holds (day, album_key).
    """
    of_day = day_albums.select("day", F.col("album_key").alias("known_album_key"), F.lit(True).alias("_here")).distinct()
    joined = salted_join(files, of_day, ["day", "known_album_key"], "left", hot=hot, spread=["path"])
    return joined.withColumn(
        "placement",
        F.when(F.col("known_uri").isNotNull(), F.when(F.col("_here"), "linked").otherwise("collected")),
    ).drop("_here")


def image_refs(state: DataFrame) -> DataFrame:
    """Recorded paths per image."""
    return state.where(F.col("image_uri").isNotNull()).groupBy("image_uri").agg(F.count("*").alias("refs"))


def caption_jobs(files: DataFrame, state: DataFrame, chunk: int = 1000) -> DataFrame:
    """(image_uri, part, caption): every path of each image with a stale caption.

    An image of more than `chunk` copies has its caption in numbered parts,
    to be joined by newlines in order.
    """
    unchanged = detect_unchanged(files, state).where(
        (F.col("status") == "unchanged") & F.col("prev_image_uri").isNotNull()
    ).select(F.col("prev_image_uri").alias("image_uri"), "path", F.col("prev_captioned").alias("captioned"))
    hot = hot_keys(unchanged, ["image_uri"])
    stale = unchanged.where(~F.coalesce(F.col("captioned"), F.lit(False))).select("image_uri").distinct()
    members = salted_join(unchanged, stale, ["image_uri"], "left_semi", hot=hot, spread=["path"])
    return chunked_lists(members, ["image_uri"], "path", chunk, hot=hot).select(
        "image_uri", "part", F.array_join("values", "\n").alias("caption")
    )


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of `updates` replace those of the same key; one row per key in each."""
    kept = current.join(updates.select(key), key, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def apply_outcomes(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The next "files" table.

    `outcomes` has a row per processed path with `outcome` (ok, touched,
    refused, failed, collect_refused), the new record's columns, and `failed`
    as the reason.  A failed path, or one whose collect was refused, keeps its
    record; a touched one only moves size and time.
    """
    current = complete_state(state).select(
        "path", F.lit(True).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in STATE_COLUMNS]
    )
    fresh = complete_state(outcomes).join(
        outcomes.select("path", F.col("outcome").alias("_outcome")).where(~F.col("outcome").isin("failed", "collect_refused")), "path"
    )
    merged = current.join(fresh, "path", "full_outer")
    outcome = F.col("_outcome")

    def column(name: str) -> Column:
        new, old = F.col(name), F.col(f"_old_{name}")
        if name in ("image_uri", "album_key", "uploaded_md5"):
            new = F.when(outcome == "refused", None).otherwise(new)
        if name == "failed":
            new = F.when(outcome == "refused", new)
        if name == "captioned":
            new = F.coalesce((outcome == "ok") & new, F.lit(False))
        chosen = F.when(outcome.isNull(), old)
        if name not in ("size", "mtime_ns"):
            chosen = chosen.when((outcome == "touched") & F.col("_old").isNotNull(), old)
        return chosen.otherwise(new).alias(name)

    return merged.select("path", *[column(c) for c in STATE_COLUMNS])


def apply_hash_outcomes(hashes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The next "hashes" table.

    `outcomes` has `sha256`, `uri`, `album_key` and, where an image was
    replaced, `old_sha256` and `old_uri`.  The old content is forgotten only
    if it still points at the replaced image.  Where `outcome` is
    collect_refused, the image in `uri` is no longer there: content that points
    at it is forgotten, so the next plan uploads it.
    """
    replaced = outcomes.where(F.col("old_uri").isNotNull()).select(
        F.col("old_sha256").alias("sha256"), F.col("old_uri").alias("uri")
    ).distinct()
    if "outcome" in outcomes.columns:
        lost = F.coalesce(F.col("outcome") == "collect_refused", F.lit(False))
        replaced = replaced.unionByName(outcomes.where(lost).select("sha256", "uri")).distinct()
        outcomes = outcomes.where(~lost)
    kept = hashes.join(replaced, ["sha256", "uri"], "left_anti")
    columns = [c for c in hashes.columns if c in outcomes.columns]
    # One image per content: the first path's, chosen with map-side combine.
    added = (
        outcomes.where(F.col("uri").isNotNull())
        .groupBy("sha256")
        .agg(F.min_by(F.struct(*columns), "path").alias("_new"))
        .select("_new.*")
    )
    return upsert(kept, added, "sha256")


def mark_gone(state: DataFrame, gone_images: DataFrame, reason: str = C.REASON_GONE) -> DataFrame:
    """Every path of a vanished image loses it and is not retried until it changes."""
    gone = gone_images.select("image_uri").distinct().withColumn("_gone", F.lit(True))
    joined = salted_join(state, gone, ["image_uri"], "left", spread=["path"])
    lost = F.col("_gone").isNotNull()
    changes = {
        "failed": F.when(lost, reason).otherwise(F.col("failed")),
        "captioned": ~lost & F.col("captioned"),
        "image_uri": F.when(~lost, F.col("image_uri")),
    }
    if "album_key" in state.columns:
        changes["album_key"] = F.when(~lost, F.col("album_key"))
    return joined.withColumns(changes).select(*state.columns)


def orphans(state: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded paths no longer found: kept and reported, never deleted."""
    return state.join(files.select("path"), "path", "left_anti")


def files_still_backed_up(state: DataFrame, files: DataFrame) -> DataFrame:
    return state.join(files.select("path"), "path", "left_semi")
