"""Album series: `Name`, `Name (2)`, ... filled in order, capacity to an album."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.paths import series_name
from shelfmark.skew import UNCOUNTED, elected, hot_keys, ranked, salted_join


def series_prefix(albums: DataFrame) -> DataFrame:
    """Existing albums (series, n, ...) up to the first missing number.

    A series has at most SERIES_LIMIT rows once its numbers are distinct, so
    its window is bounded.
    """
    numbered = albums.where(F.col("n").between(1, C.SERIES_LIMIT))
    tie = [c for c in ("pos", "album_key") if c in albums.columns] or ["n"]
    distinct = elected(numbered, ["series", "n"], tie)
    place = F.row_number().over(Window.partitionBy("series").orderBy("n"))
    return distinct.withColumn("_place", place).where(F.col("_place") == F.col("n")).drop("_place")


def _free_room(albums: DataFrame, capacity: int) -> DataFrame:
    """(series, existing, room, room_ends): one row per series, at most
    SERIES_LIMIT ends, being the free slots up to and with each album."""
    free = F.greatest(F.lit(capacity) - F.col("cnt"), F.lit(0))
    running = F.sum(free).over(Window.partitionBy("series").orderBy("n"))
    return (
        series_prefix(albums).withColumn("_end", running)
        .groupBy("series")
        .agg(
            F.max("n").alias("existing"),
            F.max("_end").alias("room"),
            F.transform(
                F.sort_array(F.collect_list(F.struct("n", "_end"))), lambda a: a["_end"]
            ).alias("room_ends"),
        )
    )


def assign_slots(
    files: DataFrame,
    albums: DataFrame,
    capacity: int = C.ALBUM_CAPACITY,
    order: Sequence[str] = ("path",),
    hot: DataFrame | None | object = UNCOUNTED,
    hot_rows: int | None = None,
) -> DataFrame:
    """Adds `n`, `album_name`, `created` and `slot_error` to files (series, ...).

    `albums` holds (series, n, cnt).  The r-th file of a series goes to the
    album whose running free room first reaches r; past all room, to new
    albums after the last one.  Beyond SERIES_LIMIT albums is an error.
    """
    if hot is UNCOUNTED:
        hot = hot_keys(files, ["series"], hot_rows)
    numbered = ranked(files, ["series"], list(order), "_r", hot=hot)
    joined = salted_join(
        numbered, _free_room(albums, capacity), ["series"], "left", hot=hot, spread=list(order)
    )
    existing = F.coalesce(F.col("existing"), F.lit(0))
    room = F.coalesce(F.col("room"), F.lit(0))
    filled = F.size(F.filter("room_ends", lambda end: end < F.col("_r")))
    in_new = existing + F.ceil((F.col("_r") - room) / capacity)
    n = F.when(F.col("_r") <= room, filled + 1).otherwise(in_new).cast("int")
    fits = F.col("n") <= C.SERIES_LIMIT
    return (
        joined.withColumn("n", n)
        .withColumns({
            "created": fits & (F.col("n") > existing),
            "slot_error": F.when(~fits, C.REASON_SERIES_FULL),
            "album_name": F.when(fits, series_name(F.col("series"), F.col("n"))),
        })
        .withColumn("n", F.when(fits, F.col("n")))
        .drop("_r", "existing", "room", "room_ends")
    )


def series_usage(assigned: DataFrame, albums: DataFrame) -> DataFrame:
    """Per album that took files: count after the run, claimed, created."""
    claimed = (
        assigned.where(F.col("n").isNotNull())
        .groupBy("series", "n", "album_name", "created").agg(F.count("*").alias("claimed"))
    )
    before = series_prefix(albums).select("series", "n", "cnt")
    return claimed.join(before, ["series", "n"], "left").select(
        "series", "n", "album_name", "claimed", "created",
        (F.coalesce(F.col("cnt"), F.lit(0)) + F.col("claimed")).cast("bigint").alias("count"),
    )
