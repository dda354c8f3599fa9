"""Matching files against a listing of the remote catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.naming import latest_by_name
from shelfmark.skew import UNCOUNTED, hot_keys, refined, salted_join


def union_catalogs(catalogs: Sequence[DataFrame]) -> DataFrame:
    """All albums of a series as one set; the later album's entry for a name wins."""
    return latest_by_name(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), catalogs))


def match_remote_name(
    files: DataFrame, remote: DataFrame, name: str = "file_name", hot: DataFrame | None | object = UNCOUNTED,
    within: Sequence[str] = (),
) -> DataFrame:
    """Adds `name_match` (skip, replace or none) and `replaces_uri`.

    `remote` holds (file_name, md5, uri), each name once to the columns `within`.
    """
    listed = remote.select(
        *within, F.col("file_name").alias(name), F.lower("md5").alias("_md5"), F.col("uri").alias("_uri")
    ).withColumn("_listed", F.lit(True))
    joined = salted_join(files, listed, [*within, name], "left", hot=hot, spread=["path"])
    same = F.coalesce(F.col("_md5") == F.lower("md5"), F.lit(False))
    match = F.when(F.col("_listed").isNull(), "none").when(same, "skip").otherwise("replace")
    return joined.withColumns({
        "name_match": match, "replaces_uri": F.when(match == "replace", F.col("_uri")),
    }).drop("_md5", "_uri", "_listed")


def match_remote_content(files: DataFrame, remote: DataFrame) -> DataFrame:
    """Files whose content is in the target under any name."""
    listed = remote.where(F.col("md5").isNotNull()).select(F.lower("md5").alias("_md5")).distinct()
    keyed = files.withColumn("_md5", F.lower("md5"))
    return salted_join(keyed, listed, ["_md5"], "left_semi", spread=["path"]).drop("_md5")


def plan_collects(
    files: DataFrame, target_albums: DataFrame, target_names: DataFrame, hashes: DataFrame,
    hot_names: DataFrame | None | object = UNCOUNTED, hot_content: DataFrame | None | object = UNCOUNTED,
    within: Sequence[str] = (),
) -> DataFrame:
    """Adds `collect_uri`: the known image to add to the target, null if none, and `cached`.

    Not collected: files whose name is in the target, of unknown content, or
    whose known image already is in one of the target's albums.  With several
    targets, `within` names the columns that tell them apart.
    """
    # Where a known image is: the target that holds its album, null for none.
    targets = F.struct(F.lit(True).alias("known"), *within)
    held = target_albums.groupBy("album_key").agg(F.min(targets).alias("_in"))
    known_content = hashes.join(held, "album_key", "left").select("sha256", F.col("uri").alias("_uri"), "_in")
    named = target_names.select(*within, "file_name").distinct().withColumn("_named", F.lit(True))
    if hot_content is UNCOUNTED:
        hot_content = hot_keys(files, ["sha256"])
    checked = salted_join(files, named, [*within, "file_name"], "left", hot=hot_names, spread=["path"])
    known = salted_join(checked, known_content, ["sha256"], "left", hot=hot_content, spread=["path"])
    here = F.col("_in").isNotNull()
    for column in within:
        here = here & (F.col(f"_in.{column}") == F.col(column))
    return known.withColumns({
        "collect_uri": F.when(F.col("_named").isNull() & ~F.coalesce(here, F.lit(False)), F.col("_uri")),
        "cached": F.when(F.col("_uri").isNotNull(), True),
    }).drop("_named", "_uri", "_in")


def images_with_album_name(images: DataFrame, albums: DataFrame) -> DataFrame:
    """Adds `album_name` (its key where the album is missing) and `shown_name`."""
    names = albums.select("album_key", F.col("name").alias("_album"))
    joined = salted_join(images, names, ["album_key"], "left", spread=["image_key"])
    file_name = F.when(F.col("file_name") != "", F.col("file_name"))
    return joined.withColumns({
        "album_name": F.coalesce("_album", "album_key"),
        "shown_name": F.coalesce(file_name, "image_key"),
    }).drop("_album")


def album_key_of(found: Column) -> Column:
    """Album key from a search hit's nested link."""
    key = F.substring_index(found["ImageAlbum"]["Uri"], "/", -1)
    return F.when(key != "", key)


def downloadable(images: DataFrame, albums: DataFrame) -> DataFrame:
    """Images of albums that do not forbid downloads."""
    allowed = albums.where(F.coalesce("allow_downloads", F.lit(True))).select("album_key")
    return salted_join(images, allowed, ["album_key"], "left_semi", spread=["image_key"])


def pick_by_name(
    catalog: DataFrame, wanted: DataFrame, exact_first: bool = True, or_key: str | None = None,
    position: str = "pos",
) -> DataFrame:
    """The catalog entry each wanted `name` means.

    Ignoring case, an exact match first if `exact_first`, then listing order.
    With `or_key`, an exact name or an exact key, in listing order.
    """
    rest = [c for c in catalog.columns if c != "name"]
    entries = catalog.select(F.col("name").alias("_name"), *rest)
    entry = F.struct("_name", *rest)
    if or_key:
        spellings = F.array_distinct(F.array("_name", or_key))
        listed = entries.select(F.explode(spellings).alias("_spelling"), position, entry.alias("_entry"))
        best = listed.groupBy("_spelling").agg(F.min_by("_entry", position).alias("_entry"))
        asked = wanted.withColumn("_spelling", F.col("name"))
        joined = salted_join(asked, best, ["_spelling"], "left")
        return joined.select(
            *wanted.columns, F.col("_entry._name").alias("found"), *[F.col(f"_entry.{c}").alias(c) for c in rest]
        )
    listed = entries.select(F.lower("_name").alias("_spelling"), position, entry.alias("_entry"))
    loose = listed.groupBy("_spelling").agg(F.min_by("_entry", position).alias("_loose"))
    asked = wanted.withColumn("_spelling", F.lower("name"))
    hot = hot_keys(asked, ["_spelling"])
    joined = salted_join(asked, loose, ["_spelling"], "left", hot=hot)
    if exact_first:
        exact = listed.select(F.col("_entry._name").alias("name"), position, "_entry").groupBy("name").agg(
            F.min_by("_entry", position).alias("_exact")
        )
        joined = salted_join(joined, exact, ["name"], "left", hot=refined(hot, wanted, ["name"]))
        joined = joined.withColumn("_loose", F.coalesce("_exact", "_loose"))
    return joined.select(
        *wanted.columns, F.col("_loose._name").alias("found"), *[F.col(f"_loose.{c}").alias(c) for c in rest]
    )


def pick_variant(details: DataFrame, size: str) -> DataFrame:
    """Adds `picked`: the wanted size where usable, else the largest there is.

    `details` holds usable (array of names), largest (name), sizes (map of
    name to struct); a name without an entry gives null.
    """
    wanted = F.lit(f"ImageSize{size}")
    chosen = F.when(F.coalesce(F.array_contains("usable", wanted), F.lit(False)), wanted).otherwise(F.col("largest"))
    return details.withColumn("picked", F.try_element_at("sizes", chosen))
