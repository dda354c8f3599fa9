"""Search, listings and keywords over the remote catalog's images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.dates import parse_bound, stored_span
from shelfmark.functions.keywords import split_keywords
from shelfmark.session import cut


# Texts of an image that are searched.
TEXT_FIELDS = ("title", "caption", "keywords", "file_name")


def search_images(
    images: DataFrame,
    text: str | None = None,
    keywords: Sequence[str] = (),
    taken_from: str | None = None,
    taken_to: str | None = None,
    limit: int = C.SEARCH_LIMIT,
) -> DataFrame:
    """Images matching everything given; `taken` is the stored UTC instant.

    Bounds are camera clock times, widened over the hours daylight saving
    repeats or skips.  Every word of `text` is a substring, ignoring case, of
    title, caption, keywords or file name.  A limit of 0 means all.
    """
    if text is None and not keywords and taken_from is None and taken_to is None:
        raise ValueError("give at least one of text, keywords, taken_from or taken_to")
    start = parse_bound(taken_from, False) if taken_from is not None else None
    end = parse_bound(taken_to, True) if taken_to is not None else None
    if start and end and start > end:
        raise ValueError("taken_from is after taken_to")

    matches = F.lit(True)
    taken = F.col("taken")
    if start:
        matches = matches & (taken >= stored_span(F.lit(start).cast("timestamp_ntz"))["lo"])
    if end:
        matches = matches & (taken <= stored_span(F.lit(end).cast("timestamp_ntz"))["hi"])
    if keywords:
        tagged = F.transform(split_keywords(F.col("keywords")), lambda k: F.lower(k))
        for keyword in keywords:
            matches = matches & F.array_contains(tagged, keyword.strip().lower())
    fields = [F.lower(F.col(c)) for c in TEXT_FIELDS]
    for word in (text or "").lower().split():
        anywhere = F.lit(False)
        for field in fields:
            anywhere = anywhere | F.coalesce(field.contains(word), F.lit(False))
        matches = matches & anywhere
    by_date = taken.asc() if start or end else taken.desc()
    found = images.where(matches).orderBy(by_date, "image_key")
    return found.limit(limit) if limit else found


def recent_images(images: DataFrame, limit: int = C.RECENT_LIMIT) -> DataFrame:
    """Newest upload first; 0 for all."""
    newest = images.orderBy(F.desc("upload_seq"), "image_key")
    return newest.limit(limit) if limit else newest


_IMAGE_ORDERS = {
    "Position": "position", "Caption": "caption", "Filename": "file_name",
    "Date Uploaded": "upload_seq", "Date Modified": "modified", "Date Taken": "taken",
}
_FOLDER_ORDERS = {"Name": "name", "DateAdded": "added", "DateModified": "modified", "SortIndex": "pos"}


def _ordered(rows: DataFrame, column: str, direction: str, tie: str) -> DataFrame:
    key: Column = F.col(column).desc() if direction == "Descending" else F.col(column).asc()
    return rows.orderBy(key, tie)


def listing_order(images: DataFrame, method: str = "Position", direction: str = "Ascending") -> DataFrame:
    return _ordered(images, _IMAGE_ORDERS[method], direction, "image_key")


def folder_listing_order(nodes: DataFrame, method: str = "Name", direction: str = "Ascending") -> DataFrame:
    return _ordered(nodes, _FOLDER_ORDERS[method], direction, "uri")


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Adds each row's place, from 1, in the order of `ordered`, over all of it.

    A sorted table's partitions follow each other, so a row's place is that in
    its partition plus the rows of earlier ones: no task sees the whole.
    """
    placed = cut(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    # A row for each partition.
    parts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    joined = placed.withColumn("_part", part).join(parts.select("_part", before.alias("_before")), "_part")
    inner = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("_before") + inner + 1).drop("_at", "_part", "_before")


def top_keywords(images: DataFrame, count: int | None = None) -> DataFrame:
    """(keyword, images): most used first, ignoring case, an image counted once."""
    distinct = F.array_distinct(F.transform(split_keywords(F.col("keywords")), lambda k: F.lower(k)))
    counts = (
        images.select(F.explode(distinct).alias("keyword"))
        .groupBy("keyword").agg(F.count("*").alias("images"))
        .orderBy(F.desc("images"), "keyword")
    )
    return counts if count is None else counts.limit(count)
