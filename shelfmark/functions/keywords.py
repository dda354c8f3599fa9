"""Keyword lists kept as one `;`- or `,`-separated string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trimmed(word: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(word, r"(?U)^\s+|\s+$", "")


def split_keywords(text: Column) -> Column:
    trimmed = F.transform(F.split(text, "[;,]"), _trimmed)
    return F.filter(trimmed, lambda k: k != "")


def edit_keywords(text: Column, add: list[str] | Column, remove: list[str] | Column) -> Column:
    """Drop `remove`, then append each of `add` not yet there; case is ignored."""
    def words(value: list[str] | Column) -> Column:
        if not isinstance(value, Column):
            value = F.array(*[F.lit(v) for v in value]).cast("array<string>")
        return F.filter(F.transform(value, _trimmed), lambda k: k != "")

    dropped = F.transform(words(remove), lambda k: F.lower(k))
    kept = F.filter(split_keywords(text), lambda k: ~F.array_contains(dropped, F.lower(k)))
    return F.aggregate(
        words(add),
        kept,
        lambda have, k: F.when(F.exists(have, lambda h: F.lower(h) == F.lower(k)), have)
        .otherwise(F.array_append(have, k)),
    )
