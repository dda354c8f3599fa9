"""License scans by diagonal voting; DataFrame functions only.

Rolling hashes of `GRAM` words of every text join the positions at which license
templates have them.  A hit at text word i and template word j votes for diagonal
i - j.  Votes are counted by diagonal, diagonals within `drift` of each other are
merged, so that words put in or left out split no match, and a span counts if the share
of the template's grams that it holds reaches the template's threshold.

Null and empty texts have no words and no labels.  Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.session import cut

GRAM = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that name a license, whole, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences of public license notices, and the labels this scan adds.
NOTICES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-notice",
}


def templates(spark: SparkSession, phrases: Mapping[str, str], notices: Mapping[str, str], share: float) -> DataFrame:
    """(template, label, base, grams, needed): a phrase needs all its grams, a notice `share` of them."""
    rows = [(i, text.split(), label, i < len(phrases)) for i, (text, label) in enumerate([*phrases.items(), *notices.items()])]
    if any(len(words) < GRAM for _, words, _, _ in rows):
        raise ValueError(f"templates need {GRAM} words")
    given = spark.createDataFrame(rows, "template int, words array<string>, label string, base boolean")
    grams = F.size("words") - (GRAM - 1)
    return given.withColumn("grams", grams).withColumn("needed", F.when(F.col("base"), grams).otherwise(F.ceil(grams * share)).cast("int"))


def _grams(words):
    starts = F.sequence(F.lit(1), F.size(words) - (GRAM - 1))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(GRAM)]))
    return F.when(F.size(words) >= GRAM, hashed).otherwise(F.array().cast("array<bigint>"))


def scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES,
    share: float = 0.7, drift: int = 3,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans holds (label, first, last, share) of every match, in words from 0; score is the
    largest share of a template that any span of the document holds, 0 to 1.
    The templates are a parameter; they and the hashes of their grams are broadcast.
    """
    spark = docs.sparkSession
    known = templates(spark, phrases, notices, share)
    positions = known.select("template", F.posexplode(_grams(F.col("words"))).alias("t_pos", "gram"))
    # Bounded by the templates given: a few grams each.
    wanted = [r[0] for r in positions.select("gram").distinct().collect()]
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    counted = docs.select("doc_id", F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("_words"))
    counted = counted.select("doc_id", F.size("_words").cast("bigint").alias("n_words"), _grams(F.col("_words")).alias("_grams"))
    kept = F.array(*[F.lit(g) for g in wanted])
    hits = F.filter(F.transform("_grams", lambda g, i: F.struct(g.alias("gram"), i.alias("pos"))), lambda h: F.array_contains(kept, h["gram"]))
    # The one pass over the texts; most documents hold no template gram and skip the search.
    scanned = cut(counted.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "n_words",
        F.when(F.arrays_overlap("_grams", kept), hits).otherwise(F.array().cast("array<struct<gram:bigint,pos:int>>")).alias("hits"),
    ), "licenses")
    votes = (
        scanned.select("_row", F.explode("hits").alias("h")).select("_row", "h.gram", F.col("h.pos").alias("pos"))
        .join(F.broadcast(positions), "gram")
        .groupBy("_row", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .agg(F.count_distinct("t_pos").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("t_pos").alias("t_positions"))
        .join(F.broadcast(known.select("template", "label", "base", "grams", "needed")), "template")
    )
    # Phrases are whole on one diagonal; only notices drift.
    side = Window.partitionBy("_row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(side)
    runs = votes.withColumn("_new", F.when(F.col("base") | gap.isNull() | (gap > drift), 1).otherwise(0)).withColumn("run", F.sum("_new").over(side))
    spans = (
        runs.groupBy("_row", "template", "run", "label", "base", "grams", "needed")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("t_positions")))).alias("held"),
            F.min("first").cast("bigint").alias("first"), (F.max("last") + GRAM - 1).cast("bigint").alias("last"),
        )
        .withColumn("share", F.col("held") / F.col("grams"))
    )
    held = F.col("held") >= F.col("needed")
    whole = F.col("base") & held
    found = spans.groupBy("_row").agg(
        F.sum(F.when(whole, 1).otherwise(0)).cast("bigint").alias("n_base"),
        F.min(F.when(whole, F.col("first"))).alias("first_word"), F.max(F.when(whole, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(held, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.when(held, F.struct("first", "last", "label", "share")))).alias("spans"),
    )
    return scanned.drop("hits").join(found, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
