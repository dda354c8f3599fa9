"""Mixing sources to target weights, by blocks and permutations; DataFrame functions only.

The words of each source, documents in an order of their own, are packed into
blocks of one length.  An output shard is `shard_slots` slots.  Each slot draws its
source at random by the targets, so a shard's counts are multinomial; slots a source
draws beyond its quota go to sources that fell short, so the totals meet the quotas.
A source's n-th slot maps through a pseudorandom permutation of its block indexes,
again and again for sources that repeat, and slots join blocks by that index.

Null texts have no words.  A null source is a source, after all others.  Repeated
rows are rows of their own.  A source without words has target 0.  An empty table
gives no rows.  Everything follows from `seed` and the rows, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.frames import aside
from shelfmark.session import cut

WORD = r"[^\x20\x09-\x0D]+"
# Cells of the table that finds a slot's source by equi join.
_CELLS = 4096
# Documents numbered within one task; larger sources are cut into slices.
_SLICE_ROWS = 4096


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """Adds to (source, source_size, ...) the weight and the target of each source.

    Targets share the words of all sources by weight; one that would exceed `repeats`
    times its size stops there, and the others share the rest by weight: the level at
    which that ends is found by one pass in the order in which sources reach their cap.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("s") - 1) % len(weights) + 1).cast("int"))
    known = (
        sources.withColumn("s", F.row_number().over(place)).withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(repeats)).withColumn("reach", F.col("cap") / F.col("weight"))
    )
    order = Window.orderBy("reach", "s")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("cap")) / F.sum("weight").over(rest)
    found = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "s", "level"))).over(Window.partitionBy())
    return (
        known.withColumn("level", level)
        .withColumn("target", F.coalesce(F.least("cap", F.col("weight") * found["level"]), F.col("cap")))
        .drop("level", "reach", "cap")
    )


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A bijection of 0..n-1 chosen by `key`: rounds of modular sums on an a x b grid
    with a*b just over n; an index that leaves the range walks on until it is back."""
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)

    def once(x: Column) -> Column:
        left, right = F.floor(x / b), x % b
        for turn in range(3):
            left = F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(2 * turn)), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(left, key, F.lit(2 * turn + 1)), b), b)
        return (left * b + right).cast("bigint")

    steps = F.array(*[F.lit(i) for i in range(24)])
    return F.aggregate(steps, once(index.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def _numbered(slots: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the number, from 0, of a row among those of `keys` in slot order: the rows
    of earlier shards plus the place within the shard, so no key meets in one task."""
    shards = slots.groupBy(*keys, "shard").agg(F.count("*").alias("_here"))
    before = F.sum("_here").over(Window.partitionBy(*keys).orderBy("shard")) - F.col("_here")
    inner = F.row_number().over(Window.partitionBy(*keys, "shard").orderBy("slot"))
    return (
        slots.withColumn("_place", inner).join(shards.withColumn("_before", before), [*keys, "shard"])
        .withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_place", "_before", "_here")
    )


def _within(slots: DataFrame, at: str, ranges: DataFrame, total: int) -> DataFrame:
    """Joins each slot to the one range lo <= at < hi, by cells of the whole 0..total."""
    cell = lambda x: F.floor(x * (float(_CELLS) / total)).cast("int")
    cells = ranges.withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1) + 1)))
    joined = slots.withColumn("_cell", cell(F.col(at))).join(cells, "_cell")
    return joined.where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("_cell", "lo", "hi")


def block_draws(sources: DataFrame, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(slots, draws): each slot's shard, source s and block, and how often each block is drawn."""
    spark = sources.sparkSession
    upto = lambda x: F.sum(x).over(Window.orderBy("s"))
    ranged = cut(sources.select("s", "n_blocks", "quota", (upto("quota") - F.col("quota")).alias("lo"), upto("quota").alias("hi")).where("quota > 0"), "ranges")
    total = ranged.agg(F.coalesce(F.max("hi"), F.lit(0)).cast("bigint")).first()[0]
    slots = spark.range(total).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("at"),
    )
    drawn = cut(_numbered(_within(slots, "at", ranged, max(total, 1)).drop("at"), ["s"], "draw"), "drawn")
    counts = drawn.groupBy("s").agg(F.count("*").alias("drawn"))
    short = (
        ranged.join(counts, "s", "left").select("s", "n_blocks", "quota", F.coalesce("drawn", F.lit(0)).alias("had"))
        .withColumn("lacks", F.col("quota") - F.col("had")).where("lacks > 0")
        .select("s", "n_blocks", "quota", "had", (upto("lacks") - F.col("lacks")).alias("lo"), upto("lacks").alias("hi"))
    )
    short = cut(short, "short")
    lacking = short.agg(F.coalesce(F.max("hi"), F.lit(0)).cast("bigint")).first()[0]
    spare = _numbered(drawn.where("draw >= quota").select("slot", "shard"), [], "at")
    moved = (
        _within(spare, "at", short.withColumn("from", F.col("lo")), max(lacking, 1))
        .withColumn("draw", F.col("had") + F.col("at") - F.col("from"))
    )
    columns = ["slot", "shard", "s", "n_blocks", "draw"]
    mapped = drawn.where("draw < quota").select(columns).unionByName(moved.select(columns)).withColumn(
        "block", permuted(F.col("draw") % F.col("n_blocks"), F.col("n_blocks"), F.xxhash64(F.lit(seed), "s"))
    ).withColumn("pass", F.floor(F.col("draw") / F.col("n_blocks")))
    return mapped, mapped.groupBy("s", "block").agg(F.count("*").alias("draws"))


def mix_blocks(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, block_words: int = 256,
    min_blocks: int = 256, shard_slots: int = 4096, seed: int = 11,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of the mix.

    documents: doc_id, _row, size, source_size, target, and `start`, the words of its
    source before it; pieces: (s, start, block, from, words, draws), the part of a document
    in a block and how often the mix takes it; slots: what each output shard holds.
    Blocks have `block_words` words, fewer where a source would have under `min_blocks`.
    """
    # One pass over the texts; what follows reads this narrow table.
    sized = cut(docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("_row"),
    ), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    length = F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(F.col("source_size") / min_blocks)))
    sources = (
        targets(sources, weights, repeats).withColumn("length", length)
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("length")))
        .withColumn("quota", F.when(F.col("source_size") > 0, F.least(
            F.col("n_blocks") * repeats, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("bigint"))).otherwise(0))
        .withColumn("slices", F.ceil(F.col("n_docs") / _SLICE_ROWS))
    )
    sources = cut(sources, "sources")
    slots, draws = block_draws(sources, shard_slots, seed)
    named = sized.withColumnRenamed("source", "_source")
    placed = named.join(sources, F.col("_source").eqNullSafe(F.col("source"))).withColumn("slice", F.pmod(F.col("_row"), F.col("slices")))
    slices = placed.groupBy("s", "slice").agg(F.sum("size").alias("_words"))
    slices = slices.withColumn("_before", F.sum("_words").over(Window.partitionBy("s").orderBy("slice")) - F.col("_words")).drop("_words")
    inner = F.sum("size").over(Window.partitionBy("s", "slice").orderBy("doc_id", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    documents = cut(
        placed.withColumn("_upto", inner).join(slices, ["s", "slice"])
        .select("doc_id", "_row", "s", "size", "source_size", "target", "length", (F.col("_before") + F.col("_upto") - F.col("size")).alias("start")), "placed")
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
    begins = F.greatest("start", F.col("block") * F.col("length"))
    ends = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    pieces = (
        documents.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), last)))
        .select("s", "start", "block", (begins - F.col("start")).alias("from"), (ends - begins).alias("words"))
        .join(draws, ["s", "block"])
    )
    return documents, pieces, slots


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of a document in the mix, repeats counted."""
    documents, pieces, _ = mix_blocks(docs, **options)
    taken = pieces.groupBy("s", "start").agg(F.sum(F.col("words") * F.col("draws")).alias("_taken")).withColumn("_some", F.lit(True))
    return documents.withColumn("_some", F.col("size") > 0).join(taken, ["s", "start", "_some"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of `docs`.

    Pass p over a source gives a document the words of its blocks drawn more than p
    times: its text as it is where that is all of them, else those words, joined by
    spaces.  A document of which nothing is taken is left out, one without words stays.
    """
    documents, pieces, _ = mix_blocks(docs, **options)
    parts = (
        pieces.withColumn("pass", F.explode(F.sequence(F.lit(0), (F.col("draws") - 1).cast("int"))))
        .groupBy("s", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "words"))).alias("_parts"))
        .withColumn("_some", F.lit(True))
    )
    # Rows alike in all three columns have parts of their own: the n-th takes the n-th.
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("start"))
    plan = documents.withColumn("_nth", nth).withColumn("_some", F.col("size") > 0).join(parts, ["s", "start", "_some"], "left")
    plan = plan.where("size = 0 or _parts is not null").select("_row", "_nth", "size", "_parts", "pass")
    row = F.xxhash64("doc_id", "source", "text")
    alike = Window.partitionBy("_row").orderBy("doc_id")
    held, column = aside(docs, ["doc_id", "source", "text"])
    texts = held.withColumn("_row", row).withColumn("_nth", F.row_number().over(alike))
    whole = F.col("_parts").isNull() | (F.aggregate("_parts", F.lit(0).cast("bigint"), lambda n, p: n + p["words"]) == F.col("size"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cutout = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(F.col("_words"), (p["from"] + 1).cast("int"), p["words"].cast("int")))), " ")
    mixed = texts.join(plan, ["_row", "_nth"]).withColumn("_words", F.when(~whole, words)).withColumn("_text", F.when(whole, F.col("text")).otherwise(cutout))
    return mixed.select(*[
        F.col("_text").alias(c) if c == "text" else F.length("_text").cast("bigint").alias(c) if c == "n_chars" else column[c].alias(c)
        for c in docs.columns
    ])
