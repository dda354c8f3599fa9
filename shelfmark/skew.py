"""Numbering, electing and joining when one key may hold a third of all rows.

Hot keys are found first, by a sketch and then a count.  At most `MAX_HOT_KEYS`
keys are treated as hot, the largest ones, so what comes to the driver and is
broadcast is bounded however large the table: a key that misses the list holds
fewer than 1/MAX_HOT_KEYS of the rows.  That share grows with the table; Spark's
own splitting of skewed join partitions is what is left for such keys.
Hot keys are split over many tasks and all others take the ordinary path;
nothing is dropped.  A table without hot keys gets an ordinary plan.

The count may be made on any table that holds at least the rows joined: pass
it as `hot` to count once, early, and not again after every join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from shelfmark.session import cut

# Rows of one key that a task handles without being split.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 4096
# Keys that the sketch of the largest ones tracks.
_TRACKED = 1 << 16
# Rows sampled per slice when choosing where to cut a hot key's order.
_SAMPLES_PER_SLICE = 32
_FAN = 32

# Not counted yet; None means counted, and no key is hot.
UNCOUNTED = object()


def hot_key_sets(
    df: DataFrame, key_sets: Mapping[str, Sequence[str]], hot_rows: int | None = None
) -> dict[str, DataFrame | None]:
    """Per name, (keys..., hot_n, slices) or None where no key is hot.

    One pass without a shuffle sketches the largest keys of all sets at once;
    only where the sketch shows any over the limit are those counted, exactly.
    The sketch tracks _TRACKED keys and misses none that holds more than a few
    times 1/_TRACKED of the rows; a miss would cost time, never rows.
    The slices of all hot keys of a set number at most 2 * MAX_HOT_KEYS.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    sketched = df.select(*[F.xxhash64(*keys).alias(f"_h_{name}") for name, keys in key_sets.items()]).agg(*[
        F.expr(f"approx_top_k(_h_{name}, {MAX_HOT_KEYS}, {_TRACKED})").alias(name) for name in key_sets
    ]).first()
    counted = None
    for name, keys in key_sets.items():
        found = [r["item"] for r in sketched[name] or [] if r["count"] > limit]
        if not found:
            continue
        # Bounded: MAX_HOT_KEYS numbers to a set.
        wanted = df.sparkSession.createDataFrame([(h,) for h in found], "_h bigint")
        largest = (
            df.select(*keys, F.xxhash64(*keys).alias("_h")).join(F.broadcast(wanted), "_h", "left_semi")
            .groupBy(*keys).agg(F.count("*").alias("hot_n"))
            .where(F.col("hot_n") > limit)
            .orderBy(F.desc("hot_n")).limit(MAX_HOT_KEYS)
            .select(F.lit(name).alias("_set"), "hot_n", F.struct(*keys).alias(f"_key_{name}"))
        )
        counted = largest if counted is None else counted.unionByName(largest, allowMissingColumns=True)
    rows = counted.collect() if counted is not None else []
    sets: dict[str, DataFrame | None] = {}
    for name, keys in key_sets.items():
        mine = [r for r in rows if r["_set"] == name]
        per_slice = max(limit, sum(r["hot_n"] for r in mine) // MAX_HOT_KEYS)
        schema = df.select(*keys).schema.add("hot_n", LongType()).add("slices", IntegerType())
        sets[name] = df.sparkSession.createDataFrame(
            [(*r[f"_key_{name}"], r["hot_n"], -(-r["hot_n"] // per_slice)) for r in mine],
            _nullable(schema),
        ) if mine else None
    return sets


def _nullable(schema):
    for field in schema.fields:
        field.nullable = True
    return schema


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame | None:
    return hot_key_sets(df, {"keys": keys}, hot_rows)["keys"]


def refined(hot: DataFrame | None, df: DataFrame, keys: Sequence[str], hot_rows: int | None = None):
    """Hot keys of a key set that refines one whose `hot` is known: a finer
    key has no more rows, so none is hot where no coarser one is."""
    return None if hot is None else hot_keys(df, keys, hot_rows)


def merged(key: str, *sets: DataFrame | None) -> DataFrame | None:
    """Hot keys of a table whose rows come from several; each set's one key
    column is taken as `key`.  Bounded as the sets are."""
    known = [s.select(F.col(s.columns[0]).alias(key), "hot_n", "slices") for s in sets if s is not None]
    if not known:
        return None
    return reduce(DataFrame.unionByName, known).groupBy(key).agg(
        F.sum("hot_n").alias("hot_n"), F.max("slices").alias("slices")
    )


def with_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of a bounded per-hot-key table; null keys match null keys."""
    renamed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *columns)
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_hot_{key}"))
    joined = df.join(F.broadcast(renamed), condition, "left")
    return joined.drop(*[f"_hot_{k}" for k in keys])


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    hot: DataFrame | None | object = UNCOUNTED,
    hot_rows: int | None = None,
) -> DataFrame:
    """Adds `name`: row_number() over (partition by keys order by order).

    A hot key's order is cut into slices at sampled values.  Where the cuts
    fall decides only how even the slices are: a row's number is its number
    within its slice plus the rows in earlier slices, which is exact.
    """
    if hot is UNCOUNTED:
        hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, number.cast("bigint"))
    df = cut(df, "ranked")
    # The order must tell rows apart; equal rows always share a slice.
    place = F.struct(*[F.col(c) for c in order])

    one_in = F.greatest(F.floor(F.col("hot_n") / (F.col("slices") * _SAMPLES_PER_SLICE)), F.lit(1))
    sampled = with_hot(df.select(*keys, place.alias("_place")), hot, keys, ["hot_n", "slices"]).where(
        F.col("slices").isNotNull()
        & (F.pmod(F.xxhash64(*[F.col(f"_place.{c}") for c in order]), one_in) == 0)
    )
    size = F.size("_sample")
    cuts = sampled.groupBy(*keys).agg(
        F.array_sort(F.collect_list("_place")).alias("_sample"), F.max("slices").alias("_slices")
    ).select(
        *keys,
        F.filter(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.col("_slices") - 1, F.lit(1))),
                lambda i: F.try_element_at(
                    F.col("_sample"), F.greatest(F.floor(i * size / F.col("_slices")).cast("int"), F.lit(1))
                ),
            ),
            lambda c: c.isNotNull(),
        ).alias("_cuts"),
    ).withColumn(
        # Every _FAN-th cut, so that a row's slice takes two short searches.
        "_coarse",
        F.filter(F.col("_cuts"), lambda c, i: (i + 1) % _FAN == 0),
    )

    def before(cut_list: Column) -> Column:
        return F.size(F.filter(cut_list, lambda c: c < place))

    sliced = with_hot(df, cuts, keys, ["_cuts", "_coarse"])
    coarse = before(F.col("_coarse"))
    sliced = sliced.withColumn(
        "_slice",
        F.when(
            F.col("_cuts").isNotNull(),
            coarse * _FAN + before(F.slice(F.col("_cuts"), coarse * _FAN + 1, F.lit(_FAN))),
        ).otherwise(0),
    )
    offsets = (
        sliced.where(F.col("_cuts").isNotNull())
        .groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"))
        .withColumn(
            "_before",
            F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_rows"),
        )
    )
    sliced = sliced.drop("_cuts", "_coarse")
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    numbered = sliced.withColumn("_local", local)
    placed = with_hot(numbered, offsets, [*keys, "_slice"], ["_before"])
    return placed.withColumn(
        name, (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint")
    ).drop("_local", "_before", "_slice")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot: DataFrame | None | object = UNCOUNTED,
    spread: Sequence[str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Equi join whose left side may hold hot keys; right has few rows per key.

    A hot key's left rows are spread over as many tasks as it has slices, and
    its right rows are repeated for each.  `spread` names the left columns
    hashed for that (all columns by default).
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"join kind {how!r} cannot repeat the right side")
    if hot is UNCOUNTED:
        hot = hot_keys(left, keys, hot_rows)
    if hot is None:
        return left.join(right, list(keys), how)
    spread_by = F.xxhash64(*[F.col(c) for c in (spread or left.columns)])
    salted = with_hot(left, hot, keys, ["slices"]).withColumn(
        "_salt", F.when(F.col("slices").isNotNull(), F.pmod(spread_by, F.col("slices"))).otherwise(0).cast("int")
    ).drop("slices")
    repeated = with_hot(right, hot, keys, ["slices"]).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1))
    ).drop("slices")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def elected(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group, by aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def chunked_lists(
    df: DataFrame, keys: Sequence[str], value: str, chunk: int, hot: DataFrame | None | object = UNCOUNTED
) -> DataFrame:
    """(keys..., part, values): a group's values in order, `chunk` to a row.

    A group of any size comes out whole, as numbered parts; part 0 is all of
    it for groups up to `chunk`.
    """
    numbered = ranked(df.select(*keys, value), keys, [value], "_n", hot=hot)
    return (
        numbered.withColumn("part", F.floor((F.col("_n") - 1) / chunk).cast("bigint"))
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(value)).alias("values"))
    )
