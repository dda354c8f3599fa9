"""Identical content at several paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.skew import UNCOUNTED, chunked_lists, hot_keys, salted_join


def elect_copies(files: DataFrame, hot: DataFrame | None | object = UNCOUNTED) -> DataFrame:
    """Adds `leader` (the first path of each content) and `is_leader`.

    The leader is a minimum, so a content that a third of all files share
    needs no ordering of its group.
    """
    leaders = files.groupBy("sha256").agg(F.min("path").alias("leader"))
    joined = salted_join(files, leaders, ["sha256"], "left", hot=hot, spread=["path"])
    return joined.withColumn("is_leader", F.coalesce(F.col("path") == F.col("leader"), F.lit(True)))


def follow_leaders(
    elected_files: DataFrame, leader_outcomes: DataFrame, hot: DataFrame | None | object = UNCOUNTED
) -> DataFrame:
    """What each follower becomes once its leader's outcome is known.

    `leader_outcomes` has (path, outcome, day).  A follower of a placed leader
    is linked on the same day and collected on another; else it fails.
    """
    outcomes = leader_outcomes.select(
        F.col("path").alias("leader"), F.col("outcome").alias("_outcome"), F.col("day").alias("_day")
    )
    joined = salted_join(elected_files, outcomes, ["leader"], "left", hot=hot, spread=["path"])
    return joined.withColumn(
        "copy_action",
        F.when(F.col("is_leader"), "leader")
        .when(F.col("_outcome") != "ok", "failed")
        .when(F.col("day") == F.col("_day"), "linked")
        .otherwise("collected"),
    ).drop("_outcome", "_day")


def duplicate_groups(files: DataFrame, chunk: int = 1000) -> DataFrame:
    """(sha256, copies, wasted_bytes, part, paths) of content held more than once."""
    groups = (
        files.groupBy("sha256")
        .agg(F.count("*").alias("copies"), F.sum("size").alias("_total"), F.min("size").alias("_one"))
        .where(F.col("copies") > 1)
        .select("sha256", "copies", (F.col("_total") - F.col("_one")).alias("wasted_bytes"))
    )
    hot = hot_keys(files, ["sha256"])
    members = salted_join(
        files.select("sha256", "path"), groups.select("sha256"), ["sha256"], "left_semi", hot=hot, spread=["path"]
    )
    lists = chunked_lists(members, ["sha256"], "path", chunk, hot=hot)
    return lists.join(groups, "sha256").select(
        "sha256", "copies", "wasted_bytes", "part", F.col("values").alias("paths")
    )
