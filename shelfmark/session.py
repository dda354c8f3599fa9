"""Session helpers: shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as `spark.checkpoint.dir` names it.

    Only on one machine, as in tests, is one made where the session names none.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="shelfmark-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str = "step") -> DataFrame:
    """Write `df` once to shared storage, for plans that use it many times.

    A lost executor then costs a re-read, not the plan before it.  Parquet
    lets every later use read only its columns.
    """
    target = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
