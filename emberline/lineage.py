"""Cutting the lineage of iterative operators through the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """spark.checkpoint.dir holds on a cluster; where nothing is set and all runs on one machine, a temporary folder of this
    process is."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="emberline_")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys into the session's number of shuffle partitions. Adaptive execution merges partitions by their bytes
    and would give a small table that a join multiplies to one task; a number that is named stays."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_place(df: DataFrame) -> DataFrame:
    """cut() of rows dealt by keys, which later plans know to be dealt so and leave where they are; with adaptive execution they don't."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.select("*"))  # planned anew
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
