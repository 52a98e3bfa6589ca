"""Helpers that every operator of this subpackage shares.

None of them imports the rest of the library.
"""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all runs on one machine
    (tests) a temporary folder of this process."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="llm_shared_")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


_used: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _used:
        atexit.register(_clear)
    _used.append(path)
    return path


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    try:
        for path in _used if spark else ():
            drop_path(spark, path)
    except Exception:  # the session's JVM has ended
        return


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _where[id(out)] = out, path
    return out


_where: dict[int, tuple[DataFrame, str]] = {}


def release(spark: SparkSession, *staged: DataFrame) -> None:
    """Give disk back within a query: delete staged tables that nothing reads any more, and have the driver
    collect its garbage, as Spark removes the files of an exchange when no plan refers to it. The first round
    lets go of what Python's objects held; only the second finds the plans unused."""
    for df in staged:
        drop_path(spark, _where.pop(id(df))[1])
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch of whole texts, for this session from now on, as plans read the setting when they run.
    Spark's spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set, bounds its bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > rows:
        spark.conf.set(key, str(rows))


def partitions(df: DataFrame, target_bytes: int = 128 << 20) -> int:
    """Shuffle partitions for whole texts: the session's number, or more where the input needs it."""
    held = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(held, math.ceil(min(size, 1 << 60) / target_bytes)) if size < 1 << 60 else held


def doc_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, null text read as empty: other columns, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"{name}_"
    return name
