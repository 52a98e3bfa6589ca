"""Run logs as JSON lines, JSON documents, figures as CSV, and Parquet tables of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.graph import dense_index


def read_logs(spark: SparkSession, folder: str, pattern: str = "*", schema: str | None = None) -> DataFrame:
    """Log lines of the files whose names match the pattern, with the file's name in log_file."""
    reader = spark.read.option("pathGlobFilter", pattern)
    if schema:
        reader = reader.schema(schema)
    return reader.json(folder).withColumn("log_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def project(logs: DataFrame, *keys: str) -> DataFrame:
    """Keys as Group:Property for a nested field or Name for one at the top; none or 'all' keeps every column."""
    if not keys or keys == ("all",):
        return logs
    return logs.select(*[F.col(k.replace(":", ".")).alias(k.split(":")[-1]) for k in keys])


def save_statistics(logs: DataFrame, folder: str, *keys: str) -> None:
    """Projected columns of run logs, a few rows, as one JSON array; read_document reads it."""
    rows = project(logs, *keys)
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.mode("overwrite").text(folder)


def save_run(exposures: DataFrame, run: str, folder: str, membership: DataFrame | None = None) -> None:
    """What a run knows of each user, in order of user: (pos, user, membership, symptom, exposure), partitioned by run. It
    stands for the arrays of a log line, which one row couldn't hold for many users."""
    rows = exposures.select("user", F.col("init_val").alias("symptom"), F.col("exposure"))
    parts = rows.select("user", F.lit(0).alias("membership")) if membership is None else membership.toDF("user", "membership")
    joined = rows.join(parts, "user", "left").join(dense_index(rows.select("user")).withColumnRenamed("idx", "pos"), "user")
    joined.select("pos", "user", "membership", "symptom", "exposure", F.lit(run).alias("run")).write.mode("append").partitionBy("run").parquet(folder)


def with_arrays(log: DataFrame, run_rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A log of one row with Membership, SymptomScores and ExposureScores as arrays, for runs of up to most users."""
    if run_rows.limit(most + 1).count() > most:
        raise ValueError(f"a log line holds up to {most} users; use the table of save_run")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "membership", "symptom", "exposure")))
    held = run_rows.agg(ordered.alias("_all")).select(F.col("_all.membership").alias("Membership"), F.col("_all.symptom").alias("SymptomScores"), F.col("_all.exposure").alias("ExposureScores"))
    return log.crossJoin(held)  # one row each


def append_log(log: DataFrame, folder: str) -> None:
    log.coalesce(1).write.mode("append").json(folder)


def save_figure(df: DataFrame, value: str, parameter: str, folder: str) -> None:
    """value and the parameter times ten, cut to a whole number, as CSV with a header."""
    df.select(value, (F.col(parameter) * 10).cast("int").alias(parameter)).coalesce(1).write.mode("overwrite").csv(folder, header=True)


def save_arrays(df: DataFrame, run: str, column: str, folder: str) -> None:
    """Arrays of runs as rows (run, pos, value), partitioned by run."""
    df.select(F.col(run).alias("run"), F.posexplode(column).alias("pos", "value")).write.mode("overwrite").partitionBy("run").parquet(folder)


def load_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
