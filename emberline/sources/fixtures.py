"""The engine's inputs made from the driver's event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.expr import epoch_seconds


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, val, time): event values over 600, 1 at most."""
    return events(spark, sf_dir).select(F.col("user_id").alias("user"), F.least(F.col("value") / 600.0, F.lit(1.0)).alias("val"), epoch_seconds("ts").alias("time"))


def contacts(spark: SparkSession, sf_dir: str, bucket: int = 300) -> DataFrame:
    """(u1, u2, time): users with one type of event in one bucket of time; the latest bucket of each pair."""
    met = events(spark, sf_dir).select("event_type", F.floor(epoch_seconds("ts") / bucket).alias("b"), F.col("user_id").alias("u1")).distinct()
    pairs = met.join(met.withColumnRenamed("u1", "u2"), ["event_type", "b"]).where("u1 < u2")
    return pairs.groupBy("u1", "u2").agg((F.max("b") * bucket).alias("time"))


def meetings(spark: SparkSession, sf_dir: str, bucket: int = 300) -> DataFrame:
    """(place, time, user): who had an event of a type in a bucket of time; contacts() are the pairs of those."""
    at = (F.floor(epoch_seconds("ts") / bucket) * bucket).alias("time")
    return events(spark, sf_dir).select(F.col("event_type").alias("place"), at, F.col("user_id").alias("user")).distinct()


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, time, lat, lon): one of 100 places on a grid, by the number in props."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, sf_dir).select(F.col("user_id").alias("user"), epoch_seconds("ts").alias("time"), (F.lit(40.0) + F.floor(k / 10) * 0.0005).alias("lat"), (F.lit(-81.0) + (k % 10) * 0.0005).alias("lon"))
