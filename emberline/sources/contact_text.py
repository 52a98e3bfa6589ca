"""Contact sequences as text: time and two names in the first three fields of a line."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.graph import collapse, dense_index


def read_contacts(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """(u1, u2, time): the latest contact of each pair; fields after the third are ignored."""
    lines = spark.read.schema("t long, n1 long, n2 long").option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path, sep=sep)
    return collapse(lines.where("t is not null and n1 is not null and n2 is not null").select(F.col("n1").alias("u1"), F.col("n2").alias("u2"), F.col("t").alias("time")))


def parse_lines(lines: DataFrame, column: str = "value", sep: str = " ") -> DataFrame:
    """The same from a column of lines."""
    field = F.split(F.btrim(F.col(column)), " +" if sep == " " else re.escape(sep))
    rows = lines.select(field[1].cast("long").alias("u1"), field[2].cast("long").alias("u2"), field[0].cast("long").alias("time"))
    return collapse(rows)


def shifted(contacts: DataFrame, now: int) -> DataFrame:
    """Times of a sequence that starts near 0, moved forward by now."""
    return contacts.withColumn("time", F.col("time") + F.lit(now))


def with_dense_ids(contacts: DataFrame) -> DataFrame:
    """Names replaced by ids from 0 in order of name."""
    ids = dense_index(contacts.select(F.explode(F.array("u1", "u2")).alias("user")))
    a, b = ids.select(F.col("user").alias("u1"), F.col("idx").alias("i1")), ids.select(F.col("user").alias("u2"), F.col("idx").alias("i2"))
    return contacts.join(a, "u1").join(b, "u2").select(F.least("i1", "i2").alias("u1"), F.greatest("i1", "i2").alias("u2"), "time")
