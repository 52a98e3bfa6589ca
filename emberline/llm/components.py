"""Connected components by alternating large-star and small-star passes over edges.

After each pair of passes the edges are written to the shared folder; it ends when they don't
change. A vertex with very many neighbours is only ever aggregated to a minimum and joined with that
one row, never gathered. The minima are written too, so that both sides of the join are exchanges and
Spark can split the rows of such a vertex over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges (a, b) of one orderable type -> (node, root) for every vertex with an edge; root is the smallest."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    for _ in range(max_rounds if before[0] else 0):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        lows = stage(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "lows")
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
        large = stage(large, "edges")
        lows = stage(large.groupBy("a").agg(F.min("b").alias("low")), "lows")
        small = large.join(lows, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = stage(small, "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
