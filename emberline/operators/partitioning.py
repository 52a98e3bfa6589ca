"""Assignment of users to groups. Results of the engine don't depend on it; it serves placement and comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.lineage import cut
from emberline.operators import blocks


def spectral(edges: DataFrame | blocks.Contacts, groups: int, iterations: int = 20) -> DataFrame:
    """(user, part) by power iteration clustering of the graph, in which each pair counts once: random walks from the degrees, ended as
    Spark's clustering ends them, then k-means. Tasks of two blocks of users add up what comes over their contacts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if isinstance(edges, blocks.Contacts):
        contacts = edges
    else:
        contacts = blocks.of_contacts(edges.where("src < dest").select(F.col("src").alias("u1"), F.col("dest").alias("u2"), F.lit(0).cast("long").alias("time")))
    spark = contacts.rows.sparkSession
    arcs = contacts.kept()
    everyone = contacts.users.select("user", F.lit(1.0).alias("v"))
    known = cut(_came(arcs, everyone).select("user", F.col("came").alias("degree")))
    total, n = known.agg(F.sum("degree"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "user long, part int")
    now = known.select("user", "degree", (F.col("degree") / total).alias("v"))
    least, before, change = max(1e-5 / n, 1e-8), math.inf, math.inf
    for _ in range(iterations):
        if change <= least:
            break
        came = _came(arcs, now.select("user", "v")).join(now, "user").select("user", "degree", (F.col("came") / F.col("degree")).alias("w"), "v")
        moved = cut(came)
        norm = moved.agg(F.sum(F.abs("w"))).first()[0]
        moved = moved.withColumn("w", F.col("w") / norm)
        delta = moved.agg(F.sum(F.abs(F.col("w") - F.col("v")))).first()[0]
        now = moved.select("user", "degree", F.col("w").alias("v"))
        change, before = abs(delta - before), delta
    # values have a mean of 1 / n, which k-means' tolerance would take for equal
    points = now.select("user", array_to_vector(F.array(F.col("v") * n)).alias("features"))
    found = KMeans(k=groups, seed=0, initSteps=2, maxIter=20, tol=1e-4).fit(points).transform(points)
    return found.select("user", F.col("prediction").cast("int").alias("part"))


def _came(arcs: blocks.Neighbours, values: DataFrame) -> DataFrame:
    """(user, came): the sum of the values (user, v) of each user's neighbours; of users with any."""
    return arcs.sums(values).groupBy("user").agg(F.sum("came").alias("came"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(user, label): each round a user takes the label most frequent among its neighbours, of equal ones the smallest."""
    labels = edges.select(F.col("src").alias("user")).distinct().withColumn("label", F.col("user"))
    for _ in range(rounds):
        votes = edges.join(labels.withColumnRenamed("user", "dest"), "dest").groupBy(F.col("src").alias("user"), "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("user").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("best"))
        labels = cut(best.select("user", (-F.col("best.m")).alias("label")))
    return labels
