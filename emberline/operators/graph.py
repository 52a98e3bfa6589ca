"""Contact graph: edges, degrees, pruning, breadth-first distances and statistics from them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.expr import approx, pair_key
from emberline.lineage import cut, spread

SOURCES, ARCS = 1024, 1 << 18


def collapse(contacts: DataFrame) -> DataFrame:
    """(u1, u2, time) with u1 < u2: one row for each pair, its latest contact; self-contacts go."""
    a, b = pair_key("u1", "u2")
    return contacts.where("u1 <> u2").groupBy(a.alias("u1"), b.alias("u2")).agg(F.max("time").alias("time"))


def directed(contacts: DataFrame) -> DataFrame:
    """(src, dest, ctime): both directions of each collapsed contact."""
    pairs = collapse(contacts)
    ends = F.explode(F.array(F.struct(F.col("u1").alias("src"), F.col("u2").alias("dest")), F.struct(F.col("u2").alias("src"), F.col("u1").alias("dest"))))
    return pairs.select(ends.alias("e"), F.col("time").alias("ctime")).select("e.src", "e.dest", "ctime")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("user")).distinct()


def connected_users(scores: DataFrame, edges: DataFrame) -> DataFrame:
    return scores.select("user").distinct().join(vertices(edges), "user", "left_semi")


def isolated_users(scores: DataFrame, edges: DataFrame) -> DataFrame:
    return scores.select("user").distinct().join(vertices(edges), "user", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("user")).agg(F.count(F.lit(1)).alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(user, neighbors): distinct neighbours in ascending order, as many as the user has."""
    return edges.groupBy(F.col("src").alias("user")).agg(F.array_sort(F.collect_set("dest")).alias("neighbors"))


def graph_size(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_distinct("src").alias("nodes"), F.count(F.when(F.col("src") < F.col("dest"), 1)).alias("edges"))


def prune(vertex: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with a contact, and simple edges."""
    pairs = collapse(contacts)
    ends = pairs.select(F.explode(F.array("u1", "u2")).alias("user"))
    return vertex.join(ends, "user", "left_semi"), pairs


def dense_index(users: DataFrame) -> DataFrame:
    """(user, idx) from 0 in order of user. Positions come from counts of ranges, not from one sorted task."""
    ranged = cut(users.select("user").distinct().repartitionByRange("user").withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    other = before.select(F.col("part").alias("low"), F.col("n").alias("m"))
    # as many rows as ranges on either side
    offset = before.join(F.broadcast(other), F.col("low") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("offset"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("part").orderBy("user"))
    return ranged.withColumn("rank", rank).join(F.broadcast(offset), "part").select("user", (F.col("offset") + F.col("rank") - 1).alias("idx"))


def one_mode_projection(memberships: DataFrame) -> DataFrame:
    """(user, factor, time) -> (u1, u2, time): users that share a factor, with the latest of their shared times."""
    a = memberships.groupBy("factor", "user").agg(F.max("time").alias("time"))
    b = a.select("factor", F.col("user").alias("u2"), F.col("time").alias("t2"))
    pairs = a.withColumnRenamed("user", "u1").join(b, "factor").where("u1 < u2")
    return pairs.groupBy("u1", "u2").agg(F.max(F.least("time", "t2")).alias("time"))


def distances(edges: DataFrame, sources: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(source, user, dist) of users other than the source, by levels: each level is one join, one distinct and one
    anti-join with what was reached before."""
    arcs = cut(spread(edges.select("src", "dest").distinct(), "src"))
    start = (vertices(edges) if sources is None else sources.select("user")).distinct().select(F.col("user").alias("source"), "user", F.lit(0).alias("dist"))
    seen = frontier = cut(start)
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = frontier.join(arcs, frontier["user"] == arcs["src"]).select("source", F.col("dest").alias("user")).distinct()
        frontier = cut(step.join(seen, ["source", "user"], "left_anti").select("source", "user", F.lit(hop).alias("dist")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("dist > 0")


def _levels(src: np.ndarray, dest: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, dist, n): breadth-first search from all sources at once, a bit for each in a row for each user."""
    nodes = np.unique(np.concatenate([src, dest]))
    order = np.argsort(dest, kind="stable")
    src, dest = np.searchsorted(nodes, src[order]), np.searchsorted(nodes, dest[order])
    first = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]])
    # arcs are followed some at a time, all that lead to one user together
    cuts = np.unique(np.r_[np.searchsorted(first, np.arange(0, len(dest), ARCS)), len(first)])
    seen = np.zeros((len(nodes), -(-len(sources) // 64)), "<u8")
    at = np.arange(len(sources))
    seen[np.searchsorted(nodes, sources), at // 64] = np.uint64(1) << (at % 64).astype("u8")
    frontier, out, hop = seen.copy(), [], 0
    while True:
        hop += 1
        came, n = np.zeros_like(frontier), np.zeros(len(sources), "i8")
        for i, j in zip(cuts, cuts[1:], strict=False):
            low, high = first[i], first[j] if j < len(first) else len(dest)
            to = dest[first[i:j]]
            fresh = np.bitwise_or.reduceat(frontier[src[low:high]], first[i:j] - low, axis=0) & ~seen[to]
            came[to] = fresh
            for k in range(0, len(fresh), 4096):
                n += np.unpackbits(fresh[k : k + 4096].view("u1"), axis=1, count=len(sources), bitorder="little").sum(axis=0, dtype="i8")
        if not n.any():
            break
        seen |= came
        frontier = came
        hit = np.flatnonzero(n)
        out.append((sources[hit], np.full(len(hit), hop), n[hit]))
    if not out:
        return tuple(np.zeros((3, 0), "i8"))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def level_counts(edges: DataFrame, block: int = SOURCES) -> DataFrame:
    """(source, dist, n): how many users stand at each distance from each source. No pair is a row: each task has all arcs,
    and a block of sources that it searches from at once."""
    arcs = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dest").cast("long").alias("dest")).distinct())
    blocks = math.ceil(vertices(arcs).count() / block)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        src, dest = (rows[c].to_numpy() for c in ("src", "dest"))
        k = key[0].as_py()
        return pa.table([pa.array(x, pa.int64()) for x in _levels(src, dest, np.unique(src)[k * block : (k + 1) * block])], ["source", "dist", "n"])

    copies = spread(arcs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))))), "block")
    return copies.groupBy("block").applyInArrow(run, "source long, dist long, n long")


def harmonic_of(edges: DataFrame) -> DataFrame:
    """harmonic() of all vertices from their level counts."""
    nodes = graph_size(edges).first()["nodes"]
    return level_counts(edges).groupBy(F.col("source").alias("user")).agg((F.sum(F.col("n") / F.col("dist")) / F.lit(max(nodes - 1, 1))).alias("harmonic"))


def harmonic(dist: DataFrame, nodes: int) -> DataFrame:
    """Harmonic centrality over nodes - 1, of vertices that reach any other."""
    return dist.groupBy(F.col("source").alias("user")).agg((F.sum(1.0 / F.col("dist")) / F.lit(max(nodes - 1, 1))).alias("harmonic"))


def radius_diameter(dist: DataFrame) -> DataFrame:
    far = dist.groupBy("source").agg(F.max("dist").alias("far"))
    return far.agg(F.min("far").alias("radius"), F.max("far").alias("diameter"))


def basic_stats(df: DataFrame, column: str) -> DataFrame:
    """min, max, mean, population deviation, to four digits."""
    c = F.col(column)
    return df.agg(approx(F.min(c)).alias("min"), approx(F.max(c)).alias("max"), approx(F.avg(c)).alias("mean"), approx(F.stddev_pop(c)).alias("std"))
