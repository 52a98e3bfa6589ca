"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from emberline.operators import graph
from emberline.plans.oracles import ORACLES
from emberline.plans.queries import QUERIES


@pytest.fixture(scope="module")
def tables(small_dir):
    con = duckdb.connect()
    for f in os.listdir(small_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small_dir}/{f}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    cell = lambda x: repr(round(float(x), 9)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, row)) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, small_dir, name):
    got, want = QUERIES[name](spark, small_dir).toPandas(), tables.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.astype(object)) == canonical(want.astype(object)) or canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small_dir, name):
    assert QUERIES[name](spark, small_dir).count() > 0


def test_entry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_harmonic_divides_by_the_graph_s_own_size(spark, small_dir):
    near = {}
    keys = [k for (k,) in spark.read.parquet(f"{small_dir}/supplier.parquet").select("s_suppkey").collect()]
    for k in keys:
        for other in ((k * 7 + 3) % len(keys), k // 2):
            if other != k:
                near.setdefault(k, set()).add(other)
                near.setdefault(other, set()).add(k)
    want = {}
    for source in near:
        dist, level = {source: 0}, [source]
        while level:
            level = sorted({b for a in level for b in near[a]} - set(dist))
            dist |= dict.fromkeys(level, max(dist.values()) + 1)
        want[source] = sum(1 / x for x in dist.values() if x) / (len(near) - 1)
    got = {r["user"]: r["harmonic"] for r in QUERIES["harmonic"](spark, small_dir).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    stats = QUERIES["graph_stats"](spark, small_dir).first()
    assert stats["nodes"] == len(near) and stats["efficiency"] == pytest.approx(sum(want.values()) / len(want), abs=1e-5)


@pytest.mark.parametrize("block", [3, 64, 1024])
def test_level_counts_equal_distances(spark, block):
    pairs = [(k, (k * 5 + 2) % 90) for k in range(90)] + [(k, k + 1) for k in range(200, 240)] + [(-7, 1 << 40)]
    edges = graph.directed(spark.createDataFrame(pairs, "u1 long, u2 long").withColumn("time", F.lit(0)))
    want = {(r["source"], r["dist"]): r["count"] for r in graph.distances(edges).groupBy("source", "dist").count().collect()}
    got = {(r["source"], r["dist"]): r["n"] for r in graph.level_counts(edges, block).collect()}
    assert got == want and max(d for _, d in got) == 40
    assert graph.level_counts(edges.limit(0)).count() == 0


def test_harmonic_makes_no_row_for_a_pair(spark, small_dir):
    plan = QUERIES["harmonic"](spark, small_dir)._jdf.queryExecution().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
