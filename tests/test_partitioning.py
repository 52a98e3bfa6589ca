from __future__ import annotations

import random

import pytest
from pyspark.ml.clustering import PowerIterationClustering

from emberline.operators import blocks, graph, partitioning
from emberline.plans.queries import QUERIES
from emberline.sources import fixtures


@pytest.mark.parametrize("size", [7, 5000])
def test_spectral_groups_are_those_of_sparks_clustering(spark, monkeypatch, size):
    """Two communities of different density with few contacts between them; users without contacts have no part."""
    monkeypatch.setattr(blocks, "USERS", size)
    rng = random.Random(3)
    pairs = {(u, v) for u in range(-8, 8) for v in range(u + 1, 8) if rng.random() < 0.9} | {(u, v) for u in range(8, 40) for v in range(u + 1, 40) if rng.random() < 0.2} | {(u, u + 1) for u in range(7, 39)}
    meetings = [(f"{u} {v}", 5, x) for u, v in sorted(pairs) for x in (u, v)] + [("alone", 5, u) for u in (99,)]
    known = spark.createDataFrame([(u, v, 1.0) for u, v in sorted(pairs)], "src long, dst long, weight double")
    want = {r["id"]: r["cluster"] for r in PowerIterationClustering(k=2, maxIter=20, initMode="degree", weightCol="weight").assignClusters(known).collect()}
    edges = graph.directed(spark.createDataFrame([(u, v, None) for u, v in sorted(pairs)], "u1 long, u2 long, time long"))
    for given in (edges, blocks.of_meetings(spark.createDataFrame(meetings, "place string, time long, user long"))):
        got = {r["user"]: r["part"] for r in partitioning.spectral(given, 2).collect()}
        assert got.keys() == want.keys() and len({(got[u], want[u]) for u in want}) == 2 == len(set(got.values()))
    assert partitioning.spectral(edges.where("src = 77"), 2).count() == 0


def test_membership_makes_no_contacts(spark, small_dir, monkeypatch):
    """Rows of pairs, which no executor holds on large tables, are not asked for."""
    monkeypatch.setattr(fixtures, "contacts", None)
    assert QUERIES["membership"](spark, small_dir).count() > 0
