from __future__ import annotations

import random

import pytest

from emberline.operators import graph, reachability
from emberline.params import PropagationParams
from emberline.plans.queries import QUERIES

D = 86_400


def hops(scores, contacts, p):
    """(source, user) to the fewest hops, by a search from each source alone."""
    init = {}
    for u, v, t in scores:
        init[u] = max(init.get(u, (-1, 0)), (v, t))
    times = {}
    for a, b, t in contacts:
        if a != b:
            for k in ((a, b), (b, a)):
                times[k] = max(times.get(k, t), t)
    out = {}
    for source, (val, time) in init.items():
        dist, level, hop = {source: 0}, {source}, 0
        while level:
            hop, val = hop + 1, val * p.transmission
            level = {b for (a, b), ct in times.items() if a in level and a in init and time <= ct + p.time_buffer and val >= init[a][0] * p.transmission * p.tol and time <= init[a][1]} - set(dist)
            dist |= dict.fromkeys(level, hop)
        out |= {(source, u): k for u, k in dist.items() if k}
    return out


@pytest.mark.parametrize("block", [1, 3, 70, 2048])
def test_levels_equal_single_searches(spark, block, monkeypatch):
    monkeypatch.setattr(reachability, "ROWS", 5)
    rng = random.Random(3)
    ids = [k * 3 - 40 for k in range(90)] + [1 << 40]
    scores = [(u, rng.choice([0.0, 0.4, 0.5, 1.0]), rng.randrange(8) * D) for u in ids for _ in range(2)]
    contacts = [(rng.choice(ids), rng.choice(ids), rng.randrange(8) * D) for _ in range(260)] + [(ids[0], 7_000, 9 * D)]
    p = PropagationParams(tol=0.3, transmission=0.8)
    s, c = spark.createDataFrame(scores, "user long, val double, time long"), spark.createDataFrame(contacts, "u1 long, u2 long, time long")
    edges, want = graph.directed(c), hops(scores, contacts, p)
    found = reachability.levels(s, edges, p, block=block)
    pairs = len({(min(k), max(k)) for k in want})
    row = reachability.ratio_of(found, graph.vertices(edges)).first()
    assert row["actual"] == pairs == reachability.ratio(reachability.reach(s, edges, p), graph.vertices(edges)).first()["actual"]
    rows = reachability.reach(s, edges, p).collect()
    assert len(rows) == len(want) > 500 and {(r["source"], r["user"]): r["dist"] for r in rows} == want and max(want.values()) > 3
    counted = {}
    for (source, _), k in want.items():
        counted[source, k] = counted.get((source, k), 0) + 1
    assert {(r["source"], r["dist"]): r["n"] for r in reachability.sizes(found).collect()} == counted
    some = spark.createDataFrame([(u,) for u in ids[:7]], "user long")
    near = {(r["source"], r["user"]): r["dist"] for r in reachability.reach(s, edges, p, some, 2).collect()}
    assert near == {k: v for k, v in want.items() if k[0] in ids[:7] and v < 3}


@pytest.mark.parametrize("name", ["reach", "reach_stats", "reach_hist", "reach_comparison", "reach_ratio"])
def test_no_join_for_a_level(spark, small_dir, name):
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().toString()
    assert "LeftAnti" not in plan and "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("name", ["reach_stats", "reach_hist", "reach_comparison"])
def test_counts_make_no_row_for_a_pair(spark, small_dir, name):
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow count(" in plan and "MapInArrow expand(" not in plan


def test_nobody(spark):
    s, c = spark.createDataFrame([(1, 0.5, 0), (2, None, 0)], "user long, val double, time long"), spark.createDataFrame([(1, 2, 0)], "u1 long, u2 long, time long")
    assert [tuple(r) for r in reachability.reach(s, graph.directed(c), PropagationParams()).collect()] == [(1, 2, 1)]
    assert reachability.reach(s.limit(0), graph.directed(c), PropagationParams()).count() == 0
    assert reachability.reach(s, graph.directed(c).limit(0), PropagationParams()).count() == 0
    assert reachability.ratio_of(reachability.levels(s, graph.directed(c).limit(0), PropagationParams()), s.select("user")).first()["actual"] == 0


@pytest.mark.parametrize("block", [3, 70, 2048])
def test_meetings_equal_their_contacts(spark, block, monkeypatch):
    monkeypatch.setattr(reachability, "TURN", 7)
    rng = random.Random(5)
    ids = [k * 3 - 40 for k in range(90)] + [1 << 40]
    scores = [(u, rng.choice([0.0, 0.4, 0.5, 1.0]), rng.randrange(8) * D) for u in ids for _ in range(2)]
    met = [(rng.choice("abc"), rng.randrange(45) * D // 6, rng.choice([*ids, 7_000])) for _ in range(330)]
    met += [("hot", 2 * D, u) for u in ids[:40]] + [("alone", 9 * D, ids[0]), (None, 9 * D, ids[1]), (None, 9 * D, ids[2]), ("a", 9 * D, None), ("a", None, ids[3])]
    contacts = [(a, b, t) for x, t, a in met for y, s, b in met if x == y and t == s and None not in (x, t, a, b) and a < b]
    p = PropagationParams(tol=0.3, transmission=0.8)
    s, m = spark.createDataFrame(scores, "user long, val double, time long"), spark.createDataFrame(met, "place string, time long, user long")
    want = hops(scores, contacts, p)
    rows = reachability.reach_over(s, m, p, block=block).collect()
    assert len(rows) == len(want) > 500 and {(r["source"], r["user"]): r["dist"] for r in rows} == want and max(want.values()) > 2
    counted = {}
    for (source, _), k in want.items():
        counted[source, k] = counted.get((source, k), 0) + 1
    assert {(r["source"], r["dist"]): r["n"] for r in reachability.sizes(reachability.counts_over(s, m, p, block)).collect()} == counted
    nodes = {x for a, b, _ in contacts for x in (a, b)}
    row = reachability.ratio_of(reachability.reached_over(s, m, p, block), reachability.met_users(m)).first()
    assert row["actual"] == len({(min(k), max(k)) for k in want}) and row["ideal"] == len(nodes) * (len(nodes) - 1)
    some = spark.createDataFrame([(u,) for u in ids[:7]], "user long")
    near = {(r["source"], r["user"]): r["dist"] for r in reachability.reach_over(s, m, p, some, 2).collect()}
    assert near == {k: v for k, v in want.items() if k[0] in ids[:7] and v < 3}
    assert reachability.reach_over(s, m.limit(0), p).count() == 0 == reachability.reach_over(s.limit(0), m, p).count()


@pytest.mark.parametrize("name", ["reach", "reach_stats", "reach_hist", "reach_comparison", "reach_ratio"])
def test_no_row_for_a_contact(spark, small_dir, name, monkeypatch):
    def made(*args):
        raise AssertionError("contacts are made")

    monkeypatch.setattr(graph, "collapse", made)
    assert QUERIES[name](spark, small_dir).count() > 0
