from __future__ import annotations

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from emberline.functions import expr
from emberline.operators import meetings, search
from emberline.params import EARTH_RADIUS_METERS, SearchParams
from emberline.plans.queries import QUERIES


def dense(h1, h2, tol, min_dur):
    """The contact of two histories by looking at every second."""

    def ticks(h):
        h = sorted(h)
        out = {}
        for (t, lat, lon), (u, *_) in zip(h, h[1:], strict=False):
            out.update(dict.fromkeys(range(t, u), (lat, lon)))
        return out

    a, b = ticks(h1), ticks(h2)
    close = [t for t in sorted(a.keys() & b.keys()) if EARTH_RADIUS_METERS * math.dist([math.radians(x) for x in a[t]], [math.radians(x) for x in b[t]]) <= tol]
    runs = []
    for t in close:
        if runs and runs[-1][1] == t:
            runs[-1][1] = t + 1
        else:
            runs.append([t, t + 1])
    good = [s for s, e in runs if e - s >= min_dur]
    return good[-1] if good else None


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_segments_equal_dense_ticks(spark, seed):
    rng = random.Random(seed)
    users = {u: [(rng.randrange(60), rng.randrange(3) * 0.001, rng.randrange(2) * 0.001) for _ in range(rng.randint(1, 7))] for u in range(5)}
    rows = [(u, *x) for u, h in users.items() for x in h]
    p = SearchParams(min_dur=4, radius=1e-4, tol=120.0, bucket=9)
    found = {(r["u1"], r["u2"]): r["time"] for r in search.contacts(spark.createDataFrame(rows, "user long, time long, lat double, lon double"), p).collect()}
    want = {}
    for a in users:
        for b in users:
            met = a < b and any(x[1:] == y[1:] for x in users[a] for y in users[b])
            if met and (t := dense(users[a], users[b], 120.0, 4)) is not None:
                want[a, b] = t
    assert found == want


def locations(spark, rows):
    return spark.createDataFrame(rows, "user long, time long, lat double, lon double")


def test_edge_cases(spark):
    p = SearchParams(min_dur=10, radius=1.0, tol=1.0, bucket=7)
    contacts = lambda rows: [tuple(r) for r in search.contacts(locations(spark, rows), p).collect()]
    still = lambda u, a, b: [(u, a, 1.0, 1.0), (u, b, 1.0, 1.0)]
    assert contacts([(0, 5, 1.0, 1.0), *still(1, 0, 50)]) == []  # one point
    assert contacts([*still(0, 0, 10), *still(1, 0, 10)]) == [(0, 1, 0)]  # exactly the least duration
    assert contacts([*still(0, 0, 9), *still(1, 0, 9)]) == []
    assert contacts([*still(0, 0, 10), *still(1, 10, 30)]) == []  # no common time
    assert contacts([(0, 0, 1.0, 1.0), (0, 5, 1.0, 1.0), (0, 12, 1.0, 1.0), *still(1, 0, 12)]) == [(0, 1, 0)]  # touching segments
    two = [(0, 0, 1.0, 1.0), (0, 15, 2.0, 2.0), (0, 20, 1.0, 1.0), (0, 40, 1.0, 1.0)]
    assert contacts([*two, *still(1, 0, 40)]) == [(0, 1, 20)]  # the later of two
    assert contacts([(0, 0, 9.0, 9.0), (0, 0, 1.0, 1.0), (0, 0, 9.5, 9.5), (0, 20, 9.5, 9.5), *still(1, 0, 20)]) == []  # last of one time holds
    assert search.contacts(locations(spark, []), p).count() == 0


def test_hot_cells_and_search_log(spark):
    """Cells cut into blocks give the same overlaps; pairs are asked for after their intervals."""
    rng = random.Random(5)
    rows = [(u, 60 * k + rng.randrange(50), 40.0 + rng.randrange(3) * 0.0005, -81.0 + rng.randrange(2) * 0.0005) for u in range(14) for k in range(30)]
    locs = spark.createDataFrame(rows, "user long, time long, lat double, lon double")
    p = SearchParams(min_dur=40, radius=1.0, tol=60.0, bucket=600)
    segs = search.segments(locs)
    whole, cut = (sorted(map(tuple, search.overlaps(segs, p, n).collect())) for n in (10_000, 7))
    assert whole == cut and len(whole) > 100
    pairs = {tuple(r) for r in search.candidate_pairs(locs, p.radius).collect()}
    lasting = {}
    for u1, u2, s, e in map(tuple, search.islands(search.overlaps(segs, p)).collect()):
        if e - s >= 40 and (u1, u2) in pairs:
            lasting[u1, u2] = max(s, lasting.get((u1, u2), s))
    found, log = search.search(locs, p)
    assert {(r["u1"], r["u2"]): r["time"] for r in found.collect()} == lasting
    row = log.first()
    assert row["Inputs"] == 14 and row["Contacts"] == len(lasting) and row["Workers"] > 0 and row["RadiusInMeters"] == 1.0


def test_candidates_near_cell_borders(spark):
    step = math.degrees(0.9 / EARTH_RADIUS_METERS)
    rows = [(0, 0, 60.0, 10.0), (1, 9, 60.0 + step, 10.0), (2, 5, 60.0, 10.0 + step / math.cos(math.radians(60))), (3, 5, 60.0, 10.0 + 3 * step)]
    pairs = {tuple(r) for r in search.candidate_pairs(locations(spark, rows), 1.0).collect()}
    assert (0, 1) in pairs and (0, 2) in pairs and (1, 3) not in pairs


ALPHABET = expr.ALPHABET


def geohash(lat, lon, precision):
    lo, hi, even, out, bits = [-90.0, -180.0], [90.0, 180.0], True, "", []
    while len(out) < precision:
        k, x = (1, lon) if even else (0, lat)
        mid = (lo[k] + hi[k]) / 2
        bits.append(x >= mid)
        (lo if x >= mid else hi)[k] = mid
        even = not even
        if len(bits) == 5:
            out += ALPHABET[sum(b << (4 - i) for i, b in enumerate(bits))]
            bits = []
    return out, (lo[0] + hi[0]) / 2, (lo[1] + hi[1]) / 2


def test_geohash(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (57.64911, 10.40744)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for precision in (1, 5, 8, 12):
        coded = df.withColumn("g", expr.geohash_encode("lat", "lon", precision))
        lat, lon = expr.geohash_decode("g", precision)
        for r in coded.withColumn("y", lat).withColumn("x", lon).collect():
            want, y, x = geohash(r["lat"], r["lon"], precision)
            assert r["g"] == want and r["y"] == pytest.approx(y, abs=1e-9) and r["x"] == pytest.approx(x, abs=1e-9)
    assert df.limit(204).select(expr.geohash_encode("lat", "lon", 11).alias("g")).collect()[203]["g"] == "u4pruydqqvj"


def test_functions(spark):
    expr.register(spark)
    row = spark.sql("SELECT score_weight(0.5D, 0L, 86400L, 2.0D, 1e-7D) AS w, haversine(0D, 0D, 0D, 1D) AS h, sdiv(1D, 0D) AS s").first()
    assert row["w"] == pytest.approx(math.log(0.5) - 0.5) and row["h"] == pytest.approx(math.radians(1) * EARTH_RADIUS_METERS) and row["s"] == 0
    df = spark.createDataFrame([(0.00005, 3.0, 0.0), (None, 1.5, 2.0)], "a double, b double, c double")
    got = df.select(expr.approx("a").alias("a"), expr.whole("b").alias("w"), expr.sdiv("b", "c").alias("d")).collect()
    assert got[1]["a"] is None and [r["w"] for r in got] == [True, False] and [r["d"] for r in got] == [0.0, 0.75]


def test_epoch_is_free_of_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 01:30:05.9' AS ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(expr.epoch_seconds("ts").alias("t")).first()["t"] == 1711848605
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_candidate_pairs_across_the_antimeridian_and_at_the_poles(spark):
    from emberline.operators import search

    places = [(10.0, 179.99995), (10.0, -179.99995), (89.9999, 0.0), (89.9999, 180.0), (-89.99995, 10.0), (-89.99995, -120.0), (89.0, 20.0), (89.0001, 20.0), (10.0, 0.0)]
    docs = spark.createDataFrame([(k, 0, lat, lon) for k, (lat, lon) in enumerate(places)], "user long, time long, lat double, lon double")
    assert sorted(map(tuple, search.candidate_pairs(docs, 30.0).collect())) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    assert [tuple(r) for r in search.candidate_pairs(docs.where("user < 2"), 30.0).collect()] == [(0, 1)]


def test_expected_reach_without_decay(spark):
    r = spark.range(1).select(*[expr.expected_reach(F.lit(v), F.lit(f), F.lit(0.6), F.lit(t)).alias(n) for n, v, f, t in (("on", 0.5, 0.1, 1.0), ("off", 0.05, 0.1, 1.0), ("some", 0.5, 0.5, 0.8))]).first()
    assert r["on"] == math.inf and r["off"] == 1.0 and r["some"] == pytest.approx(1 + math.log(0.48) / math.log(0.8))


@pytest.mark.parametrize("block", [2, 5, 640])
def test_meetings_equal_overlaps_and_islands(spark, block, monkeypatch):
    """One row for each pair, whatever the blocks; a task makes no row for an overlap."""
    rng = random.Random(8)
    rows = [(u - 3, 60 * k + rng.randrange(70), 40.0 + rng.randrange(4) * 0.0005, -81.0 + rng.randrange(3) * 0.0005 + (u % 4) // 3 * 0.5) for u in range(16) for k in range(rng.randrange(1, 25))]
    segs = search.segments(locations(spark, rows))
    monkeypatch.setattr(meetings, "ARRAY", 40 if block == 5 else 1 << 18)
    p = SearchParams(min_dur=50, radius=1.0, tol=60.0, bucket=600)
    want = {}
    for u1, u2, s, e in map(tuple, search.overlaps(segs, p).collect()):
        want.setdefault((u1, u2), [[], []])[0].append((s, e))
    for u1, u2, s, e in map(tuple, search.islands(search.overlaps(segs, p)).collect()):
        want[u1, u2][1].append((s, e))
    found = meetings.meetings(segs, p, block)
    got = {(r[0], r[1]): tuple(r[2:]) for r in found.collect()}
    assert found.count() == len(got) > 20
    assert got == {
        k: (len(o), sum(e - s for s, e in o), min(o)[0], max(e for _, e in o), len(i), max(e - s for s, e in i), max(i)[0], max((s for s, e in i if e - s >= 50), default=None)) for k, (o, i) in want.items()
    }
    assert meetings.meetings(segs.limit(0), p).count() == 0


@pytest.mark.parametrize("name", ["islands", "segment_overlaps", "proximal_segments", "contacts"])
def test_no_row_for_an_overlap(spark, small_dir, name):
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "greatest(" not in plan


@pytest.mark.parametrize("block", [1, 4, 2048])
def test_candidates_by_blocks(spark, block):
    """Each pair once, from a task of two blocks; none is made distinct."""
    rng = random.Random(6)
    rows = [(u * 7 - 30, k, 40.0 + rng.randrange(6) * 1e-5, -81.0 + rng.randrange(4) * 0.01) for u in range(15) for k in range(3)]
    locs = locations(spark, rows)
    want = {(a, b) for a, _, x, y in rows for b, _, v, w in rows if a < b and y == w and EARTH_RADIUS_METERS * abs(math.radians(x - v)) <= 1.2}
    own, followed = search._points(locs, 1.2)
    found = meetings.candidates(followed, own, block)
    assert sorted((r["u1"], r["u2"]) for r in found.collect()) == sorted(want) and 10 < len(want) < 105
    assert "Aggregate" not in search.candidate_pairs(locs, 1.2)._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert search.candidate_pairs(locs.limit(0), 1.2).count() == 0
