from __future__ import annotations

import math
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from emberline.operators import analysis, graph, partitioning, propagation
from emberline.sources import contact_text, logs, synth
from emberline.sources.dataset import Dataset, read_graphml, write_graphml
from emberline.streaming.exposure import ExposureStream, attempted_contacts


def test_contact_text(spark, tmp_path):
    path = tmp_path / "seq.txt"
    path.write_text("20 7 3 A B\n40 3 7 A B\n20 9 7 B B\n")
    got = contact_text.read_contacts(spark, str(path))
    assert sorted(map(tuple, got.collect())) == [(3, 7, 40), (7, 9, 20)]
    assert sorted(map(tuple, contact_text.shifted(contact_text.with_dense_ids(got), 1000).collect())) == [(0, 1, 1040), (1, 2, 1020)]
    path.write_text("20\t7\t3\n30\t3\t7\n")
    assert [tuple(r) for r in contact_text.read_contacts(spark, str(path), "\t").collect()] == [(3, 7, 30)]
    assert sorted(map(tuple, contact_text.parse_lines(spark.createDataFrame([("5 2 1 x",), (" 9  1 2 y",)], "value string")).collect())) == [(1, 2, 9)]


def test_logs(spark, tmp_path):
    folder = str(tmp_path / "logs")
    log = spark.createDataFrame([((3, 0.5), ("x",), [1.5, None])], "Statistics struct<Updates:long,Runtime:double>, Parameters struct<Name:string>, Scores array<double>")
    logs.append_log(log, folder)
    logs.append_log(log, folder)
    read = logs.read_logs(spark, folder, "*.json")
    assert read.count() == 2 and read.where("log_file like 'part%'").count() == 2
    assert [tuple(r) for r in logs.project(read, "Statistics:Updates", "Parameters:Name").distinct().collect()] == [(3, "x")]
    assert logs.project(read, "all").columns == read.columns
    (tmp_path / "one.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert logs.read_document(spark, str(tmp_path / "one.json")).count() == 2
    logs.save_figure(spark.createDataFrame([(0.25, 0.7)], "y double, tol double"), "y", "tol", str(tmp_path / "fig"))
    assert spark.read.csv(str(tmp_path / "fig"), header=True).collect()[0].asDict() == {"y": "0.25", "tol": "7"}
    logs.save_arrays(spark.createDataFrame([("r1", [5, 6])], "run string, xs array<int>"), "run", "xs", str(tmp_path / "arrays"))
    assert sorted((r["pos"], r["value"]) for r in logs.load_arrays(spark, str(tmp_path / "arrays")).collect()) == [(0, 5), (1, 6)]


def test_statistics_and_run_tables(spark, tmp_path):
    log = spark.createDataFrame([((3, 0.5), ("x",)), ((4, 1.5), ("y",))], "Statistics struct<Updates:long,Runtime:double>, Parameters struct<Name:string>")
    logs.save_statistics(log, str(tmp_path / "stat"), "Statistics:Updates", "Parameters:Name")
    assert sorted(map(tuple, logs.read_document(spark, str(tmp_path / "stat")).select("Updates", "Name").collect())) == [(3, "x"), (4, "y")]
    exposed = spark.createDataFrame([(9, 0.1, 0.4), (2, 0.3, 0.3)], "user long, init_val double, exposure double")
    for run, part in (("r1", None), ("r2", spark.createDataFrame([(9, 1), (2, 0)], "user long, part int"))):
        logs.save_run(exposed, run, str(tmp_path / "runs"), part)
    rows = logs.load_arrays(spark, str(tmp_path / "runs")).where("run = 'r2'")
    assert sorted(map(tuple, rows.select("pos", "user", "membership", "symptom", "exposure").collect())) == [(0, 2, 0, 0.3, 0.3), (1, 9, 1, 0.1, 0.4)]
    line = logs.with_arrays(log.limit(1), rows).first()
    assert (line["Membership"], line["SymptomScores"], line["ExposureScores"]) == ([0, 1], [0.3, 0.1], [0.3, 0.4])
    with pytest.raises(ValueError, match="up to 1"):
        logs.with_arrays(log, rows, 1)


def test_dataset_and_graphml(spark, tmp_path):
    data = synth.experiment(spark, 30, synth.power_law_cluster_graph(spark, 30, 1), now=1_000_000_000, days=3)
    data.save(str(tmp_path / "set"))
    back = Dataset.load(spark, str(tmp_path / "set"), contacts=True)
    assert back.graph is None and back.histories is None
    assert sorted(map(tuple, back.contacts.collect())) == sorted(map(tuple, data.contacts.collect())) and back.scores.count() == 90
    write_graphml(data.graph, str(tmp_path / "graph"))
    assert sorted(map(tuple, read_graphml(spark, str(tmp_path / "graph")).collect())) == sorted(map(tuple, data.graph.collect()))
    write_graphml(data.contacts, str(tmp_path / "timed"))
    assert sorted(map(tuple, read_graphml(spark, str(tmp_path / "timed")).collect())) == sorted(map(tuple, data.contacts.select("u1", "u2", "time").collect()))
    (file,) = (tmp_path / "timed").glob("part-*")
    found = ElementTree.parse(file).getroot()
    tags = [e.tag.rpartition("}")[2] for e in found.iter()]
    assert tags.count("node") == 30 and tags.count("key") == 1 and tags.count("edge") == data.contacts.count()
    (tmp_path / "g.graphml").write_text('<graphml><graph><edge source="n1" target="n5"><data key="e_time">77</data></edge><edge source="n2" target="n3"><data key="e_time">78</data></edge></graph></graphml>')
    assert sorted(map(tuple, read_graphml(spark, str(tmp_path / "g.graphml")).collect())) == [(1, 5, 77), (2, 3, 78)]


def test_generators(spark):
    users = spark.range(2000).select(F.col("id").alias("user"))
    v = synth.values(users, 2, 0.2, 3)
    assert sorted(map(tuple, v.collect())) == sorted(map(tuple, synth.values(users.repartition(7), 2, 0.2, 3).collect()))
    upper = v.groupBy("user").agg(F.min(F.col("val") >= 0.5).alias("a"), F.max(F.col("val") >= 0.5).alias("b"))
    assert upper.where("a <> b").count() == 0 and abs(upper.where("a").count() / 2000 - 0.2) < 0.04
    t = synth.times(users.limit(50), 4, 3, 10_000_000, 3)
    assert t.where("time < 10000000 - 3 * 86400 or time >= 10000000 + 86400").count() == 0 and t.count() == 600
    one = synth.times(users, 4, 1, 10_000_000, 3, random_first=True)
    assert one.count() == 2000 and one.select(F.floor(F.col("time") / 86400)).distinct().count() <= 2
    assert synth.times(users, 4, 1, 10_000_000, 3, random_first=True, independent=True).select(F.floor((F.col("time") - 10_000_000) / 86400)).distinct().count() == 4
    w = synth.walk(users.limit(100), 6, -1.0, 1.0, -0.5, 0.5, 3, "s")
    assert w.where("x < -1 or x > 1").count() == 0 and w.groupBy("user").count().where("count <> 6").count() == 0
    m = synth.mixture(users, 3, -1.0, 1.0, 3, "m").agg(F.avg("x"), F.stddev("x")).first()
    assert abs(m[0]) < 0.1 and abs(m[1] - math.sqrt(0.5 + 1 / 6)) < 0.1
    h = synth.histories(users.limit(20), 2, 3, 10_000_000, 3)
    assert h.count() == 120 and h.where("lat is null or lon is null").count() == 0
    pairs = {tuple(r) for r in synth.geometric_graph(spark, 150, 5).collect()}
    points = {r["user"]: (r["x"], r["y"]) for r in spark.range(150).select(F.col("id").alias("user"), synth.uniform(5, "x", "id").alias("x"), synth.uniform(5, "y", "id").alias("y")).collect()}
    radius = 0.25 ** (math.log10(150) - 1)
    assert pairs == {(a, b) for a in points for b in points if a < b and math.dist(points[a], points[b]) <= radius}
    g = synth.power_law_cluster_graph(spark, 200, 5)
    assert abs(g.count() - 2 * 198) <= 2 and g.where("u1 >= u2").count() == 0
    lfr = synth.benchmark_graph(spark, 300, 5)
    d = graph.degrees(graph.directed(lfr.withColumn("time", F.lit(0).cast("long")))).agg(F.max("degree"), F.avg("degree")).first()
    assert d[0] <= 50 and 2.5 < d[1] < 12
    with pytest.raises(ValueError):
        synth.values(users, 0, 0.2, 1)
    with pytest.raises(ValueError):
        synth.power_law_cluster_graph(spark, 2, 1, m=2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_communities(seed):
    """Sizes keep their bounds, nearly every stub is matched, and the share of links between communities is near mu."""
    n, mu = 800, 0.1
    pairs, home, degree = synth.planted_communities(n, seed, 3, 2, mu, (3, 50), (10, 100))
    sizes = [list(home.values()).count(k) for k in set(home.values())]
    assert sum(sizes) == n and min(sizes) >= 10 and max(sizes) <= 100
    got = [0] * n
    for a, b in pairs:
        assert a < b
        got[a] += 1
        got[b] += 1
    assert all(x <= y for x, y in zip(got, degree, strict=True)) and sum(got) >= 0.98 * sum(degree)
    between = sum(home[a] != home[b] for a, b in pairs) / len(pairs)
    assert abs(between - mu) < 0.06


def test_label_propagation_finds_two_cliques(spark):
    """Two cliques and one link between them: each clique takes one label, its smallest."""
    rows = [(a, b, 0) for g in (0, 10) for a in range(g, g + 6) for b in range(a + 1, g + 6)] + [(5, 10, 0)]
    edges = graph.directed(spark.createDataFrame(rows, "u1 long, u2 long, time long"))
    got = {r["user"]: r["label"] for r in partitioning.label_propagation(edges, 5).collect()}
    assert {got[u] for u in range(6)} == {0} and {got[u] for u in range(10, 16)} == {10}
    parts = {r["user"]: r["part"] for r in partitioning.spectral(edges, 2).collect()}
    assert set(parts) == set(got) and set(parts.values()) <= {0, 1}


def test_contact_sequence_data(spark):
    c = spark.createDataFrame([(0, 1, 1_000_000_010), (1, 2, 1_000_000_050)], "u1 long, u2 long, time long")
    data = synth.from_contact_sequence(spark, c, 1_000_000_000)
    assert data.scores.count() == 3
    with pytest.raises(ValueError, match="later"):
        synth.from_contact_sequence(spark, c.withColumn("time", F.lit(5).cast("long")), 1_000_000_000)


def test_analysis(spark):
    rng = random.Random(8)
    xs = [(rng.random() * 10, k) for k in range(40)]
    rows = [(x, 2 + 3 * x + rng.gauss(0, 1)) for x, _ in xs]
    r = analysis.regression(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    n, mx, my = len(rows), sum(x for x, _ in rows) / 40, sum(y for _, y in rows) / 40
    sxx, sxy = sum((x - mx) ** 2 for x, _ in rows), sum((x - mx) * (y - my) for x, y in rows)
    slope = sxy / sxx
    err = math.sqrt(sum((y - my - slope * (x - mx)) ** 2 for x, y in rows) / (n - 2) / sxx)
    assert r["slope"] == pytest.approx(slope) and r["slope_err"] == pytest.approx(err) and r["slope_ci"] == pytest.approx(err * 2.024394, rel=1e-5)
    for p, df, want in ((0.975, 1, 12.7062), (0.975, 10, 2.228139), (0.95, 5, 2.015048), (0.995, 30, 2.749996)):
        assert analysis.t_quantile(p, df) == pytest.approx(want, rel=1e-5)
    g = spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 2), ("b", 0.0, 3)], "g string, v double, seq int")
    assert [r["Normalizedv"] for r in analysis.normalize(g, ["g"], ["v"]).orderBy("seq").collect()] == [0.25, 1.0, None]
    assert [r["seq"] for r in analysis.head(g, ["g"], ["seq"], 1).orderBy("seq").collect()] == [1, 3]
    d = analysis.describe(g, ["g"], "v").where("g = 'a'").first()
    assert (d["count"], d["mean"], d["q25"], d["q50"], d["q75"]) == (2, 2.5, 1.75, 2.5, 3.25)
    assert analysis.parameter_grid(spark, [0.1, 0.2], [0.5]).count() == 2 and analysis.pair_combinations(g, "seq").count() == 3
    assert [tuple(r) for r in analysis.histogram(g, ["g"], "v").where("g = 'a'").orderBy("v").select("v", "share").collect()] == [(1.0, 0.5), (4.0, 0.5)]
    e = g.agg(analysis.combined_error("v").alias("c"), analysis.sem("v").alias("s")).first()
    assert e["c"] == pytest.approx(math.sqrt(17) / 3) and e["s"] == pytest.approx(math.sqrt(((1 - 5 / 3) ** 2 + (4 - 5 / 3) ** 2 + (5 / 3) ** 2) / 2) / math.sqrt(3))
    rows = [(rng.choice("abc"), None if rng.random() < 0.1 else rng.randrange(30) / 7) for _ in range(500)] + [("d", None), (None, 2.0), (None, 5.0)]
    many = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for r in analysis.describe(many, ["g"], "v").collect():
        v = sorted(x for k, x in rows if k == r["g"] and x is not None)
        at = lambda p, v=v: v[int(p * (len(v) - 1))] + (p * (len(v) - 1) % 1) * (v[min(int(p * (len(v) - 1)) + 1, len(v) - 1)] - v[int(p * (len(v) - 1))])
        assert r["count"] == len(v) and [r["q25"], r["q50"], r["q75"]] == ([pytest.approx(at(p)) for p in (0.25, 0.5, 0.75)] if v else [None] * 3)
    assert [r["quantile"] for r in analysis.quantiles(many.where("g = 'd'"), ["v"], (0.5, 1.0)).where("v is null").orderBy("quantile").collect()] == [0.5, 1.0]
    assert analysis.normalize(many, ["g"], ["v"]).count() == len(rows)
    with pytest.raises(ValueError, match="lists of up to"):
        analysis.pair_combinations(spark.range(analysis.SHORT_LIST + 1), "id")
    assert analysis.union_runs(x=g, y=g.select("v", "g", "seq")).groupBy("Graph").count().count() == 2


def test_graph(spark):
    c = spark.createDataFrame([(0, 1, 1), (1, 0, 4), (1, 2, 2), (3, 3, 9), (4, 5, 0)], "u1 long, u2 long, time long")
    e = graph.directed(c)
    assert {(r["src"], r["dest"], r["ctime"]) for r in e.collect()} == {(0, 1, 4), (1, 0, 4), (1, 2, 2), (2, 1, 2), (4, 5, 0), (5, 4, 0)}
    dist = graph.distances(e)
    assert {tuple(r) for r in dist.collect()} == {(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 1), (2, 1, 1), (2, 0, 2), (4, 5, 1), (5, 4, 1)}
    assert tuple(graph.radius_diameter(dist).first()) == (1, 2)
    assert {r["user"]: r["harmonic"] for r in graph.harmonic(dist, 5).collect()}[0] == pytest.approx(1.5 / 4)
    kept, pairs = graph.prune(spark.range(6).select(F.col("id").alias("user")), c)
    assert sorted(r["user"] for r in kept.collect()) == [0, 1, 2, 4, 5] and pairs.count() == 3
    assert [tuple(r) for r in graph.dense_index(spark.createDataFrame([(40,), (7,), (40,), (9,)], "user long")).orderBy("user").collect()] == [(7, 0), (9, 1), (40, 2)]
    m = spark.createDataFrame([(1, 9, 5), (2, 9, 7), (1, 8, 9), (2, 8, 8)], "user long, factor long, time long")
    assert [tuple(r) for r in graph.one_mode_projection(m).collect()] == [(1, 2, 8)]
    assert {r["label"] for r in partitioning.label_propagation(e, 4).where("user >= 4").collect()} <= {4, 5}


def test_stream(spark, tmp_path):
    scores = spark.createDataFrame([(0, 0.9, 0), (1, 0.1, 0)], "user long, val double, time long")
    contacts = spark.createDataFrame([(0, 1, 86_400)], "u1 long, u2 long, time long")
    for name, df in (("s", scores), ("c", contacts)):
        df.write.parquet(str(tmp_path / name))
    stream = ExposureStream(spark, str(tmp_path / "state"))
    assert stream.exposures().count() == 0
    for name, kind in (("s", "scores"), ("c", "contacts")):
        source = spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
        stream.start(source, kind, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r["user"]: round(r["exposure"], 6) for r in stream.exposures().collect()} == {0: 0.9, 1: 0.72}
    stream.on_scores(spark.createDataFrame([(1, 1.0, 50)], scores.schema), 1)
    assert {r["user"]: round(r["exposure"], 6) for r in stream.exposures().collect()} == {0: 0.9, 1: 1.0}


def test_stream_state_outlives_the_process(spark, tmp_path):
    """Batches over several processes, one of them replayed, give what the batch operator gives."""
    rng = random.Random(3)
    scores = [(u, rng.random(), rng.randrange(20) * 86_400) for u in range(12) for _ in range(3)]
    contacts = [(a, b, rng.randrange(20) * 86_400) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(40)) if a != b]
    s, c = spark.createDataFrame(scores, "user long, val double, time long"), spark.createDataFrame(contacts, "u1 long, u2 long, time long")
    part = lambda df, rows, k: spark.createDataFrame(rows[k::3], df.schema)
    for k in range(3):
        for _ in range(1 + (k == 1)):  # the second batch comes twice
            ExposureStream(spark, str(tmp_path / "state")).on_scores(part(s, scores, k), k)
            ExposureStream(spark, str(tmp_path / "state")).on_contacts(part(c, contacts, k), k)
    stream = ExposureStream(spark, str(tmp_path / "state"))
    want = propagation.exposures(s, c, stream.params, validate=False)
    assert sorted(map(tuple, stream.exposures().collect())) == sorted(map(tuple, want.collect()))
    assert stream.versions("scores") == [1, 2]
    (tmp_path / "state" / "scores" / "v3").mkdir()  # a version that was not finished
    assert stream.versions("scores") == [1, 2] and stream.exposures().count() == 12
    with pytest.raises(ValueError, match="older than"):
        stream.on_scores(part(s, scores, 0), 0)


def test_stream_keeps_old_scores_that_matter(spark, tmp_path):
    day = 86_400
    stream = ExposureStream(spark, str(tmp_path / "state"), horizon=2 * day)
    schema = "user long, val double, time long"
    stream.on_scores(spark.createDataFrame([(0, 0.9, 0), (0, 0.2, day), (0, 0.5, 2 * day), (1, 0.1, 0)], schema), 0)
    stream.on_scores(spark.createDataFrame([(1, 0.2, 9 * day)], schema), 1)
    stream.on_contacts(spark.createDataFrame([(0, 1, 9 * day)], "u1 long, u2 long, time long"), 0)
    got = {r["user"]: r["exposure"] for r in stream.exposures().collect()}
    every = spark.createDataFrame([(0, 0.9, 0), (0, 0.2, day), (0, 0.5, 2 * day), (1, 0.1, 0), (1, 0.2, 9 * day)], schema)
    want = propagation.exposures(every, spark.createDataFrame([(0, 1, 9 * day)], "u1 long, u2 long, time long"), stream.params, validate=False)
    assert got == {r["user"]: r["exposure"] for r in want.collect()}
    assert stream._last("scores").where("user = 0").count() == 2  # the largest, and the one that weighs most


def test_stream_join(spark, tmp_path):
    s = spark.createDataFrame([(1, 0.5, 0), (1, 0.7, 500_000), (2, 0.9, 0)], "user long, val double, t long").select("user", "val", F.timestamp_seconds(F.col("t") + 1_000_000_000).alias("ts"))
    c = spark.createDataFrame([(1, 9, 400_000), (2, 8, 100)], "src long, dest long, t long").select("src", "dest", F.timestamp_seconds(F.col("t") + 1_000_000_000).alias("cts"))
    for name, df in (("s", s), ("c", c)):
        df.write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    for lookback, want in ((None, [(1, 9, 0.5), (1, 9, 0.7), (2, 8, 0.9)]), ("2 days", [(1, 9, 0.7), (2, 8, 0.9)])):
        joined = attempted_contacts(read("s", s), read("c", c), lookback=lookback)
        out = f"joined{len(want)}"
        joined.writeStream.format("memory").queryName(out).option("checkpointLocation", str(tmp_path / out)).trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, spark.table(out).select("src", "dest", "val").collect())) == want


def test_stream_join_plans(spark):
    rate = spark.readStream.format("rate").load()
    s = rate.select(F.col("value").alias("user"), F.lit(0.5).alias("val"), F.col("timestamp").alias("ts"))
    c = rate.select(F.col("value").alias("src"), (F.col("value") + 1).alias("dest"), F.col("timestamp").alias("cts"))
    assert attempted_contacts(s, c).isStreaming
