"""DuckDB SQL for the engine's queries, over the driver's tables."""

from __future__ import annotations

from emberline.functions.expr import ALPHABET

TOL, ALPHA, BUFFER, ROUNDS, LEVELS = 0.6, 0.8, 172_800, 12, 10
R = 6378137.0

SCORES = "scores AS (SELECT user_id AS \"user\", least(value / 600.0, 1.0) AS val, epoch_us(ts) // 1000000 AS time FROM events)"
CONTACTS = """met AS (SELECT DISTINCT event_type, (epoch_us(ts) // 1000000) // 300 AS b, user_id AS u FROM events),
fx_contacts AS (SELECT x.u AS u1, y.u AS u2, max(x.b) * 300 AS time FROM met x JOIN met y ON x.event_type = y.event_type AND x.b = y.b AND x.u < y.u GROUP BY 1, 2)"""
EDGES = CONTACTS + """,
edges AS (SELECT u1 AS src, u2 AS dest, time AS ctime FROM fx_contacts UNION ALL SELECT u2, u1, time FROM fx_contacts)"""
INITIAL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY val DESC, time DESC) AS k FROM scores),
init AS (SELECT "user", val AS init_val, time AS init_time FROM ranked WHERE k = 1)"""
HOP = f"""weighed AS (SELECT e.src, e.dest, s.val, s.time, row_number() OVER (PARTITION BY e.src, e.dest ORDER BY ln(greatest(s.val, 1e-7)) + least((s.time - e.ctime) / 86400.0, 0.0) / 1.0 DESC, s.val DESC, s.time) AS k
  FROM edges e JOIN scores s ON s."user" = e.src AND s.time <= e.ctime + {BUFFER}),
best AS (SELECT src, dest, val * {ALPHA} AS val, time FROM weighed WHERE k = 1),
lim AS (SELECT e.src, e.dest, e.ctime, i.init_val * {ALPHA} * {TOL} AS least_val, i.init_time AS latest FROM edges e JOIN init i ON i."user" = e.src),
m1 AS (SELECT b.src, b.dest, b.val, b.time FROM best b JOIN lim l ON l.src = b.src AND l.dest = b.dest WHERE b.val >= l.least_val AND b.time <= l.latest)"""


def step(k: int) -> str:
    return f"""m{k} AS (SELECT l.src, l.dest, max(m.val * {ALPHA}) AS val, m.time FROM m{k - 1} m JOIN lim l ON l.src = m.dest AND l.dest <> m.src
  WHERE m.time <= l.ctime + {BUFFER} AND m.val * {ALPHA} >= l.least_val AND m.time <= l.latest GROUP BY l.src, l.dest, m.time)"""


CLOSE = "close_met AS (SELECT DISTINCT event_type, (epoch_us(ts) // 1000000) // 5 AS b, user_id AS u FROM events), linked AS (SELECT DISTINCT x.u FROM close_met x JOIN close_met y ON x.event_type = y.event_type AND x.b = y.b AND x.u <> y.u)"
BASE = f"WITH {SCORES},\n{EDGES},\n{INITIAL},\n{HOP}"
EXPOSED = (
    BASE + ",\n" + ",\n".join(step(k) for k in range(2, ROUNDS + 1)) + ",\nreceived AS (SELECT dest, max(val) AS v FROM (" + " UNION ALL ".join(f"SELECT dest, val FROM m{k}" for k in range(1, ROUNDS + 1)) + ") GROUP BY dest),\n"
    'exposed AS (SELECT i."user", i.init_val, greatest(i.init_val, coalesce(r.v, 0.0)) AS exposure FROM init i LEFT JOIN received r ON r.dest = i."user")'
)
RISEN = (
    ',\ncame AS (SELECT "user" AS u, 0 AS k, init_val AS v FROM init UNION ALL ' + " UNION ALL ".join(f"SELECT dest, {k}, max(val) FROM m{k} GROUP BY dest" for k in range(1, ROUNDS + 1)) + "),\n"
    'rises AS (SELECT u, CASE WHEN v > max(v) OVER (PARTITION BY u ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS r FROM came),\n'
    'risen AS (SELECT u AS "user", CAST(sum(r) AS BIGINT) AS updates FROM rises WHERE u IN (SELECT "user" FROM init) GROUP BY u)'
)
REACH = (
    f"WITH {SCORES},\n{EDGES},\n{INITIAL},\nlim AS (SELECT e.src, e.dest, e.ctime, i.init_val * {ALPHA} * {TOL} AS least_val, i.init_time AS latest FROM edges e JOIN init i ON i.\"user\" = e.src),\n"
    'r0 AS (SELECT "user" AS source, "user" AS u, init_val AS val, init_time AS time FROM init),\n'
    + ",\n".join(
        f"r{k} AS (SELECT DISTINCT r.source, l.dest AS u, r.val * {ALPHA} AS val, r.time FROM r{k - 1} r JOIN lim l ON l.src = r.u WHERE r.time <= l.ctime + {BUFFER} AND r.val * {ALPHA} >= l.least_val AND r.time <= l.latest"
        + "".join(f" AND NOT EXISTS (SELECT 1 FROM r{j} q WHERE q.source = r.source AND q.u = l.dest)" for j in range(k)) + ")"
        for k in range(1, LEVELS + 1)
    )
    + ',\nreach AS (' + " UNION ALL ".join(f'SELECT source, u AS "user", {k} AS dist FROM r{k}' for k in range(1, LEVELS + 1)) + ")"
)
LOCATIONS = "loc AS (SELECT user_id AS \"user\", epoch_us(ts) // 1000000 AS time, 40.0::DOUBLE + (CAST(props->>'$.k' AS INT) // 10) * 0.0005::DOUBLE AS lat, -81.0::DOUBLE + (CAST(props->>'$.k' AS INT) % 10) * 0.0005::DOUBLE AS lon FROM events)"
SEGMENTS = LOCATIONS + """,
led AS (SELECT "user", time AS s, lead(time) OVER (PARTITION BY "user" ORDER BY time, lat, lon) AS e, lat, lon FROM loc),
seg AS (SELECT * FROM led WHERE e > s)"""


def overlaps(tol: float) -> str:
    return f"""WITH {SEGMENTS},
ov AS (SELECT a."user" AS u1, b."user" AS u2, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM seg a JOIN seg b ON a."user" < b."user" AND a.s < b.e AND b.s < a.e
  WHERE {R} * sqrt(pow(radians(a.lat) - radians(b.lat), 2) + pow(radians(a.lon) - radians(b.lon), 2)) <= {tol})"""


ISLANDS = overlaps(200.0) + """,
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY u1, u2 ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ov),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY u1, u2 ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
isl AS (SELECT u1, u2, min(s) AS s, max(e) AS e FROM numbered GROUP BY u1, u2, k)"""
#: Distinct places are 55 metres apart in latitude and more than 40 in longitude, so within a metre means at one place.
PAIRS = """places AS (SELECT DISTINCT "user", round(lat * 10000) AS a, round(lon * 10000) AS b FROM loc),
pairs AS (SELECT DISTINCT x."user" AS u1, y."user" AS u2 FROM places x JOIN places y ON x.a = y.a AND x.b = y.b AND x."user" < y."user")"""
SUPPLIERS = """raw AS (SELECT s_suppkey AS u1, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS u2 FROM supplier UNION ALL SELECT s_suppkey, s_suppkey // 2 FROM supplier),
pr AS (SELECT DISTINCT least(u1, u2) AS u1, greatest(u1, u2) AS u2 FROM raw WHERE u1 <> u2),
arcs AS (SELECT u1 AS src, u2 AS dest FROM pr UNION ALL SELECT u2, u1 FROM pr),
d0 AS (SELECT DISTINCT src AS source, src AS u FROM arcs),
""" + ",\n".join(
    f"d{k} AS (SELECT DISTINCT d.source, a.dest AS u FROM d{k - 1} d JOIN arcs a ON a.src = d.u WHERE " + " AND ".join(f"NOT EXISTS (SELECT 1 FROM d{j} q WHERE q.source = d.source AND q.u = a.dest)" for j in range(k)) + ")"
    for k in range(1, LEVELS + 1)
) + ",\ndist AS (" + " UNION ALL ".join(f'SELECT source, u AS "user", {k} AS dist FROM d{k}' for k in range(1, LEVELS + 1)) + ")"
#: Reach of made-up scores over the suppliers' graph, whose contacts are all at time 0.
SUPPLIER_REACH = (
    f"si AS (SELECT src AS u, (src % 10) / 10.0::DOUBLE AS v, src % 3 - 1 AS t FROM (SELECT DISTINCT src FROM arcs)),\n"
    f"sl AS (SELECT a.src, a.dest, s.v * {ALPHA} * {TOL} AS least_val, s.t AS latest FROM arcs a JOIN si s ON s.u = a.src),\n"
    "h0 AS (SELECT u AS source, u, v AS val, t AS time FROM si),\n"
    + ",\n".join(
        f"h{k} AS (SELECT DISTINCT r.source, l.dest AS u, r.val * {ALPHA} AS val, r.time FROM h{k - 1} r JOIN sl l ON l.src = r.u WHERE r.time <= {BUFFER} AND r.val * {ALPHA} >= l.least_val AND r.time <= l.latest"
        + "".join(f" AND NOT EXISTS (SELECT 1 FROM h{j} q WHERE q.source = r.source AND q.u = l.dest)" for j in range(k)) + ")"
        for k in range(1, LEVELS + 1)
    )
    + ", reached AS (" + " UNION ALL ".join(f"SELECT source, u FROM h{k}" for k in range(1, LEVELS + 1)) + ")"
)
RUNS = "runs AS (SELECT l_returnflag AS \"Graph\", l_discount AS \"SendTolerance\", l_linestatus AS \"Setting\", l_extendedprice AS \"Runtime\", l_quantity AS \"Messages\", l_orderkey AS seq, l_linenumber AS line FROM lineitem)"
SEM = 'stddev_samp("Messages") / sqrt(count("Messages"))'


def uniform(seed: int, stream: str, *keys: str) -> str:
    text = f"'{seed}:{stream}'" + "".join(f" || ':' || CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


def normal(seed: int, stream: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform(seed, stream + '.u', *keys)})) * cos(2 * 3.141592653589793 * {uniform(seed, stream + '.v', *keys)}))"


def _geohash(lat: str, lon: str, precision: int) -> str:
    n_lon, n_lat = (5 * precision + 1) // 2, 5 * precision // 2
    x = f"least(greatest(CAST(floor(({lon} + 180) / 360 * {1 << n_lon}.0::DOUBLE) AS BIGINT), 0), {(1 << n_lon) - 1})"
    y = f"least(greatest(CAST(floor(({lat} + 90) / 180 * {1 << n_lat}.0::DOUBLE) AS BIGINT), 0), {(1 << n_lat) - 1})"
    chars = []
    for k in range(precision):
        terms = []
        for j in range(5):
            bit = 5 * k + j
            q, at = ("x", n_lon - 1 - bit // 2) if bit % 2 == 0 else ("y", n_lat - 1 - bit // 2)
            terms.append(f"(({q} >> {at}) & 1) * {1 << (4 - j)}")
        chars.append(f"substr('{ALPHABET}', CAST({' + '.join(terms)} + 1 AS BIGINT), 1)")
    return f"(SELECT {' || '.join(chars)} FROM (SELECT {x} AS x, {y} AS y))"


def _decode(code: str, precision: int) -> tuple[str, str]:
    n_lon, n_lat = (5 * precision + 1) // 2, 5 * precision // 2
    x, y = [], []
    for k in range(precision):
        value = f"(instr('{ALPHABET}', substr({code}, {k + 1}, 1)) - 1)"
        for j in range(5):
            bit = 5 * k + j
            (x if bit % 2 == 0 else y).append(f"(({value} >> {4 - j}) & 1) * {1 << ((n_lon if bit % 2 == 0 else n_lat) - 1 - bit // 2)}")
    return f"(({' + '.join(y)}) + 0.5::DOUBLE) * {180.0 / (1 << n_lat)!r}::DOUBLE - 90", f"(({' + '.join(x)}) + 0.5::DOUBLE) * {360.0 / (1 << n_lon)!r}::DOUBLE - 180"


_lat, _lon = _decode("code", 9)

ORACLES: dict[str, str] = {
    "scan_scores": f'WITH {SCORES} SELECT "user", round(val, 6) AS val, time FROM scores',
    "sociopatterns_edges": "WITH t AS (SELECT epoch_us(ts) // 1000000 AS t, user_id AS a, CAST(props->>'$.k' AS BIGINT) AS b FROM events) SELECT least(a, b) AS u1, greatest(a, b) AS u2, max(t) AS time FROM t WHERE a <> b GROUP BY 1, 2",
    "dense_index": f'WITH {CONTACTS}, u AS (SELECT u1 AS "user" FROM fx_contacts UNION SELECT u2 FROM fx_contacts) SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS idx FROM u',
    "log_projection": "SELECT value AS \"Updates\", event_id AS \"Messages\", CAST(props->>'$.k' AS INT) AS \"Workers\" FROM events",
    "pair_key": "SELECT l_orderkey, l_linenumber, least(l_suppkey, l_partkey) AS lo, greatest(l_suppkey, l_partkey) AS hi FROM lineitem",
    "edges": f"WITH {EDGES} SELECT src, dest, ctime FROM edges",
    "eligible_scores": f'WITH {SCORES}, {EDGES} SELECT src, dest, count(*) AS n, round(max(val), 6) AS top, max(time) AS latest FROM edges JOIN scores ON "user" = src AND time <= ctime + {BUFFER} GROUP BY src, dest',
    "score_weight": "SELECT l_orderkey, l_linenumber, round(ln(greatest(l_discount, 1e-7)) + least((l_orderkey * 100 - l_partkey * 1000) / 86400.0::DOUBLE, 0.0), 6) AS weight FROM lineitem",
    "initial_scores": f'WITH {SCORES}, {INITIAL} SELECT "user", round(init_val, 6) AS init_val, init_time FROM init',
    "first_hop": BASE + " SELECT src, dest, round(val, 6) AS val, time FROM m1",
    "send_filter": BASE + ", c AS (SELECT src, count(*) AS considered FROM best GROUP BY src), s AS (SELECT src, count(*) AS sent FROM m1 GROUP BY src) SELECT c.src, considered, coalesce(sent, 0) AS sent FROM c LEFT JOIN s ON c.src = s.src",
    "propagate_k": BASE + ", " + step(2) + " SELECT src, dest, round(val, 6) AS val, time FROM m2",
    "exposure": EXPOSED + ' SELECT "user", round(init_val, 6) AS init_val, round(exposure, 6) AS exposure FROM exposed',
    "update_stats": EXPOSED + ", up AS (SELECT CASE WHEN exposure > init_val THEN exposure - init_val END AS d FROM exposed) SELECT count(*) AS nodes, count(d) AS updates, round(coalesce(min(d), 0), 5) AS min_update, round(coalesce(max(d), 0), 5) AS max_update, round(coalesce(avg(d), 0), 5) AS avg_update, round(coalesce(stddev_pop(d), 0), 5) AS std_update FROM up",
    "update_counts": EXPOSED + RISEN + ' SELECT "user", updates FROM risen',
    "run_log": EXPOSED + RISEN + f' SELECT (SELECT count(*) FROM exposed) AS "Nodes", (SELECT count(*) FROM fx_contacts) AS "Edges", (SELECT count(*) FROM exposed WHERE exposure > init_val) AS "Updates", (SELECT CAST(coalesce(min(updates), 0) AS DOUBLE) FROM risen WHERE updates > 0) AS "MinUpdates", (SELECT CAST(coalesce(max(updates), 0) AS DOUBLE) FROM risen) AS "MaxUpdates", (SELECT round_even(coalesce(avg(updates), 0), 4) FROM risen WHERE updates > 0) AS "AvgUpdates", (SELECT round_even(coalesce(stddev_pop(updates), 0), 4) FROM risen WHERE updates > 0) AS "StdUpdates", {ALPHA}::DOUBLE AS "Transmission", {TOL}::DOUBLE AS "SendTolerance", {BUFFER}.0::DOUBLE AS "TimeBufferInSeconds"',
    "weighted_summary": "WITH w AS (SELECT event_type, max(value) AS runtime, count(*) AS messages, count(DISTINCT user_id) AS nodes, count(*) FILTER (value > 50) AS updates, min(value) AS min_update, max(value) AS max_update, avg(value) AS avg_update FROM events GROUP BY 1) SELECT max(runtime) AS runtime, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(updates) AS BIGINT) AS updates, min(min_update) AS min_update, max(max_update) AS max_update, round(CASE WHEN sum(updates) = 0 THEN 0 ELSE sum(avg_update * updates) / sum(updates) END, 5) AS avg_update FROM w",
    "isolated_users": f'WITH {SCORES}, {CLOSE} SELECT DISTINCT "user" FROM scores WHERE "user" NOT IN (SELECT u FROM linked)',
    "connected_users": f'WITH {SCORES}, {CLOSE} SELECT DISTINCT "user" FROM scores WHERE "user" IN (SELECT u FROM linked)',
    "prune_graph": "WITH c AS (SELECT least(l_suppkey, l_partkey) AS u1, greatest(l_suppkey, l_partkey) AS u2, max(l_orderkey) AS time FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2) SELECT u AS \"user\", count(*) AS edges, max(time) AS latest FROM (SELECT u1 AS u, time FROM c UNION ALL SELECT u2, time FROM c) WHERE u IN (SELECT p_partkey FROM part) GROUP BY u",
    "degrees": f'WITH {EDGES} SELECT src AS "user", count(*) AS degree FROM edges GROUP BY src',
    "degree_stats": f'WITH {EDGES}, g AS (SELECT count(*) AS degree FROM edges GROUP BY src) SELECT CAST(min(degree) AS DOUBLE) AS min, CAST(max(degree) AS DOUBLE) AS max, round(avg(degree), 3) AS mean, round(stddev_pop(degree), 3) AS std FROM g',
    "adjacency": f"WITH {EDGES} SELECT src AS \"user\", string_agg(CAST(dest AS VARCHAR), ',' ORDER BY dest) AS neighbors FROM edges GROUP BY src",
    "graph_size": f"WITH {EDGES} SELECT count(DISTINCT src) AS nodes, count(*) FILTER (src < dest) AS edges FROM edges",
    "one_mode_projection": "WITH m AS (SELECT l_suppkey AS u, l_orderkey AS f, max(epoch_us(l_shipdate) // 1000000) AS t FROM lineitem GROUP BY 1, 2) SELECT a.u AS u1, b.u AS u2, max(least(a.t, b.t)) AS time FROM m a JOIN m b ON a.f = b.f AND a.u < b.u GROUP BY 1, 2",
    "reach": REACH + ' SELECT source, "user", dist FROM reach',
    "reach_ratio": REACH + ', p AS (SELECT DISTINCT least(source, "user") AS a, greatest(source, "user") AS b FROM reach), n AS (SELECT count(DISTINCT src) AS n FROM edges) SELECT (SELECT count(*) FROM p) AS actual, n * (n - 1) AS ideal, round((SELECT count(*) FROM p) / (n * (n - 1)), 6) AS ratio_compat FROM n',
    "reach_stats": REACH + ", g AS (SELECT source, count(*) AS c, max(dist) AS far FROM reach GROUP BY source) SELECT min(c) AS min_reached, max(c) AS max_reached, round(avg(c), 5) AS mean_reached, max(far) AS max_dist FROM g",
    "reach_hist": REACH + ", g AS (SELECT source % 2 AS setting, dist, count(*) AS n FROM reach GROUP BY 1, 2) SELECT setting, dist, n, round(n / sum(n) OVER (PARTITION BY setting), 6) AS share FROM g",
    "apsp": f'WITH {SUPPLIERS} SELECT source, "user", dist FROM dist',
    "harmonic": f'WITH {SUPPLIERS} SELECT source AS "user", round(sum(1.0::DOUBLE / dist) / ((SELECT count(DISTINCT src) FROM arcs) - 1), 6) AS harmonic FROM dist GROUP BY source',
    "radius_diameter": f"WITH {SUPPLIERS}, f AS (SELECT max(dist) AS far FROM dist GROUP BY source) SELECT min(far) AS radius, max(far) AS diameter FROM f",
    "graph_stats": f"WITH {SUPPLIERS}, f AS (SELECT max(dist) AS far, sum(1.0::DOUBLE / dist) / ((SELECT count(DISTINCT src) FROM arcs) - 1) AS h FROM dist GROUP BY source), g AS (SELECT count(*) AS c FROM arcs GROUP BY src), {SUPPLIER_REACH}, "
    "q AS (SELECT count(*) AS actual FROM (SELECT DISTINCT least(source, u) AS a, greatest(source, u) AS b FROM reached)), z AS (SELECT count(DISTINCT src) AS n FROM arcs), y AS (SELECT count(*) FILTER (source < \"user\") AS reachable FROM dist) "
    "SELECT (SELECT n FROM z) AS nodes, (SELECT count(*) FROM pr) AS edges, (SELECT min(far) FROM f) AS radius, (SELECT max(far) FROM f) AS diameter, (SELECT round(avg(h), 5) FROM f) AS efficiency, "
    "(SELECT min(c) FROM g) AS min_degree, (SELECT max(c) FROM g) AS max_degree, (SELECT round(avg(c), 3) FROM g) AS mean_degree, (SELECT round(stddev_pop(c), 3) FROM g) AS std_degree, "
    "actual, n * (n - 1) AS ideal, reachable, round(actual / (n * (n - 1)), 6) AS ratio_compat, round(actual / reachable, 6) AS ratio_reachable FROM q, z, y",
    "history": f"WITH {LOCATIONS}, h AS (SELECT \"user\", time, {_geohash('lat', 'lon', 8)} AS g FROM loc) SELECT \"user\", string_agg(g || '@' || time, ',' ORDER BY time, g) AS locs FROM h GROUP BY \"user\"",
    "locf_segments": f'WITH {SEGMENTS} SELECT "user", s AS start, e AS "end", round(lat, 6) AS lat, round(lon, 6) AS lon FROM seg',
    "candidate_pairs": f"WITH {LOCATIONS}, {PAIRS} SELECT u1, u2 FROM pairs",
    "segment_overlaps": overlaps(200.0) + ' SELECT u1, u2, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS seconds, min(s) AS first, max(e) AS last FROM ov GROUP BY u1, u2',
    "proximal_segments": overlaps(1.0) + " SELECT u1, u2, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS seconds FROM ov GROUP BY u1, u2",
    "islands": ISLANDS + " SELECT u1, u2, count(*) AS n, max(e - s) AS longest, max(s) AS latest FROM isl GROUP BY u1, u2",
    "contacts": ISLANDS + f", {PAIRS} SELECT isl.u1, isl.u2, max(s) AS time FROM isl JOIN pairs ON isl.u1 = pairs.u1 AND isl.u2 = pairs.u2 WHERE e - s >= 900 GROUP BY isl.u1, isl.u2",
    "geohash_encode": f"WITH {LOCATIONS} SELECT DISTINCT \"user\", time, {_geohash('lat', 'lon', 12)} AS g12, {_geohash('lat', 'lon', 5)} AS g5 FROM loc",
    "geohash_decode": f"WITH {LOCATIONS}, c AS (SELECT DISTINCT {_geohash('lat', 'lon', 9)} AS code FROM loc) SELECT code, round({_lat}, 9) AS lat, round({_lon}, 9) AS lon FROM c",
    "haversine": f'WITH {LOCATIONS}, a AS (SELECT "user", min(lat) AS lat1, min(lon) AS lon1, max(lat) AS lat2, max(lon) AS lon2 FROM loc GROUP BY 1) SELECT "user", round(2 * {R} * asin(least(1.0, sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)))), 4) AS metres FROM a',
    "norm_stats": f'WITH {RUNS}, n AS (SELECT *, "Runtime" / max("Runtime") OVER w AS a, "Messages" / max("Messages") OVER w AS b FROM runs WINDOW w AS (PARTITION BY "Graph", "SendTolerance")) SELECT seq, line, "Graph", round(a, 6) AS nrt, round(b, 6) AS nms FROM n WHERE "SendTolerance" > 0.03',
    "head_per_group": f'WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY "Graph", "Setting" ORDER BY seq, line, "Runtime", "Messages") AS k FROM runs) SELECT "Graph", "Setting", seq, line, "Runtime" FROM k WHERE k <= 10',
    "describe_by": f'WITH {RUNS} SELECT "Graph", "Setting", count("Runtime") AS count, round(avg("Runtime"), 2) AS mean, round(stddev_samp("Runtime"), 2) AS std, min("Runtime") AS min, round(quantile_cont("Runtime", 0.25), 4) AS q25, round(quantile_cont("Runtime", 0.5), 4) AS q50, round(quantile_cont("Runtime", 0.75), 4) AS q75, max("Runtime") AS max FROM runs GROUP BY 1, 2',
    "quantiles": f"WITH {RUNS} " + " UNION ALL ".join(f'SELECT {q}::DOUBLE AS quantile, round(quantile_cont("Runtime", {q}), 2) AS "Runtime", round(quantile_cont("Messages", {q}), 2) AS "Messages" FROM runs' for q in (0.25, 0.5, 0.75, 0.95)),
    "linreg": f'WITH {RUNS}, r AS (SELECT regr_count("Runtime", "Messages") AS n, regr_slope("Runtime", "Messages") AS b, regr_intercept("Runtime", "Messages") AS a, corr("Runtime", "Messages") AS r, regr_sxx("Runtime", "Messages") AS sxx, regr_syy("Runtime", "Messages") AS syy, regr_sxy("Runtime", "Messages") AS sxy, avg("Messages") AS mx FROM runs), e AS (SELECT *, sqrt((syy - b * sxy) / (n - 2) / sxx) AS se FROM r) SELECT CAST(n AS BIGINT) AS n, round(b, 3) AS slope, round(a, 2) AS intercept, round(r, 6) AS r, round(se, 4) AS slope_err, round(se * sqrt(sxx / n + mx * mx), 3) AS intercept_err FROM e',
    "sem": f'WITH {RUNS} SELECT "Graph", round({SEM}, 6) AS sem FROM runs GROUP BY 1',
    "ratio_err": f'WITH {RUNS}, a AS (SELECT "Graph", avg("Runtime") AS a, avg("Messages") AS b, {SEM.replace("Messages", "Runtime")} AS ea, {SEM} AS eb FROM runs GROUP BY 1) SELECT "Graph", round(abs(a / b) * sqrt(pow(ea / a, 2) + pow(eb / b, 2)), 5) AS err FROM a',
    "combined_err": f'WITH {RUNS}, a AS (SELECT "Graph", "Setting", {SEM} AS e FROM runs GROUP BY 1, 2) SELECT "Graph", round(sqrt(sum(e * e)) / count(e), 6) AS err FROM a GROUP BY 1',
    "expected_reach": f'WITH {SCORES}, {INITIAL} SELECT "user", round(greatest(1.0, 1 + ln(greatest(1e-7, 0.6::DOUBLE * 0.8::DOUBLE * 0.9::DOUBLE) / greatest(1e-7, init_val)) / ln(0.8::DOUBLE)), 5) AS reach FROM init',
    "reach_comparison": REACH + f', top AS (SELECT avg(init_val) AS first FROM init), hops AS (SELECT greatest(1.0, 1 + ln(greatest(1e-7, {TOL}::DOUBLE * {ALPHA}::DOUBLE * first) / greatest(1e-7, {ALPHA}::DOUBLE * init_val)) / ln({ALPHA}::DOUBLE)) AS h FROM init, top), far AS (SELECT max(dist) AS far FROM reach GROUP BY source), x AS (SELECT avg(h) AS em, stddev_samp(h) / sqrt(count(h)) AS ee FROM hops), y AS (SELECT avg(far) AS am, stddev_samp(far) / sqrt(count(far)) AS ae FROM far) SELECT round(em, 5) AS expected_mean, round(ee, 5) AS expected_err, round(am, 5) AS actual_mean, round(ae, 5) AS actual_err FROM x, y',
    "param_grid": "SELECT round(a.i / 10, 6) AS tol, round(b.i / 10, 6) AS transmission FROM range(1, 11) a(i), range(1, 10) b(i)",
    "pair_combinations": "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey",
    "union_runs": f"WITH {RUNS}, u AS (SELECT 'lfr' AS g, * FROM runs WHERE \"SendTolerance\" < 0.03 UNION ALL SELECT 'geometric', * FROM runs WHERE \"SendTolerance\" BETWEEN 0.03 AND 0.07 UNION ALL SELECT 'power', * FROM runs WHERE \"SendTolerance\" > 0.07) SELECT g AS \"Graph\", \"Setting\", count(*) AS n, max(\"Runtime\") AS top FROM u GROUP BY 1, 2",
    "synth_values": f'WITH {SCORES}, u AS (SELECT DISTINCT "user" AS u FROM scores), k AS (SELECT u, CAST(i AS INT) AS k FROM u, range(0, 3) t(i)) SELECT u AS "user", k, round(CASE WHEN {uniform(7, "risk", "u")} < 0.2 THEN 0.5 ELSE 0.0 END + 0.5 * {uniform(7, "value", "u", "k")}, 6) AS val FROM k',
    "synth_times": f'WITH {SCORES}, u AS (SELECT DISTINCT "user" AS u FROM scores), g AS (SELECT u, CAST(d AS INT) AS d, CAST(i AS INT) AS i, {uniform(7, "time", "u", "i")} * 43200 AS x FROM u, range(0, 3) a(d), range(0, 2) b(i)) SELECT u AS "user", d * 2 + i AS k, CAST(floor(1700000000 - 86400 * d + sum(x) OVER (PARTITION BY u, d ORDER BY i)) AS BIGINT) AS time FROM g',
    "synth_walk": f'WITH RECURSIVE {SCORES}, u AS (SELECT DISTINCT "user" AS u FROM scores), w AS (SELECT u, 0 AS k, greatest(-1.0, least(1.0, {normal(7, "lat.start", "u")})) AS x FROM u UNION ALL SELECT u, k + 1, least(greatest(x + (-0.4 + 0.8 * {uniform(7, "lat.step", "u", "k + 1")}), -1.0), 1.0) FROM w WHERE k < 4) SELECT u AS "user", CAST(k AS INT) AS k, round(x, 6) AS x FROM w',
    "synth_geometric": f"WITH p AS (SELECT i AS u, {uniform(7, 'x', 'i')} AS x, {uniform(7, 'y', 'i')} AS y FROM range(0, 200) t(i)) SELECT a.u AS u1, b.u AS u2 FROM p a JOIN p b ON a.u < b.u WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= least(1.0, pow(0.25, log10(200) - 1))",
    "membership_labels": f"WITH {EDGES}, l0 AS (SELECT DISTINCT src AS u, src AS label FROM edges)"
    + "".join(f", v{k} AS (SELECT e.src AS u, l.label, count(*) AS n FROM edges e JOIN l{k - 1} l ON l.u = e.dest GROUP BY 1, 2), l{k} AS (SELECT u, label FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n DESC, label) AS r FROM v{k}) WHERE r = 1)" for k in (1, 2, 3))
    + ' SELECT u AS "user", label FROM l3',
    "isolated_orders": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 60 * c_acctbal)",
    "islands_gaps": "WITH d AS (SELECT DISTINCT user_id, (epoch_us(ts) // 1000000) // 86400 AS day FROM events), k AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d) SELECT user_id, min(day) AS start, max(day) + 1 AS \"end\" FROM k GROUP BY user_id, g",
}
