"""Message reachability: at how many hops a user's initial message can arrive at each other user."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.expr import expected_reach
from emberline.lineage import cut, spread
from emberline.operators.analysis import sem
from emberline.operators.propagation import initial_scores
from emberline.params import PropagationParams

SOURCES, PACK, WORDS, ROWS, TURN = 2048, 1 << 17, 1 << 19, 4096, 4096


def _pack(rows: pa.Table) -> pa.Table:
    """Arcs as arrays, those of one user together; four bytes for each number where that is enough."""
    order = np.argsort(rows["dest"].to_numpy(), kind="stable")
    columns = [rows[c].to_numpy()[order] for c in ("src", "dest", "ctime")]
    out = []
    for k in range(0, len(order), PACK):
        part = [c[k : k + PACK] for c in columns]
        small = [x.astype("i4") if -(1 << 31) <= x.min() and x.max() < 1 << 31 else x for x in part]
        out.append({"n": len(part[0])} | dict(zip(("src", "dest", "ctime"), (x.tobytes() for x in small), strict=True)))
    return pa.Table.from_pylist(out, pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("src", "dest", "ctime"))]))


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of whole words."""
    wide = np.zeros((len(flags), -(-flags.shape[1] // 64) * 64), bool)
    wide[:, : flags.shape[1]] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def _flags(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view("u1"), axis=1, count=n, bitorder="little").view(bool)


class _Arcs:
    """Arcs of all users, followed one at a time."""

    def __init__(self, packs: pa.Table, user: np.ndarray):
        self.packs, ends = [], [user]
        for k in range(packs.num_rows):
            size = packs["n"][k].as_py()
            src, dest, ctime = (_numbers(packs[c][k], size) for c in ("src", "dest", "ctime"))
            at = np.searchsorted(user, src)
            known = np.flatnonzero(user[np.minimum(at, len(user) - 1)] == src) if len(user) else np.zeros(0, "i8")
            self.packs.append((at[known].astype("i4"), dest[known], ctime[known]))
            ends.append(np.unique(dest[known]))
        self.nodes = np.unique(np.concatenate(ends).astype("i8"))
        at = np.searchsorted(self.nodes, user)
        self.packs = [(at[src].astype("i4"), np.searchsorted(self.nodes, dest).astype("i4"), ctime) for src, dest, ctime in self.packs]

    def know(self, upto: Callable) -> None:
        self.packs = [(src, dest, upto(ctime).astype("i4")) for src, dest, ctime in self.packs]

    def follow(self, sends: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        active, came, step = sends.any(axis=1), np.zeros_like(sends), max(1, WORDS // max(1, sends.shape[1]))
        for src, dest, upto in self.packs:
            use = np.flatnonzero(active[src] & (upto > 0))
            for k in range(0, len(use), step):
                arcs = use[k : k + step]
                to = dest[arcs]
                first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                came[to[first]] |= np.bitwise_or.reduceat(sends[src[arcs]] & prefix[upto[arcs]], first, axis=0)
        return came


def _turns(size: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values, of which each owner has size in a row, so dealt that the first of each owner stand first, then the second. Owners by number
    of values, how many owners have a value in each turn, and the values."""
    owners = np.argsort(-size, kind="stable")
    rank = np.empty(len(size), "i4")
    rank[owners] = np.arange(len(size), dtype="i4")
    count = len(size) - np.cumsum(np.bincount(size, minlength=1))[:-1]
    turn = np.arange(len(values), dtype="i4") - np.repeat((np.cumsum(size) - size).astype("i4"), size)
    to = (np.cumsum(count) - count)[turn]
    to += np.repeat(rank, size)
    out = np.empty_like(values)
    out[to] = values
    return owners, count, out


def _joined_bits(rows: np.ndarray, n: int, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of n owners the union of rows at its places, which _turns() has dealt."""
    out, some = np.zeros((n, rows.shape[1]), rows.dtype), rows.any(axis=1)
    held, few, begin = np.empty((TURN, rows.shape[1]), rows.dtype), 4 * np.count_nonzero(some) < len(some), 0
    for c in count:
        for k in range(0, c, TURN):
            places, to = at[begin + k : begin + min(c, k + TURN)], out[k : min(c, k + TURN)]
            if few:
                hit = np.flatnonzero(some[places])
                to[hit] |= rows[places[hit]]
            else:
                to |= np.take(rows, places, axis=0, out=held[: len(places)], mode="clip")
        begin += c
    return out


class _Meetings:
    """Who was where at one time. A message that is early enough for a meeting goes from any user there to all others; that a pair's
    latest contact is late enough is the same as that one of their meetings is. So a pair is neither made nor followed."""

    def __init__(self, packs: pa.Table, user: np.ndarray):
        parts = [[_numbers(packs[c][k], packs[m][k].as_py()) for c, m in (("src", "n"), ("dest", "m"), ("ctime", "m"))] for k in range(packs.num_rows)]
        member, size, self.time = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, "i8") for k in range(3))
        del parts, packs
        nodes = np.unique(np.r_[np.unique(member), user])
        member, size = np.searchsorted(nodes, member).astype("i4"), size.astype("i8")
        often = np.bincount(member, minlength=len(nodes))
        by_user = np.argsort(-often, kind="stable")
        rank = np.empty(len(nodes), "i4")
        rank[by_user] = np.arange(len(nodes), dtype="i4")
        self.nodes, member, often = nodes[by_user], rank[member], often[by_user]
        order, self.in_turn, self.members = _turns(size, member)
        # the meetings' order is that of _turns() from here on
        self.time, place = self.time[order], np.empty(len(size), "i4")
        place[order] = np.arange(len(size), dtype="i4")
        of = np.repeat(place, size)
        _, self.user_turn, self.met = _turns(often, of[np.argsort(member, kind="stable")])

    def know(self, upto: Callable) -> None:
        self.upto = upto(self.time)

    def follow(self, sends: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        heard = _joined_bits(sends, len(self.time), self.in_turn, self.members)
        for k in range(0, len(heard), TURN):
            heard[k : k + TURN] &= prefix[self.upto[k : k + TURN]]
        return _joined_bits(heard, len(self.nodes), self.user_turn, self.met)


def _numbers(x: pa.BinaryScalar, size: int) -> np.ndarray:
    x = x.as_buffer()
    return np.frombuffer(x, "i4" if x.size == 4 * size else "i8")


def _search(rows: pa.Table, key: int, transmission: float, buffer: int, max_hops: int | None, over: type) -> Iterator[tuple]:
    """All levels from the sources of block key at once, a bit for each in a row for each user: (hop, sources, users, homes, bits) by level,
    and with hop 0 who was reached at all. Sources stand in order of time, so those whose message is early enough are a prefix."""
    packed = rows["n"].is_valid()
    users = rows.filter(pa.compute.invert(packed)).select(["user", "val", "time", "least", "home"])
    by_user = np.argsort(users["user"].to_numpy())
    user, val, time, least, home = (users[c].to_numpy()[by_user] for c in ("user", "val", "time", "least", "home"))
    of = np.flatnonzero(home == key)
    of = of[np.argsort(time[of], kind="stable")]
    n = len(of)
    if not n:
        return
    rows = rows.filter(packed)
    del users
    graph = over(rows, user)
    del rows
    graph.know(lambda t: np.searchsorted(time[of], t.astype("i8") + buffer, "right"))
    nodes = graph.nodes
    order = np.argsort(nodes, kind="stable")
    node = order[np.searchsorted(nodes, user, sorter=order)]
    home_of, in_time = np.full(len(nodes), -1), np.zeros(len(nodes), "i4")
    home_of[node], in_time[node] = home, np.searchsorted(time[of], time, "right")
    lowest = np.full(len(nodes), np.inf)
    lowest[node] = least
    prefix = _bits(np.arange(n)[None, :] < np.arange(n + 1)[:, None])
    # sources of the k largest values and more
    sent, by_val = np.sort(val[of]), np.argsort(val[of], kind="stable")
    place = np.empty(n, "i8")
    place[by_val] = np.arange(n)
    large = _bits(place[None, :] >= np.arange(n + 1)[:, None])
    frontier = np.zeros((len(nodes), prefix.shape[1]), "<u8")
    frontier[node[of], np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype("u8")
    seen, hop = frontier.copy(), 0
    while max_hops is None or hop < max_hops:
        hop += 1
        sent = sent * transmission
        above = np.searchsorted(sent, lowest, "left")
        for k in range(0, len(nodes), TURN):
            frontier[k : k + TURN] &= prefix[in_time[k : k + TURN]] & large[above[k : k + TURN]]
        frontier = graph.follow(frontier, prefix)
        for k in range(0, len(nodes), TURN):
            frontier[k : k + TURN] &= ~seen[k : k + TURN]
        hit = np.flatnonzero(frontier.any(axis=1))
        if not len(hit):
            break
        seen |= frontier
        yield hop, user[of], nodes, home_of, frontier, hit
    seen[node[of], np.arange(n) // 64] ^= np.uint64(1) << (np.arange(n) % 64).astype("u8")
    yield 0, user[of], nodes, home_of, seen, np.flatnonzero(seen.any(axis=1))


LEVEL = "block int, home int, dist int, sources binary, users binary, bits binary"
COUNTED = "block int, dist int, sources binary, n binary"
PAIR = "source long, user long, dist int"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[c.split()[1]]) for x, c in zip(columns, schema.split(", "), strict=True)], [c.split()[0] for c in schema.split(", ")])


def _given(found: Iterator[tuple], key: int, schema: str, whole: bool) -> Iterator[pa.RecordBatch]:
    """What _search() found, by levels or as a whole, some rows at a time."""
    for hop, sources, nodes, home_of, bits, hit in found:
        if (hop == 0) != whole:
            continue
        if schema == COUNTED:
            n = np.zeros(len(sources), "i8")
            for k in range(0, len(hit), ROWS):
                n += _flags(bits[hit[k : k + ROWS]], len(sources)).sum(axis=0, dtype="i8")
            yield _batch(schema, [key], [hop], [sources.tobytes()], [n.tobytes()])
        elif schema == PAIR:
            for k in range(0, len(hit), 64):
                i, j = np.nonzero(_flags(bits[hit[k : k + 64]], len(sources)))
                yield _batch(schema, sources[j], nodes[hit[k + i]], np.full(len(i), hop, "i4"))
        else:
            for h in np.unique(home_of[hit]):
                some = hit[home_of[hit] == h]
                for k in range(0, len(some), ROWS):
                    part = some[k : k + ROWS]
                    yield _batch(schema, [key], [int(h)], [hop], [sources.tobytes()], [nodes[part].astype("i8").tobytes()], [bits[part].tobytes()])


def _decoded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sources, users, and for each user of which sources a message came."""
    sources, users = np.frombuffer(row["sources"], "i8"), np.frombuffer(row["users"], "i8")
    return sources, users, _flags(np.frombuffer(row["bits"], "<u8").reshape(len(users), -1), len(sources))


def _levels(scores: DataFrame, packs: DataFrame, over: type, p: PropagationParams, sources: DataFrame | None, max_hops: int | None, block: int, schema: str, whole: bool = False) -> DataFrame:
    spark = scores.sparkSession
    first = initial_scores(scores).where("user is not null and init_val is not null and init_time is not null")
    first = first.select(F.col("user").cast("long").alias("user"), F.col("init_val").cast("double").alias("val"), F.col("init_time").cast("long").alias("time"))
    wanted = first.select("user") if sources is None else first.join(sources.select(F.col("user").cast("long").alias("user")).distinct(), "user", "left_semi").select("user")
    count = wanted.count()
    blocks = max(1, math.ceil(count / block), min(math.ceil(count / 64), spark.sparkContext.defaultParallelism))
    homes = wanted.select("user", F.pmod(F.xxhash64("user"), F.lit(blocks)).cast("int").alias("home"))
    users = cut(first.withColumn("least", F.col("val") * p.transmission * p.tol).join(homes, "user", "left").withColumn("home", F.coalesce("home", F.lit(-1))))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = users.select(every, "*").unionByName(packs.select(every, "*"), allowMissingColumns=True).repartition(max(groups, min(8 * blocks, 1024)), "block")
    transmission, buffer = p.transmission, p.time_buffer

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = key[0].as_py()
        # no name here holds the rows, so the search can let go of them
        yield from _given(_search(pa.Table.from_batches(batches), k, transmission, buffer, max_hops, over), k, schema, whole)

    return rows.groupBy("block").applyInArrow(run, schema)


def _packed_arcs(edges: DataFrame) -> DataFrame:
    arcs = edges.where("src is not null and dest is not null and ctime is not null").select(*[F.col(c).cast("long").alias(c) for c in ("src", "dest", "ctime")])
    groups = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread(arcs.withColumn("g", F.pmod(F.xxhash64("dest"), F.lit(groups))), "g")
    return cut(dealt.groupBy("g").applyInArrow(lambda t: _pack(t), "n long, src binary, dest binary, ctime binary"))


def _pack_met(rows: pa.Table) -> pa.Table:
    """Users by meeting, how many are at each meeting, and its time; who is alone at one goes."""
    place, time, user = rows["place"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["time"].to_numpy(), rows["user"].to_numpy()
    order = np.lexsort((place, time))
    place, time, user = place[order], time[order], user[order]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (time[1:] != time[:-1])])
    size = np.diff(np.r_[first, len(user)])
    several = size > 1
    user, time, size = user[np.repeat(several, size)], time[first[several]], size[several]
    columns = [x.astype("i4") if len(x) and -(1 << 31) <= x.min() and x.max() < 1 << 31 else x.astype("i8") for x in (user, size, time)]
    out = [{"n": len(user), "m": len(size)} | dict(zip(("src", "dest", "ctime"), (x.tobytes() for x in columns), strict=True))] if len(user) else []
    return pa.Table.from_pylist(out, pa.schema([("n", pa.int64()), ("m", pa.int64()), *((c, pa.binary()) for c in ("src", "dest", "ctime"))]))


def _packed_meetings(meetings: DataFrame) -> DataFrame:
    known = meetings.where("place is not null and time is not null and user is not null").select("place", F.col("time").cast("long").alias("time"), F.col("user").cast("long").alias("user")).distinct()
    groups = int(meetings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread(known.withColumn("g", F.pmod(F.xxhash64("place", "time"), F.lit(groups))), "g")
    return cut(dealt.groupBy("g").applyInArrow(lambda t: _pack_met(t), "n long, m long, src binary, dest binary, ctime binary"))


def levels(scores: DataFrame, edges: DataFrame, p: PropagationParams, sources: DataFrame | None = None, max_hops: int | None = None, block: int = SOURCES) -> DataFrame:
    """(block, home, dist, sources, users, bits): which of a block's sources reach which users of another block at a level; home is
    -1 for users that are no source. The value at a level follows from the source's by repeated attenuation, so a level is a
    set of bits. Each task has all arcs, packed as arrays, and searches from the sources of one block; no pair is a row."""
    return _levels(scores, _packed_arcs(edges), _Arcs, p, sources, max_hops, block, LEVEL)


def reach(scores: DataFrame, edges: DataFrame, p: PropagationParams, sources: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(source, user, dist): the fewest hops at which a source's first message can arrive."""
    return _levels(scores, _packed_arcs(edges), _Arcs, p, sources, max_hops, SOURCES, PAIR)


def reach_over(scores: DataFrame, meetings: DataFrame, p: PropagationParams, sources: DataFrame | None = None, max_hops: int | None = None, block: int = SOURCES) -> DataFrame:
    """reach() where users at one place at one time have a contact then: meetings are (place, time, user). Each task has all of these,
    and they are as many as they are, whatever the number of contacts."""
    return _levels(scores, _packed_meetings(meetings), _Meetings, p, sources, max_hops, block, PAIR)


def counts_over(scores: DataFrame, meetings: DataFrame, p: PropagationParams, block: int = SOURCES) -> DataFrame:
    """For sizes(): (block, dist, sources, n), how many users each source reaches first at a level, counted where they are found."""
    return _levels(scores, _packed_meetings(meetings), _Meetings, p, None, None, block, COUNTED)


def reached_over(scores: DataFrame, meetings: DataFrame, p: PropagationParams, block: int = SOURCES) -> DataFrame:
    """For ratio_of(): levels() with all levels as one, dist 0."""
    return _levels(scores, _packed_meetings(meetings), _Meetings, p, None, None, block, LEVEL, whole=True)


def met_users(meetings: DataFrame) -> DataFrame:
    """Users with a contact: those who were not alone at a place and time."""
    known = meetings.where("place is not null and time is not null and user is not null").select("place", "time", "user").distinct()
    several = known.groupBy("place", "time").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.join(several, ["place", "time"], "left_semi").select("user").distinct()


def sizes(found: DataFrame) -> DataFrame:
    """(source, dist, n) from levels() or counts_over(): how many users each source reaches first at a level; no pair is a row."""

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if "n" in row:
                    of, n = np.frombuffer(row["sources"], "i8"), np.frombuffer(row["n"], "i8")
                else:
                    of, _, came = _decoded(row)
                    n = came.sum(axis=0, dtype="i8")
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(of[hit]), pa.array(np.full(len(hit), row["dist"], "i4")), pa.array(n[hit])], ["source", "dist", "n"])

    return found.mapInArrow(count, "source long, dist int, n long").groupBy("source", "dist").agg(F.sum("n").alias("n"))


def _joined(rows: pa.Table) -> pa.Table:
    """Of two blocks: how many unordered pairs are reached, either way."""
    parts = [(row["block"], row["home"], *_decoded(row)) for row in rows.to_pylist()]
    block, home = parts[0][:2]
    a = np.unique(np.concatenate([x for k, h, sources, users, _ in parts for x in ((sources,) if k == block else ()) + ((users,) if h == block else ())]))
    b = np.unique(np.concatenate([x for k, h, sources, users, _ in parts for x in ((sources,) if k == home else ()) + ((users,) if h == home else ())]))
    met = np.zeros((len(a), len(b)), bool)
    for k, h, sources, users, came in parts:
        if k == block and h == home:
            met[np.ix_(np.searchsorted(a, sources), np.searchsorted(b, users))] |= came.T
        if h == block and k == home:
            met[np.ix_(np.searchsorted(a, users), np.searchsorted(b, sources))] |= came
    return pa.table({"n": [int(met.sum()) // (2 if block == home else 1)]})


def ratio_of(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """ratio() from levels(): the blocks' bits meet, not their pairs."""
    keyed = found.withColumn("low", F.least("block", "home")).withColumn("high", F.greatest("block", "home"))
    n = keyed.groupBy("low", "high").applyInArrow(lambda rows: _joined(rows), "n long")
    out = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("actual")).crossJoin(nodes.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("ideal")))
    return out.withColumn("ratio_compat", F.try_divide(F.col("actual"), F.col("ideal")))


def comparison(scores: DataFrame, reached: DataFrame, p: PropagationParams) -> DataFrame:
    """One row: mean and standard error of the expected reach of all first messages, beside a sender of mean value, and of
    the farthest hop that messages of each source reached, sources that reached nobody aside."""
    first = initial_scores(scores)
    mean = first.agg(F.avg("init_val").alias("mean"))  # one row
    hops = expected_reach(F.col("init_val") * p.transmission, F.col("mean"), F.lit(p.tol), F.lit(p.transmission), p.eps)
    expected = first.crossJoin(F.broadcast(mean)).select(hops.alias("hops")).agg(F.avg("hops").alias("expected_mean"), sem("hops").alias("expected_err"))
    far = reached.groupBy("source").agg(F.max("dist").alias("far"))
    return expected.crossJoin(far.agg(F.avg("far").alias("actual_mean"), sem("far").alias("actual_err")))


def ratio(reached: DataFrame, nodes: DataFrame, dist: DataFrame | None = None) -> DataFrame:
    """actual (unordered pairs reached), ideal (ordered pairs of all nodes), ratio_compat of the two; with distances of
    the graph also ratio_reachable, over the pairs that any path joins."""
    pairs = reached.select(F.least("source", "user").alias("a"), F.greatest("source", "user").alias("b")).distinct()
    out = pairs.agg(F.count(F.lit(1)).alias("actual")).crossJoin(nodes.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("ideal")))
    out = out.withColumn("ratio_compat", F.try_divide(F.col("actual"), F.col("ideal")))
    if dist is not None:
        joined = dist.agg(F.count(F.when(F.col("source") < F.col("user"), 1)).alias("reachable"))
        out = out.crossJoin(joined).withColumn("ratio_reachable", F.try_divide(F.col("actual"), F.col("reachable")))
    return out
