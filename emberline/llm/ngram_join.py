"""Operator 6: self-join of documents on the Jaccard likeness of their word n-grams, by MinHash banding.

Words stand between white space; a text of fewer words than n is one n-gram. Rows per band are as
many as MAX_HASHES allows, bands as many as reach RECALL at the threshold.

Equal texts are one node with a weight. Each node's band hashes are dealt out, and bands with one
node go. Bands that hold the same nodes count once. Nodes that are left send their n-gram set to each
of their bands; a band of many nodes is cut into blocks, and each pair of blocks is a task of its
own, so no task holds more than two blocks. There all pairs are verified on the full sets by matrix
products, each pair in the first band the two share. Pairs never leave the task: it gives for each
node the weight it is linked to and one edge to the smallest node of its links' component.

Null and empty texts have no n-grams: equal ones share a class, and they link to no other text. Class
and copy ids are the smallest doc_id that isn't null. Repeated rows are copies of each other. A very long
text's set is one row. Other columns of the input take no part, whatever their names; an empty table gives
no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import LONG_MAX, partitions, small_batches, stage, table
from emberline.llm.components import components
from emberline.llm.fingerprints import Prefixes
from emberline.llm.tokens import columns

N, THRESHOLD = 5, 0.8
RECALL, MAX_HASHES = 0.999999, 128
BLOCK = 256
_M64 = (1 << 64) - 1


def bands_for(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which so many bands as the recall takes need max_hashes at most."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def ngram_set(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the n-grams of words."""
    words = text.split()
    if not words:
        return np.zeros(0, "u8")
    prefixes = Prefixes(" ".join(words))
    sizes = np.fromiter(map(len, words), "i8", len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(n, len(words))
    h = prefixes.between(starts[: len(words) - k + 1], ends[k - 1 :])
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return np.unique(h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16))


def _constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return rng.integers(1, _M64, count, "u8", endpoint=True) | np.uint64(1), rng.integers(0, _M64, count, "u8", endpoint=True)


def band_hashes(ngrams: np.ndarray, bands: int, rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(bands * rows, np.iinfo("u4").max, "u4")
    for i in range(0, len(ngrams), 2048):
        h = ngrams[i : i + 2048, None] * a
        h += b
        np.minimum(low, (h >> np.uint64(32)).astype("u4").min(axis=0), out=low)
    x = np.arange(bands, dtype="u8") * np.uint64(0xA0761D6478BD642F)
    for v in low.reshape(bands, rows).T.astype("u8"):
        x = (x ^ v) * np.uint64(0xE7037ED1A0B428DB)
        x ^= x >> np.uint64(29)
    return x.astype("i8")


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """node (md5 of the text), doc_id, bands. Staged: the band hashes are far smaller than the texts."""
    a, b = _constants(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, doc_ids, texts = columns(batch, "node", "doc_id", "text")
            found = []
            for text in texts:
                ngrams = ngram_set(text, n)
                found.append(band_hashes(ngrams, bands, rows, a, b) if len(ngrams) else None)
            yield pa.record_batch([pa.array(node, pa.binary()), pa.array(doc_ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "doc_id", "bands"])

    return stage(_nodes(docs).mapInArrow(run, "node binary, doc_id long, bands array<long>"), "signatures")


def _nodes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.unhex(F.md5(text)).alias("node"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))


def candidates(reps: DataFrame) -> DataFrame:
    """node and its bands, as (band, how many nodes it has), smallest first; bands of one node are left out,
    and of bands with the same nodes all but one."""
    members = reps.where("bands is not null").select("node", F.explode("bands").alias("band"))
    groups = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.hash("node").cast("long")).alias("y")).where("n > 1")
    kept = groups.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n")
    return members.join(kept, "band").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("band", "n"))).alias("places"))


def linked_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets are alike, as a matrix, without the diagonal."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], "f8")
    if m == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2, "f8")
        common = np.maximum(common, common.T)
    else:
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(m), [len(s) for s in sets])
        shared = np.bincount(column, minlength=len(values)) > 1
        keep = shared[column]
        place = np.cumsum(shared) - 1
        row, column = row[keep], place[column[keep]]
        common = np.zeros((m, m))
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        step = max(256, (4 << 20) // m)
        for low in range(0, int(shared.sum()), step):
            i, j = np.searchsorted(column, [low, low + step])
            x = np.zeros((m, step), "f4")
            x[row[i:j], column[i:j] - low] = 1
            common += x @ x.T
    alike = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(alike, False)
    return alike


def _roots(alike: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component."""
    label = np.arange(len(alike))
    while True:
        low = np.minimum(label, np.where(alike, label[None, :], len(alike)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verify(group: list[tuple], band: int, one: int, two: int, threshold: float) -> list[tuple]:
    """group: (node, weight, places, block, set bytes, rep). Gives (node, rep, links, root, root's rep)."""
    group = list({g[0]: g for g in sorted(group, key=lambda g: g[0])}.values())
    if len(group) < 2:
        return []
    sets = [np.frombuffer(g[4], "u1").reshape(-1, 6) for g in group]
    wide = []
    for s in sets:
        full = np.zeros((len(s), 8), "u1")
        full[:, :6] = s
        wide.append(full.reshape(-1).view("<u8"))
    alike = linked_pairs(wide, threshold)
    if one != two:  # pairs within a block have a task of their own
        block = np.array([g[3] for g in group])
        alike &= block[:, None] != block[None, :]
    if not alike.any():
        return []
    earlier = sorted({p for g in group for p in g[2] if p < band})
    if earlier:  # the pair belongs to the first band that the two share
        at = {p: k for k, p in enumerate(earlier)}
        has = np.zeros((len(group), len(earlier)), "f4")
        for i, g in enumerate(group):
            has[i, [at[p] for p in g[2] if p in at]] = 1
        alike &= ~((has @ has.T) > 0)
    links = alike @ np.array([g[1] for g in group], "i8")
    roots = _roots(alike)
    return [(g[0], g[5], int(links[i]), group[roots[i]][0], group[roots[i]][5]) for i, g in enumerate(group) if links[i]]


def links(docs: DataFrame, reps: DataFrame, places: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """Verified links: node, rep, links (weight of the nodes it is linked to in one task), root, root_rep."""
    wanted = places.join(reps.select("node", "rep", "weight"), "node")
    ranked = _nodes(docs).withColumn("rep", F.coalesce("doc_id", F.lit(LONG_MAX))).drop("doc_id")
    texts = ranked.join(wanted, ["node", "rep"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            names = ["node", "weight", "places", "band", "one", "two", "block", "ngrams", "rep"]
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
            for node, weight, found, text, rep in zip(*columns(batch, "node", "weight", "places", "text", "rep"), strict=True):
                ngrams = ngram_set(text, n)
                packed = np.ascontiguousarray(ngrams.astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes()
                bands = [p["band"] for p in found]
                for p in found:
                    blocks = -(-p["n"] // block)
                    mine = int.from_bytes(node[:8], "big") % blocks
                    for other in range(blocks):
                        rows.append((node, weight, bands, p["band"], min(mine, other), max(mine, other), mine, packed, rep))
                        size += len(packed)
                        if size > 16 << 20:
                            yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(9)], names=names)
                            rows, size = [], 0
            yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(9)], names=names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, out = [], None, []

        def give() -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            return pa.record_batch([pa.array([r[k] for r in out], kinds[k]) for k in range(5)], names=["node", "rep", "links", "root", "root_rep"])

        for batch in batches:
            for band, one, two, *rest in zip(*columns(batch, "band", "one", "two", "node", "weight", "places", "block", "ngrams", "rep"), strict=True):
                if (band, one, two) != key:
                    if key:
                        out += _verify(group, *key, threshold)
                    group, key = [], (band, one, two)
                group.append(tuple(rest))
            yield give()
            out = []
        if key:
            out += _verify(group, *key, threshold)
        yield give()

    spread = texts.select("node", "weight", "places", "text", "rep").mapInArrow(sets, "node binary, weight long, places array<long>, band long, one int, two int, block int, ngrams binary, rep long")
    dealt = spread.repartition(partitions(docs), "band", "one", "two").sortWithinPartitions("band", "one", "two")
    return stage(dealt.mapInArrow(verify, "node binary, rep long, links long, root binary, root_rep long"), "links")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, block: int = BLOCK) -> DataFrame:
    """node, doc_id, root (the smallest node of its class), copy_of (smallest doc_id with an equal text), class_id (smallest doc_id of all that links
    lead to) and n_links (documents that are alike, copies included) for each row."""
    small_batches(docs.sparkSession, 500)
    bands, rows = bands_for(threshold, recall, max_hashes)
    found = signatures(docs, n, bands, rows)
    reps = stage(found.groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(LONG_MAX)).alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands")), "reps")
    verified = links(docs, reps, candidates(reps), n, threshold, block)
    end = lambda rep, node: F.struct(F.col(rep).alias("rep"), F.col(node).alias("node"))  # noqa: E731  smallest id first, so a root holds its class's id
    roots = components(verified.select(end("rep", "node").alias("a"), end("root_rep", "root").alias("b"))).select("node.node", "root")
    rooted = reps.drop("bands").join(roots, "node", "left").join(verified.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    root = F.coalesce("root", end("rep", "node"))
    known = rooted.select("node", root["node"].alias("root"), F.nullif("rep", F.lit(LONG_MAX)).alias("copy_of"), F.nullif(root["rep"], F.lit(LONG_MAX)).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # written first, so that both sides are exchanges and the rows of a text with very many copies can be split
    return found.select("node", "doc_id").join(stage(known, "known"), "node")


def keep_first(docs: DataFrame, **parameters) -> DataFrame:
    """docs, all columns, with one row of each class: that with the smallest doc_id, null last, and of
    rows with the same one that with the smallest node; of rows equal in doc_id and text any one."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LONG_MAX)).alias("_doc"), F.col("node").alias("_node"))).alias("first")
    one = join(docs, **parameters).groupBy("root").agg(first).select("first._doc", "first._node")
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.unhex(F.md5(text)).alias("_node"), F.coalesce(docs["doc_id"].cast("long"), F.lit(LONG_MAX)).alias("_doc"))
    return keyed.join(one, ["_doc", "_node"], "left_semi").dropDuplicates(["_doc", "_node"]).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_of")
