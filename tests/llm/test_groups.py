"""Operators 4 and 6 and the pipeline against brute force."""

from __future__ import annotations

import base64
import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from emberline.llm import exact, ngram_join, packing, secret_scan, warc
from emberline.llm.common import scratch
from emberline.llm.components import components

from .conftest import nasty_rows
from .test_texts import brute_quality, brute_repeats, brute_without, by_id


def shingles(text: str, n: int = 5) -> set:
    w = text.split()
    return {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()


def brute_classes(rows):
    """row number -> (smallest row number of the class in order of doc_id, links)."""
    sets = [shingles(r["text"] or "") for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (rows[i]["text"] or "") == (rows[j]["text"] or "")
            if same or (a and b and len(a & b) >= 0.8 * len(a | b)):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], links


def test_ngram_join(nasty, empty):
    rows = nasty.collect()
    roots, links = brute_classes(rows)
    lowest = defaultdict(list)
    for r, root in zip(rows, roots, strict=True):
        lowest[root].append(r["doc_id"])
    want = [(r["doc_id"], min((d for d in lowest[root] if d is not None), default=None), n) for r, root, n in zip(rows, roots, links, strict=True)]
    got = ngram_join.join(nasty, block=2).collect()
    assert by_id([(r["doc_id"], r["class_id"], r["n_links"]) for r in got]) == by_id(want) and max(links) > 2
    kept = ngram_join.keep_first(nasty)
    assert kept.columns == nasty.columns and kept.count() == len(set(roots))
    assert ngram_join.join(empty).count() == 0 and ngram_join.keep_first(empty).count() == 0


def test_ngram_join_over_many_near_copies(spark):
    """One group larger than several blocks, with pairs on either side of the threshold."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    roots, links = brute_classes(docs.collect())
    got = {r["doc_id"]: r for r in ngram_join.join(docs, block=8).collect()}
    order = [r["doc_id"] for r in docs.collect()]
    assert [got[d]["n_links"] for d in order] == links
    by_root = defaultdict(set)
    for d, root in zip(order, roots, strict=True):
        by_root[root].add(d)
    assert {frozenset(v) for v in by_root.values()} == {frozenset(d for d in got if got[d]["class_id"] == c) for c in {r["class_id"] for r in got.values()}}


def test_bands():
    bands, rows = ngram_join.bands_for(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.1, 0.9999, 4)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(1, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


PAGES = [
    (5, "http://www.b.example.com:8080/x?q=1#f", "<p>one</p>"), (3, "https://a.example.org/", "<p>one</p>"), (9, "HTTP://A.example.org/Y", "<p>one</p>"), (1, None, None), (2, "", ""), (7, "not a url", "<p>two é 中</p>" * 500),
    (7, "not a url", "<p>two é 中</p>" * 500), (None, "http://[bad", "<p>one</p>"), (11, "http://c.example/\n x", "z"), (12, "http://c.example/", "\ud83d".encode("utf-16-le", "surrogatepass").decode("utf-16-le", "ignore") + "y"),
]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, 1, "k") for p in PAGES], "page_id long, url string, html string, first long, key string").repartition(3)
    folder, catalogue, captures = warc.archive(pages, scratch(spark, "warc_test"))
    requests = captures.groupBy("key").count().withColumnRenamed("count", "n")
    rows = warc.read_back(requests, folder, catalogue).collect()
    lowest = {}
    for p, _, h in PAGES:
        if p is not None:
            lowest[h or ""] = min(p, lowest.get(h or "", p))
    want = []
    for p, _, h in PAGES:
        payload = (h or "").encode()
        first = lowest.get(h or "")
        revisit = first is not None and p != first
        want.append((p, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert by_id([tuple(r)[:5] for r in rows]) == by_id(want)
    none = pages.limit(0)
    folder, catalogue, captures = warc.archive(none, scratch(spark, "warc_none"))
    assert catalogue == [] and captures.count() == 0


def test_capture_index_blocks(spark):
    """Every key is found, also those that fill more than a block; absent ones aren't."""
    rows = [(f"key{k // 3:04d}", "part", k, 1, "D", "response") for k in range(900)] + [("same", "part", k, 1, "D", "response") for k in range(25)]
    captures = spark.createDataFrame(rows, warc.CAPTURES).repartition(5)
    folder = scratch(spark, "index_test")
    index = warc.CaptureIndex(folder, warc.write_index(captures, folder, block_lines=7))
    for k in range(300):
        assert sorted(c[2] for c in index.find(f"key{k:04d}")) == [3 * k, 3 * k + 1, 3 * k + 2]
    assert len(index.find("same")) == 25 and index.find("key0300") == [] and index.find("") == [] and index.find("zzz") == []


def test_reversed_host():
    assert warc.reversed_host("https://www.B.Example.com:8443/P?q=1#f") == "com,example,b:8443)/P?q=1"
    assert warc.reversed_host("http://example.com") == "com,example)/" and warc.reversed_host("plain") == "plain"


def test_pipeline(spark, nasty, labels, byte_bpe, tmp_path):
    """Every stage against its brute-force version on what the stage before it kept."""
    nasty.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "secrets", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    texts = lambda df: by_id([(r["doc_id"], r["text"]) for r in df.collect()])
    kept = stages[0](spark, docs, str(tmp_path)).cache()
    verdicts = brute_quality(docs.collect(), [tuple(r) for r in labels.collect()])
    assert by_id([(r["doc_id"],) for r in kept.collect()]) == by_id([(v[0],) for v in verdicts if v[7]])
    once = stages[1](spark, kept, str(tmp_path)).cache()
    rows = kept.collect()
    roots, _ = brute_classes(rows)
    first = {}
    for r, root in zip(rows, roots, strict=True):
        first[root] = min(first.get(root, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in once.collect()) == sorted(first.values())
    cut = stages[2](spark, once, str(tmp_path)).cache()
    spans = brute_repeats(once.collect())
    assert texts(cut) == by_id([(r["doc_id"], brute_without(r["text"], spans[r["doc_id"] is None, r["doc_id"] or 0, r["text"]])) for r in once.collect()])
    safe = stages[3](spark, cut, str(tmp_path)).cache()
    assert texts(safe) == by_id([(r["doc_id"], secret_scan.redact_text(r["text"], "[SECRET]")) for r in cut.collect()])
    assert all(df.columns == docs.columns for df in (kept, once, cut, safe))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    want = packing.token_pieces(safe, byte_bpe).collect()
    assert by_id([tuple(r) for r in got]) == by_id([tuple(r) for r in want])
    assert np.sum([r["length"] for r in got]) == np.sum([r["length"] for r in want])


@pytest.mark.parametrize("name", sorted(exact.ORACLE_SQL) + ["op9_substring_dedup"])
def test_fixed_rules_equal_sql(spark, name, tmp_path):
    """On a small table with what the driver's tables hold, and on those where they are there."""
    import duckdb

    from emberline import llm

    folders = ["/root/testdata/sf0.001"] if os.path.isdir("/root/testdata/sf0.001") else []
    rows = [(k, r[1]) for k, r in enumerate(r for r in nasty_rows() if "\xa0" not in (r[1] or "") and "\x85" not in (r[1] or ""))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"http://h{k % 3}.example/{k}", f"<p>{k % 4}</p>" if k else None) for k in range(12)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for folder in [str(tmp_path), *folders]:
        con = duckdb.connect()
        for t in ("documents", "pages", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder == str(tmp_path) else ''}')")
        want = con.sql(llm.oracle_sql()[name])
        got = llm.queries()[name](spark, folder).select(*want.columns)
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_recall_on_a_table(spark):
    """Every link of the smallest table, by brute force over full sets of five words."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    sets = [shingles(r["text"] or "") for r in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for gram in s:
            holders[gram].append(k)
    shared = defaultdict(int)
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                shared[a, b] += 1
    links = [0] * len(rows)
    pairs = {(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    empty = [k for k, s in enumerate(sets) if not s]
    pairs |= {(a, b) for a in empty for b in empty if a < b and (rows[a]["text"] or "") == (rows[b]["text"] or "")}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.op6_ngram_jaccard_join(spark, folder).collect()}
    assert [got[r["doc_id"]] for r in rows] == links and len(pairs) > 100
