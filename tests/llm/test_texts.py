"""Operators 1, 2, 7, 9 and 10 against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from emberline.llm import fingerprints, quality, secret_scan, substring_dedup, toxicity

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) if not isinstance(x, float) else (False, x) for x in r))


# --- 1 ---


def test_secret_base_rules(nasty, empty):
    want = []
    for r in nasty.collect():
        t = r["text"] or ""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        want.append((r["doc_id"], *[sum(f[1] == k for f in found) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest()))
    got = secret_scan.scan(nasty).collect()
    assert by_id([tuple(r)[:5] for r in got]) == by_id(want)
    added = [r["spans"] for r in got if r["n_guess"]]
    assert len(added) == 2 and all("guess:" in s for s in added)
    assert secret_scan.scan(empty).count() == 0


def test_guess_cost():
    """The dynamic programme equals the minimum over all segmentations."""

    def brute(value: str) -> float:
        low, n = value.lower(), len(value)
        best = math.inf
        stack = [(0, 0.0)]
        while stack:
            at, cost = stack.pop()
            if at == n:
                best = min(best, cost)
                continue
            c = value[at]
            unit = lambda c: 1.0 if c.isdigit() else math.log10(26) if c.islower() or c.isupper() else math.log10(33)
            stack.append((at + 1, cost + unit(c)))
            for e in range(at + 1, n + 1):
                part = value[at:e]
                if low[at:e] in secret_scan.WORDS:
                    stack.append((e, cost + math.log10(secret_scan.WORDS.index(low[at:e]) + 2) + 0.3 + (0 if part == low[at:e] else 0.6)))
                if e - at >= 3 and len(set(part)) == 1 and (at == 0 or value[at - 1] != c):
                    stack.append((e, cost + unit(c) + math.log10(e - at) + 0.3))
                if e - at >= 4 and all(low[i : i + 2] in secret_scan._walks for i in range(at, e - 1)) and (at == 0 or low[at - 1 : at + 1] not in secret_scan._walks):
                    stack.append((e, cost + math.log10(94) + math.log10(e - at) + 0.6))
                if c.isdigit() and (m := secret_scan.DATE.match(value, at)) and m.end() == e:
                    stack.append((e, cost + math.log10(365 * 119) + 0.3))
        return best

    for value in ("password1", "Dragon99", "aaaaaa!!", "qwerty12", "x19991231y", "1999-01-02", "zZ3", "testtest", "", "10.10.2010a"):
        assert secret_scan.guess_log10(value) == pytest.approx(brute(value) if value else 0.0)
    assert secret_scan.guess_log10("password") < secret_scan.guess_log10("qwertyui") < secret_scan.guess_log10("xk29vq7z")


def test_redact(nasty, empty):
    rows = secret_scan.redact(nasty).collect()
    assert secret_scan.redact(nasty).columns == nasty.columns and len(rows) == nasty.count()
    for r in rows:
        assert r["text"] is None or not secret_scan.base_spans(r["text"]) or "[SECRET]" in r["text"]
        assert r["_row"] == "r" and r["clean"] == "c"
    assert any("[SECRET]" in (r["text"] or "") and r["n_chars"] == len(r["text"]) for r in rows)
    assert secret_scan.redact(empty).count() == 0


@pytest.mark.parametrize("text", ["pwd: kqzvxwplmtrbnydf", "pwd: zqxjkvbpwmfyg", "db pass: correcthorsebatterystaple", "auth = 4829157301648829", "Bearer qmzkvjxwplhtrbnydfgc", "auth: https://user:password@host", "pwd: ${kqzvxwplmtrbnydf"])
def test_cost_alone_decides(text):
    _, added = secret_scan.scan_text(text)
    assert [text[s:e] for s, _, e, _ in added] == [text.split()[-1]]


@pytest.mark.parametrize("text", ["password is required.", "The token is well-known.", "secret is preparation.", "The password is incorrect!"])
def test_prose_is_no_secret(text):
    assert secret_scan.redact_text(text, "[SECRET]") == text


def test_trailing_punctuation_stays():
    assert secret_scan.redact_text("The passcode is Xk29-lemmaQ/77. Next", "[SECRET]") == "The passcode is [SECRET]. Next"


# --- 2 ---


def test_fingerprints(nasty, empty):
    order = sorted(nasty.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").encode()))
    texts = [r["text"] or "" for r in order]
    want = []
    for k, t in enumerate(texts):
        changed = fingerprints.edited(t, texts[(k + 1) % len(texts)])
        want.append((order[k]["doc_id"], len(t), hashlib.sha256(changed.encode()).hexdigest()))
    rows = fingerprints.fingerprints(nasty, parts=3).collect()
    assert by_id([tuple(r)[:3] for r in rows]) == by_id(want)
    by_text = defaultdict(set)
    for r, t in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"])), sorted(order, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, len(r["text"] or ""))), strict=True):
        by_text[t["text"] or ""].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)
    assert fingerprints.fingerprints(empty).count() == 0


def test_one_document_is_its_own_next(spark):
    row = fingerprints.fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcdabcd").hexdigest()


def test_prefix_hashes():
    a, b = "xxabcdefabcxx", "yabcdefabcy"
    p, q = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for i in range(len(a) + 1):
        for j in range(i, len(a) + 1):
            for k in range(len(b) - (j - i) + 1):
                assert (p.span(i, j) == q.span(k, k + j - i)) == (a[i:j] == b[k : k + j - i])
    assert fingerprints.common_extension(p, q, 2, 1) == 9 and fingerprints.common_extension(p, q) == 0
    starts, ends = np.array([2, 8]), np.array([5, 11])
    one, two = p.between(starts, ends)
    assert one == two == q.between(np.array([1]), np.array([4]))[0]


def test_likeness_follows_jaccard():
    rng = np.random.default_rng(3)
    letters = "".join(map(chr, rng.integers(97, 123, 6000)))
    a, b = letters[:4000], letters[2000:]
    f = lambda t: {t[i : i + fingerprints.SPAN] for i in range(len(t) - fingerprints.SPAN + 1)}
    true = len(f(a) & f(b)) / len(f(a) | f(b))
    assert abs(fingerprints.likeness(fingerprints.Fingerprint(a), fingerprints.Fingerprint(b)) - true) < 0.2


# --- 9 ---


def brute_units(text: str):
    """(start, end, words) of paragraphs, lines, sentences of six words and joined shorter ones, word by word."""
    blocks, block = [], []
    at = 0
    for line in text.split("\n"):
        words = [(at + m.start(), at + m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        at += len(line) + 1
        if words:
            block.append(words)
        elif block:
            blocks.append(block)
            block = []
    blocks += [block] if block else []
    out = set()

    def add(words):
        out.add((words[0][0], words[-1][1], tuple(w for _, _, w in words)))

    told = lambda words: any(re.search(r"[A-Za-z0-9]|[^\x00-\x7f]", text[s:e]) for s, e, _ in words)
    for block in blocks:
        for words in [*block, [w for line in block for w in line]]:
            if told(words):
                add(words)
        for line in block:
            sentences = [[]]
            for w in line:
                sentences[-1].append(w)
                if text[w[1] - 1] in ".!?":
                    sentences.append([])
            sentences = [x for x in sentences if x]
            for k, x in enumerate(sentences):
                ahead, back = list(x), list(x)
                for y in sentences[k + 1 :]:
                    if len(ahead) < 6:
                        ahead += y
                for y in reversed(sentences[:k]):
                    if len(back) < 6:
                        back = y + back
                for words in (ahead, back):
                    if len(words) >= 6:
                        add(words)
    return sorted(out)


def brute_repeats(rows):
    """The merged spans to remove of each (null id, id, text), by looking at each unit and each run of sixteen words."""
    order = sorted({(r["doc_id"] is None, r["doc_id"] or 0, int(np.int64(np.uint64(xxhash.xxh64_intdigest((r["text"] or "").encode(), 42)))), r["text"] or "") for r in rows})
    first, found = {}, defaultdict(list)
    for doc in order:
        text = doc[3]
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        runs = [(words[k][0], words[k + 15][1], tuple(w for _, _, w in words[k : k + 16])) for k in range(len(words) - 15)]
        for kind, units in (("unit", brute_units(text)), ("run", runs)):
            for s, e, same in units:
                where, end = first.setdefault((kind, same), ((doc, s), e))
                if where != (doc, s):
                    s = max(s, end) if where[0] == doc else s
                    if s < e:
                        found[doc[0], doc[1], text].append((s, e))
    spans = defaultdict(list)
    for key, each in found.items():
        for s, e in sorted(each):
            if spans[key] and s <= spans[key][-1][1]:
                spans[key][-1] = spans[key][-1][0], max(e, spans[key][-1][1])
            else:
                spans[key].append((s, e))
    return spans


def brute_without(text: str, spans) -> str:
    """Blanks after a span go with it, and the line's end if nothing else is on the line."""
    gone = set()
    for s, e in spans:
        gone.update(range(s, e))
        while e < len(text) and text[e] in " \t":
            gone.add(e)
            e += 1
        if (s == 0 or text[s - 1] == "\n") and text[e : e + 1] == "\n":
            gone.add(e)
    return "".join(c for k, c in enumerate(text) if k not in gone)


def test_substring_dedup(nasty, empty):
    spans = brute_repeats(nasty.collect())
    want = [(r["doc_id"], len(r["text"] or ""), ",".join(f"{s}:{e}" for s, e in spans[r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""])) for r in nasty.collect()]
    got = substring_dedup.removed(nasty).collect()
    assert by_id([(r["doc_id"], r["n_chars"], r["removed"]) for r in got]) == by_id(want) and any(w[2] for w in want)
    clean = substring_dedup.dedup(nasty)
    assert clean.columns == nasty.columns and clean.dtypes == nasty.dtypes
    rows = clean.collect()
    texts = [(r["doc_id"], None if r["text"] is None else brute_without(r["text"], spans[r["doc_id"] is None, r["doc_id"] or 0, r["text"]])) for r in nasty.collect()]
    assert by_id([(r["doc_id"], r["text"]) for r in rows]) == by_id(texts)
    assert all(r["_row"] == "r" and r["_text"] == 1 for r in rows)
    assert substring_dedup.removed(empty).count() == 0 and substring_dedup.dedup(empty).count() == 0


def test_without_keeps_lines():
    text = "One two.  Three four.\nFive six.\nSeven."
    assert substring_dedup.without(text, [(10, 21)]) == "One two.  \nFive six.\nSeven."
    assert substring_dedup.without(text, [(22, 31)]) == "One two.  Three four.\nSeven."
    assert substring_dedup.without(text, [(0, 8), (10, 21)]) == "\nFive six.\nSeven."


def test_repeated_lines_and_paragraphs_go_whole(spark):
    lines = ["Yes. No. See e.g. 3.14 and v1.2 at https://a.example/x.y today.", "Short line", "---"]
    rows = [(k, f"Number {k} alone\n\n" + "\n".join(lines) + f"\n\nEnd {k} here") for k in range(2)]
    rows += [(7, "one two\n  three FOUR  \n\nmore"), (8, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.removed(docs).collect()}
    passage = "\n".join(lines)
    start = rows[1][1].index(passage)
    assert got[0]["removed"] == got[7]["removed"] == ""
    assert got[1]["removed"] == f"{start}:{start + len(passage)}" and got[1]["removed_chars"] == len(passage)
    assert got[8]["removed"] == "0:18"
    clean = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(docs).collect()}
    assert all(x not in clean[1] for x in lines) and clean[0] == rows[0][1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab.!?\n \té", max_size=60), min_size=1, max_size=4))
def test_units_and_word_places(texts):
    words = substring_dedup.Words([t.encode() for t in texts])
    i, j = words.units(6)
    got = sorted((int(words.doc[a]), int(words.start[a]), int(words.end[b - 1])) for a, b in zip(i, j, strict=True))
    assert got == sorted((k, s, e) for k, t in enumerate(texts) for s, e, _ in brute_units(t))


def test_query_returns_offsets_and_text(spark, tmp_path):
    line = "one line that two texts have word for word"
    spark.createDataFrame([(4, f"{line}\nand more", 1), (2, line, 1), (None, line, 1), (9, None, 1)], "doc_id long, text string, removed int").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id([tuple(r) for r in substring_dedup.op9_substring_dedup(spark, str(tmp_path)).collect()])
    n = len(line)
    assert got == by_id([(2, "", line), (4, f"0:{n}", "and more"), (9, "", None), (None, f"0:{n}", "")])


def test_passages_in_foreign_lines_go_whole(spark):
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    long, short = words(60), ". ".join(words(2) for _ in range(5)) + "."
    texts = [f"{words(20)} {long} {words(20)}", f"{words(9)} {long} {words(9)}.", f"{words(9)}. {short} {words(9)}", f"{words(7)}. {short} {words(8)}", "the " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(docs).collect()}
    assert clean[0] == texts[0] and clean[2] == texts[2]
    assert not set(long.split()) & set(clean[1].split()) and len(clean[1].split()) == 18
    assert short not in clean[3] and len(clean[3].split()) == 15
    assert substring_dedup.WINDOW <= len(clean[4].split()) < 30


# --- 10 ---


def brute_quality(rows, labels):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(words):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
        pairs = [signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), signed_seed(xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)))) for a, b in zip(h, h[1:], strict=False)]
        return [x % quality.BUCKETS for x in h + pairs]

    def signed_seed(x):
        return x

    trusted = {d for d, q, _ in labels if q == 1 and d is not None}
    raw, target = Counter(), Counter()
    for r in rows:
        g = grams(split(r["text"] or ""))
        raw.update(g)
        if r["doc_id"] in trusted:
            target.update(g)
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    ratio = lambda b: math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n)
    out = []
    for r in rows:
        t = r["text"] or ""
        w = split(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c = Counter(windows)
        covered = {k for i, x in enumerate(windows) if c[x] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if split(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        g = grams(w)
        out.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, sum(map(ratio, g)) / max(len(g), 1) if w else None))
    good = [x[7] for x in out if x[0] in trusted and not x[6]]
    threshold = float(np.quantile(good, quality.LOST)) if good else None
    return [(*x[:7], not x[6] and (threshold is None or x[7] >= threshold - 1e-12)) for x in out]


def test_quality(nasty, empty, labels):
    want = brute_quality(nasty.collect(), [tuple(r) for r in labels.collect()])
    judged = quality.judge(nasty, labels)
    got = [(r["_row"]["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]) for r in judged.collect()]
    assert by_id(got) == by_id(want)
    kept = quality.keep(nasty, labels)
    assert kept.columns == nasty.columns and by_id([(r["doc_id"],) for r in kept.collect()]) == by_id([(x[0],) for x in want if x[7]])
    assert quality.keep(empty, labels).count() == 0
    assert quality.keep(nasty, labels.limit(0)).count() == sum(not x[6] for x in want)
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()


def test_every_trusted_document_counts(spark):
    docs = spark.range(20_300).selectExpr("id AS _doc", "concat('a', id % 7, ' b') AS _text")
    trusted = quality.trusted_ids(docs.selectExpr("_doc AS doc_id", "1 AS quality"))
    assert all(r == t for r, t in quality.bucket_counts(docs, trusted))


def test_pipeline_trusts_all_labels(spark, nasty, tmp_path, monkeypatch):
    spark.range(20_300).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    seen, counts = [], quality.bucket_counts
    monkeypatch.setattr(quality, "bucket_counts", lambda rows, trusted: seen.append(trusted.count()) or counts(rows, trusted))
    corpus_pipeline.quality_rules(spark, nasty, str(tmp_path))
    assert seen == [20_300]


@pytest.mark.parametrize("n", [0, 1, 2, 333, 334, 335, 1500])
def test_threshold_is_the_exact_quantile(spark, n):
    values = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "llr double")
    want = float(np.quantile(values, quality.LOST)) if n else None
    assert quality.quantile(rows, quality.LOST) == (pytest.approx(want, abs=1e-12) if n else None)


# --- 7 ---


def some_tagger(seed: int = 1) -> toxicity.Tagger:
    rng = np.random.default_rng(seed)
    tagger = toxicity.Tagger({"vile": 0, "grumb*": 1, "*mbler": 2})
    tagger.emit, tagger.rest, tagger.trans = rng.normal(size=9), -1.3, rng.normal(size=(2, 2))
    return tagger


def brute_features(tagger, words) -> list[tuple[int, ...]]:
    """Features of every token, looked up one by one."""
    own = []
    for w in words:
        low = w.lower()
        marks = [low, *[low[:k] + "*" for k in (5, 6, 7) if len(low) > k], *["*" + low[-k:] for k in (5, 6, 7) if len(low) > k]]
        own.append([tagger.lexicon[f] for f in marks if f in tagger.lexicon])
    out = []
    for i, w in enumerate(words):
        before, after = i > 0 and bool(own[i - 1]), i + 1 < len(words) and bool(own[i + 1])
        x = list(own[i])
        if own[i]:
            x.append(toxicity.LEXICAL)
            x += [toxicity.UPPER] if len(w) > 1 and w.isupper() else [toxicity.CAPITAL] if w[0].isupper() else []
        elif before or after:
            x.append(toxicity.BESIDE)
        out.append(tuple(x + [toxicity.BEFORE] * before + [toxicity.AFTER] * after))
    return out


def brute_marginals(tagger, words) -> np.ndarray:
    """Forward and backward, token by token, in logarithms."""
    local = np.array([[0.0, sum(tagger.emit[i] for i in x) if x else tagger.rest] for x in brute_features(tagger, words)])
    forward, backward = local.copy(), np.zeros_like(local)
    for t in range(1, len(words)):
        forward[t] += np.logaddexp(*(forward[t - 1][:, None] + tagger.trans))
    for t in range(len(words) - 2, -1, -1):
        backward[t] = np.logaddexp(*(tagger.trans + local[t + 1] + backward[t + 1]).T)
    both = forward + backward
    return 1 / (1 + np.exp(both[:, 0] - both[:, 1]))


@pytest.mark.parametrize("text", ["so vile a day and Grumbling VILE it is", "a b c", "vile", "a b vile c d e f g h i Fumbler", "vile vile a", "x " * 700 + "grumbler " + "y " * 900])
def test_marginals(text):
    """Against enumeration of all labellings where the text is short, and token by token where it is long."""
    tagger, words = some_tagger(), text.split()
    want = brute_marginals(tagger, words)
    if len(words) < 12:
        scores = [tagger.score(x) for x in brute_features(tagger, words)]
        total, on = 0.0, np.zeros(len(words))
        for bits in range(1 << len(words)):
            y = [bits >> k & 1 for k in range(len(words))]
            p = math.exp(sum(s for s, v in zip(scores, y, strict=True) if v) + sum(tagger.trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            on += p * np.array(y)
        assert np.allclose(want, on / total)
    active = tagger.active(words)
    assert active == [(i, x) for i, x in enumerate(brute_features(tagger, words)) if x]
    got, total = tagger.marginals(len(words), active)
    assert np.allclose(got, want[[i for i, _ in active]]) and total == pytest.approx(want.sum())


def test_training_raises_the_likelihood():
    tagger = toxicity.Tagger({"bad": 0, "fine": 1})
    tagger.train([([(), (0,), ()], [0, 1, 0]), ([(), (1,), (0,)], [0, 0, 1]), ([(), (), (1,), ()], [0, 0, 0, 0])] * 20)
    assert tagger.emit[0] > tagger.emit[1]
    tagger.train([([(0,), ()], [1, 1]), ([(), ()], [0, 0])] * 20)
    assert tagger.trans[1, 1] > tagger.trans[1, 0] and tagger.trans[0, 0] > tagger.trans[0, 1]


def test_windows_hold_every_lexicon_token():
    tagger = some_tagger()
    words = (["a"] * 9 + ["vile", "x", "vile"]) * 30 + ["vile"] * 200 + ["b"] * 20
    made = list(toxicity.labelled(tagger, words, 1))
    assert sum(0 in x for xs, _ in made for x in xs) == words.count("vile") and all(len(xs) <= toxicity.PIECE for xs, _ in made)
    assert sum(y for _, ys in made for y in ys) == words.count("vile") + 30  # and the tokens between two
    assert all(y == 0 for _, ys in toxicity.labelled(tagger, words, 0) for y in ys)


def test_offsets_are_of_the_text_itself(spark):
    """Lower case of a dotted capital I has another length."""
    texts = ["İİİ vile grumbler", "İ" * 9 + " a b Vile", "", None, "vile", "ß grumbler\nİvile vile"]
    tagger = some_tagger()
    tagger.emit[:3], tagger.emit[3:], tagger.trans = 12.0, -2.0, np.zeros((2, 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in toxicity.tag(docs, tagger).collect()}
    assert got[0] == "4:8,9:17"
    for k, text in enumerate(texts):
        found = list(re.finditer(r"\w+", text or ""))
        p = brute_marginals(tagger, [m[0] for m in found]) if found else []
        assert got[k] == ",".join(f"{m.start()}:{m.end()}" for m, x in zip(found, p, strict=True) if x >= toxicity.SPAN)


def test_toxicity_on_a_table(spark):
    """Held-out recall and precision on the smallest table with labels enough."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in toxicity.op7_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in toxic]
    right = sum(r["predicted"] and toxic[r["doc_id"]] for r in rows)
    assert right > 0.9 * sum(toxic[r["doc_id"]] for r in rows) and right > 0.9 * sum(r["predicted"] for r in rows)


def test_toxicity_on_held_out_rows(spark):
    rows, labels = [], []
    for k in range(400):
        toxic = k % 3 == 0
        rng = np.random.default_rng(k)
        rows.append((k, " ".join(f"w{x}" for x in rng.integers(0, 40, 30)) + (" you vile grumbler " if toxic else " you kind neighbour ") + "today"))
        labels.append((k, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "vile grumbler"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", toxicity.F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tagged = toxicity.tag(docs, toxicity.fit(docs, marks)).collect()
    assert len(tagged) == len(rows)
    for r in tagged:
        toxic = r["doc_id"] is None or r["doc_id"] < 1000 and r["doc_id"] % 3 == 0
        assert (r["score"] >= toxicity.PREDICTED) == toxic and bool(r["spans"]) == toxic
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert all(v == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) for k, v in flags.items())
    blank = toxicity.tag(docs, toxicity.fit(docs, marks.limit(0))).collect()
    assert all(r["score"] < 0.01 for r in blank)
    assert toxicity.tag(docs.limit(0), toxicity.fit(docs.limit(0), marks)).count() == 0
