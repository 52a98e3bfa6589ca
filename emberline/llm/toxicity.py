"""Operator 7: toxic spans by a linear-chain conditional random field, and document scores from them.

Labels say only whether a document is toxic, so tokens get labels first: over TRAIN_DOCS training
documents at most (smallest hash of the id first; of near copies one), words, their prefixes and suffixes
are counted by label. Those that nearly only toxic documents have, MIN_TOXIC of them, form the lexicon, and
affixes that nearly only toxic documents have in MIN_OFTEN words or more, MIN_BURSTS of them. In toxic documents tokens with a lexicon feature are
labelled 1, and so are up to BRIDGE tokens between two of them.

The field has two states, transitions, and weights for lexicon features, for the neighbours of such
tokens on either side, for capital letters, and one for any token far from them. It is trained by gradient
ascent on windows: the lexicon tokens with CONTEXT tokens around them, cut every PIECE tokens, WINDOWS of
them for each label at most (smallest hash first).

A text is scored whole. Between active tokens (with lexicon features, or beside one) the potentials are
equal, so the forward and backward recursions take such a run at once by a power of the same two-by-two
matrix, and the sum of the run's marginals by a power of a block of it: all are exactly those of the
token-by-token recursion. The document score is a logistic function of the sum of all marginals, the
largest one and the number of tokens. It is fitted on documents that neither the lexicon nor the field
has seen: for each of FOLDS parts of the training documents both are learnt from the other parts.
Spans are the tokens with a marginal of SPAN or more; offsets are code points of the text.

Only rows whose crc32 of doc_id as text modulo 4 isn't 2 are learnt from; scores read nothing but
text. Null and empty texts have the score of no token at all. With no labels of one kind, every
score is the share of toxic labels, or 0 without any. A null doc_id isn't held out. Repeated rows
get equal results, and of equal training texts one is learnt from. A very long text is one task's; what is
held of it are its words and its active tokens. An empty table gives no row. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import small_batches, stage, table
from emberline.llm.ngram_join import ngram_set
from emberline.llm.tokens import columns

TRAIN_DOCS, LEXICON = 20_000, 4000
WINDOWS = 6000  # training windows of each label at most
AFFIXES = (5, 6, 7)
MIN_TOXIC, MIN_OFTEN, MIN_BURSTS, MIN_LOG_ODDS = 5, 3, 2, 2.5
CONTEXT, PIECE, BRIDGE, FOLDS = 3, 48, 2, 3
SPAN, PREDICTED = 0.5, 0.3
CACHE = 500_000
MIX = np.uint64(0x5A3C96E1B7D2)
#: Features besides the lexicon's: a lexicon token at all, one before, one after, a neighbour that is none, and capitals.
LEXICAL, BEFORE, AFTER, BESIDE, UPPER, CAPITAL = range(-6, 0)
_word = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """A word in lower case, its prefixes and its suffixes."""
    return [word, *[f"{word[:k]}*" for k in AFFIXES if len(word) > k], *[f"*{word[-k:]}" for k in AFFIXES if len(word) > k]]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, toxic, text) of the sample that is learnt from, without near copies; its ids are broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, toxic, texts = columns(batch, "doc_id", "toxic", "text")
            keys = []
            for text in texts:
                ngrams = ngram_set(text)
                keys.append([int(x) for x in (ngrams[0], (ngrams ^ MIX).min())] if len(ngrams) else [-1, -1])
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=["doc_id", "toxic", "one", "two"])

    slim = rows.select("doc_id", "toxic", "text").mapInArrow(sketched, "doc_id long, toxic int, one long, two long")
    for key in ("one", "two"):  # of near copies, which share a smallest n-gram, one is learnt from
        slim = slim.groupBy(key, "toxic").agg(F.min(F.struct("doc_id", "one", "two")).alias("row")).select("row.*", "toxic")
    return rows.join(F.broadcast(stage(slim.select("doc_id"), "training")), "doc_id", "left_semi")


def fold() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")


def count_features(rows: DataFrame) -> DataFrame:
    """For each feature and fold: t and n, toxic and all documents that have it, and bt and bn, those with MIN_OFTEN words that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, marks, folds, often = [], [], [], []
            for toxic, k, text in zip(*columns(batch, "toxic", "fold", "text"), strict=True):
                found = Counter(f for w in set(map(str.lower, _word.findall(text))) for f in features(w))
                names += found
                often += [int(c >= MIN_OFTEN) for c in found.values()]
                marks += [toxic] * len(found)
                folds += [k] * len(found)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(marks, pa.int32()), pa.array(folds, pa.int32()), pa.array(often, pa.int32())], names=["feature", "toxic", "fold", "often"])

    each = rows.select("toxic", fold().alias("fold"), "text").mapInArrow(run, "feature string, toxic int, fold int, often int")
    by_fold = [f(F.when(F.col("fold") == k, F.expr(x))).alias(f"{n}{k}") for k in range(FOLDS) for f, x, n in ((F.sum, "toxic", "t"), (F.count, "1", "n"), (F.sum, "toxic * often", "bt"), (F.sum, "often", "bn"))]
    counted = each.groupBy("feature").agg(*by_fold, F.sum("toxic").alias("t"))
    return stage(counted.where(F.col("t") >= MIN_BURSTS).drop("t").na.fill(0), "features")


def learn_lexicon(counted: DataFrame, sizes: list[tuple[int, int]], without: int | None) -> dict[str, int]:
    """feature -> number, of those that mark toxic documents of all folds but one, LEXICON of them at most. sizes: toxic and
    clean documents of each fold."""
    folds = [k for k in range(FOLDS) if k != without]
    toxic, clean = (sum(sizes[k][i] for k in folds) for i in (0, 1))
    total = {c: sum((F.col(f"{c}{k}") for k in folds), F.lit(0)) for c in ("t", "n", "bt", "bn")}
    odds = lambda t, n: F.log((t + 0.5) / F.lit(toxic + 1.0)) - F.log((n - t + 0.5) / F.lit(clean + 1.0))
    summed = counted.select("feature", *[v.alias(c) for c, v in total.items()]).withColumn("odds", odds(F.col("t"), F.col("n"))).withColumn("burst", odds(F.col("bt"), F.col("bn")))
    summed = summed.withColumn("often", F.expr(f"bt >= {MIN_BURSTS} and burst >= {MIN_LOG_ODDS}")).where(f"often or t >= {MIN_TOXIC} and odds >= {MIN_LOG_ODDS}")
    best = summed.orderBy(F.greatest(F.col("odds") * F.col("t"), F.when(F.col("often"), F.col("burst") * F.col("bt"))).desc(), "feature").limit(LEXICON)
    return {r["feature"]: k for k, r in enumerate(best.select("feature").collect())}


class Tagger:
    """A two-state field. emit: weights for state 1 of the lexicon's features and of the six besides; rest: of a token without any."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.emit = np.concatenate((np.full(len(lexicon), 1.0), np.zeros(6)))
        self.emit[BESIDE] = self.rest = -2.0
        self.trans = np.zeros((2, 2))
        self.calibration = (0.0, 0.0, 0.0, 0.0)
        self._cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}, "_powers": {}}

    def ids(self, word: str) -> tuple[int, ...]:
        """Lexicon features of a word as it stands, with those of its capitals; none if it isn't lexical."""
        found = self._cache.get(word)
        if found is None:
            if len(self._cache) > CACHE:
                self._cache.clear()
            found = tuple(self.lexicon[f] for f in features(word.lower()) if f in self.lexicon)
            if found:
                shape = (UPPER,) if len(word) > 1 and word.isupper() else (CAPITAL,) if word[0].isupper() else ()
                found += (LEXICAL, *shape)
            self._cache[word] = found
        return found

    def active(self, words: list[str]) -> list[tuple[int, tuple[int, ...]]]:
        """(position, features) of the tokens that are lexical, or beside one that is."""
        cache, here = self._cache, set(words)
        for w in here.difference(cache):
            self.ids(w)
        get = cache.__getitem__ if cache.keys() >= here else self.ids  # the cache may have been cleared on the way
        lexical = {i: x for i, w in enumerate(words) if (x := get(w))}
        near = {j for i in lexical for j in (i - 1, i, i + 1) if 0 <= j < len(words)}
        return [(j, lexical.get(j, (BESIDE,)) + (BEFORE,) * (j - 1 in lexical) + (AFTER,) * (j + 1 in lexical)) for j in sorted(near)]

    def score(self, ids: tuple[int, ...]) -> float:
        return min(float(sum(self.emit[i] for i in ids)), 50.0) if ids else self.rest

    def _run(self, n: int) -> np.ndarray:
        """For n tokens without features, scaled: their steps, and above them the steps summed with each token in turn held
        in state 1. The block [[A, B], [0, A]] multiplies as the two do."""
        held = self.__dict__.setdefault("_powers", {})
        if n not in held:
            if len(held) > 100_000:
                held.clear()
            step = np.exp(self.trans) * np.array([1.0, math.exp(self.rest)])
            base = np.zeros((4, 4))
            base[:2, :2] = base[2:, 2:] = step
            base[:2, 3] = step[:, 1]
            base, out, k = base / step.sum(), np.eye(4), n
            while k:
                if k & 1:
                    out = out @ base
                    out /= out[:2, :2].sum()
                base = base @ base
                base /= base[:2, :2].sum()
                k >>= 1
            held[n] = out
        return held[n]

    def marginals(self, n: int, active: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, float]:
        """P(state 1) of the active tokens, and the sum over all tokens."""
        step, ones = np.exp(self.trans), np.ones(2)
        first = np.array([1.0, math.exp(self.rest)])  # the first token has no transition
        local = [np.array([1.0, math.exp(self.score(x))]) for _, x in active]
        at, forward, starts = 0, [], []
        a = None  # forward weights of the token before at
        for (i, _), e in zip(active, local, strict=True):
            starts.append(a)
            a = e * (ones if i == 0 else self._across(a, first, i - at) @ step)
            a = a / a.sum()
            forward.append(a)
            at = i + 1
        out, total, b, at = np.zeros(len(active)), 0.0, ones, n
        for k in range(len(active) - 1, -1, -1):
            i, beyond = active[k][0], b  # beyond: backward weights of the last token of the run after i
            if at > i + 1:
                total += self._share(forward[k], first, at - i - 1, beyond)
                b = self._run(at - i - 1)[:2, :2] @ beyond
                b = b / b.sum()
            p = forward[k] * b
            out[k] = p[1] / p.sum()
            b = step @ (local[k] * b)
            b, at = b / b.sum(), i
        if at:
            total += self._share(None, first, at, b)
        return out, total + float(out.sum())

    def _across(self, a: np.ndarray | None, first: np.ndarray, gap: int) -> np.ndarray:
        """Forward weights after a run of gap tokens."""
        if a is None:
            return first @ self._run(gap - 1)[:2, :2]
        return a @ self._run(gap)[:2, :2] if gap else a

    def _share(self, a: np.ndarray | None, first: np.ndarray, gap: int, b: np.ndarray) -> float:
        """The sum of P(state 1) over a run of gap tokens between forward weights a and backward weights b."""
        if a is None:
            block = self._run(gap - 1)
            own = first * np.array([0.0, 1.0])
            return float((own @ block[:2, :2] @ b + first @ block[:2, 2:] @ b) / (first @ block[:2, :2] @ b))
        block = self._run(gap)
        return float((a @ block[:2, 2:] @ b) / (a @ block[:2, :2] @ b))

    def summary(self, words: list[str]) -> tuple[float, float, list[tuple[int, float]]]:
        """Sum and maximum of the marginals, and those of the active tokens."""
        if not words:
            return 0.0, 0.0, []
        active = self.active(words)
        p, total = self.marginals(len(words), active)
        return total, float(p.max(initial=0.0)), [(i, float(x)) for (i, _), x in zip(active, p, strict=True)]

    def document(self, total: float, most: float, n: int) -> float:
        a, b, c, d = self.calibration
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * math.log1p(total) + c * most + d * math.log1p(n)))))

    def train(self, windows: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-6) -> None:
        """windows: features and labels of their tokens. Ascent on the conditional log-likelihood, each step scaled by
        the size of the weight's own past gradients, so that rare features are learnt as well."""
        by_length: dict[int, list] = {}
        for w in windows:
            by_length.setdefault(len(w[0]), []).append(w)
        packed = []
        for n, group in by_length.items():
            y = np.array([g[1] for g in group])
            rows, cols = [], []
            for g, (xs, _) in enumerate(group):
                for t, x in enumerate(xs):
                    rows += [g * n + t] * len(x)
                    cols += [i % len(self.emit) for i in x]
            has = np.array([[bool(x) for x in xs] for xs, _ in group])
            packed.append((n, y, np.array(rows, "i8"), np.array(cols, "i8"), has))
        total = sum(y.size for _, y, *_ in packed) or 1
        theta = np.concatenate([self.emit, [self.rest], self.trans.ravel()])
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        k = len(self.emit)
        for step in range(1, rounds + 1):
            grad = -decay * theta
            emit, rest, trans = theta[:k], theta[k], np.exp(theta[k + 1 :].reshape(2, 2))
            for n, y, rows, cols, has in packed:
                m = len(y)
                s = np.bincount(rows, emit[cols], m * n).reshape(m, n) if len(rows) else np.zeros((m, n))
                e = np.stack([np.ones((m, n)), np.exp(np.where(has, np.minimum(s, 50.0), rest))], 2)
                f, b = np.zeros((m, n, 2)), np.ones((m, n, 2))
                f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
                for t in range(1, n):
                    x = (f[:, t - 1] @ trans) * e[:, t]
                    f[:, t] = x / x.sum(1, keepdims=True)
                for t in range(n - 2, -1, -1):
                    x = (b[:, t + 1] * e[:, t + 1]) @ trans.T
                    b[:, t] = x / x.sum(1, keepdims=True)
                p = f * b
                p = (p / p.sum(2, keepdims=True))[:, :, 1]
                d = y - p
                grad[:k] += np.bincount(cols, d.reshape(-1)[rows], k) / total if len(rows) else 0
                grad[k] += (d * ~has).sum() / total
                for t in range(n - 1):
                    pair = f[:, t, :, None] * trans[None] * (b[:, t + 1] * e[:, t + 1])[:, None, :]
                    pair /= pair.sum((1, 2), keepdims=True)
                    for i in (0, 1):
                        for j in (0, 1):
                            grad[k + 1 + 2 * i + j] += (((y[:, t] == i) & (y[:, t + 1] == j)).sum() - pair[:, i, j].sum()) / total
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
            theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        self.emit, self.rest, self.trans = theta[:k], float(theta[k]), theta[k + 1 :].reshape(2, 2)

    def calibrate(self, totals: np.ndarray, most: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        x = np.stack([np.ones(len(toxic)), np.log1p(totals), most, np.log1p(n)], 1)
        ridge, w = np.array([1e-3, 0.1, 0.1, 0.1]), np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            w = w + np.linalg.solve(h, x.T @ (toxic - p) - ridge * w)
        self.calibration = tuple(float(v) for v in w)


def labelled(tagger: Tagger, words: list[str], toxic: int) -> Iterator[tuple[list[tuple[int, ...]], list[int]]]:
    """Features and labels of the windows of a document: lexicon tokens with their context, in pieces; the first tokens if
    there are none."""
    by = dict(tagger.active(words))
    marked = [i for i, x in by.items() if BESIDE not in x]
    label = dict.fromkeys(marked, toxic)
    for i, j in zip(marked, marked[1:], strict=False):
        if j - i - 1 <= BRIDGE:
            label |= dict.fromkeys(range(i, j), toxic)
    spans: list[list[int]] = []
    for i in marked:
        s, e = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
        if spans and s <= spans[-1][1]:
            spans[-1][1] = e
        else:
            spans.append([s, e])
    for s, e in spans or [[0, min(len(words), 2 * CONTEXT + 1)]]:
        for at in range(s, e, PIECE):
            tokens = range(at, min(e, at + PIECE))
            yield [by.get(i, ()) for i in tokens], [label.get(i, 0) for i in tokens]


def fit(docs: DataFrame, labels: DataFrame) -> Tagger:
    small_batches(docs.sparkSession)
    rows = stage(training_rows(docs, labels), "sample")
    found = {r["fold"]: (r["t"] or 0, r["n"] - (r["t"] or 0)) for r in rows.groupBy(fold().alias("fold")).agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    sizes = [found.get(k, (0, 0)) for k in range(FOLDS)]
    counted = count_features(rows)
    taggers = [Tagger(learn_lexicon(counted, sizes, k)) for k in (*range(FOLDS), None)]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each window and model that may learn from it."""
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32())]
        for batch in batches:
            out = []
            for doc_id, toxic, k, text in zip(*columns(batch, "doc_id", "toxic", "fold", "text"), strict=True):
                words = _word.findall(text)
                for model, tagger in enumerate(taggers):
                    if words and model != k and tagger.lexicon:
                        out += [(model, toxic, doc_id, xs, ys) for xs, ys in labelled(tagger, words, toxic)]
            yield pa.record_batch([pa.array([r[c] for r in out], kinds[c]) for c in range(5)], names=["model", "toxic", "doc_id", "xs", "ys"])

    tagger = taggers[FOLDS]
    if not tagger.lexicon:
        toxic, clean = (sum(x[i] for x in sizes) for i in (0, 1))
        tagger.calibration = (math.log(toxic / clean) if toxic and clean else 50.0 if toxic else -50.0, 0.0, 0.0, 0.0)
        return tagger
    made = rows.select("doc_id", "toxic", fold().alias("fold"), "text").mapInArrow(windows, "model int, toxic int, doc_id long, xs array<array<int>>, ys array<int>")
    order = Window.partitionBy("model", "toxic").orderBy(F.xxhash64("doc_id", F.to_json("xs")), "doc_id")
    held: dict[int, list] = {}
    for r in made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= WINDOWS).collect():
        held.setdefault(r["model"], []).append(([tuple(x) for x in r["xs"]], r["ys"]))
    for model, t in enumerate(taggers):
        t.train(sorted(held.get(model, [])))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the model that has not seen a document makes of it."""
        for batch in batches:
            toxic, folds, texts = columns(batch, "toxic", "fold", "text")
            words = [_word.findall(t) for t in texts]
            got = [taggers[k].summary(w)[:2] for k, w in zip(folds, words, strict=True)]
            yield pa.record_batch([pa.array(toxic, pa.int32()), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([len(w) for w in words], pa.int64())], names=["toxic", "total", "most", "n"])

    sums = rows.select("toxic", fold().alias("fold"), "text").mapInArrow(summaries, "toxic int, total double, most double, n long").orderBy("toxic", "total", "most", "n").collect()
    tagger.calibrate(*[np.array([r[c] for r in sums], "f8") for c in ("total", "most", "n", "toxic")])
    return tagger


def tag(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, score, and spans (start:end of offending tokens, code points of the text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            scores, spans = [], []
            for text in texts:
                words = _word.findall(text or "")
                total, most, found = tagger.summary(words)
                scores.append(tagger.document(total, most, len(words)))
                wanted = {i for i, p in found if p >= SPAN}
                spans.append(",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(_word.finditer(text)) if i in wanted) if wanted else "")
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans string")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagged = tag(docs, fit(docs, table(spark, sf_dir, "labels")))
    return tagged.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), "spans")
