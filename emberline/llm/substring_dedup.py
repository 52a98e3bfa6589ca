"""Operator 9: removal of repeated passages by hashing paragraphs, lines, sentences and runs of words.

Words stand between ASCII white space and are compared in lower case. Units are paragraphs (lines with
words, one after the other) and lines, each with a letter or digit, and sentences: a sentence ends with a
word that ends in a full stop, exclamation or question mark, or with the line. A sentence of fewer
than MIN_WORDS words is joined with those after it, and with those before it, up to MIN_WORDS words.
Digests are counted over the whole corpus; of equal units the one earliest by (doc_id, text hash,
position) stays, the union of the others goes. Offsets are code points of the original text, end
exclusive.

Passages that no unit holds are found by windows of WINDOW words, each word of a text beginning one:
every run of WINDOW words or more that stands earlier goes, whatever its first and last sentences
are. To make few rows, a window is represented by the smallest hash of its runs of GRAM words, which
equal windows have in common; only windows whose smallest hash occurs twice, and that lie in no unit
to remove, are hashed in full and counted like units. Where a repeat overlaps its first occurrence,
the first occurrence stays whole.

Digests are two polynomials of 64-bit word hashes, from prefix sums modulo 2**64. Only digests that
occur twice or more are joined with the first occurrence; the join is on the digest, and a digest that
holds many rows is split by Spark's skew join as the other side has one row for it, and is written
first so that it is exchanged too. No group is collected: the lists gathered per document are of its
own units and windows. Texts are read in groups of GROUP_BYTES, or one by one where they are longer.

Null and empty texts have no units. Rows equal in doc_id and text count as one document and are
treated alike. A null doc_id ranks last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import LONG_MAX, release, small_batches, stage, table

MIN_WORDS = 6
WINDOW, GRAM = 16, 8
GROUP_BYTES = 512 << 10
UNIT, ANCHOR = 0, 1
_bases = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_mix = np.uint64(0xD6E8FEB86659FD93)
_space = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_stop = np.isin(np.arange(256), list(b".!?"))
_tells = np.array([chr(k).isalnum() or k > 127 for k in range(256)])
_of_byte = np.random.default_rng(20240109).integers(1, 1 << 63, 256, "u8")
ROWS = "_doc long, _key long, kind byte, d1 long, d2 long, start int, end int"
PLACES = "_doc long, _key long, d1 long, d2 long, start int, end int"


_grown = [(np.ones(1, "u8"), np.ones(1, "u8")) for _ in _bases]


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2**64."""
    if len(_grown[lane][0]) < n:
        base = _bases[lane]
        made = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), x, "u8")
            steps[0] = 1
            made.append(np.cumprod(steps))
        _grown[lane] = made[0], made[1]
    return _grown[lane][0][:n], _grown[lane][1][:n]


def _slide(low, x: np.ndarray, width: int) -> np.ndarray:
    """low (minimum or maximum) of each width values that follow each other."""
    k = 1
    while 2 * k <= width:
        x = low(x[:-k], x[k:])
        k *= 2
    return low(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def _edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes that end in white space."""
    blank = _space[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def _total(values: np.ndarray, kind: str = "u8") -> np.ndarray:
    out = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=out[1:])
    return out


class Words:
    """The words of some texts, one after the other: hash, text number, line number, start and end in the own text."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts) + b"\n"
        b = np.frombuffer(raw, "u1")
        start, end = _edges(b)
        self.n = len(start)
        base = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        self.doc = np.searchsorted(base, start, "right") - 1
        self.line = _total(b == 10, "i4")[start]
        self.stops = _stop[b[end - 1]]
        told = _total(_tells[b], "i4")
        self.told = told[start], told[end]
        if raw.isascii():
            self.hash = self._hashes(np.frombuffer(raw.lower(), "u1"), start, end)
        else:
            low = np.frombuffer(raw.decode("utf-8").lower().encode("utf-8"), "u1")
            self.hash = self._hashes(low, *_edges(low))
            within = np.cumsum(b & 0xC0 == 0x80)
            start, end = start - within[start], end - within[end - 1]
            base = base - np.where(base > 0, within[base - 1], 0)
        self.base, self.start, self.end = base, (start - base[self.doc]).astype("i4"), (end - base[self.doc]).astype("i4")
        second = (self.hash ^ self.hash >> np.uint64(29)) * _mix
        self.sums = [_total(h * _powers(k, self.n)[0]) for k, h in enumerate((self.hash, second))]

    @staticmethod
    def _hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _powers(0, len(low))
        sums = _total(_of_byte[low] * up)
        h = (sums[end] - sums[start]) * down[start]
        h = (h ^ h >> np.uint64(31)) * _mix
        return h ^ h >> np.uint64(30)

    def digest(self, lane: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The polynomial of the words from i to j, wherever they stand."""
        return (self.sums[lane][j] - self.sums[lane][i]) * _powers(lane, self.n + 1)[1][i]

    def units(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of the units, by place."""
        if not self.n:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        ends = lambda last: np.append(np.flatnonzero(last), self.n - 1) + 1
        new = np.diff(self.line) > 0
        line_end = ends(new)
        line_start = np.concatenate(([0], line_end[:-1]))
        para_end = ends((np.diff(self.line) > 1) | (np.diff(self.doc) > 0))
        para_start = np.concatenate(([0], para_end[:-1]))
        whole = np.concatenate((line_start, para_start)), np.concatenate((line_end, para_end))
        has = self.told[1][whole[1] - 1] > self.told[0][whole[0]]
        end = ends(new | self.stops[:-1])
        start = np.concatenate(([0], end[:-1]))
        long = end - start >= min_words
        s, e = start[~long], end[~long]
        k = np.searchsorted(line_end, s, "right")  # the line that a short sentence stands in
        after = end[np.minimum(np.searchsorted(end, s + min_words), len(end) - 1)]
        before = start[np.maximum(np.searchsorted(start, e - min_words, "right") - 1, 0)]
        ahead = (after <= line_end[k]) & (after - s >= min_words)
        back = (before >= line_start[k]) & (e - before >= min_words)
        i = np.concatenate((whole[0][has], start[long], s[ahead], before[back]))
        j = np.concatenate((whole[1][has], end[long], after[ahead], e[back]))
        places = np.unique(i * (self.n + 1) + j)
        return places // (self.n + 1), places % (self.n + 1)

    def smallest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the smallest hash of a run of GRAM words, 0 where it would leave its text; and the hashes of all runs."""
        if self.n < WINDOW:
            return np.zeros(0, "u8"), np.zeros(0, "u8")
        at = np.arange(self.n - GRAM + 1)
        runs = self.digest(0, at, at + GRAM)
        runs = (runs ^ runs >> np.uint64(32)) * _mix | np.uint64(1)
        low = _slide(np.minimum, runs, WINDOW - GRAM + 1)
        return np.where(self.doc[: len(low)] == self.doc[WINDOW - 1 :], low, np.uint64(0)), runs

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of each run that is the smallest of some window."""
        low, runs = self.smallest()
        wide = WINDOW - GRAM
        at = np.flatnonzero((_slide(np.maximum, np.pad(low, wide), wide + 1) == runs)) if len(low) else np.zeros(0, "i8")
        return self.doc[at], runs[at].view("i8")


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list[bytes], list[pa.Array]]]:
    """Texts in UTF-8 and the named columns, GROUP_BYTES of text at a time or one text."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("_text")).cast(pa.binary()).to_pylist()
        rest = [batch.column(batch.schema.get_field_index(n)) for n in names]
        at, size = 0, 0
        for k, t in enumerate(texts):
            if size and size + len(t) > GROUP_BYTES:
                yield texts[at:k], [c.slice(at, k - at) for c in rest]
                at, size = k, 0
            size += len(t)
        if at < len(texts):
            yield texts[at:], [c.slice(at) for c in rest]


def merged(packed: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, each start << 32 | end, by start."""
    packed = np.sort(packed)
    start, reach = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1]))) if len(packed) else np.zeros(0, "i8")
    return list(zip(start[new].tolist(), reach[np.append(new[1:], len(packed)) - 1].tolist(), strict=True)) if len(new) else []


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of docs as they are, in a struct, and what identifies a row."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LONG_MAX)).alias("_doc"), F.xxhash64(text).alias("_key"), text.alias("_text"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))


def _marks(keyed: DataFrame, min_words: int) -> DataFrame:
    """A row for each unit, and for each anchor of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (docs, keys) in _groups(batches, "_doc", "_key"):
            words, doc_ids, keys = Words(texts), docs.to_numpy(), keys.to_numpy()
            i, j = words.units(min_words)
            text, anchor = words.anchors()
            own = np.concatenate((words.doc[i], text))
            none = np.ones(len(text), bool)
            mask = np.concatenate((np.zeros(len(i), bool), none))
            fill = lambda x: pa.array(np.concatenate((x, np.zeros(len(text), x.dtype))), mask=mask)
            first = np.concatenate((words.digest(0, i, j).view("i8"), anchor))
            yield pa.record_batch(
                [pa.array(doc_ids[own]), pa.array(keys[own]), pa.array(mask.astype("i1")), pa.array(first), fill(words.digest(1, i, j).view("i8")), fill(words.start[i]), fill(words.end[j - 1])],
                names=["_doc", "_key", "kind", "d1", "d2", "start", "end"],
            )

    return keyed.select("_doc", "_key", "_text").mapInArrow(run, ROWS)


def _windows(near: DataFrame) -> DataFrame:
    """The windows that have one of the anchors and lie in none of the spans of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (docs, keys, anchors, spans) in _groups(batches, "_doc", "_key", "_anchors", "_spans"):
            words, doc_ids, keys = Words(texts), docs.to_numpy(), keys.to_numpy()
            low, _ = words.smallest()
            # an anchor that occurs twice does so for every text that has it
            at = np.flatnonzero(np.isin(low.view("i8"), anchors.flatten().to_numpy()) & (low > 0))
            base = words.base[words.doc[at]]
            start, end = words.start[at], words.end[at + WINDOW - 1]
            packed = spans.flatten().to_numpy()
            if len(packed):
                shift = np.repeat(words.base, spans.value_lengths().fill_null(0).to_numpy())
                order = np.argsort(shift + (packed >> 32), kind="stable")
                held, reach = (shift + (packed >> 32))[order], np.maximum.accumulate((shift + (packed & 0xFFFFFFFF))[order])
                k = np.searchsorted(held, base + start, "right") - 1
                free = (k < 0) | (reach[k] < base + end)
                at, start, end = at[free], start[free], end[free]
            own = words.doc[at]
            both = [pa.array(words.digest(k, at, at + WINDOW).view("i8")) for k in (0, 1)]
            yield pa.record_batch([pa.array(doc_ids[own]), pa.array(keys[own]), *both, pa.array(start), pa.array(end)], names=["_doc", "_key", "d1", "d2", "start", "end"])

    return near.select("_doc", "_key", "_text", "_anchors", "_spans").mapInArrow(run, PLACES)


def _later(units: DataFrame) -> DataFrame:
    """(_doc, _key, span): start << 32 | end of units that have an earlier occurrence, without what overlaps the first."""
    place = F.struct("_doc", "_key", "start", "end")
    counted = units.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    many = stage(counted.where("_n > 1").select("d1", "d2", "_first"), "repeated")
    release(units.sparkSession)
    same = (F.col("_doc") == F.col("_first._doc")) & (F.col("_key") == F.col("_first._key"))
    start = F.when(same, F.greatest("start", "_first.end")).otherwise(F.col("start"))
    return units.join(many, ["d1", "d2"]).where(place > F.col("_first")).select("_doc", "_key", start.alias("start"), "end").where("start < end").select("_doc", "_key", F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long")).alias("span"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and for each with something to remove its spans, which may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = _keyed(docs)
    gather = lambda spans: spans.groupBy("_doc", "_key").agg(F.collect_set("span").alias("_spans"))
    marks = stage(_marks(keyed, min_words), "marks")
    of_units = stage(_later(marks.where(f"kind = {UNIT}").drop("kind")), "spans")
    release(spark)
    anchors = marks.where(f"kind = {ANCHOR}").select("_doc", "_key", F.col("d1").alias("anchor"))
    shared = stage(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor"), "shared")
    release(spark)
    by_doc = stage(anchors.join(shared, "anchor").groupBy("_doc", "_key").agg(F.collect_set("anchor").alias("_anchors")), "anchors")
    release(spark, marks, shared)
    near = keyed.select("_doc", "_key", "_text").join(by_doc, ["_doc", "_key"]).join(gather(of_units), ["_doc", "_key"], "left")
    windows = stage(_windows(near), "windows")
    release(spark, by_doc)
    of_windows = stage(_later(windows), "spans")
    release(spark, windows)
    return keyed, gather(of_units.unionByName(of_windows))


def removed(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For each row doc_id, n_chars, n_removed, removed_chars and removed (start:end, comma-joined)."""
    return _cleaned(docs, min_words).select(
        F.col("_row")["doc_id"].cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col("_row")["text"], F.lit(""))).cast("long").alias("n_chars"),
        F.coalesce("_done.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_done.removed_chars", F.lit(0)).cast("long").alias("removed_chars"),
        F.coalesce("_done.removed", F.lit("")).alias("removed"),
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, the blanks after each, and lines that they leave empty."""
    out, at = [], 0
    for s, e in spans:
        while e < len(text) and text[e] in " \t":
            e += 1
        if (s == 0 or text[s - 1] == "\n") and e < len(text) and text[e] == "\n":
            e += 1
        if s > at:
            out.append(text[at:s])
        at = max(at, e)
    return "".join([*out, text[at:]])


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    """A text without its spans, and which they are; null where nothing goes."""
    clean, gone, count, chars = [], [], [], []
    for t, x in zip(text.to_pylist(), spans, strict=True):
        found = merged(x.values.to_numpy()) if t is not None and x.is_valid else []
        clean.append(without(t, found) if found else None)
        gone.append(",".join(f"{s}:{e}" for s, e in found) if found else None)
        count.append(len(found))
        chars.append(sum(e - s for s, e in found))
    return pa.StructArray.from_arrays([pa.array(clean, pa.string()), pa.array(gone, pa.string()), pa.array(count, pa.int64()), pa.array(chars, pa.int64())], ["clean", "removed", "n_removed", "removed_chars"])


def _cleaned(docs: DataFrame, min_words: int) -> DataFrame:
    """_row (docs' columns) and _done (clean, removed, n_removed, removed_chars). Only texts with something to remove go
    through Python."""
    keyed, spans = repeats(docs, min_words)
    joined = keyed.drop("_text").join(spans, ["_doc", "_key"], "left")
    text = F.when(F.col("_spans").isNotNull(), F.col("_row")["text"])
    cut = F.arrow_udf(_cut, "clean string, removed string, n_removed long, removed_chars long")
    return joined.select("_row", cut(text, F.col("_spans")).alias("_done"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all rows and columns, without repeated units in text; n_chars, if there, is renewed."""
    clean = F.col("_done.clean")
    renewed = {"text": F.coalesce(clean, F.col("_row")["text"])}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.when(clean.isNotNull(), F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return _cleaned(docs, min_words).select(*[renewed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_WORDS)
    return done.select(F.col("_row")["doc_id"].cast("long").alias("doc_id"), F.coalesce("_done.removed", F.lit("")).alias("removed"), F.coalesce("_done.clean", F.col("_row")["text"]).alias("text"))


ORACLE_SQL = {
    "op9_substring_dedup": r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(t, '[^\x09-\x0D\x20]+|[\x09-\x0D\x20]+')) AS u,
         generate_subscripts(regexp_extract_all(t, '[^\x09-\x0D\x20]+|[\x09-\x0D\x20]+'), 1) AS k FROM base),
placed AS (
  SELECT doc_id, k, u, CAST(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS e,
         sum(length(u) - length(replace(u, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY k) AS line FROM tokens),
words AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS w, lower(u) AS x, e - length(u) AS s, e, line,
         CAST(regexp_matches(u, '[.!?]$') AS INT) AS stops, regexp_matches(u, '[A-Za-z0-9]|[^\x00-\x7F]') AS tells
  FROM placed WHERE NOT regexp_matches(u, '^[\x09-\x0D\x20]')),
lines AS (SELECT doc_id, line, min(w) AS i, max(w) AS j, bool_or(tells) AS tells FROM words GROUP BY doc_id, line),
blocks AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS block FROM lines),
ended AS (
  SELECT doc_id, line, w, coalesce(sum(stops) OVER (PARTITION BY doc_id, line ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM words),
sentences AS (SELECT doc_id, line, min(w) AS i, max(w) AS j FROM ended GROUP BY doc_id, line, sentence),
parts AS (
  SELECT doc_id, i, j FROM lines WHERE tells
  UNION SELECT doc_id, min(i), max(j) FROM blocks GROUP BY doc_id, block HAVING bool_or(tells)
  UNION SELECT doc_id, i, j FROM sentences WHERE j - i >= 5
  UNION SELECT a.doc_id, a.i, min(b.j) FROM sentences a JOIN sentences b ON a.doc_id = b.doc_id AND a.line = b.line AND b.j - a.i >= 5 WHERE a.j - a.i < 5 GROUP BY a.doc_id, a.i
  UNION SELECT a.doc_id, max(b.i), a.j FROM sentences a JOIN sentences b ON a.doc_id = b.doc_id AND a.line = b.line AND a.j - b.i >= 5 WHERE a.j - a.i < 5 GROUP BY a.doc_id, a.j),
units AS (
  SELECT p.doc_id, min(w.s) AS s, max(w.e) AS e, 'u' || md5(string_agg(w.x, ' ' ORDER BY w.w)) AS same
  FROM parts p JOIN words w ON p.doc_id = w.doc_id AND w.w BETWEEN p.i AND p.j GROUP BY p.doc_id, p.i, p.j),
runs AS (
  SELECT doc_id, s, last_value(e) OVER run AS e, 'w' || md5(string_agg(x, ' ') OVER run) AS same, count(*) OVER run AS n
  FROM words WINDOW run AS (PARTITION BY doc_id ORDER BY w ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
ranked AS (
  SELECT *, first_value(doc_id) OVER same AS d0, first_value(s) OVER same AS s0, first_value(e) OVER same AS e0
  FROM (SELECT doc_id, s, e, same FROM units UNION ALL SELECT doc_id, s, e, same FROM runs WHERE n = 16) WINDOW same AS (PARTITION BY same ORDER BY doc_id, s, e)),
later AS (SELECT doc_id, CASE WHEN doc_id = d0 THEN greatest(s, e0) ELSE s END AS s, e FROM ranked WHERE doc_id > d0 OR s > s0),
begun AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins FROM later WHERE s < e),
islands AS (SELECT doc_id, s, e, sum(begins) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM begun),
spans AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, island),
blanks AS (SELECT p.doc_id, p.s, p.e, b.t, p.e + length(regexp_extract(substr(b.t, p.e + 1), '^[ \t]*')) AS e1 FROM spans p JOIN base b ON p.doc_id = b.doc_id),
cuts AS (SELECT *, e1 + CASE WHEN (s = 0 OR substr(t, s, 1) = chr(10)) AND substr(t, e1 + 1, 1) = chr(10) THEN 1 ELSE 0 END AS e2 FROM blanks),
kept AS (SELECT *, coalesce(lag(e2) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM cuts),
cleaned AS (
  SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY s) AS removed,
         string_agg(substr(t, before + 1, s - before), '' ORDER BY s) || substr(any_value(t), max(e2) + 1) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.removed, '') AS removed, CASE WHEN c.doc_id IS NULL THEN d.text ELSE c.text END AS text
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id"""
}
