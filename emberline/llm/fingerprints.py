"""Operator 2: document fingerprints from prefix polynomial hashes.

For each text two modular prefix arrays are made, from which the hash of any span follows by one
subtraction and one product. A fingerprint holds the text's length, the hash of the whole text under
both moduli, and the SKETCH smallest distinct hashes of its spans of SPAN code points (of the whole
text where that is shorter). Likeness of two fingerprints is the share of common hashes among the
smallest of their union, which estimates the Jaccard likeness of the sets of spans; it is 1 for equal
texts and 0 if just one is empty. The longest common extension of two texts is found by binary
search over their prefix arrays.

Each document meets the next one by doc_id: rows are dealt by ranges of doc_id, sorted, and read in
order; the first document of a range also goes to the range before it. Ranges come from quantiles of
doc_id; the driver holds the first id of each range. Null texts are empty. Equal ids follow each
other in order of text, null ids come last; an only document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import LONG_MAX, partitions, small_batches, table
from emberline.llm.tokens import columns

#: Moduli below 2**31, and bases.
MODULI = ((1 << 31) - 1, 2147483629)
BASES = (911382323, 972663749)
SPAN, SKETCH = 12, 64

_powers: list[list[np.ndarray]] = [[np.ones(1, "u8"), np.ones(1, "u8")] for _ in MODULI]


def powers(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, by doubling."""
    p = np.uint64(MODULI[m])
    for k, base in enumerate((BASES[m], pow(BASES[m], -1, MODULI[m]))):
        held = _powers[m][k]
        while len(held) < n:
            held = np.concatenate([held, held * np.uint64(pow(base, len(held), MODULI[m])) % p])
        _powers[m][k] = held
    return _powers[m][0][:n], _powers[m][1][:n]


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8") + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for m, p in enumerate(MODULI):
            up, _ = powers(m, self.n + 1)
            out = np.zeros(self.n + 1, "u8")
            np.cumsum(points * up[: self.n] % np.uint64(p), out=out[1:])
            self.sums.append(out % np.uint64(p))

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The hash of a span, the same wherever equal code points stand."""
        return tuple((int(s[end]) - int(s[start])) % p * int(powers(m, self.n + 1)[1][start]) % p for m, (s, p) in enumerate(zip(self.sums, MODULI, strict=True)))

    def spans(self, length: int) -> np.ndarray:
        """First-modulus hashes of all spans of a length."""
        p, s = np.uint64(MODULI[0]), self.sums[0]
        return (s[length:] + p - s[:-length]) % p * powers(0, self.n + 1)[1][: self.n + 1 - length] % p

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of many spans under both moduli, joined to 62 bits."""
        out = np.zeros(len(starts), "u8")
        for m, (s, p) in enumerate(zip(self.sums, MODULI, strict=True)):
            h = (s[ends] + np.uint64(p) - s[starts]) % np.uint64(p) * powers(m, self.n + 1)[1][starts] % np.uint64(p)
            out = out << np.uint64(31) | h
        return out

    def sketch(self) -> np.ndarray:
        if self.n == 0:
            return np.zeros(0, "u8")
        hashes = self.spans(min(SPAN, self.n))
        if len(hashes) > 8 * SKETCH:  # most of the smallest lie below a bound; all are looked at if too few do
            low = np.unique(hashes[hashes < np.uint64(MODULI[0] * 3 * SKETCH // len(hashes))])
            if len(low) >= SKETCH:
                return low[:SKETCH]
        return np.unique(hashes)[:SKETCH]


def common_extension(a: Prefixes, b: Prefixes, i: int = 0, j: int = 0) -> int:
    """How many code points a from i and b from j have in common, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


class Fingerprint:
    def __init__(self, text: str):
        self.prefixes = Prefixes(text)
        self.n, self.whole, self.sketch = self.prefixes.n, self.prefixes.span(0, self.prefixes.n), self.prefixes.sketch()

    def __str__(self) -> str:
        return f"{self.n:x}-{self.whole[0]:08x}{self.whole[1]:08x}-" + self.sketch.astype(">u4").tobytes().hex()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    union = np.union1d(a.sketch, b.sketch)[:SKETCH]
    if not (a.n and b.n):
        return 0.0
    both = np.intersect1d(np.intersect1d(a.sketch, b.sketch, True), union, True)
    return len(both) / len(union)


def edited(text: str, following: str) -> str:
    """The last half of text replaced by the first as many code points of the following one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def _compare(doc_id, text: str, mine: Fingerprint, following: str, theirs: Fingerprint) -> tuple:
    changed = edited(text, following)
    other = Fingerprint(changed)
    return (
        doc_id, mine.n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), str(mine), str(other), likeness(mine, other), likeness(mine, theirs),
        common_extension(mine.prefixes, other.prefixes), common_extension(mine.prefixes, theirs.prefixes),
    )


def _deal(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text, order, bucket, extra): extra rows are copies of the first row of the next range."""
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LONG_MAX)).alias("order"))
    bounds = np.unique(np.array(keyed.approxQuantile("order", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else [], "f8"))

    def bucket_of(order) -> np.ndarray:
        return np.searchsorted(bounds, order.to_numpy().astype("f8"), side="right").astype("i4")

    @F.pandas_udf("int")
    def bucket(order):
        import pandas as pd

        return pd.Series(bucket_of(order))

    first = {r["bucket"]: r["first"] for r in keyed.select("order").withColumn("bucket", bucket("order")).groupBy("bucket").agg(F.min("order").alias("first")).collect()}
    filled = sorted(first)
    starts = np.array([first[b] for b in filled], "i8")
    before = np.array([filled[k - 1] for k in range(len(filled))], "i4")  # the range before the first one is the last one

    @F.pandas_udf("struct<bucket:int,to:int>")
    def placed(order):
        """A row's range, and where a copy goes if the row begins its range, else -1."""
        import pandas as pd

        at = np.minimum(np.searchsorted(starts, order.to_numpy()), max(len(starts) - 1, 0))
        to = np.where(starts[at] == order.to_numpy(), before[at], -1) if len(starts) else np.full(len(order), -1)
        return pd.DataFrame({"bucket": bucket_of(order), "to": to.astype("i4")})

    dealt = keyed.withColumn("at", placed("order"))
    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(0).alias("extra"))
    places = F.when(F.col("at.to") >= 0, F.array(own, F.struct(F.col("at.to").alias("bucket"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    return dealt.withColumn("place", F.explode_outer(places)).select("doc_id", "text", "order", "place.bucket", "place.extra")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """For each row its fingerprint and how it compares with the edited and the next text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    small_batches(docs.sparkSession)
    n = parts or partitions(docs)
    dealt = _deal(docs, 4 * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]
        last: tuple | None = None  # the row that waits for the one after it
        ended = None  # the bucket of which the last row has met its next one
        for batch in batches:
            rows = []
            for doc_id, text, bucket, extra in zip(*columns(batch, "doc_id", "text", "bucket", "extra"), strict=True):
                if bucket == ended:
                    continue
                mine = Fingerprint(text)
                if last:
                    rows.append(_compare(*last, text, mine))
                ended = bucket if extra else None
                last = None if extra else (doc_id, text, mine)
            yield pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(9)], names=names)

    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", "order", "text").select("doc_id", "text", "bucket", "extra").mapInArrow(run, ROWS)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
