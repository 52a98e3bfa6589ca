"""Operator 10: quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Words are runs of characters other than ASCII white space. Base rules count them and the words in
repeated windows of WINDOW words. The method hashes words and pairs of words into BUCKETS buckets,
counts them over the whole raw corpus and over trusted target documents, and scores a document by
the mean of log(target share / raw share) over its n-grams, with one added to each count. A document
is kept if it passes the base rules and its score is no less than the threshold, which is the
LOST quantile of the scores of the trusted documents that pass the base rules.

Trusted documents are all those that labels marks with quality 1; their ids are joined with the texts
by an exchange of both. Every text is scored once, and what came of
it is written to the shared folder, from which the threshold is read at its two ranks. The driver holds two
counts for each bucket.

Null and empty texts have no words and fail. Without trusted documents the base rules alone decide.
Rows are judged one by one, so repeated rows get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import release, stage, table

#: White space, symbols, and the base rules' numbers.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
BUCKETS, LOST = 8192, 0.003


def _words(text: Column) -> Column:
    plain = F.btrim(text, F.lit(BLANKS))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, SPACE))


def _with_hashes(rows: DataFrame) -> DataFrame:
    """rows has _text; adds _h, a hash for each word."""
    return rows.withColumn("_words", _words(F.col("_text"))).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int")


def _positions(last: Column) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def bucket_counts(rows: DataFrame, trusted: DataFrame) -> list[tuple[int, int]]:
    """(raw, target) counts of the buckets; rows has _doc and _text."""
    # an exchange at every size: ids are as many as the labels, so a broadcast would grow with them
    marked = rows.join(trusted.withColumn("_target", F.lit(1)).hint("merge"), "_doc", "left").select("_text", F.coalesce("_target", F.lit(0)).alias("_target"))
    hashed = _with_hashes(marked)
    pairs = F.transform(_positions(F.size("_h") - 2), lambda i: _bucket(F.xxhash64(F.col("_h")[i], F.col("_h")[i + 1])))
    # explode() would have Spark test the array for rows first, and make it twice
    ngrams = hashed.select("_target", F.explode_outer(F.concat(F.transform("_h", lambda x: _bucket(x)), pairs)).alias("bucket"))
    out = [(0, 0)] * BUCKETS
    for r in ngrams.groupBy("bucket").agg(F.count("bucket").alias("raw"), F.sum("_target").alias("target")).collect():
        if r["bucket"] is not None:
            out[r["bucket"]] = r["raw"], r["target"]
    return out


def ratios(counts: list[tuple[int, int]]) -> list[float]:
    raw, target = (sum(c[k] for c in counts) + len(counts) for k in (0, 1))
    return [math.log((t + 1) / target) - math.log((r + 1) / raw) for r, t in counts]


def _measured(rows: DataFrame) -> DataFrame:
    """rows has _text; adds the counts of the base rules, base_failed and _h."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = _with_hashes(rows.withColumn("_lines", lines)).select(
        *[c for c in rows.columns if c != "_text"],
        "_h",
        F.size("_h").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    h = F.col("_h")
    windows = F.transform(_positions(F.size("_h") - WINDOW), lambda i: F.xxhash64(*[h[i + k] if k else h[i] for k in range(WINDOW)]))
    out = out.withColumn("_w", windows)
    # only a text with a repeated window needs its windows in order of hash
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.array_sort(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("_s")
    same = lambda j, k: F.coalesce(F.get(s, j)["x"] == F.get(s, k)["x"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(_positions(F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: s[j]["i"]))
    out = out.withColumn("_at", F.when(s.isNotNull(), starts)).drop("_s", "_w")
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct(F.greatest(a["end"], i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def _scored(measured: DataFrame, table_of_ratios: list[float]) -> DataFrame:
    """Adds llr, null for a text without words."""
    ratio = F.split(F.lit(",".join(map(repr, table_of_ratios))), ",").cast("array<double>")
    h = F.col("_h")
    ones = F.aggregate("_h", F.lit(0.0), lambda a, x: a + ratio[_bucket(x)])
    twos = F.aggregate(_positions(F.size("_h") - 2), F.lit(0.0), lambda a, i: a + ratio[_bucket(F.xxhash64(h[i], h[i + 1]))])
    n = F.col("n_words")
    return measured.withColumn("llr", F.when(n > 0, (ones + twos) / F.greatest(2 * n - 1, F.lit(1)))).drop("_h")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_doc")).distinct()


def quantile(values: DataFrame, q: float) -> float | None:
    """Exact quantile of the column llr, linear between ranks; only rows up to the rank leave a task, so q should be small."""
    held = values.where("llr is not null")
    n = held.count()
    if not n:
        return None
    at = (n - 1) * q
    low = math.floor(at)
    found = [r["llr"] for r in held.select("llr").orderBy("llr").offset(low).limit(2).collect()]
    return found[0] if at == low or found[0] == found[-1] else (low + 1 - at) * found[0] + (at - low) * found[-1]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """_row (docs' columns) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    return _judge(docs, labels, docs.columns)


def _judge(docs: DataFrame, labels: DataFrame, carried: list[str]) -> DataFrame:
    """judge(), with the columns that are carried alone in _row."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("_doc"), text.alias("_text"), F.struct(*[docs[f"`{c}`"] for c in carried]).alias("_row"))
    trusted = trusted_ids(labels)
    lut = ratios(bucket_counts(rows.select("_doc", "_text"), trusted))
    release(spark)  # the texts' exchange
    scored = stage(_scored(_measured(rows), lut), "quality")
    threshold = quantile(scored.where("not base_failed").select("_doc", "llr").join(trusted, "_doc", "left_semi"), LOST)
    passes = F.lit(True) if threshold is None else F.coalesce(F.col("llr") >= threshold, F.lit(False))
    return scored.drop("_doc").withColumn("kept", ~F.col("base_failed") & passes)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    return judge(docs, labels).where("kept").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = _judge(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return judged.select(F.col("_row")["doc_id"].cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
