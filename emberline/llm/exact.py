"""What SQL can say of operators 1, 2, 4 and 10: their columns that follow from fixed rules, by the operators themselves,
beside the same columns in SQL. Rows and parameters are those of the operators' own queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm.fingerprints import op2_fingerprints
from emberline.llm.quality import op10_quality_rules
from emberline.llm.secret_scan import op1_secret_scan
from emberline.llm.warc import op4_warc_index


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_warc_index(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _spans(name: str, k: int, pattern: str, least: str) -> str:
    """Matches of a pattern with their places: what stands between matches, and the matches, follow each other."""
    return f"""
{name}_found AS (
  SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS between, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', 1) AS value
  FROM base WHERE regexp_matches(t, '{pattern}')),
{name}_each AS (
  SELECT doc_id, i, whole[i] AS m, value[i] AS v, list_sum([length(x) for x in between[1:i]]) + coalesce(list_sum([length(x) for x in whole[1:i - 1]]), 0) AS s
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM {name}_found)),
{name} AS (SELECT doc_id, {k} AS k, '{name}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM {name}_each WHERE {least})"""


_keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_assign = rf"""(?:{_keyword})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_base32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(sha, {5 * g + 1}, 5) AS INT) >> {15 - 5 * j}) & 31) + 1, 1)" for g in range(8) for j in range(4))

ORACLE_SQL = {
    "secret_scan_base": f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans("assign", 0, _assign, "length(v) >= 6")},
{_spans("access", 1, "(AKIA[A-Z0-9]+)", "length(m) >= 20")},
{_spans("hex", 2, "([0-9a-f]{24,})", "true")},
spans AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
counted AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS listed
  FROM spans GROUP BY doc_id)
SELECT b.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256
FROM base b LEFT JOIN counted c ON b.doc_id = c.doc_id""",
    "edited_texts": """
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
followed AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM base)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(after, 1, length(t) // 2)) AS edited_sha256 FROM followed""",
    "capture_records": f"""
WITH base AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS sha FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM base)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_base32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts""",
    "quality_base": r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
listed AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM base),
words AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed),
runs AS (
  SELECT doc_id, i, string_agg(w, ' ') OVER run AS r, count(*) OVER run AS n FROM words WINDOW run AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, r) AS c FROM runs WHERE n = 8),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM often WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base),
repeated AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
joined AS (
  SELECT l.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(w) for w in words]), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM listed l LEFT JOIN repeated r ON l.doc_id = r.doc_id LEFT JOIN covered c ON l.doc_id = c.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM joined""",
}
