"""Operator 1: secret scans with a password guess-cost dynamic programme.

The base rules find assignments, access keys and long hexadecimal runs. The method adds values in a
credential context that the base rules miss, such as pass phrases, bearer headers and quoted values
with other characters: a value counts if the cheapest way to guess it is dear enough. That way is
the minimum over all segmentations into words, dates, repeats, keyboard walks and brute-force
characters, in log10 guesses, found by a dynamic programme from left to right.

Spans are code points of the whole text, end exclusive; a base span is the whole match. Null and
empty texts have no spans. Added spans never overlap base spans. Rows are scanned one by one, so repeated
rows get equal results and an empty table gives none; a very long text is one task's, and the cost of a
value grows with its length times the longest word. scan() reads doc_id and text alone, redact() keeps all
columns and names its own so that they don't clash.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import doc_texts, fresh, small_batches, table
from emberline.llm.tokens import columns

#: The base rules.
KINDS = ["assign", "access", "hex", "guess"]
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")

#: The method: where values stand, and what guessers try first.
CONTEXT = re.compile(r"""(?:(?<![A-Za-z])(?:pwd|pass|passphrase|passcode|passwort|contraseña|mot de passe|credentials?|auth|private[_ -]?key|access[_ -]?key|client[_ -]?secret)|password|passwd|secret|token|api[_ -]?key)["']?\x20*(?:[:=]|\bis\b)\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;]+))|\b[bB]earer\x20+([A-Za-z0-9+/_.=~-]+)""", re.IGNORECASE)
CONTEXT_WORDS = ("pwd", "pass", "contraseña", "credential", "auth", "key", "secret", "token", "bearer")
FIRST = ["password", "admin", "welcome", "letmein", "secret", "token", "default", "changeme", "dragon", "monkey", "master", "login", "hello", "test", "user", "root", "guest", "shadow", "sunshine", "football", "love", "example", "none", "null", "true", "false", "your", "here", "key", "the", "and", "that", "this", "with"]
TRAILING = ".,;:!?)]}>"


def _dictionary() -> list[str]:
    """FIRST, and then the whole words of the byte-level vocabulary by rank, which falls with frequency."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = (w[1:].lower() for w in sorted(vocabulary, key=vocabulary.get) if len(w) > 3 and w[0] == "Ġ" and w[1:].isascii() and w[1:].isalpha())
    return list(dict.fromkeys([*FIRST, *whole]))


WORDS = _dictionary()
ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmikolp"]
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d")
MIN_VALUE, MIN_LOG10 = 8, 9.0

_rank = {w: math.log10(k + 2) for k, w in enumerate(WORDS)}
_longest_word = max(map(len, WORDS))
_walks = {a + b for row in ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:], strict=False)}


def guess_log10(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation. Each segment but the first adds a factor of two."""
    n, low = len(value), value.lower()
    best = [0.0] + [math.inf] * n
    same = [1] * n  # length of the run of equal characters that ends here
    walk = [1] * n
    for j in range(1, n):
        same[j] = same[j - 1] + 1 if value[j] == value[j - 1] else 1
        walk[j] = walk[j - 1] + 1 if low[j - 1 : j + 1] in _walks else 1
    dates: dict[int, list[int]] = {}
    if any(c.isdigit() for c in value):
        for i in range(n):
            if value[i].isdigit() and (m := DATE.match(value, i)):
                dates.setdefault(m.end(), []).append(i)
    for j in range(1, n + 1):
        c = value[j - 1]
        brute = 1.0 if c.isdigit() else math.log10(26) if c.islower() or c.isupper() else math.log10(33)
        cost = best[j - 1] + brute
        for k in range(3, min(j, _longest_word) + 1):
            if (r := _rank.get(low[j - k : j])) is not None:
                plain = value[j - k : j] == low[j - k : j]
                cost = min(cost, best[j - k] + r + 0.3 + (0 if plain else 0.6))
        if (k := same[j - 1]) >= 3:
            cost = min(cost, best[j - k] + brute + math.log10(k) + 0.3)
        if (k := walk[j - 1]) >= 4:
            cost = min(cost, best[j - k] + math.log10(94) + math.log10(k) + 0.6)
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + math.log10(365 * 119) + 0.3)
        best[j] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the base rules."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """Values in a credential context that no base span touches and that are dear to guess."""
    low = text.lower()
    if not any(k in low for k in CONTEXT_WORDS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        group = next(g for g in (1, 2, 3, 4) if m[g] is not None)
        value = m[group] if group < 3 else m[group].rstrip(TRAILING)
        s = m.start(group)
        e = s + len(value)
        if e - s < MIN_VALUE or any(b[0] < e and s < b[2] for b in base):
            continue
        cost = guess_log10(value)
        if cost >= MIN_LOG10:
            out.append((s, 3, e, cost))
    return out


def _join(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans))


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    base = base_spans(text)
    return base, added_spans(text, base)


def scan(docs: DataFrame) -> DataFrame:
    """For each row the counts, the digest of base spans, all spans, and the dearest value's log10 guesses."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            rows = []
            for text in texts:
                base, more = scan_text(text)
                n = [sum(1 for b in base if b[1] == k) for k in range(3)]
                values = [ASSIGN.match(text, s)[2] for s, k, e in base if k == 0]
                cost = max([x[3] for x in more] + [guess_log10(v) for v in values], default=None)
                rows.append((*n, hashlib.sha256(_join(base).encode()).hexdigest(), _join([*base, *[x[:3] for x in more]]), len(more), cost))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_guess_log10"]
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), *[pa.array([r[i] for r in rows], kinds[i]) for i in range(7)]], names=["doc_id", *names])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_guess_log10 double")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, all rows and columns, with each span of text replaced by mark; n_chars, if there, is renewed."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(lambda t: t if t is None else redact_text(t, mark))

    clean = fresh(docs, "clean")
    out = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(clean).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))
    return docs.withColumn(clean, cleaned("text")).select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def redact_text(text: str, mark: str) -> str:
    base, more = scan_text(text)
    out, at = [], 0
    for s, _, e in sorted([*base, *[x[:3] for x in more]]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
