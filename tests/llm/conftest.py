from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
        # names that operators might use themselves
        ("_row", T.StringType()), ("_text", T.LongType()), ("node", T.StringType()), ("clean", T.StringType()), ("kept", T.StringType()), ("start", T.LongType()), ("bucket", T.StringType()),
    )]
)


def prose(rng: random.Random, n: int) -> str:
    words = ["the", "of", "and", "river", "stone", "window", "carries", "over", "slowly", "métier", "straße", "niño"]
    out = []
    for k in range(n):
        w = rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.3 else "")
        out.append(w + (". " if k % 11 == 10 else " "))
    return "".join(out).strip()


def nasty_rows() -> list[tuple]:
    rng = random.Random(5)
    base = [prose(rng, n) for n in (30, 60, 90, 120, 200, 400)]
    words = base[4].split()
    near = " ".join([*words[:100], "changed", *words[101:]])
    texts = [
        *base, base[0], base[0], near, base[3] + "\n" + base[5], None, "", " \t\n", "a", "one two three", "x" * 3000, "the " * 4000,
        prose(rng, 30_000), "tail spaces  \n\n  mixed\x85space\xa0here 中文 😀 don't <|endoftext|> end", 'password = "hunter22secret" and AKIA' + "Q" * 20 + " " + "0f" * 20,
        "api_key: abc", "secret : Xk29-lemmaQ/77+z==", 'db pass: "correct horse $7 battery"', "Bearer abcDEF123456xyz~-.q", "### *** $$$ %%% &&& | < >", "same line\nsame line\n\nsame line",
    ]
    rows = [(k, t, "en", "src0", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[2], rows[2], (3, "another text with the same id", "en", None, 29), (None, base[1], None, None, None), (None, None, None, None, None), (-7, base[2] + " x", "fr", "src1", 1)]
    return [(*r, "r", 1, "n", "c", "k", 2, "b") for r in rows]


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 0, 0), (4, 1, 0), (5, 1, 1), (None, 1, 1), (8, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


def text_of(row) -> str:
    return row["text"] or ""
