"""Operator 5: BPE encoding and decoding of whole texts by the tokenization automaton of bpe.py.

Null and empty texts have no ids. Rows are independent, so equal rows give equal results, and other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberline.llm.common import doc_texts, small_batches, table
from emberline.llm.tokens import AutomatonIds, columns, held

SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(path: str, texts: list[str]) -> Iterator[tuple[bytes, str, str]]:
    codec = held(AutomatonIds, path)
    label = codec.automaton.label
    for words in codec.batch(texts):
        ids = b"".join([a for a, _ in words])
        decoded = b"".join([label[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        yield ids, ",".join([b for a, b in words if a]), decoded


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and the text decoded from them."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            out = [(np.frombuffer(ids, "<u4").astype("i4"), decoded) for ids, _, decoded in _rows(path, texts)]
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array([x for x, _ in out], pa.list_(pa.int32())), pa.array([d for _, d in out], pa.string())], names=["doc_id", "ids", "decoded"])

    return doc_texts(docs).mapInArrow(run, SCHEMA)


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """The same encoding, as counts and digests, which leave the executors in place of the ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            n, a, b = [], [], []
            for ids, decimal, decoded in _rows(path, texts):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(decimal.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs).mapInArrow(run, DIGEST)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
