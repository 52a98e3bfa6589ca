"""Operator 8: token ids in ORC files, with integer run-length encoding, row indexes and Bloom filters
on document ids, read back by stripes.

Documents are dealt by range of doc_id, so files in name order hold them in ascending order; null
ids come last, equal ids in order of text. Each row carries where its ids start in its own file;
what the files before it hold comes from a sum over one integer column of each file, which other
columns' stripes need not be read for. Null and empty texts hold the end id alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import doc_texts, partitions, scratch, small_batches, table
from emberline.llm.tokens import WordEndIds, columns, crc32_of, held, task_number

END_ID = 2
ROWS = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Write the ids of all documents as ORC files under path."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = held(WordEndIds, tokenizer), task_number(), 0
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            ids = [np.append(encoder.ids(t), np.uint32(end_id)).astype("i4") for t in texts]
            n = np.array([len(x) for x in ids], "i8")
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype("i4"))
            yield pa.record_batch(
                [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(ids), part, "i4")), pa.array(starts), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, "i4")])))],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )

    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    texts = doc_texts(docs)
    dealt = texts.repartitionByRange(parts or partitions(texts), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(*order)
    dealt.mapInArrow(run, ROWS).write.options(**OPTIONS).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents: stripes and row groups go by min, max and Bloom filter."""
    return read_ids(spark, path).where(F.col("doc_id").isin(doc_ids))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files. The driver holds one sum for each file."""
    sums = sorted((r["part"], r["n"]) for r in read_ids(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = {}, 0
    for part, n in sums:
        before[part], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, part, start = columns(batch, "doc_id", "part", "part_start")
            ids = batch.column(batch.schema.get_field_index("ids"))
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum([0, *ids.value_lengths().to_pylist()])
            yield pa.record_batch(
                [pa.array(doc_ids, pa.int64()), pa.array([before[p] + s for p, s in zip(part, start, strict=True)], pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array([crc32_of(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return read_ids(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "orc_ids")
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_digests(spark, path)
