"""Token ids in ORC files, sorted by document id: written, read back whole or for a few documents.

Method: documents are range-partitioned and sorted by id, encoded where they lie, and written by Spark's ORC writer. An
ORC file is a list of stripes; an integer list column is stored as run-length encoded lengths and values, every stripe
carries a row index with least and greatest ids and, for the id column, a Bloom filter. Readers split files by
stripe. A lookup by id skips files and stripes by those statistics.

Columns: ``doc_id``, ``part`` (partition that wrote the row; parts are in id order), ``first`` (ids before the document
within its part), ``n_tokens``, ``ids``.

Defined results: null text is empty, so the document has its end id only; null ids sort first; rows that repeat an id
stand side by side, ordered by a hash of their text, and count each; an empty table gives no file and no rows; columns
of other names are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.frames import slices
from plumbline.llm.tokens import default_vocabulary, encoder
from plumbline.session import scratch_path

SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
STRIPE_BYTES = 64 << 20


def write_token_files(documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text", partitions: int | None = None, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Encode every whole text, append ``end_id``, write ORC below ``path`` in ascending id order."""
    vocabulary = vocabulary or default_vocabulary()
    rows = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    spread = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch):
                coded = [ids + end for ids in encoder(vocabulary).encode(piece.column("text").to_pylist())]
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(first + ends[:-1]),
                     pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], schema=schema)
                first += int(ends[-1])

    (spread.sortWithinPartitions(*by).mapInArrow(run, SCHEMA).write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.stripe.size", stripe_bytes).option("orc.create.index", "true").orc(path))


def read_token_files(spark: SparkSession, path: str, ids: Sequence[int] | None = None) -> DataFrame:
    """The stored rows; with ``ids`` only those documents, found through statistics and Bloom filters."""
    stored = spark.read.schema(SCHEMA).orc(path)
    return stored if ids is None else stored.where(F.col("doc_id").isin(*ids))


def with_start(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """``start``: ids of all documents before each one. Reads two narrow columns for the totals, one row per part."""
    sizes = stored.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("n")).orderBy("part").collect()
    before, at = [], 0
    for r in sizes:
        before.append((r["part"], at))
        at += r["n"]
    bases = spark.createDataFrame(before, "part int, base long")
    return stored.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("first"))


def checksums(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from stored rows with ``start``; the checksum is taken of the ids read."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return stored.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(documents: DataFrame, vocabulary: str | None = None, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Write all documents, read the files back, and describe each document by what the files hold."""
    spark = documents.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(documents, path, vocabulary, end_id, partitions=partitions)
    return checksums(with_start(spark, read_token_files(spark, path)))
