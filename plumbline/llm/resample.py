"""Importance resampling: documents drawn in proportion to how much likelier a target model makes them than the raw corpus.

Method: a text's words and neighbouring word pairs are hashed into a fixed number of buckets. Bucket counts over target
rows and over all rows give two generative models with add-one smoothing. A document's log weight is the sum over its
n-grams of the logarithm of the ratio of both. Drawing without replacement by weight is Gumbel top-k: each
document's log weight plus Gumbel noise, the k largest are taken. The noise comes from a hash of the id and a seed, so a
rerun, or a lost executor, draws the same. The border is found exactly by counting key prefixes, without a sort.

The target model is fitted on at most ``target_rows`` labelled rows (those of least hash of their id), a bounded list
that is sent to every task; raw counts cover all documents. By default the sample's share is the share of target rows
among labelled ones.

Defined results: null or text without words has weight 0; without target rows every weight is 0; repeated rows get the
same key and are taken together; keys equal to the border's are all taken; a null id counts as 0 for the noise; labels
that repeat or contradict each other are target only if all of them are; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import keyed_text, slices, text_bytes, written
from plumbline.llm.words import SPACED, mix, words_of

BITS = 16
TARGET_ROWS = 20_000
SEED = 17


def buckets_of(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of each text, and the text of each."""
    raw, offsets = text_bytes(column)
    words = words_of(raw, offsets, SPACED)
    h = words.hashes
    doc = np.repeat(np.arange(len(column)), np.diff(words.first))
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    inside = doc[:-1] == doc[1:]
    shift = np.uint64(64 - bits)
    return np.concatenate([h >> shift, pair[inside] >> shift]).astype(np.int64), np.concatenate([doc, doc[:-1][inside]])


def target_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic",
               target_rows: int = TARGET_ROWS) -> tuple[DataFrame, float]:
    """Ids of at most ``target_rows`` rows labelled good and not toxic, and the share of such rows among the labelled."""
    by_id = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(
        F.min(F.coalesce((labels[quality_col] == 1) & (labels[toxic_col] == 0), F.lit(False))).alias("good"))
    n = by_id.agg(F.count("*").alias("all"), F.sum(F.col("good").cast("long")).alias("good")).first()
    drawn = by_id.where("good").orderBy(F.xxhash64("id"), "id").limit(target_rows).select("id")
    return drawn, (n["good"] or 0) / n["all"] if n["all"] else 0.0


def log_ratios(docs: DataFrame, targets: DataFrame, bits: int = BITS) -> np.ndarray:
    """log(target share / raw share) by bucket, from one pass over all documents."""
    flagged = docs.join(F.broadcast(targets.select("id", F.lit(True).alias("target"))), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for part in slices(batch):
                bucket, doc = buckets_of(part.column("text"), bits)
                good = part.column("target").is_valid().to_numpy(zero_copy_only=False)[doc]
                total[0] += np.bincount(bucket[good], minlength=1 << bits)
                total[1] += np.bincount(bucket, minlength=1 << bits)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "good", "n"])

    counts = flagged.select("text", "target").mapInArrow(run, "bucket long, good long, n long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    good, n = np.ones(1 << bits), np.ones(1 << bits)
    for r in counts.toLocalIterator():
        good[r["bucket"]] += r["good"]
        n[r["bucket"]] += r["n"]
    if good.sum() == len(good):  # no target: nothing tells documents apart
        return np.zeros(1 << bits)
    return np.log(good / good.sum()) - np.log(n / n.sum())


def scored(docs: DataFrame, ratios: np.ndarray, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """(id, log_weight, gumbel_key, position): ``position`` orders as the key does, as a 64-bit integer."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bucket, doc = buckets_of(part.column("text"), bits)
                weight = np.bincount(doc, sent.value[bucket], part.num_rows).astype(float)  # counts of nothing are integers
                ids = part.column("id").fill_null(0).to_numpy()
                u = (mix(mix(ids.view(np.uint64)) + np.uint64(seed)) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
                key = weight - np.log(-np.log(u)) + 0.0
                whole = key.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(weight), pa.array(key), pa.array(whole ^ ((whole >> 63) & np.int64(2**63 - 1)))],
                    names=["id", "log_weight", "gumbel_key", "position"])

    return docs.mapInArrow(run, "id long, log_weight double, gumbel_key double, position long")


def kth_largest(values: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of 64-bit integers, 16 bits at a time: four counts of at most 65,536 groups each."""
    if k <= 0:
        return None
    found, rest = 0, values.where(F.col(column).isNotNull()).select((F.col(column).bitwiseXOR(F.lit(-(2**63)))).alias("v"))
    for shift in (48, 32, 16, 0):
        digits = rest.groupBy(F.shiftrightunsigned("v", shift).bitwiseAND(0xFFFF).alias("d")).count().collect()
        for d, n in sorted(((r["d"], r["count"]) for r in digits), reverse=True):
            if k <= n:
                break
            k -= n
        else:
            return None
        found = found << 16 | d
        rest = rest.where(F.shiftrightunsigned("v", shift) == (found - 2**64 if shift == 0 and found >= 2**63 else found))
    return found - 2**63


def resample(documents: DataFrame, labels: DataFrame, share: float | None = None, id_col: str = "doc_id", text_col: str = "text",
             seed: int = SEED, bits: int = BITS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Per document: ``id, log_weight, gumbel_key, selected``; ``share`` of all rows are selected (half up)."""
    docs = keyed_text(documents, id_col, text_col)
    drawn, usual = target_ids(labels, target_rows=target_rows)
    table = written(scored(docs, log_ratios(docs, drawn, bits), seed, bits), "resample-scores")
    k = int(table.count() * (usual if share is None else share) + 0.5)
    border = kth_largest(table, "position", k)
    selected = F.lit(False) if k <= 0 else F.lit(True) if border is None else F.col("position") >= border
    return table.select("id", "log_weight", "gumbel_key", selected.alias("selected"))
