"""Quality selection by importance resampling of hashed n-gram models.

Words and word pairs are hashed into `BUCKETS` counts. The target model is learned from a sample of at most 1000 x `salts`
documents labelled good (lowest hashes of doc_id), the raw model from all documents; both are smoothed by one count per
bucket. A document's log weight is the sum over its n-grams of log target - log raw, so exp(weight) is the ratio of the
two generative models. Adding Gumbel noise (from a hash of doc_id and the seed) and taking the k largest keys samples
without replacement in proportion to the weights.

k is a share of all documents, by default the share of good documents among the labels. The k-th largest key is found by
counting in ever narrower ranges over a written table of keys, not by a sort in one place.

Defined results: null counts as empty; a text without words has weight 0; keys are rounded to a millionth, and documents
whose key equals the k-th one are all selected; without labels, or with none that is good, all weights are 0 and k is all
documents; an empty table gives an empty result; repeated rows are treated alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables

BUCKETS = 10_000
UNIT = 1_000_000


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of all words and word pairs, the row of each, and the number of rows."""
    words = kernel.words_of(column)
    h = words.hashes()
    one = (h % np.uint64(BUCKETS)).astype(np.int64)
    if len(h) < 2:
        return one, words.doc, len(words.counts)
    inside = words.doc[1:] == words.doc[:-1]
    two = (kernel.mix(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(BUCKETS)).astype(np.int64)[inside]
    return np.concatenate((one, two)), np.concatenate((words.doc, words.doc[1:][inside])), len(words.counts)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in kernel.texts(batches):
        total += np.bincount(features(batch.column("text"))[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})


def counts(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over all rows."""
    found = docs.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


class _Weigh:
    def __init__(self, ratio):
        self.ratio = ratio

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.texts(batches):
            bucket, row, n = features(batch.column("text"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "log_weight": pa.array(np.bincount(row, self.ratio[bucket], n))})


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column `key`: counts in 1024 ranges, then within the one that holds it."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    while low < high:
        width = -(-(high - low + 1) // 1024)
        part = keys.where(F.col("key").between(low, high)).select(F.floor((F.col("key") - low) / width).cast("int").alias("bin"))
        for r in sorted(part.groupBy("bin").count().collect(), key=lambda r: -r.bin):
            if r["count"] >= k:
                low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width - 1)
                break
            k -= r["count"]
        else:
            return low  # k is more than there is
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1, salts: int = 8) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, log_weight, key, selected."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    good, known = marked.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.count("*")).first()
    ids = tables.lowest_hashes(marked.where("quality = 1"), "quality", salts).select("doc_id")
    target = counts(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))
    raw = counts(docs)
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)) if target.any() else np.zeros(BUCKETS)
    weighed = docs.select("doc_id", "text").mapInArrow(_Weigh(ratio), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, log_weight double")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.round((F.col("log_weight") - F.ln(-F.ln(uniform))) * UNIT).cast("long")
    keyed = tables.stored(weighed.withColumn("key", key), "resampling-keys")
    n = keyed.count()
    if share is None:
        share = good / known if good else 1.0
    kth = kth_largest(keyed, round(share * n))
    return keyed.select("doc_id", "log_weight", (F.col("key") / UNIT).alias("key"), (F.lit(False) if kth is None else F.col("key") >= kth).alias("selected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(tables.documents(spark, sf_dir), tables.table(spark, sf_dir, "labels"))
