"""Document fingerprints from closed syncmers.

A k-mer of a text's UTF-8 bytes is chosen if the smallest hash among its inner s-mers stands first or last in it. The choice
looks at the k-mer alone, so an edit changes anchors only where it touches them. A fingerprint lists the distinct anchors
(32-bit hashes, hex) in the order of their first places. The likeness of two fingerprints is positional: the longest run of
shared anchors in the same order, doubled, over the number of anchors of both.

Defined results: null counts as empty; an empty text has the empty fingerprint, like (1.0) only to another empty one; a text
shorter than k bytes has one anchor, the hash of all of it; equal texts have equal fingerprints; without any document
the result is empty. Neighbours go by ascending doc_id (null first), then by the hash of the text, so repeated ids and rows
have a fixed order; a single document is its own neighbour. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables

#: Two of 17 places are anchors, so texts with an edit every ten words, or of a line or two, still share many.
K, S = 24, 8


def anchors(column: pa.Array, k: int = K, s: int = S) -> list[np.ndarray]:
    """Per row: its distinct anchors in the order of their first places."""
    data, offs = kernel.flat(column)
    sums, inverse = kernel.byte_sums(data)
    size, span = np.diff(offs), k - s + 1
    n = max(len(data) - k + 1, 0)
    if n:
        inner = kernel.mix((sums[s:] - sums[:-s]) * inverse[: len(sums) - s])
        low, width = inner, 1
        while width * 2 <= span:  # minima of windows of doubled width
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[span - width : span - width + n])
        closed = (inner[:n] == low) | (inner[span - 1 : span - 1 + n] == low)
        ends = offs[1:][size > 0]
        crossing = np.zeros(n + 1, np.int32)  # k-mers over the end of a row
        np.add.at(crossing, np.clip(ends - k + 1, 0, n), 1)
        np.add.at(crossing, np.minimum(ends, n), -1)
        at = np.flatnonzero(closed & (np.cumsum(crossing[:n]) == 0))
        codes = (kernel.mix((sums[at + k] - sums[at]) * inverse[at]) >> np.uint64(32)).astype(">u4")
        first = np.searchsorted(at, offs)
    else:
        codes, first = np.zeros(0, ">u4"), np.zeros(len(offs), np.int64)
    out = []
    for i in range(len(size)):
        mine = codes[first[i] : first[i + 1]]
        if size[i] and not len(mine):  # shorter than k
            a, b = offs[i], offs[i + 1]
            whole = (sums[b : b + 1] - sums[a : a + 1]) * inverse[a : a + 1] + np.uint64(size[i])
            mine = (kernel.mix(whole) >> np.uint64(32)).astype(">u4")
        if len(mine) > 1:
            mine = mine[np.sort(np.unique(mine, return_index=True)[1])]
        out.append(mine)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    order = np.argsort(b)
    at = np.searchsorted(b[order], a)
    at[at == len(b)] = 0
    place = order[at]
    place = place[b[place] == a]  # places in b of shared anchors, in the order of a
    if len(place) > 1 and not (np.diff(place) > 0).all():
        tails: list[int] = []
        for p in place.tolist():
            i = bisect_left(tails, p)
            tails[i : i + 1] = [p]
        shared = len(tails)
    else:
        shared = len(place)
    return 2.0 * shared / (len(a) + len(b))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


class _Fingerprint:
    """Rows come by block in the order of neighbours; a block ends with the first row of the block after it (`trailer`)."""

    def __init__(self, k: int, s: int):
        self.k, self.s = k, s

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row: its neighbour may come with the next slice
        for part in kernel.texts(batches):
            both = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            yield from self._rows(both)
            held = both.slice(both.num_rows - 1)

    def _rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, trailer = batch.column("block").to_pylist(), batch.column("trailer").to_pylist()
        whole = [x or "" for x in batch.column("text").to_pylist()]
        at = [i for i in range(batch.num_rows - 1) if not trailer[i] and block[i] == block[i + 1]]
        if not at:
            return
        changed = [edited(whole[i], whole[i + 1]) for i in at]
        own = anchors(pa.array(whole, pa.large_string()), self.k, self.s)
        new = anchors(pa.array(changed, pa.large_string()), self.k, self.s)
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id").take(pa.array(at)),
                "n_chars": pa.array([len(whole[i]) for i in at], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                "fingerprint": pa.array([own[i].tobytes().hex() for i in at], pa.string()),
                "edited_fingerprint": pa.array([x.tobytes().hex() for x in new], pa.string()),
                "near_edited": pa.array([likeness(own[i], x) for i, x in zip(at, new, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64()),
            }
        )


def blocks(docs: DataFrame, per_block: int = 1000, most: int = 10_000) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with `block`, ranges of doc_id of about `per_block` rows (at most `most` ranges), and each block's
    trailer row; the number of blocks."""
    spark = docs.sparkSession
    n = docs.count()
    wanted = max(1, min(n // per_block, most))
    points = [i / wanted for i in range(1, wanted)]
    found = docs.select(F.percentile_approx("doc_id", F.array(*[F.lit(p) for p in points]), F.lit(20 * wanted))).first()[0] if points else None
    bounds = sorted({float(x) for x in found or []})
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.col("doc_id").cast("double").alias("place"))
    if bounds:
        split = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="place", outputCol="block", handleInvalid="keep")
        keyed = split.transform(keyed).withColumn("block", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("block")).cast("int"))
    else:
        keyed = keyed.withColumn("block", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    keyed = keyed.drop("place")
    # One row per block: its first row goes to the block before, the very first one to the last.
    first = keyed.groupBy("block").agg(F.min(F.struct("doc_id", "h")).alias("f")).select("block", "f.doc_id", "f.h").orderBy("block").collect()
    moved = [(first[i - 1].block, r.block, r.doc_id, r.h) for i, r in enumerate(first)]
    links = spark.createDataFrame(moved, "to_block int, from_block int, first_id long, first_h long")
    same = (F.col("block") == F.col("from_block")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    trailers = keyed.join(F.broadcast(links), same).dropDuplicates(["to_block"]).select("doc_id", "text", "h", F.col("to_block").alias("block"), F.lit(True).alias("trailer"))
    return keyed.select("doc_id", "text", "h", "block", F.lit(False).alias("trailer")).unionByName(trailers), len(first)


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """docs (doc_id, text) -> the fingerprint of each text and of its edited text, and their likeness."""
    rows, parts = blocks(docs.select("doc_id", "text"))
    rows = rows.repartition(max(parts, 1), "block").sortWithinPartitions("block", "trailer", "doc_id", "h")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("block", "trailer", "doc_id", "text").mapInArrow(_Fingerprint(k, s), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(tables.documents(spark, sf_dir))
