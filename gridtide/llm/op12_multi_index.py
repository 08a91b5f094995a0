"""SimHash near-duplicates: fingerprints that differ in few bits, found by multi-index hashing, and their components.

A fingerprint has a bit set if more than half of the text's shingles of four words (repeats count) have it set in their XXH64.
A table row stands for each different fingerprint, so copies cost nothing. The 64 bits are cut into segments with radii r
whose sum of r + 1 is one more than the distance (for distance 4: 22, 21 and 21 bits with radii 1, 1 and 0): two linked
fingerprints differ by at most r bits in one segment at least. Per segment:

1. each fingerprint stands in the table under its own value of the segment, and asks at all values of the ball of radius r
   around it (46 rows for distance 4);
2. where a question meets table rows, whole distances are compared. Only the pairs' connection is kept: what one task
   links comes out as a forest, so a bucket of near copies gives no more rows than it has members;
3. the forests of all tasks are joined to components, named by their smallest doc_id.

From 2^30 different fingerprints on there are two segments (32 bits, radii 2 and 1), so buckets stay small; the result is the
same. Values that more than `lot` fingerprints have in a segment are split: their table rows and questions are dealt to
lots, and every pair of lots meets in a task of its own. `lot` is at least a 2^16th of all table rows, so the list of such
values, which every task gets, has 2^16 entries at most.

Defined results: null counts as empty; texts without words have fingerprint zero, which links like any other; fewer than four
words are one shingle; words are compared with A-Z lower-cased; repeated rows and ids are kept; a component without any
doc_id has a null name; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables
from gridtide.llm.op10_token_groups import components

WIDTH = 4
SEED = 42
DISTANCE = 4
LOT = 4096
MOST_HOT = 1 << 16
PAIRS = 1 << 20
SHINGLES = 1 << 16


def fingerprints(column: pa.Array) -> np.ndarray:
    """A fingerprint per row."""
    words = kernel.words_of(column)
    raw = words.data.tobytes()
    line = b" ".join(w for a, b in zip(words.offs[:-1].tolist(), words.offs[1:].tolist(), strict=True) for w in raw[a:b].split())
    sizes = words.ends - words.starts
    start = np.cumsum(sizes + 1) - sizes - 1
    many = np.where(words.counts > 0, np.maximum(words.counts - WIDTH + 1, 1), 0)
    owner = np.repeat(np.arange(len(many)), many)
    begin = words.first[:-1][owner] + np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
    last = np.minimum(begin + WIDTH, words.first[1:][owner]) - 1
    counts = np.zeros((len(many), 64), np.int64)
    for at in range(0, len(owner), SHINGLES):
        own = owner[at : at + SHINGLES]
        a, b = start[begin[at : at + SHINGLES]], (start + sizes)[last[at : at + SHINGLES]]
        h = np.array([xxhash.xxh64_intdigest(line[x:y], SEED) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > many[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in kernel.texts(batches):
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fingerprints(batch.column("text")).view(np.int64))})


def plan(distinct: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """Segments (shift, bits, radius); a segment with radius -1 is not asked."""
    many = 3 if distinct < 1 << 30 else 2
    out, shift = [], 0
    for i in range(many):
        bits = 64 // many + (i < 64 % many)
        out.append((shift, bits, (distance + 1) // many + (i < (distance + 1) % many) - 1))
        shift += bits
    return out


def ball(bits: int, radius: int) -> np.ndarray:
    """All numbers of so many bits with at most `radius` of them set."""
    return np.array([sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(bits), r)], np.uint64)


def keys(fp: np.ndarray, segment: int, shift: int, bits: int) -> np.ndarray:
    """The segment's number and its value."""
    return ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)) | np.uint64(segment << 40)


class Lots:
    """Numbers of lots of table rows and of questions, by key; 1 for all keys that are not named."""

    def __init__(self, hot: dict[int, int], segments: list[tuple[int, int, int]], lot: int):
        asked: dict[int, int] = {}
        for key, n in hot.items():
            _, bits, radius = segments[key >> 40]
            for x in ball(bits, radius).tolist():
                asked[key ^ x] = asked.get(key ^ x, 0) + n
        self.key = np.array(sorted(asked), np.uint64)
        self.rows = np.array([-(-hot.get(k, 1) // lot) for k in self.key.tolist()], np.int64)
        self.questions = np.array([-(-asked[k] // lot) for k in self.key.tolist()], np.int64)

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.ones(len(key), np.int64)
        questions = rows.copy()
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            own = self.key[at] == key
            rows[own], questions[own] = self.rows[at[own]], self.questions[at[own]]
        return rows, questions


class _Dealt:
    """Table rows (asks 0) and questions (asks 1) of each fingerprint; a lot is a pair of a lot of questions and one of rows."""

    def __init__(self, segments: list[tuple[int, int, int]], lots):
        self.segments, self.lots = segments, lots

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            draw = (kernel.mix(fp + np.uint64(11)) >> np.uint64(33)).astype(np.int64)
            for number, (shift, bits, radius) in enumerate(self.segments):
                own = keys(fp, number, shift, bits)
                for asks, masks in ((0, ball(bits, 0)), (1, ball(bits, radius))):
                    for mask in masks:
                        key = own ^ mask
                        rows, questions = self.lots.value.of(key)
                        copies = rows if asks else questions
                        each = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                        rows, questions, d, k, f = (np.repeat(x, copies) for x in (rows, questions, draw, key, fp))
                        lot = d % questions * rows + each if asks else each * rows + d % rows
                        yield pa.record_batch({"key": pa.array(k.view(np.int64)), "lot": pa.array(lot.astype(np.int32)), "asks": pa.array(np.full(len(k), asks, np.int8)), "fp": pa.array(f.view(np.int64))})


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links a-b connect: fewer than there are ends."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    child, parent = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        high, low = np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart]
        np.minimum.at(root, high, low)
        merged = np.unique(high)
        child.append(merged)
        parent.append(root[merged])
        while (root != root[root]).any():
            root = root[root]
    return nodes[np.concatenate(child)], nodes[np.concatenate(parent)]


class _Meet:
    """Rows sorted by key, lot and asks -> edges between fingerprints."""

    def __init__(self, distance: int):
        self.distance = distance

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of a bucket that may go on
        for batch in batches:
            rows = [batch.column(x).to_numpy() for x in ("key", "lot", "asks", "fp")]
            if held and len(rows[0]) and (held[-1][0][-1], held[-1][1][-1]) != (rows[0][-1], rows[1][-1]):
                rows = [np.concatenate(x) for x in zip(*held, rows, strict=True)]
                held = []
            if not held and len(rows[0]):
                new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
                cut = int(new[-1]) if len(new) else 0
                yield from self.met(*(x[:cut] for x in rows))
                rows = [x[cut:] for x in rows]
            if len(rows[0]):
                held.append(rows)
        if held:
            yield from self.met(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def met(self, key: np.ndarray, lot: np.ndarray, asks: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        fp = fp.view(np.uint64)
        bucket = np.cumsum(np.concatenate(([False], (key[1:] != key[:-1]) | (lot[1:] != lot[:-1]))))
        start = np.searchsorted(bucket, np.arange(bucket[-1] + 1))
        many = np.bincount(bucket, weights=asks == 0).astype(np.int64)  # table rows come first
        question = np.flatnonzero((asks == 1) & (many[bucket] > 0))
        total = np.concatenate(([0], np.cumsum(many[bucket[question]])))
        at = 0
        while at < len(question):
            stop = max(int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1, at + 1)
            own = question[at:stop]
            n = many[bucket[own]]
            a = np.repeat(own, n)
            b = np.arange(len(a)) - np.repeat(total[at:stop] - total[at], n) + start[bucket[a]]
            x, y = fp[a], fp[b]
            near = (x < y) & (np.bitwise_count(x ^ y) <= self.distance)
            if near.any():
                a, b = forest(x[near].view(np.int64), y[near].view(np.int64))
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})
            at = stop


def links(prints: DataFrame, distance: int = DISTANCE, lot: int = LOT) -> DataFrame:
    """Different fingerprints (fp) -> edges (a, b) that connect all pairs within the distance."""
    sc = prints.sparkSession.sparkContext
    distinct = prints.count()
    segments = plan(distinct, distance)
    lot = max(lot, -(-len(segments) * distinct // MOST_HOT))
    values = F.array(*[F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(number << 40)) for number, (shift, bits, _) in enumerate(segments)])
    often = prints.select(F.explode(values).alias("key")).groupBy("key").count().where(F.col("count") > lot).toArrow()  # 2^16 rows at most
    hot = dict(zip(often.column("key").to_pylist(), often.column("count").to_pylist(), strict=True))
    dealt = prints.select("fp").mapInArrow(_Dealt(segments, sc.broadcast(Lots(hot, segments, lot))), "key long, lot int, asks byte, fp long")
    sorted_rows = dealt.repartition("key", "lot").sortWithinPartitions("key", "lot", "asks")
    return sorted_rows.mapInArrow(_Meet(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, lot: int = LOT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (16 hexadecimal digits), component_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = tables.stored(docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long"), "simhash")
    prints = tables.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("name")), "fingerprints")
    roots = components(links(prints, distance, lot)).select(F.col("class").alias("fp"), "root")
    rooted = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("name").alias("component_id"))
    named = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(tables.documents(spark, sf_dir))
