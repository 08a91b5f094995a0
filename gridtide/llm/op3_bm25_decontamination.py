"""Benchmark decontamination by BM25 retrieval with essential postings.

Test items (cut into segments of at most `SEGMENT` words) form an inverted index. Impacts are BM25 weights divided by the
segment's score for its own words, so 1 means that a passage has all of them. Every passage of every document (windows of
`WINDOW` words, `STEP` apart; a segment lies whole in one of them) is a query, and all items at `threshold` or more are
retrieved. As in MaxScore, bounds decide what is scored: a segment's most common words, up to a share `SPARE` of the threshold,
make no candidates; a passage is scored against a segment if the segment's other words that it has can reach the threshold
together with these. Bounds are never below the score, so nothing is lost.

A retrieved item counts if the text around the passage has at least `overlap` of the word trigrams of its question and of
its answer. `benchmark` has one text per item: its last third is taken as the answer.

The index is broadcast in parts of at most `ITEMS` items and `CHARS` characters (a longer item stands alone); each part
passes over all documents.

Defined results: null and empty texts and items without words match nothing; repeated rows are treated alike; equal items
with several ids are all reported; an empty benchmark leaves all documents; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables

SEGMENT, WINDOW, STEP = 64, 96, 32
ITEMS, CHARS = 2000, 8 << 20
SPARE = 0.8
K1, B = 1.2, 0.75


def spread(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a grouped list for groups `at`: (which of `at`, place in the list)."""
    n = first[at + 1] - first[at]
    owner = np.repeat(np.arange(len(at)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


class Index:
    """Postings of item segments, grouped by word."""

    def __init__(self, items: list[tuple[int, str]]):
        words = kernel.words_of(pa.array([t for _, t in items], pa.large_string()), kernel.WORD_BYTE)
        h = words.hashes()
        self.ids = [i for i, _ in items]
        self.words = [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.terms, term = np.unique(h, return_inverse=True)
        place = np.arange(len(h)) - words.first[words.doc] if len(h) else np.zeros(0, int)
        per_item = np.maximum(-(-words.counts // SEGMENT), 1)
        base = np.cumsum(per_item) - per_item
        segment = base[words.doc] + place // SEGMENT if len(h) else np.zeros(0, int)
        self.segments = int(per_item.sum())
        self.item = np.repeat(np.arange(len(items)), per_item)
        key, tf = np.unique(term.astype(np.int64) * self.segments + segment, return_counts=True)
        term, segment = key // self.segments, key % self.segments
        length = np.bincount(segment, tf, self.segments)
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((self.segments - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[segment] / max(length.mean(), 1e-9))) if len(key) else np.zeros(0)
        own = np.bincount(segment, weight, self.segments)
        self.impact, self.segment = weight / own[segment], segment
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.key, self.term, self.df = key, term, df
        self._essential: dict[float, tuple[np.ndarray, ...]] = {}

    def essential(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Postings that make candidates (offsets by word, segments, impacts), and what a segment's other words add at most."""
        if threshold not in self._essential:
            order = np.lexsort((self.term, -self.df[self.term], self.segment))
            impact, segment = self.impact[order], self.segment[order]
            total = np.cumsum(impact)
            starts = np.searchsorted(segment, np.arange(self.segments))
            other = np.zeros(len(order), bool)
            other[order] = total - (total - impact)[np.minimum(starts, max(len(order) - 1, 0))][segment] <= SPARE * threshold
            rest = np.bincount(self.segment[other], self.impact[other], self.segments)
            first = np.searchsorted(self.term[~other], np.arange(len(self.terms) + 1))
            self._essential[threshold] = first, self.segment[~other], self.impact[~other], rest
        return self._essential[threshold]

    def retrieve(self, words: kernel.Words, h: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word of the passage, segment, score) of all passages and segments at the threshold or more."""
        empty = np.zeros(0, np.int64)
        none = (empty, empty, empty, np.zeros(0))
        if not len(self.terms) or not len(h):
            return none
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[at] == h
        first, segments, impacts, rest = self.essential(threshold)
        hit = np.flatnonzero(known & (np.diff(first) > 0)[at])
        # Cells of STEP words; a row's passages begin at its cells and take WINDOW // STEP of them.
        cells = -(-words.counts // STEP)
        cell0 = np.concatenate(([0], np.cumsum(cells)))
        row = words.doc[hit]
        cell = cell0[row] + (hit - words.first[row]) // STEP
        pairs = distinct(cell.astype(np.int64) * len(self.terms) + at[hit])
        o, p = spread(first, pairs % len(self.terms))
        cell, segment, impact = pairs[o] // len(self.terms), segments[p], impacts[p]
        start = cell0[np.searchsorted(cell0, cell, side="right") - 1]
        keys, parts = [], []
        for j in range(WINDOW // STEP):  # a word in several cells of a passage adds up: still a bound
            inside = cell - j >= start
            keys.append((cell[inside] - j) * self.segments + segment[inside])
            parts.append(impact[inside])
        key, part = np.concatenate(keys), np.concatenate(parts)
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else empty
        if not len(starts):
            return none
        key, bound = key[starts], np.add.reduceat(part[order], starts)
        some = key[bound + rest[key % self.segments] >= threshold - 1e-9]
        # Scores of the passages that are left, over their distinct words.
        cell, segment = some // self.segments, some % self.segments
        owner = np.searchsorted(cell0, cell, side="right") - 1
        begin = words.first[owner] + (cell - cell0[owner]) * STEP
        n = np.minimum(begin + WINDOW, words.first[owner + 1]) - begin
        query = np.repeat(np.arange(len(some)), n)
        place = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + begin[query]
        pairs = distinct((query * len(self.terms) + at[place])[known[place]])
        query, posting = pairs // len(self.terms), pairs % len(self.terms) * self.segments
        posting += segment[query]
        place = np.minimum(np.searchsorted(self.key, posting), len(self.key) - 1)
        hit = self.key[place] == posting
        score = np.bincount(query[hit], self.impact[place[hit]], len(some))
        good = score >= threshold
        return owner[good], begin[good], segment[good], score[good]

    def overlaps(self, item: int, around: np.ndarray) -> tuple[float, float]:
        """Shares of the word trigrams of the item's question and answer that the text around has."""
        own = self.words[item]
        cut = len(own) - max(1, len(own) // 3)
        parts = (own[:cut], own[cut:]) if cut else (own, own)
        return tuple(len(a & grams(around, len(x))) / len(a) for x in parts for a in [grams(x, len(x))])

    def contaminated(self, column: pa.Array, threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """{(row, item): (score, question overlap, answer overlap)} of verified items."""
        words = kernel.words_of(column, kernel.WORD_BYTE)
        h = words.hashes()
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for row, at, segment, score in zip(*(x.tolist() for x in self.retrieve(words, h, threshold)), strict=True):
            item = int(self.item[segment])
            n = len(self.words[item])
            around = h[max(words.first[row], at - n) : min(words.first[row + 1], at + WINDOW + n)]
            q, a = self.overlaps(item, around)
            if q >= overlap and a >= overlap:
                best = found.get((row, item))
                found[row, item] = max(best, (score, q, a)) if best else (score, q, a)
        return found


def grams(words: np.ndarray, n: int) -> set:
    """Trigrams; of a part of n < 3 words runs of n words."""
    n = min(max(n, 1), 3)
    listed = words.tolist()
    return set(zip(*(listed[j:] for j in range(n)), strict=False))


class _Pairs:
    def __init__(self, index, threshold: float, overlap: float):
        self.index, self.threshold, self.overlap = index, threshold, overlap

    def found(self, batch: pa.RecordBatch):
        return self.index.value.contaminated(batch.column("text"), self.threshold, self.overlap)

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.texts(batches):
            got = sorted(self.found(batch).items())
            if got:
                cols = {
                    "doc_id": batch.column("doc_id").take(pa.array([row for (row, _), _ in got])),
                    "item_id": pa.array([self.index.value.ids[item] for (_, item), _ in got], pa.int64()),
                }
                values = {k: pa.array([v[i] for _, v in got], pa.float64()) for i, k in enumerate(("score", "question_overlap", "answer_overlap"))}
                yield pa.record_batch(cols | values)


class _Clean(_Pairs):
    """Rows without a verified item, unchanged."""

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.texts(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, _ in self.found(batch)]] = False
            yield batch.filter(pa.array(keep))


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over parts of the benchmark, each of a bounded size."""
    items = benchmark.select("item_id", "text").where("text is not null and item_id is not null")
    span = F.floor(F.sum(F.length("text")).over(Window.partitionBy("chunk").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0)) / CHARS)
    rank = F.floor((F.row_number().over(Window.partitionBy("chunk").orderBy("item_id", "text")) - 1) / ITEMS)
    n = items.count()
    chunked = items.withColumn("chunk", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n // 50_000))))
    parts = chunked.withColumn("span", span).withColumn("rank", rank)
    keys = parts.select("chunk", "span", "rank").distinct().orderBy("chunk", "span", "rank").collect()
    for k in keys:
        mine = parts.where((F.col("chunk") == k.chunk) & (F.col("span") == k.span) & (F.col("rank") == k["rank"]))
        yield Index([(r.item_id, r.text) for r in mine.select("item_id", "text").orderBy("item_id", "text").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.4) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of all verified items in all documents."""
    sc = docs.sparkSession.sparkContext
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(_Pairs(sc.broadcast(index), threshold, overlap), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.4) -> DataFrame:
    """docs without those that hold a verified item."""
    sc = docs.sparkSession.sparkContext
    for index in indexes(benchmark):
        docs = docs.mapInArrow(_Clean(sc.broadcast(index), threshold, overlap), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(tables.documents(spark, sf_dir), tables.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return clean(docs, tables.table(spark, sf_dir, "benchmark"))
