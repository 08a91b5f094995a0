"""Ranked lexical search by NRA: postings read in order of impact, with a lower and an upper score for every document.

All documents are ranked for each question text. A term's impact in a document and its weight are whole numbers, so scores are
exact and equal ones are ties, which the smaller doc_id wins:

1. One pass over the documents finds the postings of the questions' terms and counts what weights need: documents with a term,
   all terms, documents per term. Postings are written packed, per stretch of text.
2. Shards of documents (parts of a task) hold one list per term, sorted by falling impact. Per question its lists are read from
   the top, all together and in growing blocks. What a document got so far is its lower score; with the next unread
   impact of every list where it was not met, its upper score. Reading goes on until every document whose upper score reaches
   the k-th best lower score (of this shard or of earlier ones of the task) has both equal: then membership, ties and scores
   are resolved, also of documents never met.
3. At most k rows per question and task go on; the best k are taken per salt, then per question.

Questions are handled in blocks of about `CHARS` characters of text, which bounds what every task gets; each block takes one
pass over the documents, whose postings are bounded by a shard in memory (`DOCS` documents).

Defined results: null and empty texts have no terms, match nothing and count nowhere; a question without terms, or whose terms no
document holds, has no rows; equal question rows are one question, rows of one item_id with different texts are questions of
their own; repeated documents rank one after the other; a null doc_id comes last among equal scores; other columns are
ignored; empty tables give an empty result. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables

K = 10
CHARS = 4 << 20
DOCS = 1 << 14
FIRST = 64
SALTS = 64
POSTINGS, TERMS = 0, 1


def weight(n: int, df: int) -> int:
    """A term's weight; n documents have a term, df of them this one."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class _Postings:
    """Packed postings of the given terms (ascending hashes), and per task what it counted."""

    def __init__(self, terms, kind: str):
        self.terms, self.kind = terms, kind

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = self.terms.value
        df = np.zeros(len(terms), np.int64)
        ids = None
        for batch in kernel.texts(batches):
            words = kernel.words_of(batch.column("text"), kernel.WORD_BYTE)
            h = words.hashes()
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            hit = terms[at] == h
            pair, tf = np.unique(words.doc[hit] * len(terms) + at[hit], return_counts=True)
            doc, term = np.divmod(pair, len(terms))
            df += np.bincount(term, minlength=len(terms))
            some, place = np.unique(doc, return_inverse=True)
            ids = batch.column("doc_id").take(pa.array(some))
            packed = (words.counts[some].astype(np.int64), place.astype(np.uint32), term.astype(np.uint32), tf.astype(np.uint32))
            own = {x: pa.array([v.tobytes()], pa.binary()) for x, v in zip(("n", "doc", "term", "tf"), packed, strict=True)}
            yield self.row(POSTINGS, ids, own, int(np.count_nonzero(words.counts)), len(h))
        if ids is not None:
            own = {x: pa.array([v.tobytes()], pa.binary()) for x, v in (("n", df), ("doc", b""), ("term", np.arange(len(terms), dtype=np.uint32)), ("tf", b"")) if len(v)}
            yield self.row(TERMS, ids.slice(0, 0), own, 0, 0)

    @staticmethod
    def row(kind: int, ids: pa.Array, own: dict, docs: int, words: int) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        packed = {x: own.get(x, pa.nulls(1, pa.binary())) for x in ("n", "doc", "term", "tf")}
        return pa.record_batch({"kind": pa.array([kind], pa.int32()), "ids": lists} | packed | {"docs": pa.array([docs], pa.int64()), "words": pa.array([words], pa.int64())})


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of TERMS -> (term, df)."""
    for batch in batches:
        for term, df in zip(batch.column("term"), batch.column("n"), strict=True):
            df = np.frombuffer(df.as_buffer(), np.int64)
            own = df > 0
            yield pa.record_batch({"term": pa.array(np.frombuffer(term.as_buffer(), np.uint32)[own].astype(np.int64)), "df": pa.array(df[own])})


def nra(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, floor: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents and their scores, but none below `floor`. lists: documents and their impacts, highest first;
    order: of documents with equal scores."""
    low = np.zeros(docs, np.int64)
    met = np.zeros((len(lists), docs), bool)
    block, at = FIRST, 0
    while True:
        upper, rest = low, 0  # both grow: low by what is read now
        nexts = []
        for j, (doc, impact) in enumerate(lists):
            own = doc[at : at + block]
            low[own] += impact[at : at + block]
            met[j, own] = True
            if at + block < len(doc):
                nexts.append((j, impact[at + block]))
                rest += int(impact[at + block])
        at, block = at + block, 2 * block
        best = int(np.partition(low, docs - k)[docs - k]) if docs >= k else 0
        bar = max(floor, best, 1)
        upper = low + rest
        for j, impact in nexts:
            upper[met[j]] -= impact
        alive = np.flatnonzero(upper >= bar)
        if (upper[alive] == low[alive]).all():
            break
    first = np.lexsort((order[alive], -low[alive]))[:k]
    return alive[first], low[alive[first]]


class _Ranked:
    """Packed postings -> the best rows of each question in this task. questions: (item, item_id, terms, times)."""

    def __init__(self, questions, weights, n: int, total: int, k: int, kinds: tuple[pa.DataType, ...]):
        self.questions, self.weights, self.n, self.total, self.k, self.kinds = questions, weights, n, total, k, kinds

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, object]]] = {}
        held: list[tuple] = []
        docs = 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                n, doc, term, tf = (np.frombuffer(batch.column(x)[i].as_buffer(), kind) for x, kind in (("n", np.int64), ("doc", np.uint32), ("term", np.uint32), ("tf", np.uint32)))
                for lo in range(0, len(ids), DOCS):  # postings are sorted by document
                    a, b = np.searchsorted(doc, [lo, lo + DOCS])
                    held.append((ids.slice(lo, DOCS), n[lo : lo + DOCS], doc[a:b].astype(np.int64) - lo + docs, term[a:b].astype(np.int64), tf[a:b].astype(np.int64)))
                    docs += len(held[-1][0])
                    if docs >= DOCS:
                        self.shard(held, best)
                        held, docs = [], 0
        if held:
            self.shard(held, best)
        rows = [(item, self.questions.value[item][0], i, -score) for item, found in best.items() for score, _, i in found]
        if rows:
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), self.kinds[0], self.kinds[1], pa.int64())
            yield pa.record_batch({x: pa.array(list(v), kind) for x, v, kind in zip(("item", "item_id", "doc_id", "score"), columns, kinds, strict=True)})

    def shard(self, held: list[tuple], best: dict[int, list[tuple[int, bool, object]]]) -> None:
        ids = pa.concat_arrays([h[0] for h in held])
        n, doc, term, tf = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
        order = np.empty(len(ids), np.int64)
        order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        m = 100 - 75 + (75 * n * self.n) // self.total
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        by = np.lexsort((-impact, term))
        doc, term, impact = doc[by], term[by], impact[by]
        weights = self.weights.value
        start = np.searchsorted(term, np.arange(len(weights) + 1))
        for item, (_, terms, times) in enumerate(self.questions.value):
            lists = [(doc[start[t] : start[t + 1]], impact[start[t] : start[t + 1]] * (int(weights[t]) * c)) for t, c in zip(terms, times, strict=True) if start[t] < start[t + 1] and weights[t] > 0]
            if not lists:
                continue
            found = best.get(item, [])
            top, score = nra(lists, len(ids), self.k, -found[-1][0] if len(found) == self.k else 0, order)
            more = [(-s, i is None, i) for s, i in zip(score.tolist(), ids.take(pa.array(top)).to_pylist(), strict=True)]
            if more:
                best[item] = sorted(found + more, key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))[: self.k]


def blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The different rows (item_id, text) with a text, in blocks of about `CHARS` characters."""
    items = items.select("item_id", "text").where("text is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    many = max(1, -(-chars // CHARS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(many)))
    for i in range(many):
        got = dealt.where(F.col("block") == i).collect()  # of bounded size
        if got:
            yield [(r.item_id, r.text) for r in sorted(got, key=lambda r: (str(r.item_id), r.text))]


def questions_of(block: list[tuple[object, str]]) -> tuple[np.ndarray, list[tuple[object, list[int], list[int]]]]:
    """Hashes of all terms, ascending, and per question its id, the places of its terms in them, and how often each stands."""
    words = kernel.words_of(pa.array([text for _, text in block], pa.string()), kernel.WORD_BYTE)
    terms, place = np.unique(words.hashes(), return_inverse=True)
    out = []
    for (item, _), a, b in zip(block, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        own, times = np.unique(place[a:b], return_counts=True)
        out.append((item, own.tolist(), times.tolist()))
    return terms, out


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score: the k best of all documents per item."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select("doc_id", "text")
    kind, own = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id")))
    kinds = tuple(t.select(c).limit(0).toArrow().schema.field(c).type for t, c in ((items, "item_id"), (docs, "doc_id")))
    out = spark.createDataFrame([], f"item_id {own}, rank int, doc_id {kind}, score long")
    for block in blocks(items):
        terms, questions = questions_of(block)
        if not len(terms):
            continue
        schema = f"kind int, ids array<{kind}>, n binary, doc binary, term binary, tf binary, docs long, words long"
        packed = tables.stored(docs.mapInArrow(_Postings(sc.broadcast(terms), kind), schema), "postings")
        n, total = packed.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        counted = packed.where(F.col("kind") == TERMS).select("term", "n").mapInArrow(_counted, "term long, df long")
        found = counted.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # terms of one block
        weights = np.zeros(len(terms), np.int64)
        for t, df in zip(found.column("term").to_pylist(), found.column("df").to_pylist(), strict=True):
            weights[t] = weight(n, df)
        ranked = _Ranked(sc.broadcast(questions), sc.broadcast(weights), n, total, k, kinds)
        rows = packed.where(F.col("kind") == POSTINGS).select("ids", "n", "doc", "term", "tf").mapInArrow(ranked, f"item long, item_id {own}, doc_id {kind}, score long")
        out = out.unionByName(best_of(rows, k))
    return out


def best_of(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item: per salt first, so no item meets in one task as a whole."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(tables.documents(spark, sf_dir), tables.table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE_SQL = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
counted AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS} AS term FROM rows) GROUP BY r, doc_id, term),
sized AS (SELECT r, sum(tf)::BIGINT AS n FROM counted GROUP BY r),
whole AS (SELECT count(*) AS many, sum(n)::BIGINT AS total FROM sized),
spread AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
asked AS (SELECT item_id, text, {_TERMS} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
scored AS (
  SELECT item_id, text, counted.r, any_value(doc_id) AS doc_id,
    sum(floor(1000 * ln((2 * many + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * many) // total))))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN spread USING (term) JOIN sized ON sized.r = counted.r CROSS JOIN whole
  GROUP BY item_id, text, counted.r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
WHERE rank <= {K}
"""
