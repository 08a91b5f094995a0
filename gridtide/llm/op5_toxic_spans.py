"""Toxicity by a linear-chain conditional random field over words.

The field has two states, clean and toxic. A word's potential comes from the word itself and its two neighbours (hashed
weights); neighbouring states have transition potentials. Forward-backward gives each word's marginal probability of the
toxic state; runs of words at 0.5 or more are the offending offsets, and a logistic over the largest marginal, their sum
and their density is the document's score.

Labelled tokens: the labels mark documents, so the words of a toxic training document are labelled toxic if they occur in
toxic documents far above their rate in others (likelihood ratio), as strongly as half of the document's strongest word;
all other words are labelled clean.

Learning uses a sample of at most 1000 x `salts` labelled documents for each value of the label (the lowest hashes of
doc_id, repeated texts once), whole texts, in one task; documents of each label are weighted to their share among all
training labels.

Defined results: null counts as empty; a text without words gets the score of a text whose marginals are all 0; without a
label of both kinds every score is the share of label 1 among the training labels (0.5 without labels); null doc_id is
not held out and not learned from; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables

BITS = 18
_STEP = 64


def scan(m: np.ndarray) -> np.ndarray:
    """Row vectors v[t] = v[t-1] m[t], scaled to sum 1, from (0.5, 0.5). m: (4, n) as m00, m01, m10, m11.

    The chain is cut into stretches whose matrix products are taken side by side; a short pass over the products gives each
    stretch its first vector."""
    n = m.shape[1]
    k = -(-n // _STEP)
    padded = np.zeros((4, k * _STEP))
    padded[:, :n] = m
    padded[0, n:] = padded[3, n:] = 1.0
    steps = np.ascontiguousarray(padded.reshape(4, k, _STEP).transpose(2, 0, 1))
    p = np.zeros((4, k))
    p[0] = p[3] = 1.0
    for a, b, c, d in steps:
        p = np.stack((p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d))
        p /= p.max(0)
    first = np.empty((2, k))
    x, y = 0.5, 0.5
    for i, (a, b, c, d) in enumerate(p.T.tolist()):
        first[0, i], first[1, i] = x, y
        x, y = x * a + y * c, x * b + y * d
        total = x + y
        x, y = x / total, y / total
    out = np.empty((_STEP, 2, k))
    x, y = first
    for j, (a, b, c, d) in enumerate(steps):
        x, y = x * a + y * c, x * b + y * d
        total = x + y
        x, y = x / total, y / total
        out[j, 0], out[j, 1] = x, y
    return out.transpose(1, 2, 0).reshape(2, k * _STEP)[:, :n]


def chain(potential: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors and backward vectors of all rows' chains at once. potential: log-potential of the toxic state."""
    n = len(potential)
    e = np.exp(np.clip(potential, -30, 30))
    t = np.exp(trans)
    ahead = np.stack((np.full(n, t[0]), t[1] * e, np.full(n, t[2]), t[3] * e))
    back = ahead.copy()
    ahead[:, starts] = np.stack((np.ones(len(starts)), e[starts], np.ones(len(starts)), e[starts]))
    back[:, starts] = 0.5  # nothing is known after the end of a row
    alpha = scan(ahead)
    beta = np.full((2, n), 0.5)
    if n > 1:
        beta[:, :-1] = scan(back[[0, 2, 1, 3], :0:-1])[:, ::-1]
    return alpha, beta


def marginals(potential: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    if not len(potential):
        return np.zeros(0)
    alpha, beta = chain(potential, starts, trans)
    both = alpha * beta
    return both[1] / np.maximum(both.sum(0), 1e-300)


class Rows:
    """Words of several rows: how many each has, where each begins, and the row of each word."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.starts = self.first[:-1][counts > 0]


def features(h: np.ndarray, rows: Rows) -> np.ndarray:
    """Cells of the word, the word before and the word after, one row each; cell 0 of a kind stands for none."""
    out = np.zeros((3, len(h)), np.int32)
    out[0] = h >> np.uint64(64 - BITS)
    side = (kernel.mix(h) >> np.uint64(64 - BITS + 1)).astype(np.int32)
    out[1, 1:], out[2, :-1] = side[:-1], side[1:]
    out[1, rows.starts] = 0
    out[2, rows.first[1:][rows.counts > 0] - 1] = 0
    return out


def potentials(cells: np.ndarray, w: dict) -> np.ndarray:
    return w["bias"] + w["own"][cells[0]] + w["left"][cells[1]] + w["right"][cells[2]]


def summary(p: np.ndarray, words: Rows | kernel.Words) -> np.ndarray:
    """Per row: log-odds of the largest marginal, log of the sum of marginals, marginals per hundred words."""
    n = words.counts
    total = np.concatenate(([0.0], np.cumsum(p)))
    sums = np.maximum(total[words.first[1:]] - total[words.first[:-1]], 0)
    top = np.zeros(len(n))
    some = np.flatnonzero(n > 0)
    if len(some):
        top[some] = np.maximum.reduceat(p, words.first[some])
    odds = np.log(np.clip(top, 1e-4, 1 - 1e-4) / (1 - np.clip(top, 1e-4, 1 - 1e-4)))
    return np.stack((odds, np.log1p(sums), np.minimum(100 * sums / np.maximum(n, 1), 20)), 1)


def token_labels(words: Rows, h: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for the words of toxic rows that speak for the label."""
    key, at = np.unique(h, return_inverse=True)
    pairs = np.unique(at.astype(np.int64) * len(words.counts) + words.doc)
    word, row = pairs // len(words.counts), pairs % len(words.counts)
    n1, n0 = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    d1 = np.bincount(word[toxic[row]], minlength=len(key)).astype(float)
    d0 = np.bincount(word[~toxic[row]], minlength=len(key)).astype(float)
    rate = (d1 + d0) / (n1 + n0)
    gain = 2 * (d1 * np.log(np.maximum(d1, 1e-9) / (n1 * rate)) + d0 * np.log(np.maximum(d0, 1e-9) / (n0 * rate)))
    lift = ((d1 + 0.5) / (n1 + 1)) / ((d0 + 0.5) / (n0 + 1))
    gain[(lift < 5) | (d1 < 2)] = 0
    mine = np.where(toxic[words.doc], gain[at], 0)
    top = np.zeros(len(words.counts))
    some = np.flatnonzero(words.counts > 0)
    if len(some):
        top[some] = np.maximum.reduceat(mine, words.first[some])
    return (mine > 0) & (mine >= 0.5 * top[words.doc])


Part = tuple[np.ndarray, np.ndarray, np.ndarray]  # cells, starts of rows, labels


def gradient(part: Part, w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of one part: label minus marginal of each word, and of the four transitions."""
    cells, starts, y = part
    s, t = potentials(cells, w), np.exp(w["trans"])
    alpha, beta = chain(s, starts, w["trans"])
    both = alpha * beta
    p = both[1] / np.maximum(both.sum(0), 1e-300)
    inner = np.ones(len(y), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    e = np.exp(np.clip(s[inner], -30, 30))
    pair = np.stack([alpha[a][inner - 1] * t[2 * a + b] * (e if b else 1.0) * beta[b][inner] for a in (0, 1) for b in (0, 1)])
    expected = (pair / np.maximum(pair.sum(0), 1e-300)).sum(1)
    seen = np.bincount(2 * y[inner - 1].astype(int) + y[inner], minlength=4)
    return y - p, seen - expected


def fit_field(parts: list[Part], rounds: int = 50, rate: float = 0.3, ridge: float = 1e-6) -> dict:
    """Maximum likelihood by Adam on full gradients, summed part by part."""
    n = sum(len(y) for _, _, y in parts)
    sizes = {"own": 1 << BITS, "left": 1 << (BITS - 1), "right": 1 << (BITS - 1)}
    w = {k: np.zeros(v) for k, v in sizes.items()} | {"bias": np.array(-4.0), "trans": np.zeros(4)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for r in range(1, rounds + 1):
        grad = {k: -ridge * w[k] for k in sizes} | {"bias": np.array(0.0), "trans": np.zeros(4)}
        for part in parts:
            miss, trans = gradient(part, w)
            for i, k in enumerate(sizes):
                grad[k] += np.bincount(part[0][i], miss / n, sizes[k])
            grad["bias"] = grad["bias"] + miss.sum() / n
            grad["trans"] += trans / n
        grad["trans"][0] = 0.0
        for k, g in grad.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w[k] = w[k] + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x1 = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x1.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        g = x1.T @ (weight * (y - q)) - ridge * b
        hess = (x1 * (weight * q * (1 - q))[:, None]).T @ x1 + ridge * np.eye(len(b))
        b = b + np.clip(np.linalg.solve(hess, g), -2, 2)
    return b


class _Fit:
    """One task over the bounded sample: labelled texts in, one row with the model's arrays out."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: dict = {"share": np.array(self.counts.get(1, 0) / max(sum(self.counts.values()), 1) if self.counts else 0.5)}
        marks, hashes, counts = [], [], []
        for batch in kernel.texts(batches):
            words = kernel.words_of(batch.column("text"), kernel.WORD_BYTE)
            marks.append(batch.column("toxic").to_numpy() == 1)
            hashes.append(words.hashes())
            counts.append(words.counts)
        toxic = np.concatenate(marks) if marks else np.zeros(0, bool)
        if toxic.any() and not toxic.all():
            h, rows = np.concatenate(hashes), Rows(np.concatenate(counts))
            y = token_labels(rows, h, toxic)
            parts, at = [], 0
            for mine, n in zip(hashes, counts, strict=True):
                some = Rows(n)
                parts.append((features(mine, some), some.starts, y[at : at + len(mine)]))
                at += len(mine)
            parts = [x for x in parts if len(x[2])]
            if parts:
                w = fit_field(parts)
                x = summary(np.concatenate([marginals(potentials(c, w), s, w["trans"]) for c, s, _ in parts]), rows)
                weight = np.where(toxic, self.counts[1] / toxic.sum(), self.counts[0] / (~toxic).sum())
                model |= w | {"logistic": fit_logistic(x, toxic.astype(float), weight * len(toxic) / weight.sum())}
        out = io.BytesIO()
        np.savez_compressed(out, **model)
        yield pa.record_batch({"model": pa.array([out.getvalue()], pa.binary())})


def learn(docs: DataFrame, labels: DataFrame, salts: int = 3) -> dict:
    """docs (doc_id, text) and labels (doc_id, toxic) of the training fold -> the model's arrays (2^19 weights)."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = tables.lowest_hashes(known, "toxic", salts)
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").dropDuplicates(["toxic", "text"])
    model = sample.repartition(1).sortWithinPartitions("doc_id", "text").select("toxic", "text").mapInArrow(_Fit(counts), "model binary").first()
    if model is None:  # no row reached a task
        return {"share": np.array(counts.get(1, 0) / sum(counts.values()) if counts else 0.5)}
    return dict(np.load(io.BytesIO(model[0])))


class _Score:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = self.model.value
        for batch in kernel.texts(batches):
            words = kernel.words_of(batch.column("text"), kernel.WORD_BYTE)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            if "logistic" in w:
                rows = Rows(words.counts)
                p = marginals(potentials(features(words.hashes(), rows), w), rows.starts, w["trans"])
                score = 1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(words.counts)), summary(p, words))) @ w["logistic"], -30, 30)))
                self._spans(words, p, spans)
            else:
                score = np.full(batch.num_rows, float(w["share"]))
            kept = {x: batch.column(x) for x in batch.schema.names if x != "text"}
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch(kept | {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32)), "spans": pa.array(spans, kind)})

    @staticmethod
    def _spans(words: kernel.Words, p: np.ndarray, spans: list[list]) -> None:
        """Runs of toxic words of a row, as code-point offsets."""
        hit = np.flatnonzero(p >= 0.5)
        if not len(hit):
            return
        point = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
        joined = np.zeros(len(hit), bool)
        joined[1:] = (hit[1:] == hit[:-1] + 1) & (words.doc[hit[1:]] == words.doc[hit[:-1]])
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(hit)) - 1
        for a, b in zip(hit[first].tolist(), hit[last].tolist(), strict=True):
            row = words.doc[a]
            base = point[words.offs[row]]
            spans[row].append({"start": int(point[words.starts[a]] - base), "end": int(point[words.ends[b]] - base)})


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of docs but text, and score, predicted, spans (code-point offsets of toxic runs), in place of columns of
    these names."""
    docs = docs.drop("score", "predicted", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", score double, predicted int, spans array<struct<start: long, end: long>>"
    return docs.mapInArrow(_Score(shared), schema)


def training(docs: DataFrame, labels: DataFrame) -> dict:
    """The model learned from the training fold."""
    mine = tables.fold(5) != 0
    return learn(docs.where(mine), labels.where(mine))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    model = training(docs, tables.table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", F.coalesce(tables.fold(5) == 0, F.lit(False)).alias("held_out"), "text"), model)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose score is 0.5 or more; learned from the given documents and labels. Without labels of both
    kinds nothing can be learned, and all documents stay."""
    model = training(tables.documents(spark, sf_dir), tables.table(spark, sf_dir, "labels"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_Keep(shared), docs.schema)


class _Keep(_Score):
    """The rows whose prediction is 0, unchanged; all rows where no model was fitted."""

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "logistic" not in self.model.value:
            yield from batches
            return
        for batch in kernel.texts(batches):
            (scored,) = super().__call__([batch.select(["text"])])
            yield batch.filter(pc.equal(scored.column("predicted"), 0))
