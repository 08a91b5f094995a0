"""Language identification by bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of the byte n-grams that are typical for it. All filters share their hash functions,
so cell i of all of them is one integer whose bit l belongs to language l: AND-ing the cells of an n-gram gives the set of
languages that contain it. A text's languages are counted over its n-grams, each count is corrected for the filter's
false-positive rate, and the largest corrected count decides (ties: the first name).

Learning uses a sample of at most 1000 x `salts` labelled documents of each language (the lowest hashes of doc_id) and
whole texts of them. An n-gram belongs to a language if its relative frequency there is at least `share` of its largest
relative frequency in any language and it occurs twice or more.

Defined results: null text or text without a letter gives `und` and score 0; no learned language gives `und`; a text none
of whose n-grams is known gets the first language and score 0; null doc_id is not held out, and not learned from; repeated rows are
scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables

GRAM = 4
HASHES = 2
#: Bytes after lower-casing: letters and everything beyond ASCII stay, all else is a gap.
_GAP = np.full(256, 0x20, np.uint8)
_GAP[0x61:0x7B] = np.arange(0x61, 0x7B)
_GAP[0x80:] = np.arange(0x80, 0x100)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the rows, and the offset of each row's first one. Windows that begin with two gaps are left out."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    gap, gaps = pa.scalar(" ", pa.large_string()), pa.scalar("   ", pa.large_string())
    padded = pc.binary_join_element_wise(gap, lower, gaps, pa.scalar("", pa.large_string()))
    data, offs = kernel.flat(padded)
    data = _GAP[data]
    n = max(len(data) - GRAM + 1, 0)
    codes = np.zeros(n, np.uint64)
    for j in range(GRAM):
        codes = (codes << np.uint64(8)) | data[j : j + n]
    good = ~((data[:n] == 0x20) & (data[1 : n + 1] == 0x20)) if n else np.zeros(0, bool)
    for j in range(1, GRAM):  # windows over the end of a row
        ends = offs[1:] - j
        good[ends[(ends >= 0) & (ends < n)]] = False
    at = np.flatnonzero(good)
    return codes[at], np.searchsorted(at, offs)


def cells(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(kernel.mix(codes * np.uint64(2) + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in range(HASHES)]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams per language in this partition."""
    got: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in kernel.texts(batches):
        codes, first = grams(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        row = np.repeat(np.arange(len(langs)), np.diff(first))
        for lang in sorted(set(langs)):
            mine = np.array([x == lang for x in langs])
            keys, n = np.unique(codes[mine[row]], return_counts=True)
            if lang in got:
                both, at = np.unique(np.concatenate((got[lang][0], keys)), return_inverse=True)
                keys, n = both, np.bincount(at, np.concatenate((got[lang][1], n)), len(both)).astype(np.int64)
            got[lang] = (keys, n)
    for lang, (keys, n) in got.items():
        yield pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def training_sample(docs: DataFrame, salts: int) -> DataFrame:
    """Whole texts of at most 1000 x `salts` documents of each language, chosen by the hash of doc_id."""
    ids = tables.lowest_hashes(docs.select("doc_id", "lang").where("lang is not null and doc_id is not null").distinct(), "lang", salts)
    return docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])


def learn(docs: DataFrame, salts: int = 2, share: float = 0.35, bits: int = 20) -> dict:
    """Languages, one integer of language bits per cell, and each language's false-positive rate."""
    sample = training_sample(docs, salts)
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = tables.stored(counts, "language-grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    planes = []
    for at in range(0, len(names), 63):
        some = names[at : at + 63]
        places = F.create_map(*[F.lit(x) for i, lang in enumerate(names) for x in (lang, i - at)]) if names else None
        sizes = F.create_map(*[F.lit(x) for lang in names for x in (lang, float(max(totals[lang], 1)))])
        rel = counts.select("gram", "n", places[F.col("lang")].alias("bit"), (F.col("n") / sizes[F.col("lang")]).alias("rel"))
        per_gram = rel.groupBy("gram").agg(F.max("rel").alias("top"), F.collect_list(F.struct("bit", "rel", "n")).alias("ls"))
        keep = F.filter("ls", lambda x: (x.rel >= F.col("top") * share) & (x.n >= 2) & x.bit.between(0, len(some) - 1))
        mask = F.aggregate(keep, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bit)))
        masks = per_gram.select("gram", mask.alias("mask")).where("mask <> 0")
        by_cell = masks.mapInArrow(_Cells(bits), "cell int, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask"))
        got = by_cell.toArrow()  # at most 2^bits rows
        plane = np.zeros(1 << bits, np.uint64)
        plane[got.column("cell").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
        planes.append((some, plane))
    return {"planes": planes, "bits": bits}


class _Cells:
    def __init__(self, bits: int):
        self.bits = bits

    def __call__(self, batches):
        for b in batches:
            codes, mask = b.column("gram").to_numpy().view(np.uint64), b.column("mask").to_numpy()
            for c in cells(codes, self.bits):
                yield pa.record_batch({"cell": pa.array(c.astype(np.int32)), "mask": pa.array(mask)})


class _Decide:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches):
        model = self.model.value
        bits = model["bits"]
        names = [x for some, _ in model["planes"] for x in some]
        rates = [float(((plane >> np.uint64(i)) & np.uint64(1)).mean()) ** HASHES for some, plane in model["planes"] for i in range(len(some))]
        for batch in kernel.texts(batches):
            n = batch.num_rows
            codes, first = grams(batch.column("text"))
            size = np.diff(first)
            at = cells(codes, bits)
            votes = np.zeros((len(names), n))
            k = 0
            for some, plane in model["planes"]:
                found = plane[at[0]]
                for c in at[1:]:
                    found &= plane[c]
                for i in range(len(some)):
                    total = np.concatenate(([0], np.cumsum((found >> np.uint64(i)) & np.uint64(1), dtype=np.int64)))
                    hits = total[first[1:]] - total[first[:-1]]
                    votes[k] = np.maximum(hits - size * rates[k], 0) / max(1 - rates[k], 1e-9)
                    k += 1
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if names:
                best = votes.argmax(0)
                top, total = votes.max(0), votes.sum(0)
                lang = [names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                score = np.where(letters, np.clip(top / np.maximum(total, 1e-12), 0, 1), 0.0)
            else:
                lang, score = ["und"] * n, np.zeros(n)
            cols = {x: batch.column(x) for x in ("doc_id", "held_out")}
            yield pa.record_batch(cols | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, held_out, text) -> doc_id, held_out, lang_pred, score. The model is at most 8 MB per 63 languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", "held_out", "text").mapInArrow(_Decide(shared), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    held = F.coalesce(tables.fold(4) == 2, F.lit(False))
    model = learn(docs.where(~held).select("doc_id", "lang", "text"))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
