"""Periodic runs against all lags of all texts, and the query against a word-by-word version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gridtide.llm import kernel
from gridtide.llm import op11_recursive_splitting as op11

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """(start, length, period) of all runs: every lag over the whole text, periods that a smaller one explains left out."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(w[i : i + length - p] == w[i + p : i + length] for p in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in found), default=None)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(x for k, x in enumerate(w) if k not in gone))]
    four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(found), *four, *digest)


def test_runs_of_many_small_texts():
    rng = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            some, s = rng.randint(1, 4), []
            while len(s) < rng.randint(0, 60):
                s += [rng.randint(0, some) for _ in range(rng.randint(1, 5))] * rng.choice((1, 1, 2, 4, 5, 7))
            texts.append(s)
        keys = kernel.mix(np.array([x for s in texts for x in s], np.uint64) + np.uint64(5))
        got = op11.runs(keys, np.repeat(np.arange(len(texts)), [len(s) for s in texts]))
        at = np.cumsum([0, *map(len, texts)]).tolist()
        assert [tuple(r) for r in got.tolist()] == [(s + at[i], length, q) for i, t in enumerate(texts) for s, length, q in brute_runs(t)]


@pytest.mark.parametrize("period", [1, 2, 3, 5, 63, 64, 65, 1000])
def test_runs_of_any_period(period):
    """Exactly four periods, one word fewer, and a run whose period holds a square."""
    half = list(range(10, 10 + period))
    for tail, some in ((0, period >= 2), (-1, False), (3, True)):
        w = [1, 2, *(half * 9)[: 4 * period + tail], 3]
        got = op11.runs(kernel.mix(np.array(w, np.uint64)), np.zeros(len(w), np.int64))
        assert [tuple(r) for r in got.tolist()] == ([(2, 4 * period + tail, period)] if some and 4 * period + tail >= 6 else [])
    inner = [5, *half, *half, 6]
    w = inner * 4
    got = op11.runs(kernel.mix(np.array(w, np.uint64)), np.zeros(len(w), np.int64))
    assert (0, len(w), len(inner)) in [tuple(r) for r in got.tolist()]


def test_a_word_too_rare_in_its_piece_splits_again():
    # 7 stands four times, but once in each piece that the single words 100.. leave.
    w = [1, 2, 7, 2, 1, 100, 1, 2, 7, 2, 1, 101, 1, 2, 7, 2, 1, 102, 7, 1, 1, 1, 1, 1, 1]
    at, bounds = op11.segments(kernel.mix(np.array(w, np.uint64)), np.zeros(len(w), np.int64))
    assert at.tolist() == list(range(19, 25)) and bounds.tolist() == [0, 6]


def test_a_million_words_of_few_kinds():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 40, 300_000)
    w[100_000:180_000] = np.resize(w[100_000:119_999], 80_000)  # period 19,999, four times and a little
    got = op11.runs(kernel.mix(w.astype(np.uint64)), np.zeros(len(w), np.int64))
    assert max(got.tolist(), key=lambda r: r[1])[2] == 19_999


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op11.query(spark, SF).collect())
    assert got == sorted(brute_row(r.doc_id, r.text) for r in rows)
    assert sum(r[1] > 0 for r in got) >= 0.05 * len(got)


def test_odd_rows(spark, odd):
    df = op11.collapse(odd.withColumnRenamed("part", "runs"))
    assert len(set(df.columns)) == len(df.columns) and "text" not in df.columns and "source" in df.columns
    for r in df.join(odd.select("doc_id", "lang", "text").distinct(), ["doc_id"]).collect():
        if r.doc_id not in (7, None):
            w = WORD.findall(r.text or "")
            found = brute_runs(w) if len(w) < 1000 else []
            assert r.n_words == len(w) and [tuple(x) for x in r.runs] == found and (found or r.collapsed == " ".join(w))
