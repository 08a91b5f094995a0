"""NRA against full scores: the reading of lists, shards, blocks of questions and the whole search."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridtide.llm import op13_nra_search as op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(docs, items, k=10):
    """All scores of all documents: item_id, rank, doc_id, score."""
    tf = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in tf if c)
    total = sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in sorted({(i, t) for i, t in items if t}, key=str):
        got = []
        for place, (i, c) in enumerate(tf):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * sum(c.values()) * n) // total
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                got.append((-score, i is None, i or 0, place, i))
        out += [(item, r, i, -s) for r, (s, _, _, _, i) in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, size=400):
    """Few words, many ties and copies, some ids missing or twice, lengths from none to 300 words."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(size):
        w = rng.choice(vocabulary, int(rng.choice([0, 1, 3, 20, 300])), p=np.arange(60, 0, -1) / 1830)
        rows.append((None if i % 97 == 5 else i // 2 if i % 50 == 1 else i, " ".join(w.tolist())))
        if i % 5 == 0:
            rows.append((size + i, rows[-1][1]))
    return rows + [(7001, None), (7002, "..."), (7003, "W1 w1")]


ITEMS = [(1, "w1 w5 w40 w59"), (2, "w0"), (3, "w0 w0 w0 W1 nothing"), (4, "nothing at all"), (5, None), (6, ""), (None, "w3 w4"), (1, "w2"), (7, " ".join(f"w{i}" for i in range(60))), (2, "w0")]


@pytest.mark.parametrize("seed", range(3))
def test_search_against_full_scores(spark, seed):
    docs = corpus(seed)
    df = op13.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(docs, ITEMS)


def test_blocks_of_questions(spark, monkeypatch):
    monkeypatch.setattr(op13, "CHARS", 40)
    docs = corpus(9, 100)
    df = op13.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"), 3)
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(docs, ITEMS, 3)


def test_ids_of_letters(spark):
    docs = [("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "two")]
    got = op13.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("q", "one")], "item_id string, text string"))
    assert [(r.item_id, r.rank, r.doc_id) for r in got.sort("rank").collect()] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


@pytest.mark.parametrize("shards", [1, 2, 7, 400])
def test_shards_of_one_task(monkeypatch, shards):
    """The same rows from any number of shards; scores carried from earlier ones lose nothing."""
    docs = [(i, t) for i, t in corpus(5) if i is not None]
    monkeypatch.setattr(op13, "DOCS", -(-len(docs) // shards))
    words, questions = op13.questions_of([("q", "w1 w5 w40 w59 w0 w0"), ("p", "w7")])

    class Shared:
        def __init__(self, value):
            self.value = value

    batch = pa.record_batch({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs])})
    packed = list(op13._Postings(Shared(words), "bigint")([batch]))
    n = sum(r.column("docs")[0].as_py() for r in packed)
    total = sum(r.column("words")[0].as_py() for r in packed)
    weights = np.zeros(len(words), np.int64)
    for r in packed:
        if r.column("kind")[0].as_py() == op13.TERMS:
            weights[:] = [op13.weight(n, int(x)) for x in np.frombuffer(r.column("n")[0].as_buffer(), np.int64)]
    rows = [r for r in packed if r.column("kind")[0].as_py() == op13.POSTINGS]
    got = defaultdict(list)
    for b in op13._Ranked(Shared(questions), Shared(weights), n, total, 10, (pa.string(), pa.int64()))(rows):
        for r in b.to_pylist():
            got[r["item_id"]].append((r["doc_id"], r["score"]))
    expected = defaultdict(list)
    for item, _, i, s in sorted(brute(docs, [("q", "w1 w5 w40 w59 w0 w0"), ("p", "w7")]), key=lambda r: (r[0], r[1])):
        expected[item].append((i, s))
    assert got == expected


def test_reading_stops_only_when_all_is_resolved():
    rng = np.random.default_rng(2)
    for _ in range(200):
        docs, k = int(rng.integers(1, 500)), int(rng.integers(1, 12))
        full, lists = np.zeros(docs, np.int64), []
        for _ in range(int(rng.integers(1, 9))):
            own = rng.permutation(docs)[: int(rng.integers(0, docs + 1))]
            impact = -np.sort(-rng.integers(1, int(rng.choice([3, 50, 10**9])), len(own)))
            full[own] += impact
            lists.append((own, impact))
        order = rng.permutation(docs)
        floor = int(rng.choice([0, np.median(full)]))
        got = op13.nra([x for x in lists if len(x[0])] or [(np.array([0]), np.array([0]))], docs, k, floor, order)
        best = [i for i in np.lexsort((order, -full)).tolist() if full[i] >= max(floor, 1)][:k]
        assert got[0].tolist() == best and got[1].tolist() == full[best].tolist()
