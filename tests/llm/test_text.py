"""Operators that work text by text, against plain Python."""

import hashlib
import random
import re
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridtide.llm import kernel, op1_tree_bpe, op5_toxic_spans, op6_licence_automaton, op9_closed_syncmers
from tests.llm.conftest import ROWS

LOWER = {i: i + 32 for i in range(65, 91)}
TEXTS = [t or "" for _, t, _, _ in ROWS]


def test_words_and_hashes():
    column = pa.array([t for _, t, _, _ in ROWS])
    for inside, pattern in ((kernel.NOT_SPACE, rb"[^\x20\x09-\x0d]+"), (kernel.WORD_BYTE, rb"[0-9a-z\x80-\xff]+")):
        words = kernel.words_of(column, inside)
        want = [w for t in TEXTS for w in re.findall(pattern, t.translate(LOWER).encode())]
        assert [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends)] == want
        h = words.hashes()
        assert len(set(want)) == len(set(h.tolist())) == len(set(zip(want, h.tolist())))
        assert words.counts.tolist() == [len(re.findall(pattern, t.translate(LOWER).encode())) for t in TEXTS]


def test_slices_cover_rows_in_order():
    column = pa.array(["a" * 10, None, "", "b" * 100, "c" * 5, "d"])
    got = list(kernel.slices(column, 16))
    assert got[0][0] == 0 and got[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(got, got[1:]))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_is_the_librarys(tokenizer):
    c, rng = op1_tree_bpe.codec(None), random.Random(3)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "éèàüß ", "  \n\t", "!?.,-", "aA1 .", "日本語テキスト"]
    texts = TEXTS + ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 300, 700, 5000)]
    texts += [t + " y<|endoftext|>'ll " + t[:9] for t in texts]
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == ids
        assert c.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_spread_over_tasks(spark, odd, tokenizer):
    got = op1_tree_bpe.encode(odd, ids=True).collect()
    want = []
    for i, t, _, _ in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(100):
        seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        text = [rng.randrange(5) for _ in range(20)]
        a = op6_licence_automaton.Automaton(seqs)
        parts = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        best = [max(n for n in range(e + 2) if n == 0 or tuple(text[e - n + 1 : e + 1]) in parts) for e in range(20)]
        assert [(e, n) for e, n, _ in a.runs(text)] == [(e, best[e]) for e in range(20) if best[e] and (e == 19 or best[e + 1] != best[e] + 1)]


def test_licences(spark, place, odd):
    texts = ["Released under the MIT\nLicense, and the Apache license.", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "mit licence", "the general public LICENSE"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, (_, t, _, _) in enumerate(ROWS)]
    got = {r.doc_id: r for r in op6_licence_automaton.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hits = [(k, label) for phrase, label in op6_licence_automaton.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(k for k, _ in hits), max(k for k, _ in hits)) if hits else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
    assert got[0].labels == "apache,mit" and got[0].score == 1.0
    assert got[1].labels == "isc" and 0.6 <= got[1].score < 1
    assert got[2].labels == "" and got[3].labels == "gpl"


def closed_syncmers(text, k, s):
    """Places of k-mers whose least s-mer hash is first or last."""
    data = np.frombuffer(text.encode(), np.uint8)
    sums, inverse = kernel.byte_sums(data)
    h = kernel.mix((sums[s:] - sums[:-s]) * inverse[: len(sums) - s]).tolist() if len(data) >= s else []
    return [i for i in range(len(data) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]


def test_syncmers():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(200))) for _ in range(50)] + ["", "a" * 100]
    for k, s in ((16, 5), (9, 9), (64, 16)):
        got = op9_closed_syncmers.anchors(pa.array(texts), k, s)
        for t, a in zip(texts, got):
            kmers = {t.encode()[i : i + k] for i in closed_syncmers(t, k, s)}
            assert len(a) == (len(kmers) or int(bool(t)))


def own_likeness(pairs):
    got = op9_closed_syncmers.anchors(pa.array([t for pair in pairs for t in pair]))
    return [op9_closed_syncmers.likeness(a, b) for a, b in zip(got[::2], got[1::2])]


@pytest.mark.parametrize("every, least", ((10, 0.45), (20, 0.65)))
def test_likeness_of_scattered_edits(spark, every, least):
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text]
    texts = [w for w in texts if 30 <= len(w) <= 600][:60]
    got = own_likeness([(" ".join(w), " ".join("changed" if i % every == every - 1 else x for i, x in enumerate(w))) for w in texts])
    assert len(got) == 60 and min(got) > 0 and sum(got) / 60 >= least


def test_likeness_of_short_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text]
    texts = [t[:120] for t in texts if len(t) >= 120 and len(t[:120].encode()) < 200]
    got = own_likeness([(t, op9_closed_syncmers.edited(t, "Replaced by other words of the next text, whatever they are.")) for t in texts])
    assert min(got) > 0 and sum(got) / len(got) >= 0.5


def test_fingerprints(spark, odd):
    got = op9_closed_syncmers.fingerprints(odd).collect()
    import xxhash  # noqa: F401  the order of equal ids is by Spark's own hash, so only distinct ids are compared

    by = {r.doc_id: r for r in got if r.doc_id in (1, 2, 3, 4, 5, 6, 8, 9, 10)}
    text = {i: t or "" for i, t, _, _ in ROWS}
    for i, nxt in ((1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (8, 9), (9, 10)):
        want = op9_closed_syncmers.edited(text[i], text[nxt])
        r = by[i]
        assert r.n_chars == len(text[i])
        assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        a, b, c = op9_closed_syncmers.anchors(pa.array([text[i], want, text[nxt]]))
        assert (r.fingerprint, r.edited_fingerprint) == (a.tobytes().hex(), b.tobytes().hex())
        assert (r.near_edited, r.near_next) == (op9_closed_syncmers.likeness(a, b), op9_closed_syncmers.likeness(a, c))
    assert by[1].fingerprint == by[8].fingerprint
    assert by[2].near_next == 1.0 and by[5].near_next == 0.0


def test_chain_against_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7):
        potential, trans = rng.normal(size=n), rng.normal(size=4)
        starts = np.array([0, 3]) if n > 3 else np.array([0])
        weights = {}
        for y in product((0, 1), repeat=n):
            w = sum(p for p, v in zip(potential, y) if v) + sum(trans[2 * y[i - 1] + y[i]] for i in range(1, n) if i not in starts)
            weights[y] = np.exp(w)
        total = sum(weights.values())
        want = [sum(w for y, w in weights.items() if y[i]) / total for i in range(n)]
        assert np.allclose(op5_toxic_spans.marginals(potential, starts, trans), want)
    long = op5_toxic_spans.marginals(rng.normal(size=1000), np.array([0, 500]), trans)
    assert long.min() > 0 and long.max() < 1
