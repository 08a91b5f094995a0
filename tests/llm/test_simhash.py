"""SimHash fingerprints bit by bit, and their components against all pairs."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gridtide.llm import op12_multi_index as op12

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    some = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_roots(prints, distance):
    """The smallest member of each one's component, by all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in prints:
        for y in prints:
            if x < y and (x ^ y).bit_count() <= distance:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {p: find(p) for p in prints}


def families(seed, groups=6, size=40):
    """Fingerprints in chains and clouds, some exactly at the distance and some one bit beyond."""
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(groups):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(size):
            out.add(x)
            for bit in rng.choice(64, int(rng.integers(1, 7)), replace=False).tolist():
                x ^= 1 << bit
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(small, odd):
    texts = [r.text for r in small.collect()] + [r.text for r in odd.collect()] + [None, "", " ", "a", "A b\tC", "a b c d", "a b c d e"]
    got = op12.fingerprints(pa.array(texts, pa.string()))
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize(("distance", "lot", "many"), [(4, 4096, 1), (4, 3, 1), (4, 1, 1), (3, 5, 1), (0, 4, 1), (1, 4, 1), (4, 6, 1 << 31)])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, distance, lot, many):
    """Also with hot values split into lots, and with two segments."""
    cut = op12.plan
    monkeypatch.setattr(op12, "plan", lambda n, d: cut(max(n, many), d))
    prints = families(distance + lot)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long").repartition(3)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in op12.links(df, distance, lot).collect()]
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {p: find(p) for p in prints} == brute_roots(prints, distance)


@pytest.mark.parametrize("many", [1, 1 << 31])
def test_plan(many):
    for distance in range(9):
        parts = op12.plan(many, distance)
        assert sum(bits for _, bits, _ in parts) == 64 and [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts[:-1]]]).tolist()
        assert sum(r + 1 for *_, r in parts) == distance + 1


def test_forest_of_a_dense_group_is_small():
    a, b = np.triu_indices(500, 1)
    x, y = op12.forest(a, b)
    assert len(x) == 499 and set(x.tolist()) | set(y.tolist()) == set(range(500))


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    roots = brute_roots(sorted(set(prints.values())), 4)
    low = defaultdict(list)
    for i, p in prints.items():
        low[roots[p]].append(i)
    got = sorted(tuple(r) for r in op12.query(spark, SF).collect())
    assert got == sorted((i, f"{p:016x}", min(low[roots[p]])) for i, p in prints.items())


def test_odd_rows(spark, odd):
    got = op12.near_duplicates(odd).collect()
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == dict.fromkeys([2, 3, 4, None], 2)
    assert {r.component_id for r in got if r.doc_id in (1, 8)} == {1}
