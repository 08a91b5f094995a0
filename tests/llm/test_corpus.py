"""Operators over the corpus, against brute force on the smallest tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.llm import op2_importance_resampling as op2
from gridtide.llm import op3_bm25_decontamination as op3
from gridtide.llm import op4_line_spread as op4
from gridtide.llm import op5_toxic_spans as op5
from gridtide.llm import op7_language_filters as op7
from gridtide.llm import op8_katz_backoff as op8
from gridtide.llm import op10_token_groups as op10

SF = "/root/testdata/sf0.001"
SF10 = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """Smallest id of each component, by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[find(k)].append(i)
    return [(i, len(s), min(low[find(k)])) for k, (i, s) in enumerate(sets)]


def near_copies(seed, groups=12, size=9, length=60):
    """Families of texts that differ from a common one by more and more words, so links form chains."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 500, length)]
        for _ in range(size):
            w = list(base)
            for p in rng.choice(length, rng.integers(0, 4), replace=False):
                w[p] = f"n{rng.integers(0, 10_000)}"
            rows.append((len(rows), " ".join(w)))
            if rng.random() < 0.4:
                base = w
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(op10, "GROUP", 4)
    rows = near_copies(seed)
    got = [tuple(r) for r in op10.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_join_on_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op10.join(small).collect()) == sorted(brute_components(rows))


def test_a_large_group_of_near_copies_gives_few_rows(spark, monkeypatch):
    """Near copies of one text, a third linked with each other and the rest apart: every table of pairs stays linear."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 60)]
    rows = []
    for i in range(600):
        w = list(base)
        for p in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            w[p] = f"n{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(w)))
    kept, stored = {}, op10.tables.stored

    def spy(df, name):
        out = stored(df, name)
        kept[name] = max(out.count(), kept.get(name, 0))
        return out

    monkeypatch.setattr(op10.tables, "stored", spy)
    got = op10.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_components(rows))
    assert kept["star-pairs"] <= 2 * len(rows)
    assert kept.get("forest", 0) < kept["close-classes"] <= kept["opened-groups"] + kept["group-members"]


def test_forest_of_an_opened_group():
    """Verified links of members of different components, no more than there are components to join."""
    import pyarrow as pa

    sets = [np.arange(k, k + 40, dtype=np.uint64) for k in (0, 1, 2, 3, 200)]
    rows = [(c, c, s.tobytes(), asks) for asks in (True, False) for c, s in enumerate(sets)]
    got = op10._forest(pa.table({k: pa.array([r[i] for r in rows]) for i, k in enumerate(("class", "root", "tokens", "asks"))}))
    assert len(got) == 3 and {x for p in got.to_pylist() for x in p.values()} == {0, 1, 2, 3}


@pytest.mark.parametrize("kinds", [[], [1], [0]])
def test_toxicity_stage_without_both_kinds_of_labels_keeps_all(spark, place, odd, kinds):
    labels = [(i, 1, k) for i in (1, 7, 8, 9) for k in kinds]
    assert op5.stage(spark, odd, place(odd, labels)).count() == odd.count()


def test_parity_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(7)
    for n, m in ((1, 1), (40, 50), (300, 900)):
        common = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
        for _ in range(20):
            x, y = (np.unique(np.concatenate((common, rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)))) for k in (n, m))
            assert op10.distance(op10.parity(x), op10.parity(y)) <= len(np.setxor1d(x, y))
            assert op10.distance(op10.parity(x), op10.parity(x)) == 0


def test_join_stage_keeps_one_of_each(spark, odd):
    got = op10.stage(spark, odd, SF)
    assert got.columns == odd.columns
    kept = sorted((str(r.doc_id), (r.text or "")[:30]) for r in got.collect())
    ids = Counter(i for i, _ in kept)
    assert ids["1"] == 1 and ids["8"] == 0 and ids["7"] == 2 and ids["None"] == 2 and ids["2"] == ids["3"] == ids["4"] == 1


def test_katz_counts_and_base(spark, small):
    texts = {r.doc_id: [*words(r.text), "\0end"] for r in small.select("doc_id", "text").collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for i in train for w in texts[i])
    n, v = sum(c.values()), len(c)
    got = op8.query(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, r.doc_id not in train)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_sums_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "a b d", "b a", "c c c a", "a", "b b a d e", "f a b", "a b c d"] * 3 + ["g h", "i j k l", "m"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, uni, gains = op8.learn(docs)
    u = model["unigrams"]
    counts = {r.key: r.n for r in uni.collect()}
    p = {k: 10 ** float(u.log_p(np.array([n]))[0]) for k, n in counts.items()}
    assert math.isclose(sum(p.values()) + u.left, 1)
    number = {int(np.array([h]).view(np.int64)[0]): i + 1 for i, h in enumerate(model["frequent"])}
    gain = {r.key: r.gain for r in gains.collect()}
    for h in range(len(model["frequent"]) + 1):
        alpha = 10 ** model["log_alpha"][h]
        total = alpha * u.left
        for k, x in p.items():
            key = h * (len(number) + 1) + number.get(k, 0)
            total += alpha * x * 10 ** gain.get(key, 0.0)
        assert math.isclose(total, 1, rel_tol=1e-9)
    # a text's score is the product over its tokens
    (r,) = op8.score(spark.createDataFrame([(1, "a b zz c")], "doc_id long, text string"), model, uni, gains).collect()
    import pyarrow as pa

    h = op8.tokens(pa.array(["a b zz c"]))[0].view(np.int64).tolist()
    before, want = 0, 0.0
    for k in h:
        own = number.get(k, -1)
        x = p.get(k, u.left)
        if before >= 0:
            x *= 10 ** model["log_alpha"][before] * 10 ** (gain.get(before * (len(number) + 1) + own, 0.0) if own > 0 else 0.0)
        want += math.log10(x)
        before = own
    assert math.isclose(r.score, want, rel_tol=1e-9) and r.n_known == 4


def katz(train, texts, d1, d2):
    """log10 probability of each text by all pairs of the training texts, whatever their counts."""
    seqs = [["<s>", *words(t), "</s>"] for t in train]
    c, pairs, follows = Counter(w for s in seqs for w in s[1:]), Counter(p for s in seqs for p in zip(s, s[1:])), defaultdict(set)
    for a, b in pairs:
        follows[a].add(b)
    n, count = sum(c.values()), Counter(a for s in seqs for a in s[:-1])
    disc = lambda k, d: k * (d[k] if k <= op8.TOP else 1)
    left = 1 - sum(disc(x, d1) for x in c.values()) / n
    p = lambda w: disc(c[w], d1) / n if w in c else left

    def log_p(a, b):
        if not follows[a]:
            return math.log10(p(b))
        seen = sum(disc(pairs[a, w], d2) for w in follows[a]) / count[a]
        s = min(1, count[a] / (count[a] + 1) / seen)
        if b in follows[a]:
            return math.log10(s * disc(pairs[a, b], d2) / count[a])
        return math.log10((1 - s * seen) / (1 - sum(map(p, follows[a]))) * p(b))

    return [sum(log_p(a, b) for a, b in zip(["<s>", *words(t)], [*words(t), "</s>"])) for t in texts]


def test_katz_tables_are_small(spark):
    """Packages give back their columns; written pairs take a few bytes each, and as many tokens have numbers as may."""
    rng = np.random.default_rng(7)
    keys = np.sort(rng.integers(-(1 << 63), 1 << 63, 1000))
    more = [rng.integers(0, 500, 1000).astype(np.uint16), rng.integers(-(1 << 63), 1 << 63, 1000)]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip([keys, *more], op8.columns_of(op8.bundled(keys, *more)), strict=True))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 20_000, 2000)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model, uni, gains = op8.learn(docs)
    assert len(model["frequent"]) == uni.count()
    pairs = len({p for t in texts for p in zip(["<s>", *t.split()], [*t.split(), "</s>"])})
    assert gains.count() == pairs
    assert model["pairs"].agg(F.sum(F.length("body"))).first()[0] < 6 * pairs


@pytest.mark.parametrize("frequent", (8, 64, 1 << 16))
@pytest.mark.parametrize("part", (200, 1 << 20))
def test_katz_pairs_of_rare_tokens(spark, monkeypatch, frequent, part):
    """Scores are those of a count of all pairs, however few tokens have numbers and however many parts there are."""
    monkeypatch.setattr(op8, "FREQUENT", frequent)
    monkeypatch.setattr(op8, "PART", part)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, int(k)) if x < 10**6) for k in rng.integers(0, 30, 80)]
    more = ["w1 new w2 w700", "", "new other", "w3 w3 w3 w50"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model, uni, gains = op8.learn(docs)
    if frequent < 100:
        assert len(model["frequent"]) < uni.count()
    got = op8.score(spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string"), model, uni, gains).collect()
    want = katz(texts, texts + more, model["unigrams"].d, model["d2"])
    assert len(got) == len(want)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9)


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF10}/documents.parquet").select("doc_id", "lang")
    share = op7.query(spark, SF10).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share >= 0.97


def test_language_of_texts_without_letters(spark, odd, place):
    got = {(r.doc_id, r.lang_pred) for r in op7.query(spark, place(odd)).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (5, "und")} <= got


def test_toxicity_finds_words(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(300):
        w = [f"w{x}" for x in rng.integers(0, 300, 40)]
        bad = i % 4 == 0
        if bad:
            for p in rng.integers(0, 39, 3):
                w[p : p + 2] = ["utter", "scum"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = op5.training(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    text = dict(rows)
    for r in op5.score(docs, model).collect():
        assert r.predicted == truth[r.doc_id] and 0 <= r.score <= 1
        assert all("scum" in text[r.doc_id][s.start : s.end] or "utter" in text[r.doc_id][s.start : s.end] for s in r.spans)
        assert bool(r.spans) == bool(truth[r.doc_id])


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF10}/labels.parquet")
    got = op5.query(spark, SF10).join(labels, "doc_id").groupBy("held_out", "toxic").agg(F.avg("predicted")).collect()
    rate = {(r.held_out, r.toxic): r[2] for r in got}
    assert rate[True, 0] < 0.1 and rate[True, 1] > 0.5 and rate[False, 1] > 0.9


def test_leaks_are_the_planted_ones(spark):
    docs = spark.read.parquet(f"{SF10}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF10}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in op3.query(spark, SF10).collect()}
    assert got == want and want


def test_retrieval_against_full_scores():
    """Everything at the threshold is found: block bounds lose nothing."""
    import pyarrow as pa

    from gridtide.llm import kernel

    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"t{x}" for x in rng.integers(0, 40, rng.integers(1, 90)))) for i in range(60)]
    text = [" ".join(f"t{x}" for x in rng.integers(0, 80, rng.integers(0, 400))) for _ in range(20)]
    index = op3.Index(items)
    w = kernel.words_of(pa.array(text), kernel.WORD_BYTE)
    h = w.hashes()
    for threshold in (0.2, 0.5):
        got = {(r, a, s): x for r, a, s, x in zip(*(v.tolist() for v in index.retrieve(w, h, threshold)))}
        want = {}
        for r in range(len(text)):
            for a in range(w.first[r], w.first[r + 1], op3.STEP):
                terms = set(h[a : min(a + op3.WINDOW, w.first[r + 1])].tolist())
                score = np.zeros(index.segments)
                for t, term in enumerate(index.terms.tolist()):
                    if term in terms:
                        at = slice(index.first[t], index.first[t + 1])
                        score[index.segment[at]] += index.impact[at]
                want |= {(r, a, s): score[s] for s in np.flatnonzero(score >= threshold).tolist()}
        sure = {k for k, x in want.items() if x > threshold + 1e-9}
        assert sure <= set(got) <= set(want) and all(math.isclose(got[k], want[k]) for k in sure)


def test_common_words_make_no_candidates():
    """Words of every item are looked up only for passages that have rarer words of the item; scores stay whole."""
    import pyarrow as pa

    from gridtide.llm import kernel

    common = "the of and to in is"
    index = op3.Index([(i, f"{common} rare{i} odd{i} single{i}") for i in range(50)] + [(50, ""), (51, "one")])
    first, segments, impacts, rest = index.essential(0.5)
    for w in common.split():
        at = int(np.searchsorted(index.terms, np.uint64(kernel.word_hash(w))))
        assert first[at] == first[at + 1]
    assert len(segments) <= 50 * 3 + 1 and (rest <= 0.4 + 1e-9).all()
    assert np.allclose(np.bincount(segments, impacts, index.segments) + rest, [1.0] * 50 + [0.0, 1.0])
    words = kernel.words_of(pa.array([common * 3, f"{common} rare7 odd7 single7", None, "x one"]), kernel.WORD_BYTE)
    row, _, segment, score = index.retrieve(words, words.hashes(), 0.5)
    assert list(zip(row.tolist(), segment.tolist())) == [(1, 7), (3, 51)] and np.allclose(score, 1)


def test_decontamination_keeps_clean_rows(spark, odd):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, "")], "item_id long, text string")
    got = op3.clean(odd, items)
    assert got.columns == odd.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id not in (1, 8))


def test_lines(spark):
    common = "subscribe to our newsletter today"
    rows = [(i, f"own line {i}\n{common}\n\nend {i}", f"s{i % 6}") for i in range(12)] + [(20, common, "s1"), (21, None, "s2"), (22, "", None), (23, f"{common}\nmore", None)]
    rows += [(30 + i, f"few sites\nx{i}", f"s{i % 4}") for i in range(10)]
    got = {r.doc_id: r for r in op4.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].text == rows[0][1] and got[0].lines_removed == 0
    assert got[5].text == "own line 5\n\nend 5" and got[5].lines_removed == 1
    assert 20 not in got and got[21].text is None and got[22].text == "" and got[23].text == "more"
    assert all(got[30 + i].text == f"few sites\nx{i}" for i in range(10))


def test_exact_counts_near_the_threshold(spark):
    rows = [(i * 100 + s, f"line {i}", f"s{s}") for i in range(3, 8) for s in range(i)]
    got = op4.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.text for r in got.groupBy("text").count().where("count > 1").collect()} == {"line 3", "line 4"}


def test_kth_largest(spark):
    rng = np.random.default_rng(6)
    values = sorted((rng.integers(-(10**12), 10**12, 500).tolist() + [7] * 50), reverse=True)
    keys = spark.createDataFrame([(x,) for x in values], "key long")
    for k in (1, 2, 250, 550):
        assert op2.kth_largest(keys, k) == values[k - 1]
    assert op2.kth_largest(keys.where("false"), 3) is None and op2.kth_largest(keys, 0) is None


def test_resampling_prefers_good_texts(spark):
    got = op2.query(spark, SF10).join(spark.read.parquet(f"{SF10}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("selected").cast("int"))).collect()
    rate = {r.quality: r[1] for r in got}
    assert rate[1] > 0.97 and rate[0] < 0.5


def test_resampling_weights(spark):
    rows = [(i, "a b" if i % 2 else "c d") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 40, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in op2.resample(docs, labels, share=0.5).collect()}
    one, two = (60 + 0 + 1), op2.BUCKETS
    good = 3 * (math.log(21 / (60 + two)) - math.log(21 / (120 + two)))
    assert one and math.isclose(got[1].log_weight, good, rel_tol=1e-9)
    assert sum(r.selected for r in got.values()) == 20
