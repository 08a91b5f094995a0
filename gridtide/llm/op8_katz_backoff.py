"""Language-model scores by Katz backoff with Good-Turing discounts.

Tokens are the words of a text and one end. Counts of all training tokens give the unigram table; the bigram table counts
every pair of neighbours (the start of a text counts as a neighbour). Only histories that were never followed by anything
back off with weight 1. The 65,536 most frequent tokens (fewer where the last of them have equal counts) have numbers; what is known
of them as histories is broadcast, as are the 65,536 most frequent pairs of numbers. Numbers save lookups and change no result.

    P(w)     = d(c) c / N for a seen word; all unseen words together are one class with the mass that is left
    P(w | h) = s(h) d(c) c / C(h) if the pair was seen, else alpha(h) P(w)
    alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over seen w)

d are Good-Turing discounts for counts up to 5 (from the table's counts of counts; an absolute discount where these are
not usable). s(h) keeps at least 1/(C(h)+1) for what follows h for the first time. Both levels sum to 1 exactly.

Tables are written, and read by parts: tokens without a number and pairs that are not among the most frequent are sent to
the part of the table that holds them (by hash), together with the row they belong to. All pairs of a history without a number
lie in that history's part, where its C, alpha and gains are computed; pairs of a numbered history and a word without a number
lie in the word's part, where its count is. Pairs of two tokens without numbers are counted in the word's part and sent on to
the history's. Counts and questions travel as compressed columns, one package per slice and part. Parts hold some two million
tokens, and no key has more than 1/65,536 of all. Sums of a row's tokens come back and are added up.

Defined results: null counts as empty; an empty text has one token, the end; without training documents every token is
unseen (n_known 0); null doc_id is not held out and not learned from; repeated rows are scored alike; other columns are
ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables

END = np.uint64(0xE4D0E4D0E4D0E4D1)
FREQUENT = 1 << 16
PART = 2_000_000
KEPT = 500_000
SLICE = 2 << 20
TOP = 5
#: Kinds of packages: tokens, pairs of numbers, of number and token without one, of token without a number and number, of two
#: tokens without numbers, questions about pairs (by numbered and by other histories), sums of rows.
UNIGRAM, NN, NR, RN, RR, BIGRAM, RARE, ROWS = range(8)
CODEC = pa.Codec("zstd", 1)
#: Set in the ids of tokens without a number and in the keys of pairs that hold one: as signed numbers they are negative.
TOP_BIT = np.uint64(1 << 63)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, the row of each, and the place of each row's first one. Every row ends with END."""
    words = kernel.words_of(column)
    h = words.hashes()
    rows = len(words.counts)
    first = words.first + np.arange(rows + 1)
    out = np.full(len(h) + rows, END, np.uint64)
    out[np.arange(len(h)) + words.doc] = h
    return out, np.repeat(np.arange(rows), np.diff(first)), first


def numbers(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Ids of tokens: 1 + place among the frequent hashes, or else the hash as a negative number."""
    rare = (h | TOP_BIT).view(np.int64)
    if not len(frequent):
        return rare
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, at + 1, rare)


def histories(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The id of the token before; 0 at the start of a row."""
    out = np.empty(len(ids), ids.dtype)
    out[1:] = ids[:-1]
    out[first[:-1]] = 0
    return out


def pair_keys(before: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """Of two numbers, the number of the pair; otherwise a negative hash. `size` is the number of frequent tokens."""
    mixed = kernel.mix(kernel.mix(before.view(np.uint64)) + word.view(np.uint64)) | TOP_BIT
    return np.where((before >= 0) & (word >= 0), before * (size + 1) + word, mixed.view(np.int64))


class _Count:
    """Counts of tokens in this partition."""

    names = ("key",)

    def keys(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """What is counted, and the columns that it stands for."""
        h = tokens(batch.column("text"))[0].view(np.int64)
        return h, h

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in kernel.texts(batches):
            keys, *columns = self.keys(batch)
            held.append(self._sum([(keys, np.ones(len(keys), np.int64), *columns)]))
            size += len(held[-1][0])
            if size > KEPT:
                held = [self._sum(held)]
                size = len(held[0][0])
                if size > KEPT // 2:
                    yield self._out(held[0])
                    held, size = [], 0
        if held:
            yield self._out(self._sum(held))

    @staticmethod
    def _sum(held):
        keys, n, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
        return keys, np.bincount(at, n, len(keys)).astype(np.int64), *(x[first] for x in columns)

    def _out(self, counted) -> pa.RecordBatch:
        return pa.record_batch({name: pa.array(x) for name, x in zip(self.names, counted[2:], strict=True)} | {"n": pa.array(counted[1])})


def bundled(first: np.ndarray, *more: np.ndarray) -> bytes:
    """Columns of whole numbers, the first ascending, as compressed bytes: those of the same place in a number stand together."""
    out = [struct.pack("<I", len(first))]
    for x in (np.diff(first, prepend=first.dtype.type(0)), *more):
        body = CODEC.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), asbytes=True)
        out += [struct.pack("<cI", x.dtype.char.encode(), len(body)), body]
    return b"".join(out)


def columns_of(package: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", package), 4, []
    while at < len(package):
        char, size = struct.unpack_from("<cI", package, at)
        kind = np.dtype(char.decode())
        planes = CODEC.decompress(package[at + 5 : at + 5 + size], kind.itemsize * n, asbytes=True)
        out.append(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel())
        at += 5 + size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def merged(packages: list[bytes], width: int) -> list[np.ndarray]:
    """The rows of packages whose last column is a count, ascending and summed over equal rows; `width` columns."""
    if not packages:
        return [np.zeros(0, np.int64)] * width
    *keys, n = (np.concatenate(x) for x in zip(*map(columns_of, packages), strict=True))
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys, n = [k[order] for k in keys], n[order].astype(np.int64)
    new = np.ones(len(n), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [*(k[at] for k in keys), np.add.reduceat(n, at) if len(at) else n]


class _CountPairs(_Count):
    """Counts of pairs of neighbours in this partition, packed by part and kind."""

    def __init__(self, frequent, parts: int):
        self.frequent, self.parts = frequent, parts

    def keys(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        h, _, first = tokens(batch.column("text"))
        ids = numbers(h, self.frequent.value)
        before = histories(ids, first)
        return pair_keys(before, ids, len(self.frequent.value)), before, ids

    def _out(self, counted) -> pa.RecordBatch:
        key, n, before, word = counted
        out: list[tuple] = []
        for kind, of, by, other in ((NN, key >= 0, key, None), (NR, (before >= 0) & (word < 0), word, before), (RN, (before < 0) & (word >= 0), before, word), (RR, (before < 0) & (word < 0), word, before)):
            out += packed(self.parts, kind, by[of], *(() if other is None else (other[of],)), small(n[of]))
        return _record(out)


def counted(docs: DataFrame) -> DataFrame:
    """(key, n): the written table of counts of tokens over all rows."""
    rows = docs.select("text").mapInArrow(_Count(), "key long, n long")
    return tables.stored(rows.groupBy("key").agg(F.sum("n").alias("n")), "unigrams")


def counted_pairs(docs: DataFrame, frequent, parts: int, rare: DataFrame) -> DataFrame:
    """The written table of counts of pairs over all rows, packed by part and kind: NN (pair, count), NR (word, history, count, the
    word's own count), RN (history, word, count), RR (history, word, count, the word's own count). rare: packed unigrams
    without a number."""
    rows = docs.select("text").mapInArrow(_CountPairs(frequent, parts), _PACKED)

    def count(pairs: pa.Table, words: pa.Table) -> pa.Table:
        return _count_part(pairs, words, parts)

    return tables.stored(rows.groupBy("part").cogroup(rare.groupBy("part")).applyInArrow(count, _PACKED), "bigrams")


def _of_kind(table: pa.Table, kind: int) -> list[bytes]:
    return table.filter(pc.equal(table.column("kind"), kind)).column("body").to_pylist()


def _count_part(pairs: pa.Table, words: pa.Table, parts: int) -> pa.Table:
    """Counts of one part; those of pairs of two tokens without numbers are packed by the part of the history."""
    out: list[tuple] = []
    if pairs.num_rows:
        part = pairs.column("part")[0].as_py()
        key, n = merged(_of_kind(pairs, NN), 2)
        out.append((part, NN, bundled(key, small(n))))
        history, word, n = merged(_of_kind(pairs, RN), 3)
        out.append((part, RN, bundled(history, small(word), small(n))))
        known, count = merged(_of_kind(words, UNIGRAM), 2)
        for kind in (NR, RR):
            word, history, n = merged(_of_kind(pairs, kind), 3)
            c = small(count[np.searchsorted(known, word)])
            if kind == NR:
                out.append((part, NR, bundled(word, small(history), small(n), c)))
            else:
                out += packed(parts, RR, history, word, small(n), c)
    return pa.Table.from_batches([_record([x for x in out if len(x[2])])], _SCHEMA)


class _Spectrum:
    """Packed pairs -> counts and how many pairs have them."""

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist(), strict=True):
                n, k = np.unique(columns_of(body)[1 if kind == NN else 2], return_counts=True)
                yield pa.record_batch({"n": pa.array(n.astype(np.int64)), "k": pa.array(k.astype(np.int64))})


def spectrum(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of a table (n, k): all values n, ascending, and the sums of k. Counts of T tokens have at most sqrt(2 T) values."""
    got = counts.groupBy("n").agg(F.sum("k").alias("k")).toArrow()
    n, k = got.column("n").to_numpy(), got.column("k").to_numpy()
    order = np.argsort(n)
    return n[order].astype(np.int64), k[order].astype(np.int64)


def least_of_top(n: np.ndarray, k: np.ndarray) -> int:
    """The least count such that at most FREQUENT keys have it or more."""
    some = np.flatnonzero(np.cumsum(k[::-1])[::-1] <= FREQUENT)
    return int(n[some[0]]) if len(some) else int(n.max(initial=0)) + 1


def discounts(values: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Good-Turing factors d[0..TOP], 1 beyond; d[0] is unused."""
    seen = dict(zip(values.tolist(), k.tolist(), strict=True))
    n = [0] + [seen.get(i, 0) for i in range(1, TOP + 2)]
    d = np.ones(TOP + 1)
    if all(n[1:]):
        common = (TOP + 1) * n[TOP + 1] / n[1]
        if common < 1:
            d[1:] = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, TOP + 1)]
    if not ((d[1:] > 0) & (d[1:] < 1)).all():
        fixed = min(max(n[1] / (n[1] + 2 * n[2]), 0.1), 0.9) if n[1] else 0.5
        d[1:] = 1 - fixed / np.arange(1, TOP + 1)
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= TOP, d[np.minimum(c, TOP)], 1.0) * c


class Unigrams:
    def __init__(self, total: int, distinct: int, d: np.ndarray, left: float):
        self.total, self.distinct, self.d = total, distinct, d
        # Mass of the class of unseen words; where nothing can be discounted it gets one count of its own.
        self.whole = total if 0 < left < 1 else total + 1
        self.left = left if 0 < left < 1 else 1 / self.whole

    def log_p(self, c: np.ndarray) -> np.ndarray:
        p = discounted(c, self.d) / self.whole
        return np.log10(np.where(c > 0, p, self.left))

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + 1 * (self.distinct + 1)))


def backoff(count: np.ndarray, seen: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of histories with these counts, shares of seen pairs and unigram shares of the words seen: scale s(h), log alpha(h)."""
    scale = np.minimum(1.0, count / (count + 1) / np.maximum(seen, 1e-300))
    return scale, np.log10((1 - scale * seen) / np.maximum(1 - lower, 1e-12))


def numbered(body: bytes, kind: int, m: dict) -> tuple[np.ndarray, ...]:
    """Of a package of pairs with numbered histories: key, history, count of the pair, count of its word."""
    if kind == NN:
        key, n = columns_of(body)
        history = key // len(m["counts"])
        return key, history, n, m["counts"][key % len(m["counts"])]
    word, history, n, c = columns_of(body)
    history = history.astype(np.int64)
    return pair_keys(history, word, len(m["frequent"])), history, n, c


def gain_of(history: np.ndarray, n: np.ndarray, c: np.ndarray, m: dict) -> np.ndarray:
    """What a seen pair with a numbered history adds to the log probability of backing off."""
    return np.log10(m["scale"][history] * discounted(n, m["d2"]) / m["history"][history]) - m["log_alpha"][history] - m["unigrams"].log_p(c)


class _Seen:
    """Packed pairs -> numbered histories, the discounted shares of their pairs and the unigram probabilities of the words."""

    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = self.model.value
        for batch in batches:
            p, lower = np.zeros((2, len(m["counts"])))
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist(), strict=True):
                _, history, n, c = numbered(body, kind, m)
                p += np.bincount(history, discounted(n, m["d2"]) / m["history"][history], len(p))
                lower += np.bincount(history, 10 ** m["unigrams"].log_p(c), len(p))
            some = np.flatnonzero(p)
            yield pa.record_batch({"history": pa.array(some), "p": pa.array(p[some]), "lower": pa.array(lower[some])})


class _Gain:
    """Packed pairs with a numbered history -> key, count and gain of those with `least` or more."""

    def __init__(self, model, least: int = 0):
        self.model, self.least = model, least

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = self.model.value
        for batch in batches:
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist(), strict=True):
                key, history, n, c = numbered(body, kind, m)
                some = n >= self.least
                gain = gain_of(history[some], n[some], c[some], m)
                yield pa.record_batch({"key": pa.array(key[some]), "n": pa.array(n[some].astype(np.int64)), "gain": pa.array(gain)})


def learn(docs: DataFrame) -> tuple[dict, DataFrame, DataFrame]:
    """The model (arrays over at most 65,537 numbers; its `pairs` is the packed bigram table), the unigram table, and a view of the
    pairs with a numbered history, one in a row with its gain."""
    sc = docs.sparkSession.sparkContext
    uni = counted(docs)
    values, k = spectrum(uni.select("n", F.lit(1).alias("k")))
    total, distinct = int((values * k).sum()), int(k.sum())
    d1 = discounts(values, k)
    left = sum(x * n * (1 - d1[n]) for n, x in zip(values.tolist(), k.tolist(), strict=True) if n <= TOP) / max(total, 1)
    unigrams = Unigrams(total, distinct, d1, left)
    least = least_of_top(values, k)
    top = uni.where(F.col("n") >= least).toArrow()  # at most 65,536 rows
    hashes, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(hashes)
    frequent, n = hashes[order], n[order].astype(np.int64)
    ends = int(n[frequent == END].sum()) or (uni.where(F.col("key") == int(np.array([END]).view(np.int64)[0])).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    parts = max(1, -(-total // PART))
    pairs = counted_pairs(docs, sc.broadcast(frequent), parts, uni.where(F.col("n") < least).mapInArrow(_UnigramTable(parts), _PACKED))
    values, k = spectrum(pairs.mapInArrow(_Spectrum(), "n long, k long"))
    history = np.concatenate(([max(ends, 1)], n)).astype(float)
    log_uni = np.concatenate(([0.0], unigrams.log_p(n)))
    model = {"frequent": frequent, "counts": np.concatenate(([0], n)), "history": history, "log_uni": log_uni, "d2": discounts(values, k), "unigrams": unigrams, "total": total}
    model |= {"parts": parts, "least": least}
    known = pairs.where(F.col("kind").isin(NN, NR))
    rows = known.mapInArrow(_Seen(sc.broadcast(model)), "history long, p double, lower double")
    sums = rows.groupBy("history").agg(F.sum("p").alias("p"), F.sum("lower").alias("lower")).toArrow()  # at most 65,537 rows
    seen, lower = np.zeros(len(history)), np.zeros(len(history))
    seen[sums.column("history").to_numpy()] = sums.column("p").to_numpy()
    lower[sums.column("history").to_numpy()] = sums.column("lower").to_numpy()
    scale, log_alpha = backoff(history, seen, lower)
    model |= {"scale": scale, "log_alpha": log_alpha}
    shared, columns = sc.broadcast(model), "key long, n long, gain double"
    heavy = pairs.where(F.col("kind") == NN).mapInArrow(_Gain(shared, least_of_top(values, k)), columns).toArrow()  # at most 65,536 rows
    order = np.argsort(heavy.column("key").to_numpy())
    model |= {"heavy": heavy.column("key").to_numpy()[order], "heavy_gain": heavy.column("gain").to_numpy()[order], "pairs": pairs}
    return model, uni, known.mapInArrow(_Gain(shared), columns)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (kernel.mix(keys.view(np.uint64) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def packed(parts: int, kind: int, keys: np.ndarray, *more: np.ndarray, by: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """One package for each part of the table that holds some of the keys, which lie in the part of `by` where it is given."""
    order = np.argsort(keys)
    part = part_of(keys if by is None else by, parts)[order]
    order = order[np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")]
    edges = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts)))) if len(part) else np.zeros(1, np.int64)
    for p in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[p] : edges[p + 1]]
        yield p, kind, bundled(keys[at], *(x[at] for x in more))


_PACKED = "part long, kind int, body binary"
_SCHEMA = pa.schema({"part": pa.int64(), "kind": pa.int32(), "body": pa.binary()})


def _record(listed: list[tuple], **more: pa.Array) -> pa.RecordBatch:
    part, kind, body = zip(*listed, strict=True) if listed else ((), (), ())
    return pa.record_batch({"part": pa.array(part, pa.int64()), "kind": pa.array(kind, pa.int32()), "body": pa.array(body, pa.binary())} | more)


class _UnigramTable:
    """Unigrams packed by part, some hundred thousand at a time."""

    def __init__(self, parts: int, rows: int = 1 << 19):
        self.parts, self.rows = parts, rows

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= self.rows:
                yield self._packed(held)
                held = []
        if held:
            yield self._packed(held)

    def _packed(self, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
        return _record(list(packed(self.parts, UNIGRAM, (key.view(np.uint64) | TOP_BIT).view(np.int64), small(n))))


class _Ask:
    """Texts -> sums over what is known here, and the other tokens packed for the parts of the tables."""

    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = self.model.value
        uni, parts = m["unigrams"], m["parts"]
        log_base = np.concatenate(([0.0], uni.log_base(m["counts"][1:])))
        task = TaskContext.get().partitionId() << 32
        for at, batch in enumerate(kernel.texts(batches, limit=SLICE)):
            h, row, first = tokens(batch.column("text"))
            ids = numbers(h, m["frequent"])
            before = histories(ids, first)
            rows, named = batch.num_rows, ids > 0  # a row's score takes the alphas of other histories with their unigrams
            score = np.where(before >= 0, m["log_alpha"][np.maximum(before, 0)], 0.0)
            score[named] += m["log_uni"][ids[named]]
            pair = np.arange(len(ids))
            key = pair_keys(before, ids, len(m["frequent"]))
            if len(m["heavy"]):
                place = np.minimum(np.searchsorted(m["heavy"], key), len(m["heavy"]) - 1)
                hit = m["heavy"][place] == key
                score[pair[hit]] += m["heavy_gain"][place[hit]]
                pair, key = pair[~hit], key[~hit]
            other = ~named
            sums = np.stack(
                (
                    np.diff(first).astype(float),
                    np.bincount(row[named], minlength=rows),
                    np.bincount(row[named], log_base[ids[named]], rows),
                    np.bincount(row, score, rows),
                )
            )
            batch_id = task + at
            at_row = row.astype(_small(rows))
            out = [(batch_id % parts, ROWS, sums.tobytes())]
            out += packed(parts, UNIGRAM, ids[other], at_row[other])
            word, rare = ids[pair], before[pair] < 0
            out += packed(parts, BIGRAM, key[~rare], at_row[pair[~rare]], by=np.where(word < 0, word, key)[~rare])
            out += packed(parts, RARE, key[rare], at_row[pair[rare]], by=before[pair[rare]])
            ids_here = [batch.column("doc_id")] + [batch.column("doc_id").slice(0, 0)] * (len(out) - 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids_here]))), pa.int32()), batch.column("doc_id"))
            yield _record(out, batch=pa.array([batch_id] * len(out), pa.int64()), rows=pa.array([rows] * len(out), pa.int32()), doc_ids=lists)


def _small(rows: int) -> type:
    """The smallest type for row numbers of a slice."""
    return np.uint16 if rows < 1 << 16 else np.uint32


_SUMS = "batch long, rows int, doc_ids array<{kind}>, whole binary, at binary, known binary, base binary, score binary"


def _known(table: pa.Table, m: dict) -> dict[int, tuple[np.ndarray, ...]]:
    """One part of the tables: per kind of question the sorted keys and their values. Beside the unigrams' counts stand log alphas."""
    uni = m["unigrams"]

    def listed(rows: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * width

    def by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], values[order]

    known = {}
    rows = [numbered(body, kind, m) for kind in (NN, NR) for body in _of_kind(table, kind)]
    key, history, n, c = listed(rows, 4)
    known[BIGRAM] = by_key(key, gain_of(history, n, c, m))
    rows = [[h, w.astype(np.int64), n, m["counts"][w]] for h, w, n in map(columns_of, _of_kind(table, RN))] + [columns_of(x) for x in _of_kind(table, RR)]
    history, word, n, c = listed(rows, 4)
    found, at = np.unique(history, return_inverse=True)
    count, mass, log_p = np.bincount(at, n, len(found)), discounted(n, m["d2"]), uni.log_p(c)
    scale, log_alpha = backoff(count, np.bincount(at, mass, len(found)) / np.maximum(count, 1), np.bincount(at, 10**log_p, len(found)))
    known[RARE] = by_key(pair_keys(history, word, len(m["frequent"])), np.log10(scale[at] * mass / count[at]) - log_alpha[at] - log_p)
    keys, n = merged(_of_kind(table, UNIGRAM), 2)
    alphas = np.zeros(len(keys))  # 0 for what never was a history
    if len(found) and len(keys):
        place = np.minimum(np.searchsorted(found, keys), len(found) - 1)
        alphas = np.where(found[place] == keys, log_alpha[place], 0.0)
    known[UNIGRAM] = keys, n, alphas
    return known


def _answer(asked: pa.Table, table: pa.Table, m: dict) -> pa.Table:
    """All questions to one part of the tables: per slice one row with the sums of the rows that asked, packed."""
    known, uni = _known(table, m), m["unigrams"]
    asked = asked.sort_by([("batch", "ascending"), ("kind", "ascending")])
    kinds, batches, sizes = (asked.column(x).to_pylist() for x in ("kind", "batch", "rows"))
    out: list[list] = [[] for _ in range(8)]
    at = 0
    while at < asked.num_rows:
        batch, rows = batches[at], sizes[at]
        sums, whole, ids = np.zeros((3, rows)), None, None
        while at < asked.num_rows and batches[at] == batch:
            raw = asked.column("body")[at].as_py()
            if kinds[at] == ROWS:
                whole, ids = raw, asked.column("doc_ids")[at].as_py()
                at += 1
                continue
            key, row = columns_of(raw)
            keys, vals, *alphas = known[kinds[at]]
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            if kinds[at] == UNIGRAM:
                c = np.zeros(len(key), np.int64)
                c[hit] = vals[place[hit]]
                sums[0] += np.bincount(row[hit], minlength=rows)
                sums[1] += np.bincount(row, uni.log_base(c), rows)
                sums[2] += np.bincount(row, uni.log_p(c), rows) + np.bincount(row[hit], alphas[0][place[hit]], rows)
            else:
                sums[2] += np.bincount(row[hit], vals[place[hit]], rows)
            at += 1
        some = np.flatnonzero(sums.any(0))
        packs = (some.astype(_small(rows)), sums[0][some].astype(np.uint32), sums[1][some], sums[2][some])
        for held, x in zip(out, (batch, rows, ids, whole, *(x.tobytes() for x in packs)), strict=True):
            held.append(x)
    kind = asked.schema.field("doc_ids").type
    types = (pa.int64(), pa.int32(), kind, *[pa.binary()] * 5)
    names = ("batch", "rows", "doc_ids", "whole", "at", "known", "base", "score")
    return pa.table({n: pa.array(x, t) for n, x, t in zip(names, out, types, strict=True)})


def _total(parts: pa.Table) -> pa.Table:
    """Sums of all rows of one slice over the parts that answered."""
    rows = parts.column("rows")[0].as_py()
    sums, ids = np.zeros((4, rows)), None
    for i in range(parts.num_rows):
        whole, at, known, base, score = (parts.column(x)[i].as_py() for x in ("whole", "at", "known", "base", "score"))
        if whole is not None:
            sums += np.frombuffer(whole).reshape(4, rows)
            ids = parts.column("doc_ids")[i].values
        at = np.frombuffer(at, _small(rows))
        for j, x in ((1, np.frombuffer(known, np.uint32)), (2, np.frombuffer(base)), (3, np.frombuffer(score))):
            sums[j][at] += x
    counts = {x: pa.array(np.rint(sums[j]).astype(np.int64)) for j, x in enumerate(("n_tokens", "n_known"))}
    return pa.table({"doc_id": ids} | counts | {"base_score": pa.array(sums[2]), "score": pa.array(sums[3])})


def score(docs: DataFrame, model: dict, uni: DataFrame, gains: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score. The view of gains is not needed: they are
    taken from the packed table."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = sc.broadcast({k: x for k, x in model.items() if k != "pairs"})
    asked = docs.select("doc_id", "text").mapInArrow(_Ask(shared), f"{_PACKED}, batch long, rows int, doc_ids array<{kind}>")
    unnamed = uni.where(F.col("n") < model["least"]).mapInArrow(_UnigramTable(model["parts"]), _PACKED)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return _answer(left, right, shared.value)

    def total(parts: pa.Table) -> pa.Table:
        return _total(parts)

    answers = asked.groupBy("part").cogroup(unnamed.unionByName(model["pairs"]).groupBy("part")).applyInArrow(answer, _SUMS.format(kind=kind))
    whole = answers.groupBy("batch").applyInArrow(total, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return whole.select("doc_id", "n_tokens", "n_known", F.lit(model["total"]).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    model, uni, gains = learn(docs.where(tables.fold(7) != 2))
    held = F.coalesce(tables.fold(7) == 2, F.lit(False)).alias("held_out")
    return score(docs, model, uni, gains).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
