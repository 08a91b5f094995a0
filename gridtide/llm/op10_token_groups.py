"""Documents whose word shingles have a Jaccard likeness of 0.75 or more, and the components of these links.

A document's set is its distinct shingles of five words (64-bit hashes). Documents with equal sets are one class, known by
a digest of the set. Two sets can only be linked if they share a token among the first n - ceil(0.75 n) + 1 of their tokens in
one common order (frequent tokens last); lists of classes by these tokens lead to all candidates:

1. Within each list every class is compared with the smallest one of about its size; each class keeps the pair of its longest
   list and the one with the smallest name (two rows a class), tested by parity bitmaps of the sets, whose Hamming distance
   is never above the sets' difference, and then exactly. They join most of a large group of near copies.
2. Lists that still hold several components form the token-group matrix. Their classes are partitioned into groups of
   similar ones (same first shared token, about the same size, about `GROUP` each), and each group stores the union of its
   members' list tokens. A query class meets the groups of its lists; a group is opened only if the number of query tokens
   in its union could still reach a link with a member of fitting size.
3. Opened groups are compared by bitmaps first, which leaves the classes that are close to one of another component; these
   come again with their whole sets, and each task gives a forest of verified links, fewer than it has classes.

Pairs inside one component need no test, so no link between components is lost. Frequent tokens only shape the order, which
any choice leaves exact: those with `HOT` or more classes and a 2^20th of all counts, counted over all documents in stretches
of text.

Defined results: null and empty texts and texts without words have no set, and are linked with nothing (component_id is
their doc_id); fewer than five words make one shingle; a null doc_id never names a component unless no other member has
an id (then it is null); repeated rows and ids are kept, and linked by their sets; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables

WIDTH = 5
GROUP = 64
QUERIES = 2000
HOT, MOST_HOT = 8, 1 << 20
STRETCH = 8
PART = 2_000_000
BLOOM_BITS = 24


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """100 * intersection >= 75 * union."""
    return 100 * shared >= 75 * (a + b - shared)


def prefix(n: int) -> int:
    """Tokens of a set of n that a linked one must share one of."""
    return n - (3 * n + 3) // 4 + 1


def fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def sets_of(column: pa.Array) -> list[np.ndarray]:
    words = kernel.words_of(column)
    return kernel.shingle_hashes(words, words.hashes(), WIDTH)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """A class per distinct set; 0 for the empty one."""
    sizes = np.array([len(s) for s in sets], np.uint64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernel.mix(flat + np.uint64(7)))))
    ends = np.cumsum(sizes).astype(np.int64)
    return np.where(sizes > 0, kernel.mix(sums[ends] - sums[ends - sizes.astype(np.int64)] + sizes), np.uint64(0)).view(np.int64)


def new_classes(classes: np.ndarray) -> list[int]:
    """Places of the first row of each class."""
    places = np.unique(classes, return_index=True)[1]
    return sorted(i for i in places.tolist() if classes[i] != 0)


SETS, TOKENS = 0, 1


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SETS: doc_id, n, class. Rows of TOKENS: token (as class), n = classes of a stretch of text that have it; and
    one with token 0 and the number of list entries."""
    held: list[np.ndarray] = []
    entries = 0
    for at, batch in enumerate(kernel.texts(batches)):
        sets = sets_of(batch.column("text"))
        classes = digests(sets)
        kind = pa.array(np.full(len(sets), SETS, np.int32))
        yield pa.record_batch({"kind": kind, "doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "class": pa.array(classes)})
        for i in new_classes(classes):
            held.append(sets[i])
            entries += prefix(len(sets[i]))
        if at % STRETCH == STRETCH - 1:
            yield _frequent(held, batch.schema.field("doc_id").type, entries)
            held, entries = [], 0
    if held:
        yield _frequent(held, batch.schema.field("doc_id").type, entries)


def _frequent(held: list[np.ndarray], kind: pa.DataType, entries: int) -> pa.RecordBatch:
    token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
    token, n = np.append(token[n > 2], np.uint64(0)), np.append(n[n > 2], entries)
    return pa.record_batch({"kind": pa.array(np.full(len(n), TOKENS, np.int32)), "doc_id": pa.nulls(len(n), kind), "n": pa.array(n), "class": pa.array(token.view(np.int64))})


class _Lists:
    """Entries of the lists by token, packed per slice and part."""

    def __init__(self, hot, parts: int):
        self.hot, self.parts = hot, parts

    def first_tokens(self, s: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The prefix in the common order: rare tokens by value, then frequent ones by rank."""
        p = prefix(len(s))
        rare = s[rank < 0]
        if len(rare) >= p:
            return rare[:p]
        often = s[rank >= 0][np.argsort(rank[rank >= 0])]
        return np.concatenate((rare, often[: p - len(rare)]))

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, ranks = self.hot.value
        for batch in kernel.texts(batches):
            sets = sets_of(batch.column("text"))
            classes = digests(sets)
            own = new_classes(classes)
            if not own:
                continue
            tokens, owner = [], []
            for k, i in enumerate(own):
                s = sets[i]
                rank = np.full(len(s), -1)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    rank = np.where(hot[at] == s, ranks[at], -1)
                tokens.append(self.first_tokens(s, rank))
                owner.append(np.full(len(tokens[-1]), k, np.uint32))
            tokens, owner = np.concatenate(tokens), np.concatenate(owner)
            part = (kernel.mix(tokens) % np.uint64(self.parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(self.parts + 1))
            some = np.flatnonzero(np.diff(edges))
            names, sizes = classes[own], np.array([len(sets[i]) for i in own], np.int64)
            cut = [order[edges[p] : edges[p + 1]] for p in some.tolist()]
            mine = [np.unique(owner[x], return_inverse=True) for x in cut]  # classes with tokens in the part
            yield pa.record_batch(
                {
                    "part": pa.array(some, pa.int64()),
                    "tokens": pa.array([tokens[x].tobytes() for x in cut], pa.binary()),
                    "owners": pa.array([place.astype(np.uint32).tobytes() for _, place in mine], pa.binary()),
                    "classes": pa.array([names[who].tobytes() for who, _ in mine], pa.binary()),
                    "sizes": pa.array([sizes[who].tobytes() for who, _ in mine], pa.binary()),
                }
            )


def _shared(part: pa.Table) -> pa.Table:
    """Lists of one part with two or more classes: entries (token, class, n), and the pairs of step 1 (token null) with the
    length of the longest list that gives them."""
    tokens, classes, sizes = [], [], []
    for t, o, c, s in zip(*(part.column(x).to_pylist() for x in ("tokens", "owners", "classes", "sizes")), strict=True):
        owner = np.frombuffer(o, np.uint32)
        tokens.append(np.frombuffer(t, np.uint64))
        classes.append(np.frombuffer(c, np.int64)[owner])
        sizes.append(np.frombuffer(s, np.int64)[owner])
    token, cls, n = np.concatenate(tokens), np.concatenate(classes), np.concatenate(sizes)
    del tokens, classes, sizes
    order = np.argsort(token)
    same = token[order][1:] == token[order][:-1]
    often = np.concatenate((same, [False])) | np.concatenate(([False], same))
    order = order[often]
    token, cls, n = token[order], cls[order], n[order]
    order = np.lexsort((cls, n, token))
    token, cls, n = token[order], cls[order], n[order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))) if len(token) else np.zeros(0, bool)
    token, cls, n = token[new], cls[new], n[new]
    begin = np.concatenate(([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, bool)
    # Leaders: the first of a list, and each one too large for the leader before it.
    leader = np.zeros(len(token), np.int64)
    many = np.diff(np.append(np.flatnonzero(begin), len(token)))
    for a, k in zip(np.flatnonzero(begin).tolist(), many.tolist(), strict=True):
        at, lead = a, a
        while at < a + k:
            stop = at + int(np.searchsorted(n[at : a + k], n[lead] * 4 // 3, side="right"))
            leader[at:stop] = lead
            at = lead = stop
    listed = np.flatnonzero(np.repeat(many > 1, many))
    led = np.flatnonzero(cls != cls[leader])
    length = np.repeat(many, many)
    led = led[np.argsort(-length[led], kind="stable")]
    pair, at = np.unique(np.stack((cls[led], cls[leader[led]])), axis=1, return_index=True)
    at = led[at]
    none = pa.nulls(len(listed), pa.int64())
    return pa.table(
        {
            "token": pa.concat_arrays([pa.array(token[listed].view(np.int64)), pa.nulls(len(at), pa.int64())]),
            "class": pa.array(np.concatenate((cls[listed], pair[0]))),
            "n": pa.array(np.concatenate((n[listed], n[at]))),
            "other": pa.concat_arrays([none, pa.array(pair[1])]),
            "m": pa.concat_arrays([none, pa.array(n[leader[at]])]),
            "length": pa.concat_arrays([none, pa.array(length[at])]),
        }
    )


class _Packs:
    """Whole sets, or their parity bitmaps, of the classes that a Bloom filter may contain."""

    def __init__(self, bloom, bitmaps: bool):
        self.bloom, self.bitmaps = bloom, bitmaps

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = self.bloom.value
        for batch in kernel.texts(batches):
            sets = sets_of(batch.column("text"))
            classes = digests(sets)
            found = np.ones(len(sets), bool)
            for cell in bloom_cells(classes):
                found &= (words[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1
            own = [i for i in new_classes(classes) if found[i]]
            if own:
                packs = [parity(sets[i]) if self.bitmaps else sets[i].tobytes() for i in own]
                yield pa.record_batch({"class": pa.array(classes[own]), "tokens": pa.array(packs, pa.binary())})


def parity(s: np.ndarray) -> bytes:
    """A bit per cell of the hash range, two to four per token: whether the cell has an odd number of tokens."""
    bits = max(int(2 * len(s) - 1).bit_length(), 6)
    cell = (s >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def folded(bitmap: bytes, bits: int) -> int:
    """The bitmap as a number, folded to so many cells."""
    x = np.unpackbits(np.frombuffer(bitmap, np.uint8))
    while len(x) > bits:
        x = x[::2] ^ x[1::2]
    return int.from_bytes(np.packbits(x).tobytes())


def distance(a: bytes, b: bytes) -> int:
    """Cells that differ, after folding the finer bitmap onto the coarser one."""
    bits = 8 * min(len(a), len(b))
    return (folded(a, bits) ^ folded(b, bits)).bit_count()


def bloom_cells(classes: np.ndarray) -> list[np.ndarray]:
    return [(kernel.mix(classes.view(np.uint64) + np.uint64(k)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for k in (1, 2, 3)]


def _bloom_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in bloom_cells(batch.column("class").to_numpy()):
            yield pa.record_batch({"word": pa.array(cell >> 6), "bit": pa.array((np.uint64(1) << (cell & 63).astype(np.uint64)).view(np.int64))})


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets -> linked pairs."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a_tokens"), batch.column("b_tokens"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            keep.append(bool(linked(np.count_nonzero(y[at] == x), len(x), len(y))))
        yield _kept(batch, keep)


def _sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both bitmaps -> pairs that can be linked: a link's sets differ in a seventh of both sizes at most."""
    for batch in batches:
        sizes = zip(*(batch.column(x).to_pylist() for x in ("na", "nb", "a_tokens", "b_tokens")), strict=True)
        yield _kept(batch, [7 * distance(a, b) <= na + nb for na, nb, a, b in sizes])


def _kept(batch: pa.RecordBatch, keep: list[bool]) -> pa.RecordBatch:
    mask = pa.array(keep, pa.bool_())
    return pa.record_batch({k: batch.column(k).filter(mask) for k in ("a", "b", "na", "nb")})


def components(edges: DataFrame) -> DataFrame:
    """(class, root) of all ends of the edges (a, b): alternating large and small stars until nothing changes. Each
    round's edges are written, so a lost executor costs one round at most."""
    edges = tables.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = tables.stored(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("class"), F.col("b").alias("root"))


class Sets:
    """The sets of classes, made anew from the texts: only classes that a Bloom filter may contain (2 MB), so little of the
    corpus moves. Bitmaps of all listed classes are made once and written."""

    def __init__(self, docs: DataFrame, listed: DataFrame):
        self.docs = docs
        self.bitmaps = tables.stored(self._of(listed, True), "parity-bitmaps")

    def _of(self, classes: DataFrame, bitmaps: bool) -> DataFrame:
        words = classes.mapInArrow(_bloom_rows, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^18 rows at most
        bloom = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
        bloom[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        shared = self.docs.sparkSession.sparkContext.broadcast(bloom)
        packs = self.docs.mapInArrow(_Packs(shared, bitmaps), "class long, tokens binary")
        return packs.groupBy("class").agg(F.any_value("tokens").alias("tokens"))

    @staticmethod
    def _tried(pairs: DataFrame, packs: DataFrame, test, name: str) -> DataFrame:
        a = packs.select(F.col("class").alias("a"), F.col("tokens").alias("a_tokens"))
        b = packs.select(F.col("class").alias("b"), F.col("tokens").alias("b_tokens"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "a_tokens", "b_tokens")
        return tables.stored(both.mapInArrow(test, "a long, b long, na long, nb long"), name)

    def links(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b, na, nb) -> those that are linked, by bitmaps and then exactly."""
        sifted = self._tried(pairs, self.bitmaps, _sift, "sifted-pairs")
        return self._tried(sifted, self.whole(sifted.select(F.explode(F.array("a", "b")).alias("class"))), _verify, "links")

    def whole(self, classes: DataFrame) -> DataFrame:
        """The whole sets of the classes, written."""
        return tables.stored(self._of(classes.distinct(), False), "whole-sets")


def _open(queries: pa.Table, members: pa.Table) -> pa.Table:
    """Queries of one group, and its members: those that are close by bitmaps to one of another component (asks: queries)."""
    rows = list(zip(*(members.column(x).to_pylist() for x in ("n", "root", "tokens")), strict=True))
    seen: dict[tuple[int, int], int] = {}  # folded bitmaps by (which row, bits)

    def at(key: int, bitmap: bytes, bits: int) -> int:
        if (key, bits) not in seen:
            seen[key, bits] = folded(bitmap, bits)
        return seen[key, bits]

    asks, met = np.zeros(len(queries), bool), np.zeros(len(rows), bool)
    for i, (n, root, own) in enumerate(zip(*(queries.column(x).to_pylist() for x in ("n", "root", "tokens")), strict=True)):
        for j, (m, r, other) in enumerate(rows):
            if r > root and 4 * min(n, m) >= 3 * max(n, m):
                bits = 8 * min(len(own), len(other))
                if 7 * (at(-1 - i, own, bits) ^ at(j, other, bits)).bit_count() <= n + m:
                    asks[i] = met[j] = True
    kept = [t.select(["grp", "lot", "class", "root"]).filter(pa.array(mask)) for t, mask in ((queries, asks), (members, met))]
    sides = [t.append_column("asks", pa.array(np.full(len(t), asks, bool))) for t, asks in zip(kept, (True, False), strict=True)]
    return pa.concat_tables(sides)


def _forest(group: pa.Table) -> pa.Table:
    """Close queries and members of one opened group with their whole sets: verified links (a, b) that join the components."""
    rows = [(c, r, np.frombuffer(t, np.uint64), q) for c, r, t, q in zip(*(group.column(x).to_pylist() for x in ("class", "root", "tokens", "asks")), strict=True)]
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = x = top.get(top[x], top[x])
        return x

    out: list[tuple[int, int]] = []
    members = [r for r in rows if not r[3]]
    for a, root, own, _ in (r for r in rows if r[3]):
        for b, other_root, other, _ in members:
            if other_root > root and 4 * min(len(own), len(other)) >= 3 * max(len(own), len(other)):
                x, y = find(root), find(other_root)
                if x != y:
                    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                    if linked(np.count_nonzero(other[at] == own), len(own), len(other)):
                        top[max(x, y)] = min(x, y)
                        out.append((a, b))
    return pa.table({x: pa.array([o[k] for o in out], pa.int64()) for k, x in enumerate("ab")})


def classes_and_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, class) of all rows, and (class, root) of the classes that are linked with another one."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = tables.stored(docs.mapInArrow(_sets, f"kind int, doc_id {kind}, n long, class long"), "shingle-sets")
    sets = first.where(F.col("kind") == SETS).select("doc_id", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
    tokens = first.where(F.col("kind") == TOKENS).groupBy(F.col("class").alias("token")).agg(F.sum("n").alias("n"))
    entries = tokens.where("token = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = tokens.where("token <> 0")
    least = max(HOT, -(-counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // MOST_HOT))
    hot = counted.where(F.col("n") >= least).toArrow()  # at most 2^20 rows: each has that share of all counts
    hot = hot.sort_by([("n", "descending"), ("token", "ascending")])
    hashes = hot.column("token").to_numpy().view(np.uint64)
    rank = np.arange(len(hashes))[::-1]  # the most frequent come last
    order = np.argsort(hashes)
    parts = max(1, -(-entries // PART))
    packed = docs.mapInArrow(_Lists(sc.broadcast((hashes[order], rank[order])), parts), "part long, tokens binary, owners binary, classes binary, sizes binary")

    def shared_lists(part: pa.Table) -> pa.Table:
        return _shared(part)

    found = tables.stored(packed.groupBy("part").applyInArrow(shared_lists, "token long, class long, n long, other long, m long, length long"), "shared-lists")
    lists = found.where("token is not null").select("token", "class", "n")
    stars = tables.stored(star_pairs(found.where("token is null")), "star-pairs")
    test = Sets(docs, lists.select("class").distinct())
    links = test.links(stars)
    roots = components(links)
    rest = open_links(mixed_lists(lists, roots), test)
    return sets, roots if rest.isEmpty() else components(contracted(rest, roots))


def star_pairs(found: DataFrame) -> DataFrame:
    """For each class its pair of the longest list and that with the smallest name: (a, b, na, nb)."""
    pair = lambda *first: F.struct(*first, F.col("other").alias("b"), F.col("m").alias("nb"))
    best = found.groupBy(F.col("class").alias("a"), F.col("n").alias("na")).agg(F.max(pair("length")).alias("x"), F.min(pair()).alias("y"))
    both = F.explode(F.array_distinct(F.array(F.struct("x.b", "x.nb"), F.struct("y.b", "y.nb"))))
    return best.select("a", "na", both.alias("p")).select("a", "p.b", "na", "p.nb")


def mixed_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, class, n, root, band) of lists with several components."""
    rooted = lists.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    band = F.floor(F.ln("n") / float(np.log(4 / 3)))
    return tables.stored(rooted.join(mixed, "token").select("token", "class", "n", "root", band.alias("band")), "mixed-lists")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    ra, rb = (roots.select(F.col("class").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    found = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return found.withColumns({f"root_{x}": F.coalesce(f"root_{x}", x) for x in "ab"})


def contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between components that links join, and between the classes of a component and its root."""
    between = _rooted(links, roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    return between.unionByName(roots.select(F.col("class").alias("a"), F.col("root").alias("b")))


def open_links(rows: DataFrame, test: Sets) -> DataFrame:
    """(a, b): verified links that join the components of `rows` as all links between them do. A group meets at most about
    `QUERIES` queries in one task; it comes once for each such lot."""
    bitmaps = test.bitmaps
    member = rows.groupBy("class").agg(F.min("token").alias("token"), F.min("root").alias("root"), F.max("n").alias("n"), F.max("band").alias("band"))
    many = member.groupBy("token", "band").agg(F.ceil(F.count("*") / GROUP).alias("k"))
    grp = F.xxhash64("token", "band", F.pmod(F.xxhash64("class"), F.col("k")))
    member = tables.stored(member.join(many, ["token", "band"]).select("class", "n", "root", grp.alias("grp")), "group-members")
    union = rows.select("token", "class").join(member, "class").groupBy("token", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # Entries of the matrix: tokens of the query in the group's union. Only members between least and most can fit.
    least, most = F.greatest("lo", F.ceil(F.col("n") * 3 / 4)), F.least("hi", F.floor(F.col("n") * 4 / 3))
    met = rows.join(union, "token").where(least <= most).groupBy("class", "n", "root", "grp").agg(F.count("*").alias("k"), F.min(least).alias("lo"), F.max(most).alias("hi"))
    reach = 7 * (F.col("k") + F.greatest(F.floor((F.col("n") * 3 + 3) / 4), F.floor((F.col("hi") * 3 + 3) / 4)) - 1) >= 3 * (F.col("n") + F.col("lo"))
    opened = tables.stored(met.where(reach).select("class", "n", "root", "grp"), "opened-groups")
    lots = opened.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("lots"))
    queries = opened.join(lots, "grp").withColumn("lot", F.pmod(F.xxhash64("class"), F.col("lots")).cast("int")).drop("lots").join(bitmaps, "class")
    copies = member.join(lots, "grp").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots").join(bitmaps, "class")
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])  # other attributes than those of the queries

    def opening(left: pa.Table, right: pa.Table) -> pa.Table:
        return _open(left, right)

    marked = queries.groupBy("grp", "lot").cogroup(copies.groupBy("grp", "lot")).applyInArrow(opening, "grp long, lot int, class long, root long, asks boolean")
    close = tables.stored(marked, "close-classes")

    def verifying(group: pa.Table) -> pa.Table:
        return _forest(group)

    whole = close.join(test.whole(close.select("class")), "class")
    return tables.stored(whole.groupBy("grp", "lot").applyInArrow(verifying, "a long, b long"), "forest")


def join(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    sets, roots = classes_and_roots(docs)
    rooted = sets.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("name"))
    return rooted.join(names, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", F.when(F.col("root").isNull(), F.col("doc_id"))).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(tables.documents(spark, sf_dir))


class _Classed:
    """All columns and the class of the text's set (null for the empty one)."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.texts(batches):
            classes = digests(sets_of(batch.column("text")))
            yield batch.append_column(self.name, pa.array(classes, mask=classes == 0))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that of the smallest doc_id (null last), then of the smallest class; of rows
    alike in both, one. Documents without a set stay."""
    sets, roots = classes_and_roots(docs)
    rooted = sets.where("class is not null").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")
    own, kept_id, kept_class = (tables.unused(x, docs.columns) for x in ("class", "kept_id", "kept_class"))
    kept = rooted.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias(kept_id), F.col("k.class").alias(kept_class))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = docs.mapInArrow(_Classed(own), f"{fields}, {own} long")
    same = (F.col(own) == F.col(kept_class)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    chosen = marked.join(kept, same, "left_semi")
    twice = sets.groupBy("doc_id", "class").count().where("count > 1").select(F.col("doc_id").alias(kept_id), F.col("class").alias(kept_class))
    if not twice.isEmpty():  # repeated rows: one of each stays
        chosen = chosen.join(twice, same, "left_anti").unionByName(chosen.join(twice, same, "left_semi").dropDuplicates(["doc_id", own]))
    return chosen.unionByName(marked.where(F.col(own).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
