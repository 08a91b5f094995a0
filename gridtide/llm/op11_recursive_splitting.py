"""Periodic runs of words, found by recursive frequency splitting, and texts with each run cut to its first period.

A run is a stretch of words with smallest period q that is at least `POWER` periods and `LEAST` words long and that no
neighbouring word extends. So every word of a run stands in it `POWER` times or more:

1. A word that stands fewer times in the current segment (at first a whole text) belongs to no run in it, and splits it. The
   pieces are counted again, until no segment has such a word; pieces shorter than `LEAST` words go.
2. Surviving segments are scanned at the lags where a run can be. For lags from B to 2B-1 (B = 1, 2, 4 ...) all windows of 2B
   words get exact names (pairs of names of half windows). A run with such a period holds a window that begins at a
   multiple of B and comes again q words later, and no sooner, as it is longer than the period. These places and lags are the
   anchors; at each anchor's lag its segment is compared with itself, and stretches of equal words that hold an anchor
   are runs if they are long enough. Their period is the smallest, as a smaller one would bring the window back sooner.

Both steps work on all texts of a slice at once and cost n log n for a segment of n words, whatever its periods; splitting
sorts only what is not yet stable. Words are compared as they are (64-bit hashes). A text is one row, so a run is never cut.

Defined results: null counts as empty, and texts without words have no runs and an empty collapsed text; words are what stands
between blanks, and the collapsed text has one space between them; repeated rows and ids are kept; other columns stay,
but those named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables

POWER = 4
LEAST = 6


def segments(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that survive the splitting, ascending, and the bounds of their segments among them. keys: of the words."""
    at, part = np.arange(len(keys)), text
    whole: list[np.ndarray] = []
    while len(at):
        named = kernel.mix(keys[at] + kernel.mix(part.astype(np.uint64)))  # equal for equal words of one segment
        _, name, count = np.unique(named, return_inverse=True, return_counts=True)
        rare = count[name] < POWER
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        unstable = np.repeat(np.logical_or.reduceat(rare, first), np.diff(np.append(first, len(part))))
        whole.append(at[~unstable])
        left = unstable & ~rare
        at, old = at[left], part[left]
        if len(at):
            first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (old[1:] != old[:-1]))))
            size = np.diff(np.append(first, len(at)))
            part = np.repeat(np.arange(len(first)), size)
            long = np.repeat(size >= LEAST, size)
            at, part = at[long], part[long]
    places = np.sort(np.concatenate([np.zeros(0, np.int64), *whole]))
    if not len(places):
        return places, np.zeros(1, np.int64)
    new = (places[1:] != places[:-1] + 1) | (text[places[1:]] != text[places[:-1]])
    return places, np.concatenate(([0], np.flatnonzero(new) + 1, [len(places)]))


def anchors(line: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag): windows that come again after `lag` words, and no sooner, and are longer than the lag."""
    name, width = np.unique(line, return_inverse=True)[1], 1
    places, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while POWER * width <= longest and len(name) > width:
        pair = name[:-width] * (int(name.max()) + 1) + name[width:]
        name = np.unique(pair, return_inverse=True)[1]
        order = np.argsort(name, kind="stable")
        gap = order[1:] - order[:-1]
        hit = (name[order[1:]] == name[order[:-1]]) & (gap >= width) & (gap < 2 * width) & (order[:-1] % width == 0)
        places.append(order[:-1][hit])
        lags.append(gap[hit])
        width *= 2
    return np.concatenate(places), np.concatenate(lags)


def runs(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs by start and period; start counts over all texts of the slice."""
    at, bounds = segments(keys, text)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    # One line of all segments; a number of its own stands after each, so nothing matches across.
    word = np.unique(keys[at], return_inverse=True)[1].astype(np.int64)
    many = len(bounds) - 1
    line = np.insert(word, bounds[1:], -1 - np.arange(many))
    begin = bounds[:-1] + np.arange(many)
    size = np.diff(bounds)
    place, lag = anchors(line, int(size.max()))
    if not len(place):
        return np.zeros((0, 3), np.int64)
    segment = np.searchsorted(begin, place, side="right") - 1
    order = np.lexsort((place, lag, segment))
    place, lag, segment = place[order], lag[order], segment[order]
    edge = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (lag[1:] != lag[:-1]))))
    out: list[tuple[int, int, int]] = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(place)], strict=True):
        s, q = int(segment[a]), int(lag[a])
        own = line[begin[s] : begin[s] + size[s]]
        equal = np.concatenate(([False], own[:-q] == own[q:], [False]))
        turn = np.flatnonzero(equal[1:] != equal[:-1])
        start, stop = turn[::2], turn[1::2]  # equal to the word q later from start to before stop
        held = place[a:b] - begin[s]
        has = np.searchsorted(held, stop) > np.searchsorted(held, start)
        for i in np.flatnonzero(has & (stop - start + q >= max(LEAST, POWER * q))).tolist():
            out.append((int(at[bounds[s] + start[i]]), int(stop[i] - start[i]) + q, q))
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

#: From a slice and its numbers of words: for some rows, which word stands at each place.
Reading = Callable[[pa.RecordBatch, np.ndarray], dict[int, np.ndarray]]


class _Runs:
    def __init__(self, reading: Reading | None):
        self.reading = reading

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.texts(batches):
            words = kernel.words_of(batch.column("text"), lower=False)
            keys, first, doc = words.hashes(), words.first, words.doc
            read = self.reading(batch, words.counts) if self.reading else {}
            for row, order in read.items():
                keys[first[row] : first[row + 1]] = keys[first[row] + order]
            found = runs(keys, doc)
            owner = doc[found[:, 0]] if len(found) else np.zeros(0, np.int64)
            # A word goes if it stands in a run after the run's first period.
            step = np.zeros(len(doc) + 1, np.int64)
            np.add.at(step, found[:, 0] + found[:, 2], 1)
            np.add.at(step, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(step[:-1]) == 0
            raw = words.data.tobytes()
            texts = []
            changed = set(read) | set(owner.tolist())
            for row, (a, b) in enumerate(zip(words.offs[:-1].tolist(), words.offs[1:].tolist(), strict=True)):
                own = raw[a:b].split()  # by the same blanks
                if row in changed:
                    order = read.get(row, np.arange(len(own)))[kept[first[row] : first[row + 1]]]
                    own = [own[i] for i in order.tolist()]
                texts.append(b" ".join(own))
            found[:, 0] -= first[owner]
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], fields=list(RUN)),
            )
            kept_columns = {x: batch.column(x) for x in batch.schema.names if x != "text"}
            yield pa.record_batch(kept_columns | {"n_words": pa.array(words.counts.astype(np.int64)), "runs": lists, "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})


def collapse(docs: DataFrame, reading: Reading | None = None) -> DataFrame:
    """All columns of docs but text, with n_words, runs by start and period (places in the text, words from 0) and the
    collapsed text. No shuffle: a text's words meet in its own task."""
    docs = docs.drop("n_words", "runs", "collapsed")
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(_Runs(reading), own + FOUND)


def repeated_tails(batch: pa.RecordBatch, counts: np.ndarray) -> dict[int, np.ndarray]:
    """Every tenth text (by `key`) repeats a stretch of its own words from some place on, to its end."""
    out = {}
    for row, (h, n) in enumerate(zip(batch.column("key").to_pylist(), counts.tolist(), strict=True)):
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            i = np.arange(n)
            out[row] = np.where(i < a, i, a + (i - a) % p)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("key"))
    found = collapse(docs, repeated_tails)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = found.withColumn("longest", F.array_max(ranked))
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
