"""Whole-column text work inside a task: Arrow string columns as flat byte arrays, word bounds and 64-bit hashes.

A string column of a slice is one byte array plus row offsets; words, hashes and windows are found for all rows of the
slice at once. Slices hold at most `limit` bytes (or one row), so memory follows the longest row, not the batch.
Nulls count as empty texts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
LIMIT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between calls."""
    if len(_POWERS[0]) < n:
        size = max(n, LIMIT + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def slices(column: pa.Array, limit: int = LIMIT) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text; a longer row stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, n = 0, len(sizes)
    total = np.concatenate(([0], np.cumsum(sizes)))
    while start < n:
        stop = int(np.searchsorted(total, total[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offsets of the rows in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of a slice: starts and ends in bytes, `first` = offset of each row's first word, `doc` = row of each word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, inside: np.ndarray = NOT_SPACE):
        self.data, self.offs = data, offs
        on = inside[data]
        size = len(data)
        before = np.zeros(size, bool)
        after = np.zeros(size, bool)
        before[1:], after[:-1] = on[:-1], on[1:]
        before[offs[:-1][offs[:-1] < size]] = False
        after[(offs[1:] - 1)[offs[1:] > 0]] = False
        self.starts = np.flatnonzero(on & ~before)
        self.ends = np.flatnonzero(on & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self._doc = None

    @property
    def doc(self) -> np.ndarray:
        if self._doc is None:
            self._doc = np.repeat(np.arange(len(self.counts)), self.counts)
        return self._doc

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U64)
        sums, inverse = byte_sums(self.data)
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(U64))


def byte_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums; any substring's hash is a difference times an inverse power."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def words_of(column: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    data, offs = flat(column)
    return Words(ASCII_LOWER[data] if lower else data, offs, inside)


def word_hash(word: str) -> int:
    """The hash that `Words.hashes` gives to one word."""
    return int(words_of(pa.array([word])).hashes()[0])


def shingle_hashes(words: Words, hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row: distinct hashes of runs of `width` words, ascending; a shorter row is one run; a row without words has none."""
    n = len(hashes)
    runs = np.zeros(max(n - width + 1, 0), U64)
    for j in range(width):
        runs += mix(hashes[j : j + len(runs)] + U64(j + 1))
    runs = mix(runs)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            whole = U64(0)
            with np.errstate(over="ignore"):
                for j, h in enumerate(hashes[a:b]):
                    whole = whole + mix(np.array([h + U64(1000 * (b - a) + j)]))[0]
            out.append(mix(np.array([whole])))
        else:
            out.append(np.zeros(0, U64))
    return out


def texts(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    """The rows of all batches again, in slices of at most `limit` bytes of `column`."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        for a, b in slices(batch.column(at), limit):
            yield batch.slice(a, b - a)
