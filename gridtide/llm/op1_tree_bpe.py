"""Byte-level BPE encoding and decoding by tree concatenation.

Text is cut where no rule of the tokenizer looks across: before a space that follows a visible character. What has no such
place for long (a run of letters, of punctuation, of spaces) is split into the tokenizer's words, and a long word is cut
in halves down to leaves. Halves are encoded apart, then joined: the last tokens of the left and the first of the right
half are encoded again as one window, which doubles until its first token is the left half's and its last one the right
half's at these places. BPE is exact on a sequence of tokens if it is on all neighbouring pairs, and every pair then comes
from one exact encoding, so the joined tokens are those of the whole.

Texts above `PIECE` characters are spread as pieces over all tasks, and a document's pieces meet again in one task: what
meets is one row's tokens. Other texts are encoded where they are read.

The vocabulary file is a parameter (a byte-level BPE whose ids follow the order of its merges). Its special tokens are
recognised in texts, as the file asks for. Decoding concatenates the tokens' bytes and replaces what is not UTF-8.

Defined results: null counts as empty; an empty text has 0 tokens, and the digests of two empty strings; repeated rows and
ids keep their rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import kernel, tables

PIECE = 1 << 15
LEAF = 256
#: Longer runs without a change between space and no space go by the tree.
RUN = 512
PLAIN, WORDS, SPECIAL = 0, 1, 2
_LONG_RUN = re.compile(r"\S{%d}|\s{%d}" % (RUN, RUN))
_SAFE = re.compile(r"(?<=\S) ")
_BETWEEN = "\0"


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Codec:
    """The vocabulary, its merges and its splitting into words."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        back = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        vocab = spec["model"]["vocab"]
        ranks = {b"".join(back[c] for c in s): i for s, i in vocab.items() if s not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for s, i in ranks.items():
            self.bytes[i] = s
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.shown = [b""] * size
        for s, i in vocab.items():
            self.shown[i] = s
        self.digits = [b"%d," % i for i in range(size)]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # The words of a text, as the vocabulary's splitting rule has them.
        import public_tokenizers

        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    # -- cutting ------------------------------------------------------------------------------------------------------

    def pieces(self, text: str, size: int = PIECE) -> Iterator[tuple[int, str, bool]]:
        """(kind, payload, glued): in order; a glued piece continues a word of the piece before it."""
        for i, part in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                yield SPECIAL, part, False
            elif part:
                yield from self._plain(part, size)

    def _plain(self, text: str, size: int) -> Iterator[tuple[int, str, bool]]:
        runs = [m.start() for m in _LONG_RUN.finditer(text)]
        if not runs and len(text) <= size:
            yield PLAIN, text, False
            return
        start = 0
        while start < len(text):
            run = next((r for r in runs if r >= start), len(text))
            stop = self._safe_before(text, start, min(start + size, run))
            if stop > start:
                yield PLAIN, text[start:stop], False
                start = stop
                continue
            found = _SAFE.search(text, max(start + 1, min(run + 1, len(text))))
            stop = found.start() if found else len(text)
            yield from self._stretch(text[start:stop], size)
            start = stop

    @staticmethod
    def _safe_before(text: str, start: int, limit: int) -> int:
        """The last safe cut in (start, limit]; the end of the text is one."""
        if limit >= len(text):
            return len(text)
        at = limit
        while at > start:
            at = text.rfind(" ", start + 1, at + 1)
            if at < 0:
                return start
            if not text[at - 1].isspace():
                return at
            at -= 1
        return start

    def _stretch(self, text: str, size: int) -> Iterator[tuple[int, str, bool]]:
        """A stretch without a safe cut: its words; long ones in halves."""
        held: list[str] = []
        room = size
        for word, _ in self.own.pre_tokenizer.pre_tokenize_str(text):
            if len(word) > size:
                if held:
                    yield WORDS, _BETWEEN.join(held), False
                    held, room = [], size
                for k, (a, b) in enumerate(_halves(0, len(word), size)):
                    yield WORDS, word[a:b], k > 0
                continue
            if len(word) > room:
                yield WORDS, _BETWEEN.join(held), False
                held, room = [], size
            held.append(word)
            room -= len(word)
        if held:
            yield WORDS, _BETWEEN.join(held), False

    # -- encoding -----------------------------------------------------------------------------------------------------

    def word(self, word: str) -> list[int]:
        """One word of the vocabulary's alphabet, by the tree."""
        parts = [[t.id for t in self.own.model.tokenize(word[a:b])] for a, b in _halves(0, len(word), LEAF)]
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Exact tokens of two neighbouring parts of one word."""
        width = 4
        while left and right:
            a, b = min(width, len(left)), min(width, len(right))
            window = "".join(self.shown[i] for i in left[len(left) - a :] + right[:b])
            new = [t.id for t in self.own.model.tokenize(window)]
            if (a == len(left) or new[0] == left[-a]) and (b == len(right) or new[-1] == right[b - 1]):
                return left[: len(left) - a] + new + right[b:]
            width *= 2
        return left + right

    def encode_piece(self, kind: int, payload: str) -> list[int]:
        if kind == PLAIN:
            return self.fast.encode_ordinary(payload)
        if kind == SPECIAL:
            return [self.special[payload]]
        return [i for word in payload.split(_BETWEEN) for i in self.word(word)]

    def merge(self, parts: list[tuple[list[int], bool]]) -> list[int]:
        """Tokens of consecutive pieces; glued neighbours are joined pairwise, level by level."""
        while any(glued for _, glued in parts[1:]):
            level: list[tuple[list[int], bool]] = []
            free = False  # the last one of the level can take its right neighbour
            for ids, glued in parts:
                if glued and level and free:
                    level[-1] = (self.join(level[-1][0], ids), level[-1][1])
                    free = False
                else:
                    level.append((ids, glued))
                    free = True
            parts = level
        return [i for ids, _ in parts for i in ids]

    def encode(self, text: str) -> list[int]:
        got = [(self.encode_piece(kind, payload), glued) for kind, payload, glued in self.pieces(text)]
        return got[0][0] if len(got) == 1 else self.merge(got)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        listed = b"".join(map(self.digits.__getitem__, ids))[:-1]
        decoded = b"".join(map(self.bytes.__getitem__, ids))
        try:
            decoded.decode("utf-8")
        except UnicodeDecodeError:
            decoded = decoded.decode("utf-8", errors="replace").encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _halves(a: int, b: int, size: int) -> Iterator[tuple[int, int]]:
    if b - a <= size:
        yield a, b
    else:
        yield from _halves(a, (a + b) // 2, size)
        yield from _halves((a + b) // 2, b, size)


@lru_cache(maxsize=2)
def codec(path: str | None) -> Codec:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Codec(path)


_DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest_columns(rows: list[tuple[int, str, str]]) -> dict[str, pa.Array]:
    return {f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DIGESTS)}


class _Whole:
    """Texts that stay where they are read: digests, and with `ids` the tokens."""

    def __init__(self, path: str | None, ids: bool):
        self.path, self.ids = path, ids

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(self.path)
        for batch in kernel.texts(batches):
            got = [c.encode(x or "") for x in batch.column("text").to_pylist()]
            kept = {x: batch.column(x) for x in batch.schema.names if x != "text"}
            more = {"ids": pa.array(got, pa.list_(pa.int32()))} if self.ids else {}
            yield pa.record_batch(kept | _digest_columns([c.digests(x) for x in got]) | more)


class _Cut:
    def __init__(self, path: str | None):
        self.path = path

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(self.path)
        for batch in kernel.texts(batches):
            for i, (row, text) in enumerate(zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                got = list(c.pieces(text))
                n = len(got)
                kept = {x: pa.concat_arrays([batch.column(x).slice(i, 1)] * n) for x in batch.schema.names if x not in ("text", "row")}
                yield pa.record_batch(
                    {
                        "row": pa.array([row] * n, pa.int64()),
                        "seq": pa.array(range(n), pa.int32()),
                        "kind": pa.array([p[0] for p in got], pa.int32()),
                        "payload": pa.array([p[1] for p in got], pa.string()),
                        "glued": pa.array([p[2] for p in got], pa.bool_()),
                    }
                    | kept
                )


class _Pieces:
    def __init__(self, path: str | None):
        self.path = path

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(self.path)
        for batch in kernel.texts(batches, "payload"):
            ids = [c.encode_piece(k, p) for k, p in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True)]
            kept = {x: batch.column(x) for x in batch.schema.names if x not in ("kind", "payload")}
            yield pa.record_batch(kept | {"tokens": pa.array([np.array(x, np.int32).tobytes() for x in ids], pa.binary())})


def _merged(part: pa.Table, path: str | None, ids: bool) -> pa.Table:
    """All pieces of one document as one row."""
    c = codec(path)
    part = part.sort_by("seq")
    lists = [np.frombuffer(x, np.int32).tolist() for x in part.column("tokens").to_pylist()]
    got = c.merge(list(zip(lists, part.column("glued").to_pylist(), strict=True)))
    kept = {x: part.column(x).slice(0, 1) for x in part.column_names if x not in ("row", "seq", "glued", "tokens")}
    more = {"ids": pa.array([got], pa.list_(pa.int32()))} if ids else {}
    return pa.table(kept | _digest_columns([c.digests(got)]) | more)


def encode(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, and with `ids` the tokens themselves."""
    docs = docs.select("doc_id", "text")
    own = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    found = f"{own}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    size = F.coalesce(F.length("text"), F.lit(0))
    short = docs.where(size <= PIECE).mapInArrow(_Whole(path, ids), found)
    cut = docs.where(size > PIECE).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_Cut(path), f"row long, seq int, kind int, payload string, glued boolean, {own}")
    spread = cut.repartition("row", "seq").mapInArrow(_Pieces(path), f"row long, seq int, glued boolean, {own}, tokens binary")

    def merged(part: pa.Table) -> pa.Table:
        return _merged(part, path, ids)

    return short.unionByName(spread.groupBy("row").applyInArrow(merged, found))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(tables.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token counts and digests, with their tokens."""
    return encode(docs, ids=True)
