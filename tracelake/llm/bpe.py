"""Byte-level BPE encoding and decoding by rank files.

Each pre-token is merged with a hierarchical-bitmap rank queue: one bucket per
merge rank holds the positions (nodes of a linked list over the bytes) whose
pair has this rank; three levels of 64-bit words say which buckets hold any,
so that find-first-set gives the lowest rank in constant time.  Entries that a
neighbouring merge made stale are skipped when they come up.  A pre-token of n
bytes costs about n pushes and pops, so one of a million bytes is no trouble.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.scratch import small_batches
from tracelake.llm.text import chunks, extended

#: A pattern with a boundary before every space that no white space follows, wherever the text is cut there.
CUTS_AT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens, and words between spaces, in a generation of a worker's memo.
MEMO = 400_000


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class RankQueue:
    """Positions by rank, lowest rank first and leftmost first within a rank.

    ``buckets[rank]`` is a heap of positions.  Bit r of ``low`` (in words of 64)
    is set while bucket r has entries, a bit of ``mid`` while a word of ``low``
    is not zero, and a bit of ``top`` while a word of ``mid`` is not zero.
    """

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int]:
        """(rank, position) of the first entry; only if ``top`` is not zero."""
        top = self.top
        word = (top & -top).bit_length() - 1
        bits = self.mid[word]
        word = word << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        lowest = bits & -bits
        rank = word << 6 | lowest.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        bits = self.low[word] = bits ^ lowest
        if not bits:
            bits = self.mid[word >> 6] = self.mid[word >> 6] ^ 1 << (word & 63)
            if not bits:
                self.top = top & (top - 1)
        return rank, bucket[0]


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(len(self.bytes_of))
        self.memo = _Memo(lambda piece: pack(self.merge(piece.encode())))
        self.words = _Memo(self.word) if pattern == CUTS_AT_SPACES else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, queue, get = len(piece), self.queue, ranks.get
        push, pop = queue.push, queue.pop
        end = list(range(1, n + 1))  # node i spans bytes i to end[i]; the next node starts there
        before = list(range(-1, n - 1))
        at = [get(piece[i : i + 2]) for i in range(n - 1)]  # rank of the pair that starts at node i
        at.append(None)
        for i, rank in enumerate(at):
            if rank is not None:
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if at[i] != rank:
                continue  # stale
            j = end[i]
            stop = end[i] = end[j]
            at[j] = None
            if stop < n:
                before[stop] = i
                rank = at[i] = get(piece[i : end[stop]])
                if rank is not None:
                    push(rank, i)
            else:
                at[i] = None
            h = before[i]
            if h >= 0:
                rank = get(piece[h:stop])
                if rank != at[h]:
                    at[h] = rank
                    if rank is not None:
                        push(rank, h)
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.words is not None:
            first, *rest = text.split(" ")
            try:
                return self.matches(first) + b"".join(map(self.words.__getitem__, rest))
            except _WhiteSpace:
                pass
        return self.matches(text)

    def matches(self, text: str) -> bytes:
        """Ids of each match of the pattern, one after the other."""
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def word(self, word: str) -> bytes:
        """Ids of a word and the space before it, where the pattern can be matched apart."""
        if not word or word[0].isspace():
            raise _WhiteSpace
        return self.matches(" " + word)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _WhiteSpace(Exception):
    """White space, or the end, follows a space."""


class _Memo(dict):
    """Ids by piece of text, in two generations: what is used again survives when the young one is full."""

    def __init__(self, ids: Callable[[str], bytes]):
        super().__init__()
        self.ids, self.old = ids, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.ids(piece)
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each whole text in the array column ``into``.

    A null or empty text has no ids (an empty array).  ``ranks_path`` must be
    readable on every executor.  A column already named ``into`` is replaced.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop(into)
    schema = extended(kept.schema, f"`{into}` array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(ranks_path, pattern)
        for part in chunks(batches, text):
            ids = [use.encode(t) for t in part.column(text).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[*part.schema.names, into])

    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of the ids in the binary column ``into``; null ids give empty bytes."""
    kept = docs.drop(into)
    schema = extended(kept.schema, f"`{into}` binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(ranks_path, pattern)
        for part in batches:
            out = [use.decode(np.array(x or [], "<u4").tobytes()) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, into])

    return kept.mapInArrow(run, schema)


def round_trip_digest(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids, and give both digests: key, n_tokens, ids_sha256, decoded_sha256.

    One row per input row, repeated keys and null keys included; a null text
    counts as empty.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(ranks_path, pattern)
        for part in chunks(batches, text):
            ids = [use.encode(t) for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(use.decode(x)).hexdigest() for x in ids]),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
