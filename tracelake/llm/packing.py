"""Best-two-fit packing of documents into sequences of a fixed capacity.

The classical procedure: fill a sequence greedily with the largest documents
that fit; if a gap stays, take out its smallest document and put in the two
unpacked documents that fill the gap so widened most tightly, if they fill it
more tightly than the one did.  Repeat with the next sequence.

Each choice depends only on which lengths are still to be had, not on which
document has them, and there are no more lengths than the capacity.  So the
whole corpus is reduced to a count for each length; sequences that would be
filled alike are planned together, as often as the counts allow, which gives
exactly what one sequence at a time would.  The plan has a few runs for each
length, however many documents there are.  Each document then finds its place
from its length and its rank among those of that length, which the tasks that
encode it count as they go.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.scratch import Scratch
from tracelake.llm.text import chunks
from tracelake.llm.token_files import AT_ONCE_BYTES, LibraryEncoder, _encoder

CAPACITY = 2048


class Stock:
    """How many documents of each length are unpacked, and the largest length to be had up to each one."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.largest = np.zeros(len(counts), np.int64)
        self.refresh()

    def refresh(self) -> None:
        at = np.arange(len(self.left))
        self.largest = np.maximum.accumulate(np.where(self.left > 0, at, 0))

    def upto(self, size: int, used: Counter) -> int:
        """Largest length up to ``size`` of which more are left than ``used`` says; 0 if there is none."""
        at = int(self.largest[size])
        while at and self.left[at] <= used[at]:
            at = int(self.largest[at - 1])
        return at

    def pair(self, room: int, over: int, used: Counter) -> tuple[int, int] | None:
        """The two lengths with the largest sum above ``over`` and at most ``room``; of these the one with the largest part."""
        best, found = over, None
        big = self.upto(room - 1, used)
        while big and 2 * big > best:
            small = self.upto(min(big, room - big), used + Counter([big]))
            if small and big + small > best:
                best, found = big + small, (big, small)
                if best == room:
                    break
            big = self.upto(big - 1, used)
        return found


def fill(stock: Stock, capacity: int) -> tuple[list[int], Counter]:
    """Lengths of the next sequence in order of their places, and how many of each length had to be there for these choices."""
    used: Counter = Counter()
    sizes: list[int] = []
    gap = capacity
    while size := stock.upto(gap, used):
        times = min(gap // size, int(stock.left[size]) - used[size])
        used[size] += times
        sizes += [size] * times
        gap -= size * times
    if gap and sizes:
        # the document taken out is in use still, so it can't be one of the two
        two = stock.pair(gap + sizes[-1], sizes[-1], used)
        if two:
            return [*sizes[:-1], *two], used + Counter(two)
    return sizes, used


@dataclass
class Plan:
    """Runs of documents of one length: those of ranks first .. first + uses * times - 1 fill ``uses`` places, from ``offset`` on, in each of ``times`` sequences from ``sequence`` on."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    uses: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of documents by length and rank."""
        wide = np.int64(1) << np.int64(48)  # ranks stay far below
        at = np.searchsorted(self.length * wide + self.first, length * wide + rank, side="right") - 1
        nth = rank - self.first[at]
        return self.sequence[at] + nth // self.uses[at], self.offset[at] + (nth % self.uses[at]) * length


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Pack ``counts[n]`` documents of each length n (1 .. capacity)."""
    stock = Stock(np.concatenate([counts, np.zeros(capacity + 1 - len(counts), np.int64)]))
    taken = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    while stock.largest[capacity]:
        sizes, needs = fill(stock, capacity)
        uses = Counter(sizes)
        kinds = sorted(uses, reverse=True)
        times = min((int(stock.left[s]) - needs[s]) // n + 1 for s, n in uses.items())
        offset = 0
        for s in kinds:
            runs.append((s, int(taken[s]), sequences, uses[s], offset))
            taken[s] += uses[s] * times
            stock.left[s] -= uses[s] * times
            offset += uses[s] * s
        sequences += times
        stock.refresh()
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def piece_lengths(n: int, capacity: int) -> list[int]:
    """A document of ``n`` tokens: whole if it fits, else pieces of the capacity after a first one that may be shorter."""
    whole, rest = divmod(n, capacity)
    return [rest] * bool(rest) + [capacity] * whole


def encoded_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, by_word: bool = False, end_id: int = 0, with_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, part, nth): all pieces of all whole texts.

    ``part`` is the task and ``nth`` the number of pieces of this length before
    this one in it; both are only right as written, so write the result before
    use.  Without ``with_ids`` the column ``ids`` (unsigned 32-bit) is null.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use: LibraryEncoder = _encoder(tokenizer_path, by_word)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in chunks(batches, text, AT_ONCE_BYTES):
            keys, rows = batch.column(0).to_pylist(), []
            for k, ids in zip(keys, use.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids, start = ids + end, 0
                for piece, n in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((k, piece, start, n, zlib.crc32(own), own if with_ids else None, int(seen[n])))
                    seen[n] += 1
                    start += n
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *[pa.array(c[j], pa.int64()) for j in (2, 3, 4)], pa.array(c[5], pa.binary()), pa.array(np.full(len(rows), part), pa.int64()), pa.array(c[6], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"])

    return docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part long, nth long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, by_word: bool = False, end_id: int = 0, with_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): a row for each piece.

    Every row of ``docs`` is packed once: a null text is empty and so one
    token, its end; null and repeated ids are packed as any other.  An empty
    table gives no rows.  Sequences have no gaps inside; offsets start at 0.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    staged = scratch.table(encoded_pieces(docs, tokenizer_path, capacity, by_word, end_id, with_ids, key, text), "pieces")
    # pieces of a length in a task, and of that length in the tasks before
    each = scratch.table(staged.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in each.groupBy("length").agg(F.sum("n")).collect():  # at most one row for each length
        counts[length] = n
    packed = plan(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = each.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(before, F.lit(0)).alias("base"))
    ranked = staged.join(base, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = packed.place(np.asarray(batch.column(3)), np.asarray(batch.column(6)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents, tokens): the ids of each sequence, its documents' ends being their end ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("tokens"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    return rows.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("documents"), "tokens")
