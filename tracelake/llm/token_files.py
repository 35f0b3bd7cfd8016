"""Token ids in binary shards: frequency-ranked, byte-aligned variable length.

A shard file holds, little-endian:

    magic        8 bytes  ``TLIDS01\\n``
    counts       4 x u64  documents, ids, control bytes, data bytes
    doc ids      i64 each
    null flags   u8 each  (1: the document's id is null)
    lengths      u64 each
    control      2 bits for each id, four to a byte, lowest first: data bytes - 1
    data         1 to 4 bytes for each id's frequency rank

The file ``ids_by_rank`` (u32 each, most frequent first) beside the shards maps
ranks back.  Control bytes are kept apart from data bytes, so a reader gets all
lengths by one table lookup and all places by one cumulative sum.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.scratch import Scratch, partitions_for
from tracelake.llm.text import chunks

MAGIC = b"TLIDS01\n"
#: Ids of a shard file; a longer document gets a file of its own.
SHARD_IDS = 4_000_000
#: Distinct words in a generation of a worker's memo, which keeps two.
MEMO = 300_000
#: Bytes of text that are encoded at a time.
AT_ONCE_BYTES = 2 << 20

#: Data bytes of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4", copy=False)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_shard(rows: list[tuple[int | None, np.ndarray]]) -> bytes:
    """File of (document id, ranks) rows."""
    control, data = pack(np.concatenate([x for _, x in rows]) if rows else np.zeros(0, np.uint32))
    n = sum(len(x) for _, x in rows)
    return b"".join(
        [
            MAGIC,
            struct.pack("<4Q", len(rows), n, len(control), len(data)),
            np.array([k or 0 for k, _ in rows], "<i8").tobytes(),
            np.array([k is None for k, _ in rows], np.uint8).tobytes(),
            np.array([len(x) for _, x in rows], "<u8").tobytes(),
            control,
            data,
        ]
    )


def read_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ranks) of a file."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, n, nc, nd = struct.unpack_from("<4Q", blob, 8)
    at = 40
    keys = np.frombuffer(blob, "<i8", docs, at)
    nulls = np.frombuffer(blob, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(blob, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    if len(blob) != at + nc + nd:
        raise ValueError("token shard is cut short")
    ranks = unpack(blob[at : at + nc], blob[at + nc :], n)
    return [None if z else k for k, z in zip(keys.tolist(), nulls.tolist(), strict=True)], lengths, ranks


class LibraryEncoder:
    """Ids by the tokenizers library.

    With ``by_word`` a text is cut at its spaces, each distinct word (with the
    space before it) goes through the library once, many words in one call, and
    is remembered.  This is right for byte-level tokenizers that split before
    their merges by a pattern in which a space starts a token and no token goes
    on over one, as GPT-2's; a text in which white space or the end follows a
    space, or that holds the string of an added token (which the library
    turns into that token's id), goes through whole.  Without ``by_word`` every
    text goes whole.
    """

    #: Words in a string, and strings in a call: the library is quicker with short strings.
    AT_ONCE, STRINGS = 64, 512

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = by_word
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each id; a byte is one character in the vocabulary
        for token, k in self.tokenizer.get_vocab().items():
            self.sizes[k] = len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space."""
        out: list[bytes] = []
        step = self.AT_ONCE * self.STRINGS
        for a in range(0, len(words), step):
            strings = [" " + " ".join(words[k : min(k + self.AT_ONCE, a + step)]) for k in range(a, min(a + step, len(words)), self.AT_ONCE)]
            found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u4")
            text = np.frombuffer("".join(strings).encode(), np.uint8)
            starts = np.flatnonzero(text == 32)  # words hold no space
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), np.append(starts[1:], len(text))) + 1
            flat, at = ids.tobytes(), 0
            for stop in (4 * cuts).tolist():
                out.append(flat[at:stop])
                at = stop
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._library(texts)
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        split = [[t] if any(x in t for x in self.added) else t.split(" ") for t in texts]
        firsts = [s.pop(0) for s in split]
        unknown = set().union(*split).difference(young)
        # a word that is empty or starts with white space is never remembered
        odd = {w for w in unknown if not w or w[0].isspace()}
        if odd:
            marks = {" " + (w[:1] or " ") for w in odd}
            for k, t in enumerate(texts):
                if split[k] and (t[-1] == " " or any(m in t for m in marks)):
                    firsts[k], split[k] = t, []
            unknown -= odd
        known = unknown.intersection(old) if old else set()
        young.update((w, old[w]) for w in known)
        new = list(unknown - known)
        young.update(zip(new, self._words(new), strict=True))
        return [first + b"".join(map(young.__getitem__, s)) for first, s in zip(self._library(firsts), split, strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str, by_word: bool) -> LibraryEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each core has a task of its own, and threads keep memory
    return LibraryEncoder(path, by_word)


def encode_ids(docs: DataFrame, tokenizer_path: str, by_word: bool, end_id: int | None, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text as unsigned integers of ``width`` bytes, ``end_id`` after them."""
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _encoder(tokenizer_path, by_word)
        for part in chunks(batches, text, AT_ONCE_BYTES):
            ids = use.encode([t or "" for t in part.column(text).to_pylist()])
            out = [np.frombuffer(x + end, "<u4").astype(f"<u{width}").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(run, "doc_id long, ids binary")


def ids_by_frequency(staged: DataFrame, width: int = 4) -> np.ndarray:
    """All ids that occur, most frequent first, ties by id.  As many as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}"))
            if len(got) > len(total):
                total, got = got, total
            total[: len(got)] += got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    found = staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return found.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy().astype(np.uint32)


def write_token_files(docs: DataFrame, tokenizer_path: str, by_word: bool = False, end_id: int | None = 0, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the shards of ``docs(doc_id, text)`` in ascending id order; (folder, manifest).

    Null ids come first, rows that repeat an id follow each other in the order
    of their ids' bytes, a null text is empty, and an empty table gives no
    shard.  The manifest (file, part, piece, docs, ids, start) lists what was
    committed: a file left by a lost or repeated task is in no row of it.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = folder or scratch.path("shards")
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    staged = scratch.table(encode_ids(docs, tokenizer_path, by_word, end_id, width), "staged")
    order = ids_by_frequency(staged, width)
    rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    store, at = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/ids_by_rank") as out:
        out.write(order.astype("<u4").tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pa.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt, piece = task.partitionId(), task.taskAttemptId(), 0
        rows: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held, piece
            name = f"{part:08d}-{piece:06d}-{attempt}.ids"
            with store.open_output_stream(f"{at}/{name}") as out:
                out.write(write_shard(rows))
            told = pa.RecordBatch.from_pydict({"file": [name], "part": [part], "piece": [piece], "docs": [len(rows)], "ids": [held]})
            rows, held, piece = [], 0, piece + 1
            return told

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ranks = rank_of[np.frombuffer(ids, f"<u{width}")]
                rows.append((key, ranks))
                held += len(ranks)
                if held >= SHARD_IDS:
                    yield flush()
        if rows:
            yield flush()

    parts = partitions_for(spark)
    sorted_rows = staged.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), "ids")
    manifest = scratch.table(sorted_rows.mapInArrow(write, "file string, part long, piece long, docs long, ids long"), "manifest")
    scratch.drop(staged)
    # ids of the parts before, then of the pieces before in the part
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = manifest.groupBy(F.col("part").alias("p")).agg(F.sum("ids").alias("n")).select("p", F.coalesce(F.sum("n").over(upto(Window.orderBy("p"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("ids").over(upto(Window.partitionBy("part").orderBy("piece"))), F.lit(0))
    placed = manifest.withColumn("inside", inside).join(sums, F.col("part") == F.col("p"))
    return folder, placed.select("file", "part", "piece", "docs", "ids", (F.col("base") + F.col("inside")).alias("start"))


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the manifest's shards; ids as little-endian unsigned 32-bit integers."""
    return _read(folder, manifest, lambda ids: ids.tobytes(), "ids binary", pa.binary())


def token_file_digest(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the shards."""
    return _read(folder, manifest, lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32 long", pa.int64())


def _read(folder: str, manifest: DataFrame, value, field: str, kind: pa.DataType) -> DataFrame:
    spark = manifest.sparkSession
    name = field.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pa.fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{at}/ids_by_rank") as f:
            ids_by_rank = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for blob, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys, lengths, ranks = read_shard(blob.as_py())
                ids, ends = ids_by_rank[ranks], np.cumsum(lengths)
                out = [value(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(out, kind)], names=["doc_id", "start", "n_tokens", name])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    files = files.select("content", F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.join(manifest.select("file", "start"), "file").select("content", "start").mapInArrow(run, f"doc_id long, start long, n_tokens long, {field}")
