"""LM scoring with a probabilistic suffix tree over words.

Words are counted over all training documents.  A context of up to ``order``
words is tested where it occurs ``least`` times or more, twice being the fewest
that can be: its next-word counts must predict the training text better, leaving
out the word predicted, than the longest retained shorter context does, by
``gain`` nats a word.  Retained contexts are the tree's states.  A word's
probability comes from the longest retained suffix of what stands before it,
smoothed towards the shorter one by the number of different next words
(Witten-Bell), down to the base distribution.

The model grows with the corpus and is never in one place.  Documents are coded
in blocks, kept as files in the shared folder, their places sorted by the words
that end there, so that strings are runs of places.  For each level every block
sends its distinct strings of words with its counts, cut by key range, to the
tasks that add them up, and gets the totals back in the same cut.  One of the
blocks that hold a string is its owner and adds it to the sums of its context,
which are added up over blocks likewise; back comes whether the context is
retained.  A block keeps what it is told in files of its own, so answers move once.
What strings the next level has depends on totals only, so a block asks for these
when it sends its sums, and is made up from its files once a level.
Keys are hashes, so ranges are even, and a frequent word or context is one key a
block; sorted keys move as differences, contexts as numbers in their range.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.scratch import Scratch, partitions_for
from tracelake.llm.text import WordHashes, chunks, mix64

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Text of a block; its arrays take some forty times as much while it is worked on.
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class TreePlan:
    order: int = 4
    #: Occurrences of a context, and of a next word that is counted under it.
    least: int = 2
    gain: float = 0.005
    add: float = 0.1
    folds: int = 10
    held_out: int = 0


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([(a.dtype.str, a.tobytes()) for a in arrays]))


def _unpack(blob: bytes) -> list[np.ndarray]:
    return [np.frombuffer(b, d) for d, b in pickle.loads(zstandard.ZstdDecompressor().decompress(blob))]


def _planes(values: np.ndarray) -> np.ndarray:
    """Whole numbers as bytes, one byte's place after the other, which packs better; before them, how many of the low places are kept."""
    values = values.astype(np.uint64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    out = np.empty(1 + width * len(values), np.uint8)
    out[0], by_place = width, out[1:].reshape(width, -1)
    for k in range(width):
        by_place[k] = values.view(np.uint8)[k::8]
    return out


def _from_planes(planes: np.ndarray) -> np.ndarray:
    first, *more = planes[1:].reshape(int(planes[0]), -1)
    out = first.astype(np.uint64)
    for k, by_place in enumerate(more, 1):
        out |= by_place.astype(np.uint64) << np.uint64(8 * k)
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _from_steps(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_from_planes(planes), dtype=np.uint64)


def _argsort(keys: np.ndarray) -> np.ndarray:
    """Order of 64-bit keys, by their high bits and places in one word, which NumPy sorts several times as fast as by index."""
    bits = np.uint64(max(1, (len(keys) - 1).bit_length()))
    packed = np.sort(keys >> bits << bits | np.arange(len(keys), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ranked = keys[order]
    return np.argsort(keys) if (ranked[1:] < ranked[:-1]).any() else order


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where one of each stands, and the place of every key among them."""
    order = _argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(new) - 1
    return ranked[new], order[new], where


_ROW = "block string, kind int, p int, data binary"
_NAMES = ["block", "kind", "p", "data"]
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.binary()]
#: Kinds of rows other than requests and answers: a range's sums over words, and one that only names a block.
_SUMS, _PRESENT = -1, -2
#: Rows on words and strings, and on contexts.
_STRINGS, _CONTEXTS = 0, 1
#: Words of all documents that a key range of a level is made for.
RANGE_WORDS = 8 << 20


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)


def _cut(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(p, from, to) of the key ranges that sorted keys fall into."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(p, int(a), int(b)) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


class Files:
    """Files of the blocks, by kind, in the shared folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def _at(self, *path: str) -> tuple[pa.fs.FileSystem, str]:
        store, at = pa.fs.FileSystem.from_uri(self.folder)
        return store, "/".join((at, *path))

    def make(self, *kinds: str) -> None:
        for kind in kinds:
            store, at = self._at(kind)
            store.create_dir(at, recursive=True)

    def write(self, kind: str, name: str, blob: bytes) -> None:
        """A task that is run again writes the same."""
        store, at = self._at(kind, name)
        part = f"{at}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(blob)
        store.move(part, at)

    def read(self, kind: str, name: str) -> bytes:
        store, at = self._at(kind, name)
        with store.open_input_stream(at) as f:
            return f.read()

    def drop(self, kind: str) -> None:
        store, at = self._at(kind)
        store.delete_dir(at)


class Block:
    """Coded documents, and what is known of their words so far.

    Places stand in the order of the words that end at them, last word first, so
    the strings of each level are runs of places, and what is known of a string is
    one number for its run.
    """

    def __init__(self, blob: bytes):
        self.words, order, shared, self.lengths, self.ids, self.id_null, self.train = _unpack(blob)
        self.words, self.order, self.shared = _from_steps(self.words), _from_planes(order).astype(np.int64), shared
        self.starts = np.cumsum(self.lengths) - self.lengths
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(self.order))
        self.previous = rank[self.order - 1]  # of a document's first word, any
        self.word = self.run = np.cumsum(self.shared == 0) - 1
        self.level, self.live = 0, np.arange(len(self.order))  # places after a context tested on the level; no other is tested on a later one

    @staticmethod
    def code(ids: list[int | None], texts: pa.StringArray | list[str | None], train: list[bool], memo: WordHashes | None = None, order: int = TreePlan.order) -> bytes:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())))
        coded = split.flatten().dictionary_encode()  # each distinct word is hashed once, so ``memo`` is not asked
        place, some = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        words, _, where = _distinct(np.fromiter(map(xxhash.xxh3_64_intdigest, (*some, b"")), np.uint64, len(some) + 1))  # the last is the end, as no word is empty
        whole = np.array([w != b"" for w in some], bool)[place]  # an empty one stands at either end of a text that is blank there
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
        lengths = np.bincount(np.repeat(np.arange(len(counts)), counts)[whole], minlength=len(counts)) + 1
        index = np.full(lengths.sum(), where[-1])
        within = np.ones(len(index), bool)
        within[np.cumsum(lengths) - 1] = False
        index[within] = where[place[whole]]
        sort, shared = _by_last_words(index, lengths, order + 1)
        return _pack(_steps(words), _planes(sort), shared, lengths, np.array([k or 0 for k in ids], np.int64), np.array([k is None for k in ids], np.uint8), np.array(train, np.uint8))

    @cached_property
    def place(self) -> np.ndarray:
        return (np.arange(len(self.order)) - np.repeat(self.starts, self.lengths))[self.order]

    @cached_property
    def trains(self) -> np.ndarray:
        return np.repeat(self.train.astype(bool), self.lengths)[self.order]

    def unigrams(self) -> np.ndarray:
        return np.bincount(self.word[self.trains], minlength=len(self.words))

    def know(self, counts: np.ndarray, total: int, distinct: int, plan: TreePlan, bits: int, word_bits: int = 0, scored: bool = True) -> None:
        self.least, self.deepest, self.bits, self.word_bits = plan.least, plan.order, bits, word_bits or bits
        self.c0 = counts
        self.base = (counts + plan.add) / (total + plan.add * (distinct + 1))
        # of each string of the level: its key, count, whether that is of a counted string of words, probability of its last word
        self.keys, self.count, self.p = self.words, counts, self.base
        self.fine = np.ones(len(counts), bool)
        self.ended = np.zeros(len(self.order)) if scored else None  # probabilities at places that are not live any more

    def extend(self, tested: np.ndarray | None = None) -> None:
        """Take up the contexts of one more word; which live places have one that is tested may be known from before."""
        self.level = k = self.level + 1
        if tested is None:
            able = np.append(self.fine & (self.count >= self.least), False)  # the last is run -1, of places that are not live
            tested = (self.place[self.live] >= k) & able[self.run[self.previous[self.live]]]  # the same in all of a string's run
        if self.ended is not None:
            ended = self.live[~tested]
            self.ended[ended] = self.p[self.run[ended]]
        self.tested, self.live = tested, self.live[tested]
        new = self.shared[self.live] <= k
        places = self.live[new]
        self.first, self.context = np.flatnonzero(new), self.run[self.previous[places]]
        word = self.word[places]
        self.shorter = self.p[self.run[places]]
        self.taken = self.c0[word] >= self.least
        self.asked = np.flatnonzero(self.taken)
        self.used = np.zeros(len(self.keys), bool)
        self.used[self.context] = True
        self.run = np.full(len(self.order), -1)
        self.run[self.live] = np.cumsum(new) - 1
        self.last = word[self.asked]

    @cached_property
    def next_keys(self) -> np.ndarray:
        """Keys of the strings that are asked for."""
        with np.errstate(over="ignore"):
            return mix64(self.keys[self.context[self.asked]] * _A + self.words[self.last] * _B + np.uint64(self.level))

    @cached_property
    def by_key(self) -> np.ndarray:
        return _argsort(self.next_keys)

    @property
    def stands(self) -> np.ndarray:
        """Whether a context worth testing stands before each place."""
        return self.run >= 0

    @property
    def counted(self) -> np.ndarray:
        """Whether the word at each place is counted under it."""
        return np.append(self.taken, False)[self.run]

    def request(self, block: str) -> list[tuple]:
        """Rows that ask for the totals of this level's strings, by key range."""
        mine = np.add.reduceat(self.trains[self.live], self.first, dtype=np.int64)[self.asked]
        keys, mine = self.next_keys[self.by_key], mine[self.by_key]
        return [(block, _STRINGS, p, _pack(_steps(keys[a:b]), _planes(mine[a:b]))) for p, a, b in _cut(keys, self.bits)]

    def in_order(self) -> np.ndarray:
        """Strings of the level before that can be contexts, by key."""
        some = np.flatnonzero(self.fine & (self.count >= self.least))
        return some if self.level == 1 else some[_argsort(self.keys[some])]

    def context_cut(self, contexts: np.ndarray) -> list[tuple[int, int, int]]:
        return _cut(self.keys[contexts], self.word_bits if self.level == 1 else self.bits)

    def tally(self, block: str, totals: np.ndarray, own: np.ndarray, numbers: np.ndarray) -> list[tuple]:
        """Rows with the sums over the strings that this block owns, by range of their contexts.

        A context is called by its number in the range, and its count is sent with its sums only.
        """
        under, n, p = self.context[self.asked][own], totals[own], self.shorter[self.asked][own]
        twice = n >= 2
        gain = np.where(twice, n * (np.log(np.maximum(1, n - 1)) - np.log(p)), 0.0)
        able = self.in_order()
        used = self.used[able]
        contexts, numbers = able[used], numbers[used]
        s, t, s2, a = (np.bincount(under, x, len(self.keys))[contexts] for x in (n, n > 0, np.where(twice, n, 0), gain))
        times = np.where(t > 0, self.count[contexts], 0)
        return [(block, _CONTEXTS, q, _pack(_steps(numbers[i:j]), *(_planes(x[i:j]) for x in (times, s, t, s2)), a[i:j])) for q, i, j in self.context_cut(contexts)]

    def settle(self, got: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Which strings of the level before are retained contexts, and the sums and numbers of next words of those, from the answers on ``tally``."""
        contexts = self.in_order()
        contexts = contexts[self.used[contexts]]
        kept = contexts[np.concatenate([np.zeros(0, bool), *(np.unpackbits(g[0], count=j - i).astype(bool) for g, (_, i, j) in zip(got, self.context_cut(contexts), strict=True))])]
        sort = np.argsort(kept)
        retained = np.zeros(len(self.keys), np.int64)
        retained[kept] = 1
        return [retained, *(_joined(got, x, _from_planes)[sort] for x in (1, 2))]

    def learn(self, totals: np.ndarray, retained: np.ndarray, sums: np.ndarray, kinds: np.ndarray) -> None:
        """Take the probabilities under the retained contexts, and the totals."""
        hit = np.flatnonzero(retained[self.context])
        context = self.context[hit]
        found = (np.cumsum(retained) - 1)[context]
        times, kinds = self.count[context], kinds[found]
        spare = times - sums[found] + kinds
        p = self.shorter
        self.take(totals)
        p[hit] = (self.count[hit] + spare * p[hit]) / (times + kinds)
        self.p = p

    def take(self, totals: np.ndarray) -> None:
        """Take the totals of the strings asked for; their probabilities are not known by that."""
        if self.level < self.deepest:
            keys = np.zeros(len(self.first), np.uint64)
            keys[self.asked] = self.next_keys
            self.keys = keys
        self.count = np.zeros(len(self.first), np.int64)
        self.count[self.asked] = totals
        self.fine, self.p = self.taken, self.shorter
        for name in ("next_keys", "by_key"):
            self.__dict__.pop(name, None)

    def scores(self, total: int) -> pa.RecordBatch:
        def by_doc(x: np.ndarray) -> np.ndarray:
            placed = np.empty(len(x), x.dtype)
            placed[self.order] = x
            return np.add.reduceat(placed, self.starts) if len(self.starts) else np.zeros(0)

        self.ended[self.live] = self.p[self.run[self.live]]
        ids = pa.array(self.ids, pa.int64(), mask=self.id_null.astype(bool))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(self.train == 0), pa.array(self.lengths), pa.array(by_doc((self.c0 > 0).astype(np.int64)[self.word]), pa.int64()), pa.array(np.full(len(self.lengths), total, np.int64)), pa.array(by_doc(np.log10(self.base)[self.word])), pa.array(by_doc(np.log10(self.ended)))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def _by_last_words(index: np.ndarray, lengths: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by up to ``words`` words of their document that end there, last word first, and how many of these each shares with the one before."""
    n = len(index)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    one = rank = index.astype(np.uint64) + np.uint64(1)  # 0: before the document

    def back(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, values.dtype)
        out[by:] = values[: max(0, n - by)]
        out[place < by] = 0
        return out

    known = 1
    sort = np.argsort(rank) if words == 1 else None
    while known < words:
        by = min(known, words - known)
        width = max(1, n.bit_length())  # of a rank
        keys = (rank << np.uint64(width) | back(rank, by)) << np.uint64(64 - 2 * width)
        sort = _argsort(keys)
        ranked = keys[sort]
        rank = np.empty(n, np.uint64)
        rank[sort] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1]))
        known += by
    shared, same = np.zeros(n, np.uint8), np.ones(max(0, n - 1), bool)
    for by in range(words):
        column = back(one, by)[sort]
        same &= column[1:] == column[:-1]
        shared[1:] += same
    return sort, shared


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, plan: TreePlan = TreePlan()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs(doc_id, text)``.

    A null or empty text is its end only.  A row with a null id trains and is
    not held out.  Rows that repeat count each time.  An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tree")
    files = Files(scratch.path("blocks"))
    files.make("coded", *(f"{x}{k}" for x in ("totals", "numbers", "tested", "answers", "contexts") for k in range(plan.order + 1)))
    parts = partitions_for(spark)
    word_bits = max(4, int(np.ceil(np.log2(parts))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list[pa.StringArray]] = ([], [])
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal size
            ids, texts = held
            train = [k is None or zlib.crc32(str(k).encode()) % plan.folds != plan.held_out for k in ids]
            blob = Block.code(ids, pa.concat_arrays(texts), train, order=plan.order)
            name = uuid.uuid4().hex
            files.write("coded", name, blob)
            block = Block(blob)
            counts = block.unigrams()
            ids.clear()
            texts.clear()
            size = 0
            return _rows([(name, 0, p, _pack(_steps(block.words[a:b]), _planes(counts[a:b]))) for p, a, b in _cut(block.words, word_bits)])

        for part in chunks(batches):
            if held[0] and size + part.column(1).nbytes > BLOCK_BYTES:
                yield close()
            held[0].extend(part.column(0).to_pylist())
            held[1].append(part.column(1))
            size += part.column(1).nbytes
        if held[0]:
            yield close()

    def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _add_words(batches, plan.least)

    asked = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, _ROW), "words")
    # every block goes through every step, also one without any answer
    every = scratch.table(asked.select("block").distinct().select("block", F.lit(_PRESENT).alias("kind"), F.lit(0).alias("p"), F.lit(b"").alias("data")), "every")
    told = scratch.table(_spread(asked, parts).mapInArrow(add_words, _ROW), "answers")
    sums = [_unpack(r[0])[0] for r in told.where(F.col("kind") == _SUMS).select("data").collect()]  # two numbers for each range
    total, distinct = (int(sum(x[k] for x in sums)) for k in (0, 1))
    scratch.drop(asked)
    bits = max(word_bits, int(np.ceil(np.log2(max(1, total / RANGE_WORDS)))))

    def known(name: str, level: int, scored: bool = False) -> Block:
        """The block as it is after a level, from its files; the answers on that level's contexts are new."""
        block = Block(files.read("coded", name))
        block.know(*_numbers(files.read("totals0", name)), total, distinct, plan, bits, word_bits, scored)
        for k in range(1, level + 1):
            tested(block, name)
            if k < level:
                of = _numbers(files.read(f"contexts{k}", name))
            else:
                of = block.settle([_unpack(x) for x in pickle.loads(files.read(f"answers{k}", name))])
                files.write(f"contexts{k}", name, _packed(*of))
            block.learn(*_numbers(files.read(f"totals{k}", name)), of[0].astype(bool), *of[1:])
        return block

    def tested(block: Block, name: str) -> None:
        """Extend a block as in the step that did so first."""
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(files.read(f"tested{block.level + 1}", name)), np.uint8)
        block.extend(np.unpackbits(bits, count=len(block.live)).astype(bool))

    def count(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        """Take the totals of a level, add up under its contexts, and ask for the strings of the next level, which needs no probabilities."""
        for name, rows in _by_block(batches):
            got = [_unpack(r[3]) for r in rows if r[1] == _STRINGS]
            totals = _joined(got, 0, _from_planes)
            if level < plan.order:
                files.write(f"numbers{level}", name, _packed(_joined(got, -1, _from_steps)))
            if level == 0:
                files.write("totals0", name, _packed(totals))
                block = known(name, 0)
            else:
                block = known(name, level - 1)
                tested(block, name)
                owned = np.concatenate([np.zeros(0, bool), *(np.unpackbits(g[1], count=b - a).astype(bool) for g, (_, a, b) in zip(got, _cut(block.next_keys[block.by_key], bits), strict=True))])
                sort, found, own = block.by_key, totals, np.zeros(len(owned), bool)
                totals = np.zeros(len(found), np.int64)
                totals[sort], own[sort] = found, owned
                files.write(f"totals{level}", name, _packed(totals))
                yield _rows(block.tally(name, totals, own, *_numbers(files.read(f"numbers{level - 1}", name))))
                if level < plan.order:
                    block.take(totals)
            del got, totals
            if level < plan.order:
                block.extend()
                files.write(f"tested{level + 1}", name, zstandard.ZstdCompressor(level=1).compress(np.packbits(block.tested).tobytes()))
                yield _rows(block.request(name))

    def keep(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        """Put the answers on a level's contexts into files, for the next step."""
        for name, rows in _by_block(batches):
            files.write(f"answers{level}", name, pickle.dumps([r[3] for r in rows if r[1] == _CONTEXTS]))
        yield _rows([])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (p, kind), rows in _runs(batches, "p", "kind"):
            yield _rows(_add_strings(p, rows, plan.least) if kind == _STRINGS else _add_contexts(p, rows, plan.gain))

    def answers(kind: int) -> DataFrame:
        return _to_blocks(told.where(F.col("kind") == kind).union(every), parts)

    for level in range(plan.order + 1):

        def step(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            return count(batches, level)

        def put(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            return keep(batches, level)

        before, told = told, scratch.table(_spread(answers(_STRINGS).mapInArrow(step, _ROW), parts).mapInArrow(add, _ROW), "answers")
        scratch.drop(before)
        if level:
            files.drop(f"numbers{level - 1}")
        if level > 1:
            files.drop(f"answers{level - 1}")
        if 0 < level < plan.order:
            scratch.drop(scratch.table(answers(_CONTEXTS).mapInArrow(put, _ROW), "kept"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _by_block(batches):
            files.write(f"answers{plan.order}", name, pickle.dumps([r[3] for r in rows if r[1] == _CONTEXTS]))
            yield known(name, plan.order, scored=True).scores(total)

    return answers(_CONTEXTS if plan.order else _STRINGS).mapInArrow(finish, _SCORES)


def _spread(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "p").sortWithinPartitions("p", "kind")


def _to_blocks(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "block").sortWithinPartitions("block", "kind", "p")


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, list[tuple]]]:
    at = [_NAMES.index(c) for c in columns]
    held: list[tuple] = []
    last: tuple = ()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = tuple(row[k] for k in at)
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    return ((name, rows) for (name,), rows in _runs(batches, "block"))


def _joined(got: list[list[np.ndarray]], column: int, read: Callable) -> np.ndarray:
    """A column of the answers of all ranges."""
    return np.concatenate([np.zeros(0, np.int64), *(read(g[column]).astype(np.int64) for g in got)])


def _packed(*arrays: np.ndarray) -> bytes:
    return _pack(*map(_planes, arrays))


def _numbers(blob: bytes) -> list[np.ndarray]:
    return [_from_planes(x).astype(np.int64) for x in _unpack(blob)]


def _add_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for (p,), rows in _runs(batches, "p"):
        got = [[f(x) for f, x in zip((_from_steps, _from_planes), _unpack(r[3]), strict=True)] for r in rows]
        keys, _, inverse = _distinct(np.concatenate([g[0] for g in got]))
        counts = np.bincount(inverse, np.concatenate([g[1] for g in got]), len(keys)).astype(np.int64)
        sums = ("", _SUMS, p, _pack(np.array([counts.sum(), (counts > 0).sum()])))
        yield _rows([*((r[0], 0, p, _pack(_planes(counts[i]), _steps(i[counts[i] >= least]))) for r, i in zip(rows, _apart(inverse, got), strict=True)), sums])


def _add_strings(p: int, rows: list[tuple], least: int) -> list[tuple]:
    """Totals of the strings asked for, which of them a row owns (its first place is in that row), and numbers of those that can be contexts."""
    got = [[f(x) for f, x in zip((_from_steps, _from_planes), _unpack(r[3]), strict=True)] for r in rows]
    keys, first, inverse = _distinct(np.concatenate([g[0] for g in got]))
    counts = np.bincount(inverse, np.concatenate([g[1] for g in got]), len(keys)).astype(np.int64)
    own = np.zeros(len(inverse), bool)
    own[first] = True
    return [(r[0], _STRINGS, p, _pack(_planes(counts[i]), np.packbits(o), _steps(i[counts[i] >= least]))) for r, i, o in zip(rows, _apart(inverse, got), _apart(own, got), strict=True)]


def _add_contexts(p: int, rows: list[tuple], gain: float) -> list[tuple]:
    """Which contexts are retained, and the sums and numbers of their next words."""
    got = [[f(x) for f, x in zip((_from_steps, _from_planes, _from_planes, _from_planes, _from_planes, np.asarray), _unpack(r[3]), strict=True)] for r in rows]
    numbers, *whole = (np.concatenate([g[x] for g in got]) for x in range(6))
    numbers = numbers.astype(np.int64)
    n = int(numbers.max(initial=-1)) + 1
    c = np.zeros(n)
    c[numbers[whole[0] > 0]] = whole[0][whole[0] > 0]
    s, t, s2, a = (np.bincount(numbers, x, n) for x in whole[1:])
    # nats gained over the training words after the context, each predicted without itself; none if no word after it counts
    some = np.flatnonzero(t)
    c, s, t, s2, a = (x[some] for x in (c, s, t, s2, a))
    rest = np.where(c > s2, c - s2, 0.0)
    gained = a - s2 * np.log(c + t) + rest * np.log(np.where(rest > 0, c - s + t, 1.0) / (c + t))
    some, s, t = (x[gained >= gain * c] for x in (some, s, t))
    retained, place = np.zeros(n, bool), np.zeros(n, np.int64)
    retained[some], place[some] = True, np.arange(len(some))
    answers = []
    for r, g in zip(rows, got, strict=True):
        i = g[0].astype(np.int64)
        kept = retained[i]
        at = place[i[kept]]
        answers.append((r[0], _CONTEXTS, p, _pack(np.packbits(kept), _planes(s[at]), _planes(t[at]))))
    return answers


def _apart(values: np.ndarray, got: list) -> list[np.ndarray]:
    """What belongs to each row."""
    return np.split(values, np.cumsum([len(g[0]) for g in got])[:-1])
