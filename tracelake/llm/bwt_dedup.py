"""Suffix-array dedup: find every byte that a repeated string of W bytes covers.

A string of W bytes is known by the smallest hash of the 32-byte grams in it,
its anchor.  Equal strings have equal anchors at equal places, so only strings
with the same anchor need comparing, and the contexts of one anchor are aligned
at it.  Neighbouring strings of a document with one anchor form a segment.

1.  Segments are counted by (anchor, digest of the segment's bytes).  Anchors
    seen once end here.  Segments seen more than once are repeated whole.
2.  For anchors with several different segments, these are merged as
    Burrows-Wheeler transforms.  Each segment is a shard; being aligned, all
    shards are refined a column at a time: from the interleaving sorted by what
    follows column c, one stable partition by the symbols at c gives the one
    sorted from c on, and common prefix lengths follow from minima over the
    intervals so joined.  Nothing is sorted again.  Intervals whose common
    prefix is W or longer are the repeated strings.
3.  An anchor with more than ``most_shards`` different segments would be a group
    without bound in one task.  Its strings are instead counted by 64-bit hash
    within the anchor, which partial aggregation spreads over all tasks.

Segments with anchor and digest (128 bits) alike count as equal bytes.

In periodic text (padding, rules, one line over and over) the anchor moves on
with every period, so there are as many segments as periods.  A document
therefore brings each kind of segment once, with its count, and the places of
those it holds more than once as merged runs: one for a periodic text of any
length.  Long texts are cut into slices of strings first; a segment so cut in
two is two segments of one anchor, which step 2 compares as any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import prefilter
from tracelake.llm.scratch import Scratch, partitions_for
from tracelake.llm.text import chunks, mix64

#: Bytes of an anchor; a power of two.
GRAM = 32
#: Strings of a text that are cut into segments at a time, so that memory beside a long text is bounded.
SLICE = 1 << 21
#: Different segments of an anchor that one task merges; segments merged at a time.
MOST_SHARDS, AT_ONCE = 4096, 16384

_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD[0])


def _fold(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[1]
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` bytes."""
    level, have, out = _BYTE[data], 1, None
    step = 0
    while True:
        if size & have:
            out = (level, have) if out is None else (_fold(level[: max(0, len(level) - out[1])] * _ODD[7] + out[0][have:]) if len(level) > out[1] else level[:0], out[1] + have)
        if have * 2 > size:
            return out[0][: max(0, len(data) - size + 1)]
        level = _fold(level[:-have] * _ODD[2 + step % 5] + level[have:]) if len(level) > have else level[:0]
        have, step = have * 2, step + 1


def segments(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first string, strings, bytes before the anchor) of each segment of a document."""
    grams = gram_hashes(np.frombuffer(data, np.uint8), GRAM)
    span = width - GRAM + 1
    at, have = np.arange(len(grams), dtype=np.int32), 1
    while have * 2 <= span:
        a, b = at[:-have], at[have:]
        at = np.where(grams[b] < grams[a], b, a)
        have *= 2
    if have < span:
        a, b = at[: len(at) - (span - have)], at[span - have :]
        at = np.where(grams[b] < grams[a], b, a)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]], first, np.diff(np.append(first, len(at))), at[first] - first


def union_of_runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs, not even neighbours, that cover the same places."""
    order = np.argsort(first, kind="stable")
    first, upto = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > upto[:-1] + 1]))
    return first[new], upto[np.append(new[1:] - 1, len(upto) - 1)]


#: Columns of ``own_kinds``: anchor, digest, first string, strings, segments like this one.
Kinds = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _gathered(kinds: Kinds) -> tuple[Kinds, tuple[np.ndarray, np.ndarray]]:
    """Each kind once, at its first place; and the runs of those that were there more than once."""
    order = np.lexsort((kinds[2], kinds[1], kinds[0]))
    anchor, digest, first, n, count = (x[order] for x in kinds)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])])
    at = np.flatnonzero(new)
    several = np.repeat(np.diff(np.append(at, len(new))) > 1, np.diff(np.append(at, len(new))))
    runs = union_of_runs(first[several], first[several] + n[several] - 1) if several.any() else (first[:0], first[:0])
    return (anchor[at], digest[at], first[at], n[at], np.add.reduceat(count, at)), runs


def own_kinds(data: bytes, width: int) -> tuple[Kinds, tuple[np.ndarray, np.ndarray]]:
    """Kinds of segments of a text of ``width`` bytes or more, and the runs of strings that it holds more than once as whole segments."""
    found, runs, strings = [], [], len(data) - width + 1
    for a in range(0, strings, SLICE):
        own = data if strings <= SLICE else data[a : a + SLICE + width - 1]
        key, first, n, _ = segments(own, width)
        digest = np.empty(len(key), np.uint64)
        for k in range(0, len(key), 65536):
            x, z = first[k : k + 65536].tolist(), (first[k : k + 65536] + n[k : k + 65536] + (width - 1)).tolist()
            digest[k : k + 65536] = [xxhash.xxh3_64_intdigest(own[i:j]) for i, j in zip(x, z, strict=True)]
        kinds = key, digest, first + a, n, np.ones(len(key), np.int64)
        if len(set(digest.tolist())) < len(digest):
            kinds, more = _gathered(kinds)
            runs.append(more)
        found.append(kinds)
    kinds = found[0]
    if len(found) > 1:
        kinds, more = _gathered(tuple(np.concatenate(x) for x in zip(*found, strict=True)))
        runs.append(more)
    return kinds, union_of_runs(*(np.concatenate(x) for x in zip(*runs, strict=True))) if any(len(r[0]) for r in runs) else (kinds[2][:0], kinds[2][:0])


def merge_shards(group: np.ndarray, strings: list[bytes], lead: np.ndarray, count: np.ndarray, width: int) -> list[np.ndarray]:
    """Which of each segment's strings occur in another segment of its group.

    ``strings[k]`` is a segment with its anchor after ``lead[k]`` bytes and
    ``count[k]`` strings; ``group`` is ascending.  Refined from the last column
    to the first, so that at column c the shards of a group stand sorted by
    their bytes from c on.
    """
    n, left = len(strings), width - GRAM
    columns = left + width
    table = np.full((columns, n), 256, np.int16)  # 256: the shard has no byte there and matches nothing
    for k, (s, before) in enumerate(zip(strings, lead.tolist(), strict=True)):
        table[left - before : left - before + len(s), k] = np.frombuffer(s, np.uint8)
    found = np.zeros((left + 1, n), bool)
    order = np.arange(n)
    base = group.astype(np.int64) * 257
    common = np.zeros(n + 1, np.int32)  # common[k]: bytes from this column on that places k - 1 and k share
    for c in range(columns - 1, -1, -1):
        symbols = table[c, order]
        key = base + symbols
        if (key[1:] >= key[:-1]).all():
            same = np.concatenate([[False], (key[1:] == key[:-1]) & (symbols[1:] != 256), [False]])
            common = np.where(same, common + 1, 0)
        else:
            move = np.argsort(key, kind="stable")
            moved = key[move]
            order = order[move]
            same = np.flatnonzero((moved[1:] == moved[:-1]) & (symbols[move[1:]] != 256)) + 1
            a, b = move[same - 1] + 1, move[same]
            least = common[b]
            wide = np.flatnonzero(b > a)
            if len(wide):
                cuts = np.empty(2 * len(wide), np.int64)
                cuts[::2], cuts[1::2] = a[wide], b[wide] + 1
                least[wide] = np.minimum.reduceat(common, cuts)[::2]
            common = np.zeros(n + 1, np.int32)
            common[same] = least + 1
        if c <= left:
            found[c, order] = np.maximum(common[:-1], common[1:]) >= width
    out = []
    for k in range(n):
        start = left - int(lead[k])
        out.append(np.flatnonzero(found[start : start + int(count[k]), k]))
    return out


def _emit(rows: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))


def repeated_strings(docs: DataFrame, width: int = 200, most_shards: int = MOST_SHARDS, scratch: Scratch | None = None) -> DataFrame:
    """(rid, rid2, base, firsts, lasts): runs of places in a document, counted from base, where repeated strings of ``width`` bytes start.

    ``docs`` has (rid, rid2, text): 96 bits that stand for a row.  Runs may repeat and overlap.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width must be at least {2 * GRAM}")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "bwt")
    parts = partitions_for(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            got, firsts, lasts = [], [], []
            for rid, rid2, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = (t or "").encode()
                if len(data) >= width:
                    kinds, runs = own_kinds(data, width)
                    size = len(kinds[0])
                    got.append((*kinds, np.full(size, rid), np.full(size, rid2)))
                    one = int(np.argmax(kinds[4] > 1))  # the text's runs go with one of its repeated kinds
                    sure = [None if not len(r) else r.tolist() for r in runs]
                    for column, own in zip((firsts, lasts), sure, strict=True):
                        column += [None] * one + [own] + [None] * (size - one - 1)
            if got:
                key, digest, first, n, count, rid, rid2 = (np.concatenate(x) for x in zip(*got, strict=True))
                yield _emit({"anchor": pa.array(key.view(np.int64)), "digest": pa.array(digest.view(np.int64)), "rid": pa.array(rid), "rid2": pa.array(rid2.astype(np.int32)), "first": pa.array(first.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "times": pa.array(count), "firsts": pa.array(firsts, pa.list_(pa.int32())), "lasts": pa.array(lasts, pa.list_(pa.int32()))})

    found = docs.select("rid", "rid2", "text").mapInArrow(cut, "anchor long, digest long, rid long, rid2 int, first int, n int, times long, firsts array<int>, lasts array<int>")
    again = scratch.table(found.groupBy("anchor").agg(F.sum("times").alias("c")).where("c > 1").select(F.col("anchor").alias("a")), "anchors")
    rows = scratch.table(found.join(again, F.col("anchor") == F.col("a")).drop("a"), "segments")
    kinds = scratch.table(rows.groupBy("anchor", "digest").agg(F.sum("times").alias("c"), F.min(F.struct("rid", "rid2", "first", "n")).alias("at")), "kinds")
    several = scratch.table(kinds.groupBy("anchor").agg(F.count("*").alias("shards")).where("shards > 1").select(F.col("anchor").alias("a"), "shards"), "several")
    wanted = scratch.table(kinds.join(several, F.col("anchor") == F.col("a")).select("anchor", "digest", "c", "shards", "at.*"), "wanted")

    # the bytes of one segment of each kind
    asked = wanted.groupBy("rid", "rid2").agg(F.collect_list(F.struct("anchor", "digest", "first", "n", "shards")).alias("asked"))
    words, bits = prefilter.bitmap(wanted, "rid", wanted.count())
    texts, _ = prefilter.split(docs.select("rid", "rid2", "text"), "rid", words, bits)
    texts = texts.dropDuplicates(["rid", "rid2"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            flat, ends = part.column(1).values, np.asarray(part.column(1).offsets)
            low = int(ends[0])
            flat = flat.slice(low, int(ends[-1]) - low)
            first, n = (np.asarray(flat.field(k)) for k in (2, 3))
            pieces = []
            for t, a, z in zip(part.column(0).to_pylist(), (ends[:-1] - low).tolist(), (ends[1:] - low).tolist(), strict=True):
                data = t.encode()
                pieces += [data[x : x + k + width - 1] for x, k in zip(first[a:z].tolist(), n[a:z].tolist(), strict=True)]
            yield _emit({"anchor": flat.field(0), "digest": flat.field(1), "n": flat.field(3), "shards": flat.field(4), "piece": pa.array(pieces, pa.binary())})

    pieces = scratch.table(texts.join(asked, ["rid", "rid2"]).select("text", "asked").mapInArrow(fetch, "anchor long, digest long, n int, shards long, piece binary"), "pieces")

    def leads(pieces: list[bytes]) -> np.ndarray:
        return np.array([int(np.argmin(gram_hashes(np.frombuffer(s[:width], np.uint8), GRAM))) for s in pieces], np.int64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            anchor, digest, n, strings = zip(*rows, strict=True)
            group = np.cumsum(np.concatenate([[0], np.diff(np.array(anchor)) != 0])) if len(rows) > 1 else np.zeros(1, np.int64)
            hits = merge_shards(group, list(strings), leads(list(strings)), np.array(n), width)
            keep = [(a, d, *_runs(h)) for a, d, h in zip(anchor, digest, hits, strict=True) if len(h)]
            cols = list(zip(*keep, strict=True)) if keep else [[]] * 4
            return _emit({"anchor": pa.array(cols[0], pa.int64()), "digest": pa.array(cols[1], pa.int64()), "firsts": pa.array(cols[2], pa.list_(pa.int32())), "lasts": pa.array(cols[3], pa.list_(pa.int32()))})

        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            if len(held) > AT_ONCE:
                stop = len(held) - 1
                while stop and held[stop - 1][0] == held[-1][0]:
                    stop -= 1
                while stop:  # whole groups
                    take = min(stop, AT_ONCE)
                    while take < stop and held[take][0] == held[take - 1][0]:
                        take += 1
                    yield settle(held[:take])
                    held, stop = held[take:], stop - take
        if held:
            yield settle(held)

    cold = pieces.where(F.col("shards") <= most_shards).select("anchor", "digest", "n", "piece").repartition(parts, "anchor").sortWithinPartitions("anchor", "digest").mapInArrow(merge, "anchor long, digest long, firsts array<int>, lasts array<int>")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                n = np.array(part.column(2).to_pylist(), np.int64)
                hashes = [gram_hashes(np.frombuffer(s, np.uint8), width) for s in part.column(3).to_pylist()]
                repeat = np.repeat(np.arange(part.num_rows), n)
                yield _emit({"anchor": part.column(0).take(pa.array(repeat)), "digest": part.column(1).take(pa.array(repeat)), "hit": pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])), "string": pa.array(np.concatenate(hashes).view(np.int64))})

    hot = scratch.table(pieces.where(F.col("shards") > most_shards).select("anchor", "digest", "n", "piece").mapInArrow(strings, "anchor long, digest long, hit int, string long"), "strings")
    twice = scratch.table(hot.groupBy("anchor", "string").agg(F.count("*").alias("c")).where("c > 1").select(F.col("anchor").alias("a"), F.col("string").alias("s")), "twice")
    hot = hot.join(twice, (F.col("anchor") == F.col("a")) & (F.col("string") == F.col("s"))).groupBy("anchor", "digest").agg(F.collect_list("hit").alias("firsts")).withColumn("lasts", F.col("firsts"))

    runs = scratch.table(cold.union(hot).select(F.col("anchor").alias("a"), F.col("digest").alias("d"), "firsts", "lasts"), "runs")
    scratch.drop(pieces, wanted, several, again)
    whole = scratch.table(kinds.where("c > 1").select(F.col("anchor").alias("a"), F.col("digest").alias("d")), "whole")
    by = (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d"))
    alone = kinds.where("c = 1").select("anchor", "digest", "at.rid", "at.rid2", "at.first")
    all_of = rows.join(whole, by).select("rid", "rid2", F.col("first").alias("base"), F.array(F.lit(0)).alias("firsts"), F.array(F.col("n") - 1).alias("lasts"))
    sure = rows.where("firsts is not null").select("rid", "rid2", F.lit(0).alias("base"), "firsts", "lasts")
    return all_of.union(alone.join(runs, by).select("rid", "rid2", "first", "firsts", "lasts")).union(sure)


def _runs(hits: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of neighbouring numbers."""
    breaks = np.flatnonzero(np.diff(hits) > 1)
    return hits[np.append(0, breaks + 1)].tolist(), hits[np.append(breaks, len(hits) - 1)].tolist()


def covered(size: int, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Mask of the bytes that strings starting at first to last cover."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last + width, -1)
    return np.cumsum(edges[:-1]) > 0


def _with_cuts(docs: DataFrame, width: int, most_shards: int) -> DataFrame:
    """``docs`` with the first and last places of its runs as two more array columns (null or empty: none).

    Only rows whose text has runs are shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bwt")
    names = [F.col(f"`{c}`") for c in docs.columns]
    a, b, x, y, firsts, lasts = prefilter.unused(docs, "rid", "rid2", "cut_rid", "cut_rid2", "firsts", "lasts")
    keys = F.xxhash64("doc_id", "text"), F.hash("doc_id", "text")
    runs = repeated_strings(docs.select(keys[0].alias("rid"), keys[1].alias("rid2"), "text"), width, most_shards, scratch)
    from_base = lambda name: F.transform(name, lambda k: k + F.col("base"))
    cuts = runs.groupBy("rid", "rid2").agg(F.collect_list(F.struct(from_base("firsts").alias("f"), from_base("lasts").alias("l"))).alias("c"))
    cuts = scratch.table(cuts.select("rid", "rid2", F.flatten("c.f").alias("firsts"), F.flatten("c.l").alias("lasts")), "cuts")
    words, bits = prefilter.bitmap(cuts, "rid", cuts.count())
    words = scratch.table(words, "bitmap")
    scratch.clear(keep=[cuts, words])
    some, none = prefilter.split(docs.withColumns({a: keys[0], b: keys[1]}), a, words, bits)
    joined = some.join(cuts.toDF(x, y, firsts, lasts), (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left")
    nothing = F.lit(None).cast("array<int>")
    return joined.select(*names, firsts, lasts).union(none.select(*names, nothing.alias(firsts), nothing.alias(lasts)))


def _masks(part: pa.RecordBatch, sizes: list[int], width: int) -> Iterator[np.ndarray | None]:
    """For each row the mask of its covered bytes, or None, from the last two columns."""
    values, ends = zip(*((np.asarray(c.values), np.asarray(c.offsets)) for c in part.columns[-2:]), strict=True)
    for k, size in enumerate(sizes):
        first, last = (v[e[k] : e[k + 1]] for v, e in zip(values, ends, strict=True))
        yield covered(size, first, last, width) if len(first) else None


def dedup_digest(docs: DataFrame, width: int = 200, most_shards: int = MOST_SHARDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document after removal.

    One row per row of ``docs(doc_id, text)``.  A null text counts as empty;
    texts shorter than ``width`` keep all; rows that repeat a text of ``width``
    bytes or more lose all of it in every copy.  Rows with the same id and text
    are occurrences of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = []
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            for data, mask in zip(texts, _masks(part, [len(d) for d in texts], width), strict=True):
                gone, spans, kept = 0, 0, data
                if mask is not None:
                    gone, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] > mask[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
                rows.append((len(data), gone, spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield _emit({"doc_id": part.column(0), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3])})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_cuts(docs.select("doc_id", "text"), width, most_shards).mapInArrow(run, schema)


def dedup_texts(docs: DataFrame, width: int = 200, most_shards: int = MOST_SHARDS) -> DataFrame:
    """``docs`` with every covered byte taken out of ``text`` (the rest of a character that is cut in two goes too); null stays null."""

    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = [None if t is None else t.encode() for t in part.column(at).to_pylist()]
            out = []
            for data, mask in zip(texts, _masks(part, [len(d or b"") for d in texts], width), strict=True):
                if mask is not None:
                    data = np.frombuffer(data, np.uint8)[~mask].tobytes()
                out.append(None if data is None else data.decode(errors="ignore"))
            columns = part.columns[:-2]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with_cuts(docs, width, most_shards).mapInArrow(run, docs.schema)
