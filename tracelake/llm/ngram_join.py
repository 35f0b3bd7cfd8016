"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct n-word shingles.  All shingles stand in one
global order (frequent ones last, else by hash); two sets with Jaccard t or more
share a shingle among the first |x| - ceil(t |x|) + 1 of each, and up to their
first common one nothing else is common, so their places there bound the overlap.

1.  A first pass counts the shingles that prefixes by hash hold; those of many
    documents go last in the order of the second pass.
2.  Equal sets count as one head.  Heads with the same prefix and size are one
    group, and buckets of prefix shingles list groups.
3.  Group pairs of a bucket's leader (the group with the bucket's shingle at the
    first place, so that with the fewest rare ones) and its other groups, as far
    as sizes and places allow, are expanded to members and verified; so are the
    leader and the members of each group.  Each group meets one leader first, and
    then those that are not in its component yet.  Verified links join components.
4.  In small buckets that still hold several components the group pairs that
    could join two are formed and filtered.  Large buckets of one leader, the
    members of both groups of a pair, and those of one group become units, whose
    pairs are compared block by block: by their signatures (the parity of the set
    in two bits a shingle, an upper bound of the overlap), which leaves the heads
    that may have a partner, and then by their sets.  No pair is written but links
    that join two components, fewer than the heads of the blocks.  Pairs in one
    component need no look: they are linked already.  Of the pairs of small
    buckets that are left each head's first is verified before the others, of
    which those need no look that it has joined.

So copies and near copies, however many, cost rows in proportion to their
number, every link that could join two components is verified, and none is
lost.  Sets are kept as 64-bit hashes of shingles.  Signatures rule pairs out
before texts are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import prefilter
from tracelake.llm.components import components
from tracelake.llm.scratch import Scratch, partitions_for
from tracelake.llm.text import WordHashes, chunks, hashed, mix64, text_keys, words_of

#: Documents from which on a prefix shingle counts as frequent, by class.
FREQUENT = (32, 1024)
#: Groups of a small bucket; members in a block of a unit and shingles of all of them; pairs compared at a time.
SMALL, BLOCK, BLOCK_SHINGLES, AT_ONCE = 48, 2048, 1 << 20, 1 << 18
#: 64-bit words of the signature of a set of up to 512 shingles, doubled with each doubling of the set.
LONG = 16

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_hashes(text: str | None, n: int, memo: WordHashes) -> np.ndarray:
    """Hashes of the shingles in their order, repeats included; of the whole sequence if it has fewer than n words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = hashed(words, memo)
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = mix64(total * _ODD[i % 8] + h[i : len(h) - k + 1 + i])
    return total


def shingle_set(text: str | None, n: int, memo: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(text, n, memo))


def signature(shingles: np.ndarray) -> bytes:
    """Parity of the set in about two bits a shingle."""
    bits = 64 * LONG << max(0, (len(shingles) - 1).bit_length() - 9)
    counts = np.bincount((shingles >> np.uint64(24)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(long: bytes, words: int) -> np.ndarray:
    """The parity in fewer bits, from the longer one."""
    return np.bitwise_xor.reduce(np.frombuffer(long, np.uint64).reshape(-1, words), axis=0)


def most_overlap(nx: int, ny: int, x: bytes, y: bytes) -> int:
    """Upper bound of the intersection of two sets, by their sizes and signatures."""
    words = min(len(x), len(y)) // 8
    return (nx + ny - int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())) // 2


def prefix_length(size: int, top: int, bottom: int) -> int:
    """Shingles of a set's prefix for the threshold top / bottom."""
    return size - -(-top * size // bottom) + 1 if size else 0


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _frequent(docs: DataFrame, n: int, top: int, bottom: int, scratch: Scratch) -> list[np.ndarray]:
    """For each class of frequent shingles a bitmap of its hashes (a few others may be in it: any order is right).

    Every prefix by hash is counted, added up a chunk at a time before the
    exchange; only the bitmaps, of bounded size, reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in chunks(batches):
            sets = [shingle_set(t, n, memo) for t in part.column(0).to_pylist()]
            prefixes, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s[: prefix_length(len(s), top, bottom)] for s in sets)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prefixes.view(np.int64)), pa.array(counts)], names=["k", "c"])

    found = docs.select("text").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).where(f"c > {FREQUENT[0]}")
    found = scratch.table(found, "frequent")
    return [prefilter.collected(*prefilter.bitmap(keys, "k", keys.count(), mixed=True)) for keys in (found.where(f"c > {c}") for c in FREQUENT)]


def _linked(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, Scratch]:
    """(doc_id, t1, t2, n, comp, name) of every row: hashes of its text, set size, component by number (null for an empty set) and by its smallest id."""
    limit = Fraction(round(threshold * 1_000_000), 1_000_000)
    if not 0 < limit <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    top, bottom = limit.numerator, limit.denominator
    scratch = Scratch(docs.sparkSession, "ngrams")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", *text_keys("text"))
    classes = _frequent(docs, n, top, bottom, scratch)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in chunks(batches):
            rows = []
            for t in part.column(1).to_pylist():
                s = shingle_set(t, n, memo)
                k = prefix_length(len(s), top, bottom)
                level = sum(prefilter.among(s, words).astype(np.int8) for words in classes)
                # in the global order: class, then hash; s is sorted by hash
                first = s[np.argsort(level, kind="stable")[:k]] if level.any() else s[:k]
                digest = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((len(s), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), first.view(np.int64), signature(s)))
            made = _batch(rows, ["n", "d1", "d2", "prefix", "signature"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *made.columns], names=["doc_id", "t1", "t2", *made.schema.names])

    sets = scratch.table(docs.mapInArrow(describe, f"doc_id {kind}, t1 long, t2 long, n long, d1 long, d2 long, prefix array<long>, signature binary"), "sets")
    heads = sets.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("name"), F.min(F.struct("t1", "t2")).alias("t"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("signature").alias("signature"))
    heads = scratch.table(heads.select("d1", "d2", "name", "t.t1", "t.t2", "n", "prefix", "signature", F.xxhash64("prefix").alias("p1"), F.xxhash64(F.lit(1), "prefix").alias("p2"), F.monotonically_increasing_id().alias("head")), "heads")

    # groups of several heads; any other head is its own group
    groups = heads.groupBy("n", "p1", "p2").agg(F.min("head").alias("gid"), F.count("*").alias("c")).where("c > 1").select(F.col("n").alias("gn"), F.col("p1").alias("g1"), F.col("p2").alias("g2"), "gid")
    grouped = heads.select("head", "n", "p1", "p2").join(groups, (F.col("n") == F.col("gn")) & (F.col("p1") == F.col("g1")) & (F.col("p2") == F.col("g2"))).select("gid", "head", "n")
    grouped = scratch.table(grouped, "grouped")
    some, none = prefilter.split(heads.select("head", "n", "prefix"), "head", *prefilter.bitmap(grouped, "head", grouped.count()))
    some = some.join(grouped.select(F.col("head").alias("h"), "gid"), F.col("head") == F.col("h"), "left").where("gid is null or gid = head")
    leaders = none.withColumn("several", F.lit(False)).union(some.select("head", "n", "prefix", F.col("gid").isNotNull().alias("several")))

    posts = leaders.select(F.col("head").alias("gid"), "n", "several", F.posexplode("prefix").alias("pos", "bucket"))
    shared = scratch.table(posts.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select(F.col("bucket").alias("b")), "shared")
    posts, _ = prefilter.split(posts.select("bucket", "gid", "n", "several", "pos"), "bucket", *prefilter.bitmap(shared, "b", shared.count()))
    posts = scratch.table(posts, "posts")
    first = posts.groupBy("bucket").agg(F.min(F.struct("pos", "gid", "n", "several")).alias("l"), F.count("*").alias("c")).where("c > 1").select(F.col("bucket").alias("b"), "l", "c")
    rows = scratch.table(posts.join(first, F.col("bucket") == F.col("b")).select("bucket", "gid", "n", "several", "pos", "l", "c"), "rows")
    scratch.drop(posts)

    star = scratch.table(rows.where("gid <> l.gid").where(_may(F.col("n"), F.col("l.n"), F.col("pos"), F.col("l.pos"), top, bottom)).select(F.col("l.gid").alias("a"), F.col("gid").alias("b")).distinct(), "star")
    more = grouped.where("head <> gid").select(F.col("gid").alias("g"), F.col("head").alias("m"))
    # each group with one leader first, then with the others that it is not joined to
    nearest = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    expand = lambda pairs: pairs.union(pairs.join(more, F.col("b") == F.col("g")).select("a", F.col("m").alias("b")))
    links = _verified(expand(nearest).union(more.select(F.col("g").alias("a"), F.col("m").alias("b"))), heads, docs, n, top, bottom, scratch)
    others = _unjoined(expand(star.join(nearest, ["a", "b"], "left_anti")), links, scratch)
    links = links.union(_verified(others, heads, docs, n, top, bottom, scratch))
    labels = scratch.table(components(links, scratch), "components")

    # what the stars have not joined: components of heads, the least and greatest of each group
    known = labels.select(F.col("node").alias("x"), "component")
    of_group = grouped.join(known, F.col("head") == F.col("x"), "left").select("gid", "head", F.coalesce("component", "head").alias("component"))
    of_group = scratch.table(of_group, "labelled")
    spread = of_group.groupBy("gid").agg(F.min("component").alias("from"), F.max("component").alias("to")).withColumnRenamed("gid", "y")
    # a leader's own pairs are settled, but not those of the other members of its group
    left = rows.where("(gid <> l.gid or several) and (c > 2 or l.several)")
    few = left.where(F.col("c") <= SMALL).select("bucket", "gid", "n", "pos", "several").join(known, F.col("gid") == F.col("x"), "left").join(spread, F.col("gid") == F.col("y"), "left")
    few = few.select("bucket", F.col("gid").alias("id"), "n", "pos", F.coalesce("from", "component", "gid").alias("from"), F.coalesce("to", "component", "gid").alias("to"), "several")
    pairs = scratch.table(_small_pairs(scratch.table(few, "few"), top, bottom, scratch).distinct(), "group_pairs")
    sides = pairs.where("wide").select(F.xxhash64("a", "b").alias("unit"), F.explode(F.array("a", "b")).alias("id"))
    units = left.where(F.col("c") > SMALL).select(F.col("l.gid").alias("unit"), F.col("gid").alias("id")).union(sides)
    units = units.join(of_group.select("gid", "head"), F.col("id") == F.col("gid"), "left").select("unit", F.coalesce("head", "id").alias("id"))
    units = units.union(of_group.select(F.col("gid").alias("unit"), F.col("head").alias("id"))).distinct()
    units = units.join(known, F.col("id") == F.col("x"), "left").select("unit", "id", F.coalesce("component", "id").alias("component"))
    links = links.union(_unit_links(scratch.table(units, "units"), heads, docs, n, top, bottom, scratch))
    wanted = scratch.table(_unjoined(pairs.where("not wide").select("a", "b"), links, scratch), "wanted")
    # near copies are all wanted with each other: each head with one first here, too
    nearest = wanted.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = links.union(_verified(nearest, heads, docs, n, top, bottom, scratch))
    others = _unjoined(wanted.join(nearest, ["a", "b"], "left_anti"), links, scratch)
    links = links.union(_verified(others, heads, docs, n, top, bottom, scratch))

    labels = scratch.table(components(links, scratch), "components").select(F.col("node").alias("x"), "component")
    named = heads.select("d1", "d2", "name", "head").join(labels, F.col("head") == F.col("x"), "left").select("d1", "d2", "name", F.coalesce("component", "head").alias("comp"))
    named = scratch.table(named, "named")
    names = named.groupBy(F.col("comp").alias("k")).agg(F.min("name").alias("least"))
    named = named.join(names, F.col("comp") == F.col("k")).select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "comp", "least")
    out = sets.select("doc_id", "t1", "t2", "n", "d1", "d2").join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    out = scratch.table(out.select("doc_id", "t1", "t2", "n", "comp", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("name")), "linked")
    scratch.clear(keep=[out])
    return out, scratch


def similarity_components(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``.

    Two documents link when intersection size / union size of their sets is
    ``threshold`` or more (compared in whole numbers, to 6 decimals).
    component_id is the smallest id reachable by links.  A null, empty or blank
    text has an empty set, links with nothing and is its own component.  Rows
    with equal sets link.  A row with a null id links as any other but names no
    component: one of null ids only has the name null.  Rows that repeat an id
    are documents of their own, each with its text's component.
    """
    return _linked(docs, n, threshold)[0].select("doc_id", F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of similar ones: that with the smallest id (null last; then by hash of the text).

    Of rows that repeat its id and text one stays.  Rows without words all stay.
    Only texts of rows that may go are shuffled.
    """
    linked, scratch = _linked(docs.select("doc_id", "text"), n, threshold)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")
    copies = linked.where("comp is not null").groupBy("comp", "doc_id", "t1", "t2").agg(F.count("*").alias("c"))
    best = linked.where("comp is not null").groupBy(F.col("comp").alias("k")).agg(F.min(place).alias("best"))
    touched = copies.join(best, F.col("comp") == F.col("k")).select(F.col("doc_id").alias("id"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), (place == F.col("best")).alias("stays"), "c")
    touched = scratch.table(touched.where("not stays or c > 1").drop("c"), "touched")
    scratch.clear(keep=[touched])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"), *text_keys("text"))
    some, none = prefilter.split(packed, "t1", *prefilter.bitmap(touched, "u1", touched.count()))
    same = F.col("key").eqNullSafe(F.col("id")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2"))
    kept = some.join(touched.where("stays"), same).dropDuplicates(["key", "t1", "t2"])
    return none.select("row").union(some.join(touched, same, "left_anti").select("row")).union(kept.select("row")).select("row.*")


def _may(nx: Column, ny: Column, px: Column, py: Column, top: int, bottom: int) -> Column:
    """Whether sizes, and places of the first common shingle in the order, leave room for the overlap that is needed."""
    sizes = F.least(nx, ny) * bottom >= F.greatest(nx, ny) * top
    return sizes & (F.least(nx - px, ny - py) * (top + bottom) >= (nx + ny) * top)


def _unjoined(pairs: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that the links do not join, directly or not."""
    joined = scratch.table(components(links, scratch), "joined")
    joined_to = lambda k: joined.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    pairs = pairs.join(joined_to("a"), "a", "left").join(joined_to("b"), "b", "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _small_pairs(rows: DataFrame, top: int, bottom: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, wide) of groups of a small bucket, a < b, that could join two components and that sizes and places allow.

    ``rows`` has (bucket, id, n, pos, from, to, several); a pair is wide if
    either stands for several.  Buckets of one component end here.
    """
    open_ = rows.groupBy("bucket").agg(F.min("from").alias("lo"), F.max("to").alias("hi"), F.count("*").alias("c")).where("lo < hi and c > 1").select(F.col("bucket").alias("b"))
    left = rows.join(open_, F.col("bucket") == F.col("b")).select("bucket", "id", "from", "to", "n", F.col("pos").cast("long").alias("pos"), "several")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 1):
            key, low, high, size, pos, several = (table.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7))
            starts = np.flatnonzero(_changes(table, 1))
            sizes = np.diff(np.append(starts, table.num_rows))
            for m in np.unique(sizes).tolist():
                one, two = np.triu_indices(m, 1)
                at = starts[sizes == m][:, None]
                for piece in np.array_split(at, -(-len(at) * len(one) // AT_ONCE)) if len(one) else []:
                    i, j = (piece + one).reshape(-1), (piece + two).reshape(-1)
                    joined = (low[i] == high[i]) & (low[i] == low[j]) & (high[i] == high[j])
                    keep = ~joined & (bottom * np.minimum(size[i], size[j]) >= top * np.maximum(size[i], size[j]))
                    i, j = i[keep], j[keep]
                    keep = np.minimum(size[i] - pos[i], size[j] - pos[j]) * (top + bottom) >= top * (size[i] + size[j])
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), several[i] | several[j])], names=["a", "b", "wide"])

    return left.repartition(partitions_for(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(pairs, "a long, b long, wide boolean")


def _unit_links(units: DataFrame, heads: DataFrame, docs: DataFrame, n: int, top: int, bottom: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of heads of a unit that join its components as all links of the unit do.

    ``units`` has (unit, id, component).  Units of one component end here.  A
    unit is dealt in blocks, and a task compares two of them: first all
    signatures, then the sets of the heads that these leave a partner.  Neither
    writes more rows than the two blocks have heads.
    """
    open_ = units.groupBy("unit").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(F.col("unit").alias("u"))
    left = scratch.table(units.join(open_, F.col("unit") == F.col("u")).drop("u"), "open_units")
    marks, _ = prefilter.split(heads.select("head", "n", "t1", "t2", "signature"), "head", *prefilter.bitmap(left, "id", left.count()))
    marks = scratch.table(marks, "marks")
    left = scratch.table(left.join(marks.select("head", "n"), F.col("id") == F.col("head")).drop("head"), "sized_units")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    left = left.join(left.groupBy(F.col("unit").alias("u")).agg(blocks), F.col("unit") == F.col("u")).drop("n")
    left = left.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("unit", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "id", "component")
    signed = left.join(marks.select("head", "n", "signature"), F.col("id") == F.col("head")).drop("head")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, one, two in _block_pairs(batches):
            component, size = (table.column(k).to_numpy(zero_copy_only=False) for k in (5, 6))
            folds, found = _folds(table.column(7).to_pylist()), np.zeros(table.num_rows, bool)
            for piece in np.array_split(one, -(-len(one) * len(two) // AT_ONCE)):
                i, j = (x.reshape(-1) for x in np.meshgrid(piece, two, indexing="ij"))
                keep = (component[i] != component[j]) & ((i < j) | (one[0] != two[0])) & (bottom * np.minimum(size[i], size[j]) >= top * np.maximum(size[i], size[j]))
                i, j = i[keep], j[keep]
                keep = (size[i] + size[j] - _apart(folds, i, j)) // 2 * (top + bottom) >= top * (size[i] + size[j])
                found[i[keep]] = found[j[keep]] = True
            yield pa.RecordBatch.from_arrays(table.columns[:6], names=["unit", "lo", "hi", "block", "id", "component"]).filter(pa.array(found))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, one, two in _block_pairs(batches):
            key, component = (table.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(6)]
            x, y = _joining(sets, one, two, component, top, bottom)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[x], key[y])), pa.array(np.maximum(key[x], key[y]))], names=["a", "b"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in chunks(batches):
            sets = [shingle_set(t, n, memo).tobytes() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sets, pa.binary())], names=["t1", "t2", "set"])

    parts = partitions_for(units.sparkSession)
    dealt = lambda rows: rows.repartition(parts, "unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi")
    some = dealt(signed).mapInArrow(partners, "unit long, lo int, hi int, block int, id long, component long")
    some = scratch.table(some, "partners")
    ids = some.select("id").distinct().withColumnRenamed("id", "i")
    needed = scratch.table(marks.join(ids, F.col("head") == F.col("i")).select("head", "t1", "t2"), "needed")
    texts, _ = prefilter.split(docs.select("t1", "t2", "text"), "t1", *prefilter.bitmap(needed, "t1", needed.count()))
    sets = texts.dropDuplicates(["t1", "t2"]).select("t1", "t2", "text").mapInArrow(describe, "t1 long, t2 long, set binary")
    sets = scratch.table(needed.join(sets, ["t1", "t2"]).select("head", "set"), "unit_sets")
    scratch.drop(marks)
    some = some.join(sets, F.col("id") == F.col("head")).drop("head")
    return scratch.table(dealt(some).mapInArrow(link, "a long, b long"), "links")


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For each two blocks of a unit, or a block and itself, their rows (unit, lo, hi, block, ..) and the places of either's."""
    for table in _whole_groups(batches, 3):
        lo, hi, block = (table.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        starts = np.flatnonzero(_changes(table, 3))
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            one, two = np.flatnonzero(block[a:z] == lo[a]), np.flatnonzero(block[a:z] == hi[a])
            if len(one) and len(two):
                yield table.slice(a, z - a), one, two


def _joining(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, component: np.ndarray, top: int, bottom: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``one`` and in ``two`` whose sets are similar enough, as many as it takes to join the components that such pairs join."""
    size = np.array([len(s) for s in sets])
    starts = np.cumsum(size) - size
    words, number = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.unique(component, return_inverse=True)[1]
    marked, out = np.zeros(len(words), np.int32), []
    for i in one.tolist():
        mine = number[starts[i] : starts[i] + size[i]]
        near = (bottom * np.minimum(size[i], size[two]) >= top * np.maximum(size[i], size[two])) & (label[two] != label[i]) & ((two > i) | (one[0] != two[0]))
        marked[mine] = 1
        # the other sets' numbers, some million at a time
        far = two[near]
        for js in np.split(far, np.flatnonzero(np.diff(np.cumsum(size[far]) >> 20)) + 1) if len(far) else []:
            js = js[label[js] != label[i]]
            if not len(js):
                continue
            ends = np.cumsum(size[js])
            at = np.arange(ends[-1]) + np.repeat(starts[js] - ends + size[js], size[js])
            inter = np.add.reduceat(marked[number[at]], ends - size[js])
            for j in js[bottom * inter >= top * (size[i] + size[js] - inter)].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
        marked[mine] = 0
    x, y = np.array(out, np.int64).reshape(-1, 2).T
    return x, y


def _folds(marks: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Words of each signature, and for each length that occurs all signatures of that length or more, folded to it."""
    words = np.array([len(m) // 8 for m in marks])
    out = {}
    for w in np.unique(words).tolist():
        table = np.zeros((len(marks), w), np.uint64)
        for k in np.flatnonzero(words >= w).tolist():
            table[k] = folded(marks[k], w)
        out[w] = table
    return words, out


def _apart(folds: tuple[np.ndarray, dict[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the signatures of pairs differ, at the shorter one's length."""
    words, tables = folds
    out, least = np.zeros(len(i), np.int64), np.minimum(words[i], words[j])
    for w, table in tables.items():
        at = np.flatnonzero(least == w)
        for piece in np.array_split(at, -(-len(at) * w // (1 << 21))) if len(at) else []:
            out[piece] = np.bitwise_count(table[i[piece]] ^ table[j[piece]]).sum(axis=1, dtype=np.int64)
    return out


def _changes(table: pa.Table | pa.RecordBatch, keys: int) -> np.ndarray:
    """Where the first columns differ from the row before; true for the first row."""
    change = np.ones(table.num_rows, bool)
    columns = [np.asarray(table.column(k)) for k in range(keys)]
    change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return change


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew so that rows with equal keys stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 8192 and sum(b.nbytes for b in held) < 32 << 20:
            continue
        table = pa.concat_batches(held)
        last = int(np.flatnonzero(_changes(table, keys))[-1])
        if last:
            yield table.slice(0, last)
        held = [table.slice(last)]
    if held:
        yield pa.concat_batches(held)


def _verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, n: int, top: int, bottom: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; those that the signatures rule out need no texts."""
    pairs = scratch.table(pairs, "pairs")
    marks, _ = prefilter.split(heads.select("head", "n", "t1", "t2", "signature"), "head", *prefilter.bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", 2 * pairs.count()))
    marks = scratch.table(marks, "marks")

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [most_overlap(nx, ny, x, y) * (top + bottom) >= top * (nx + ny) for nx, ny, x, y in zip(*(batch.column(k).to_pylist() for k in range(6, 10)), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:6], names=["a", "b", "a1", "a2", "b1", "b2"]).filter(pa.array(good, pa.bool_()))

    side = lambda k: marks.select(F.col("head").alias(k), F.col("n").alias(f"n{k}"), F.col("t1").alias(f"{k}1"), F.col("t2").alias(f"{k}2"), F.col("signature").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a1", "a2", "b1", "b2", "na", "nb", "sa", "sb")
    likely = scratch.table(both.mapInArrow(rule_out, "a long, b long, a1 long, a2 long, b1 long, b2 long"), "likely")
    scratch.drop(marks)
    texts, _ = prefilter.split(docs.select("t1", "t2", "text"), "t1", *prefilter.bitmap(likely.select(F.explode(F.array("a1", "b1")).alias("u1")), "u1", 2 * likely.count()))
    texts = scratch.table(texts.dropDuplicates(["t1", "t2"]), "texts")
    text = lambda k: texts.select(F.col("t1").alias(f"{k}1"), F.col("t2").alias(f"{k}2"), F.col("text").alias(f"t{k}"))
    both = likely.join(text("a"), ["a1", "a2"]).join(text("b"), ["b1", "b2"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sets = WordHashes(), {}

        def known(key: int, text: str) -> np.ndarray:
            if key not in sets:
                if len(sets) > 64:
                    sets.clear()
                sets[key] = shingle_set(text, n, memo)
            return sets[key]

        for part in chunks(batches, "ta"):
            good = []
            for a, b, ta, tb in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = known(a, ta), known(b, tb)
                both = np.concatenate([x, y])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                good.append(bottom * inter >= top * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = scratch.table(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "links")
    scratch.drop(texts)
    return links
