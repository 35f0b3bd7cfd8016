"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents form one stream of words in a shuffled order, cut into
blocks of equally many words.  Slot i of the mix takes the point
``i * 1327217885 mod 2^31`` (the golden-ratio sequence in whole numbers),
which cumulative targets map to a source; the k-th slot of a source takes block
k of its stream.  A stream may be read twice and no more.

Only DataFrame functions are used.  Positions in a stream are prefix sums over
small hash buckets, so a source that holds most rows is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.prefilter import unused
from tracelake.llm.scratch import Scratch

#: 2^31 divided by the golden ratio, made odd.
STEP, RANGE_BITS = 1327217885, 31
#: Points are matched to sources by cells of this many bits.
CELL_BITS = 10
SLOTS_PER_CHUNK, DOCS_PER_BUCKET = 256, 512
#: Chunks or buckets whose sums are added up in one window.
SUMS_PER_WINDOW = 4096


@dataclass(frozen=True)
class MixPlan:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    #: Words of the mix, as a share of all words.
    share: float = 1.5
    #: Times that a document may be used.
    passes: int = 2
    #: Words of a block: all words over slots_per_source and sources, within these bounds.
    most_block: int = 4096
    slots_per_source: int = 2000
    seed: int = 17


def word_count(text: str = "text") -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """(source, source_size, target, low, high): words wanted of each source, and its interval of points.

    Weights go to sources by code point, null last.  A target stops at
    ``passes`` times its source's size; what is over goes to the others by
    weight until none is above, which sorted by size over weight is one pass.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(plan.weights)
    weight = F.element_at(F.array(*map(F.lit, plan.weights)), (F.col("i") % n + 1).cast("int"))
    per = per.withColumn("i", F.row_number().over(every) - 1).withColumn("w", weight).withColumn("cap", F.col("source_size") * float(plan.passes))
    full = Window.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    per = per.withColumn("wanted", F.sum("source_size").over(whole) * plan.share - F.coalesce(F.sum("cap").over(full), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(full), F.lit(0.0)))
    per = per.withColumn("level", F.col("wanted") / F.col("rest")).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    per = per.withColumn("level", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(Window.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    per = per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")))
    upto = F.sum("target").over(every.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("target").over(whole)
    point = lambda x: F.when(total > 0, F.round(x / total * float(1 << RANGE_BITS))).otherwise(0.0).cast("long")
    return per.select("source", "source_size", "target", point(upto - F.col("target")).alias("low"), point(upto).alias("high"))


def _totals_before(sums: DataFrame, place: str) -> DataFrame:
    """``sums(source, place, n)`` as (s, p, base): what the smaller places of the source add up to.

    In two levels, so that a source with most of the rows is not one window.
    """
    sums = sums.withColumn("high", F.floor(F.col(place) / SUMS_PER_WINDOW))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.groupBy(F.col("source").alias("s"), F.col("high").alias("h")).agg(F.sum("n").alias("n"))
    tops = tops.select("s", "h", F.coalesce(F.sum("n").over(upto("s").orderBy("h")), F.lit(0)).alias("top"))
    inside = sums.select("source", "high", F.col(place).alias("p"), F.coalesce(F.sum("n").over(upto("source", "high").orderBy(place)), F.lit(0)).alias("within"))
    both = inside.join(tops, F.col("source").eqNullSafe(F.col("s")) & (F.col("high") == F.col("h")))
    return both.select("s", "p", (F.col("top") + F.col("within")).alias("base"))


def schedule(spark, goals: DataFrame, slots: int) -> DataFrame:
    """(slot, source, block): the source of each slot, and how many of its slots came before."""
    shift = RANGE_BITS - CELL_BITS
    cells = goals.where("high > low").withColumn("cell", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % (1 << RANGE_BITS)) * STEP % (1 << RANGE_BITS)).alias("point"))
    points = points.withColumn("cell", F.shiftright("point", shift))
    chosen = points.join(cells, "cell").where("point >= low and point < high").select("slot", "source", F.floor(F.col("slot") / SLOTS_PER_CHUNK).alias("chunk"))
    counts = _totals_before(chosen.groupBy("source", "chunk").agg(F.count("*").alias("n")), "chunk")
    ranked = chosen.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    return ranked.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("p"))).select("slot", "source", (F.col("base") + F.col("r")).alias("block"))


def _key(plan: MixPlan) -> Column:
    return F.xxhash64(F.lit(plan.seed), F.col("doc_id"))


def _bucket(key: Column, rows: int) -> Column:
    return F.pmod(F.shiftright(key, 8), F.lit(max(1, -(-rows // DOCS_PER_BUCKET))))


def streams(sizes: DataFrame, plan: MixPlan, rows: int) -> DataFrame:
    """``sizes`` with (bucket, nth, start): each document's place in its source's stream, by hash of its id."""
    placed = sizes.withColumn("key", _key(plan)).withColumn("bucket", _bucket(F.col("key"), rows))
    sums = _totals_before(placed.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    placed = placed.withColumn("nth", F.row_number().over(inside)).withColumn("within", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("p")))
    return placed.select("doc_id", "source", "size", "bucket", "nth", (F.col("base") + F.col("within")).alias("start"))


def mix(docs: DataFrame, plan: MixPlan = MixPlan()) -> tuple[DataFrame, DataFrame, int]:
    """(documents, pieces, number of documents) of the mix of ``docs(doc_id, text, source)``.

    documents: doc_id, source, size, bucket, nth, start, source_size, target,
    one row per input row.  pieces: doc_id, source, bucket, nth, pass, slot, first,
    words: the run of a document's words that a slot takes.  A null text has
    no words, documents without words get no piece, rows that repeat are
    documents of their own, and an empty table gives empty results.  Reruns
    agree, as order and schedule depend on ids and sizes only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sizes = scratch.table(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    goals = scratch.table(targets(sizes, plan), "targets")
    rows = sizes.count()
    wanted, sources = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    block = int(min(plan.most_block, max(1, wanted // max(1, sources * plan.slots_per_source))))
    slots = scratch.table(schedule(spark, goals, int(-(-wanted // block))), "slots")
    placed = streams(sizes, plan, rows).join(goals.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = scratch.table(placed, "streams")
    runs = placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(plan.passes - 1)))).withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
    runs = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("size") - 1) / block))))
    cut = F.greatest("from", F.col("block") * block)
    runs = runs.select("doc_id", "source", "bucket", "nth", "pass", "block", (cut - F.col("from")).alias("first"), (F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block) - cut).alias("words"))
    taken = runs.join(slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "slot"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return placed, taken.select("doc_id", "source", "bucket", "nth", "pass", "slot", "first", "words"), rows


def taken_words(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes, repeats counted."""
    placed, pieces, _ = mix(docs, plan)
    sums = pieces.groupBy("source", "bucket", "nth").agg(F.sum("words").alias("taken")).withColumnsRenamed({"source": "s", "bucket": "b", "nth": "k"})
    out = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("nth") == F.col("k")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass that takes words of it.

    A pass takes a stream from its start, so it is known by the last place it
    reaches; texts are compared with that of their source and never shuffled.
    A document of which the last slot takes a part stays whole.  Documents
    without words are dropped.
    """
    _, pieces, rows = mix(docs, plan)
    place = lambda key: F.struct(_bucket(key, rows).alias("bucket"), key.alias("key"), F.col("doc_id").alias("id"))
    ends = pieces.groupBy("source", "pass").agg(F.max(place(_key(plan))).alias("end"))
    of, last, uses, nth = unused(docs, "of_source", "last_places", "uses", "nth_use")
    ends = ends.groupBy(F.col("source").alias(of)).agg(F.collect_list("end").alias(last))
    ends = Scratch(docs.sparkSession, "mixed").table(ends, "ends")  # a row for each source
    here = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(ends, F.col("source").eqNullSafe(F.col(of)))
    here = here.withColumn(uses, F.size(F.filter(last, lambda end: place(_key(plan)) <= end))).where(F.col(uses) > 0)
    return here.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(uses)))).select(*[F.col(f"`{c}`") for c in docs.columns])
