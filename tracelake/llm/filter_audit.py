"""Filter interaction audit by inclusion-exclusion.

A filter is a boolean column that is true where it fails a document.  For every
set S of filters the joint failures J(S), the weight of the documents that all
of S fail, are sums of products of the flags.  All else follows from these 2^k
numbers without another look at the documents:

* survivors of the filters P:  sum over S in P of (-1)^|S| J(S)
* failed by P and by no other: sum over S containing P of (-1)^(|S|-|P|) J(S)
* Harsanyi dividend of S in "documents that a set of filters removes":
  (-1)^(|S|+1) J(S); a filter's Shapley value is the sum of the dividends of the
  sets that hold it, each divided by the size of its set.

Everything is DataFrame expressions.  Documents are reduced to an id, a part, a
256-bit digest of the text and the flags before anything is shuffled, and rows
alike in these are counted before they move, so neither a large group of copies
nor a large part meets in one task.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters of ``document_flags`` and ``mark_copies``.
FILTERS = "ABCDE"
#: More filters would make too many orders to list.
MOST_FILTERS = 6

_SPACE = " \t\n\x0b\f\r"


def document_flags(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, digest, A, B, C, D): the filters that need no other document.

    Words are maximal ``[^\\x20\\x09-\\x0D]+``, case-sensitive; a null text is
    empty, a null part the empty string; a null key stays null.  A: under 100
    words.  B: 100 * distinct words < 80 * words.  C: 100 * ``[A-Z]`` > 10 * code
    points.  D: holds any of ``#$%&*|``.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), whole.alias("whole"), F.btrim(whole, F.lit(_SPACE)).alias("trimmed"))
    words = base.select("key", "part", "whole", F.when(F.col("trimmed") != "", F.split("trimmed", r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")).alias("words"))
    capitals = F.octet_length("whole") - F.octet_length(F.regexp_replace("whole", "[A-Z]+", ""))
    return words.select(
        "key",
        "part",
        F.unhex(F.sha2("whole", 256)).alias("digest"),
        (F.size("words") < 100).alias("A"),
        (F.size(F.array_distinct("words")).cast("long") * 100 < F.size("words").cast("long") * 80).alias("B"),
        (capitals.cast("long") * 100 > F.char_length("whole").cast("long") * 10).alias("C"),
        F.col("whole").rlike("[#$%&*|]").alias("D"),
    )


def mark_copies(flagged: DataFrame, labels: DataFrame, filters: list[str]) -> DataFrame:
    """(part, the filters, E, n, good, toxic): counts of documents alike in all flags; E fails where a smaller key has the same text.

    Keys that are null have no smaller one and are none; rows that repeat the
    smallest key of a text all pass.  ``labels`` (doc_id, quality, toxic): a
    document is good or toxic if any row of its id says so.
    """
    one = flagged.groupBy("key", "part", "digest", *filters).agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    marked = one.join(known, "key", "left").select("*", F.coalesce("good", F.lit(False)).alias("is_good"), F.coalesce("bad", F.lit(False)).alias("is_toxic"))
    like = ["part", "digest", *filters, "is_good", "is_toxic"]
    # of each class of rows: all, those without a key, the smallest key and how many rows have it
    classes = marked.groupBy(*like).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("unkeyed"), F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("first"))
    least = classes.groupBy(F.col("digest").alias("text")).agg(F.min("first.key").alias("least"))
    alone = F.when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(0)
    split = classes.join(least, F.col("digest") == F.col("text")).withColumn("passing", alone + F.col("unkeyed"))
    sides = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("passing").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passing")).alias("n"))))
    rows = split.select("part", *filters, "is_good", "is_toxic", sides.alias("side")).select("part", *filters, "side.E", "side.n", "is_good", "is_toxic")
    return rows.groupBy("part", *filters, "E").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def _subsets(mask: int) -> list[int]:
    return [s for s in range(mask + 1) if s & mask == s]


def _sums(array: str, sums: list[list[tuple[int, int]]]) -> Column:
    """An array of sums of factor * place of an array."""
    return F.expr("array(" + ", ".join(" + ".join(f"{factor} * `{array}`[{place}]" for factor, place in terms) or "0L" for terms in sums) + ")")


def _sign(mask: int) -> int:
    return -1 if mask.bit_count() % 2 else 1


def joint_failures(counted: DataFrame, filters: list[str], weights: list[str], part: str = "part") -> DataFrame:
    """(part, an array of 2^k sums for each weight): place S holds the weight of the rows that all filters of the bit set S fail."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    flag = [F.col(f"`{f}`").cast("long") for f in filters]

    def joint(weight: str, mask: int) -> Column:
        out = F.col(f"`{weight}`")
        for k, x in enumerate(flag):
            if mask >> k & 1:
                out = out * x
        return F.sum(out).alias(f"{weight}_{mask}")

    every = range(1 << len(filters))
    sums = counted.groupBy(part).agg(*[joint(w, m) for w in weights for m in every])
    return sums.select(part, *[F.array(*[F.col(f"{w}_{m}") for m in every]).alias(w) for w in weights])


def survivors(joint: str, k: int) -> Column:
    """Array over bit sets P: weight of the rows that no filter of P fails."""
    return _sums(joint, [[(_sign(s), s) for s in _subsets(p)] for p in range(1 << k)])


def failed_exactly(joint: str, k: int) -> Column:
    """Array over bit sets P: weight of the rows that all filters of P and no others fail."""
    full = (1 << k) - 1
    return _sums(joint, [[(_sign(s), p | s) for s in _subsets(full & ~p)] for p in range(1 << k)])


def dividends(joint: str, k: int) -> Column:
    """Array over bit sets S: the Harsanyi dividend of S (0 for the empty set)."""
    return _sums(joint, [[(-_sign(s), s)] if s else [] for s in range(1 << k)])


def shapley_over_orders(dividend: str, k: int) -> Column:
    """Array over filters: rows removed, summed over all k! orders (k! times the Shapley value, a whole number)."""
    orders = factorial(k)
    return _sums(dividend, [[(orders // s.bit_count(), s) for s in range(1 << k) if s >> i & 1] for i in range(k)])


def interactions(joint: DataFrame, filters: list[str], weight: str = "n", part: str = "part") -> DataFrame:
    """(part, filters, joint, exactly, survivors, dividend): a row for each part and set of filters."""
    k = len(filters)
    names = F.array(*[F.lit("".join(f for i, f in enumerate(filters) if s >> i & 1)) for s in range(1 << k)])
    wide = joint.select(part, F.arrays_zip(names.alias("filters"), F.col(weight).alias("joint"), failed_exactly(weight, k).alias("exactly"), survivors(weight, k).alias("survivors"), dividends(weight, k).alias("dividend")).alias("rows"))
    return wide.select(part, F.explode("rows").alias("row")).select(part, "row.*")


def order_report(joint: DataFrame, filters: list[str], part: str = "part") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    ``joint`` holds arrays ``n``, ``good`` and ``toxic`` of ``joint_failures``.
    """
    k = len(filters)
    steps = []
    for order in permutations(range(k)):
        name, before = "".join(filters[x] for x in order), 0
        for step, i in enumerate(order, 1):
            steps.append(f"named_struct('filter_order', '{name}', 'step', {step}, 'i', {i}, 'one', {1 << i}, 'before', {before}, 'after', {before | 1 << i})")
            before |= 1 << i
    listed = F.expr(f"array({', '.join(steps)})")
    solved = joint.select(part, F.col("n").alias("joint"), failed_exactly("n", k).alias("exactly"), dividends("n", k).alias("dividend"), *[survivors(w, k).alias(f"left_{w}") for w in ("n", "good", "toxic")])
    solved = solved.withColumn("shapley", shapley_over_orders("dividend", k))
    lost = lambda w: (F.col(f"left_{w}")[F.col("at.before")] - F.col(f"left_{w}")[F.col("at.after")]).cast("long")
    out = solved.select("*", F.explode(listed).alias("at"))
    return out.select(
        part,
        "at.filter_order",
        "at.step",
        F.col("left_n")[F.col("at.after")].cast("long").alias("kept"),
        lost("n").alias("removed"),
        (F.col("joint")[F.col("at.one")] - lost("n")).cast("long").alias("redundant"),
        F.col("exactly")[F.col("at.one")].cast("long").alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.col("shapley")[F.col("at.i")].cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Joint failures of the five filters by part: arrays n, good and toxic of 32 sums.  No documents give no rows."""
    counted = mark_copies(document_flags(docs, key, text, part), labels, list(FILTERS[:-1]))
    return joint_failures(counted, list(FILTERS), ["n", "good", "toxic"])
