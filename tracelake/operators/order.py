"""Exact order statistics of a whole column, by narrowing ranges of values.

A pass takes approximate percentiles (mergeable sketches of bounded size, made
in every task) of the values inside each open range, on either side of the ranks
that are wanted there; the next one counts the values below and at these
percentiles exactly.  A rank then is one of the two values, or lies strictly
between them, where some ten-thousandths of the values are left, however they
are spread and however often any one repeats.  A range of few values ends it:
they are counted by value.  So nothing is sorted, and no task and not the driver
ever holds more than a sketch or ``FEW`` values for each rank.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a range that are counted one by one.
FEW = 1 << 14
#: Accuracy of the sketches: ranks are off by at most one in so many.
ACCURACY = 10_000


@dataclass
class Span:
    """The open range (low, high), None being no bound, with ``below`` values before it and ``inside`` in it."""

    low: float | None
    high: float | None
    below: int
    inside: int
    ranks: list[int] = field(default_factory=list)

    def holds(self, v: Column) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (v > F.lit(self.low))
        if self.high is not None:
            inside = inside & (v < F.lit(self.high))
        return inside


def select_ranks(df: DataFrame, ranks: list[int], column: str = "v", few: int = FEW) -> dict[int, float]:
    """The values of zero-based ``ranks`` in ascending order; nulls are left out and NaN must not be there.

    Two passes for each ten-thousandfold range of the number of values, and one.
    """
    v = F.col(column)
    rows = df.select(v.cast("double").alias(column)).where(v.isNotNull())
    n = rows.count()
    if any(not 0 <= r < n for r in ranks):
        raise ValueError(f"ranks beyond {n} values")
    found: dict[int, float] = {}
    spans = [Span(None, None, 0, n, sorted(set(ranks)))] if ranks else []
    while spans:
        small = [s for s in spans if s.inside <= few]
        if small:
            _by_value(rows, column, small, found)
        spans = _narrowed(rows, column, [s for s in spans if s.inside > few], found)
    return found


def _by_value(rows: DataFrame, column: str, spans: list[Span], found: dict[int, float]) -> None:
    v = F.col(column)
    which = F.coalesce(*[F.when(s.holds(v), k) for k, s in enumerate(spans)])  # ranges don't overlap
    counts = rows.withColumn("_span", which).where("_span is not null").groupBy("_span", column).agg(F.count("*").alias("n")).collect()
    for k, span in enumerate(spans):
        at = span.below
        todo = list(span.ranks)
        for value, n in sorted((r[1], r[2]) for r in counts if r[0] == k):
            while todo and todo[0] < at + n:
                found[todo.pop(0)] = value
            at += n


def _narrowed(rows: DataFrame, column: str, spans: list[Span], found: dict[int, float]) -> list[Span]:
    """The ranges that are left after a sketch and a count; ranks that are settled go to ``found``."""
    if not spans:
        return []
    v = F.col(column)
    slack = 2 / ACCURACY
    wanted = [[min(1.0, max(0.0, (r - s.below + 0.5) / s.inside + side)) for r in s.ranks for side in (-slack, slack)] for s in spans]
    sketches = rows.agg(*[F.percentile_approx(F.when(s.holds(v), v), fractions, ACCURACY).alias(f"s{k}") for k, (s, fractions) in enumerate(zip(spans, wanted, strict=True))]).first()
    pivots = sorted({x for s in sketches for x in s})
    counts = rows.agg(*[c for k, p in enumerate(pivots) for c in (F.count_if(v < F.lit(p)).alias(f"b{k}"), F.count_if(v == F.lit(p)).alias(f"e{k}"))]).first()
    out: dict[tuple, Span] = {}
    for span in spans:
        # values up to each pivot of the range, in order
        edges = [(span.low, span.below)] + [(p, counts[f"b{k}"]) for k, p in enumerate(pivots) if (span.low is None or p > span.low) and (span.high is None or p < span.high)]
        equal = {p: counts[f"e{k}"] for k, p in enumerate(pivots)}
        for rank in span.ranks:
            at = max(k for k, (_, before) in enumerate(edges) if before <= rank)
            low, before = edges[at]
            if at and rank < before + equal[low]:
                found[rank] = low
                continue
            start = before + (equal[low] if at else 0)
            high, upto = edges[at + 1] if at + 1 < len(edges) else (span.high, span.below + span.inside)
            out.setdefault((low, high), Span(low, high, start, upto - start)).ranks.append(rank)
    return list(out.values())


def quantiles(df: DataFrame, q: list[float], column: str = "v", omit_nan: bool = True) -> list[float]:
    """Linear-interpolated quantiles of all values; NaN if there are none, or with ``omit_nan`` off if any is NaN."""
    if any(not 0 <= x <= 1 for x in q):
        raise ValueError("quantiles are from 0 to 1")
    v = F.col(column)
    odd, n = df.agg(F.count_if(F.isnan(v)), F.count_if(v.isNotNull() & ~F.isnan(v))).first()
    if not n or odd and not omit_nan:
        return [math.nan] * len(q)
    places = [x * (n - 1) for x in q]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    values = select_ranks(df.where(~F.isnan(v)), ranks, column)
    out = []
    for p in places:
        a, b, t = values[math.floor(p)], values[math.ceil(p)], p - math.floor(p)
        out.append(a if a == b else a * (1 - t) + b * t)
    return out
