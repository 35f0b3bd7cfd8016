"""Header tables: named columns, one row a trace."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, grid
from tracelake.functions.expr import compile_expression
from tracelake.operators.solvers import cut as cut_lineage


def sort(df: DataFrame, key: str, row: str, reverse: bool = False) -> DataFrame:
    """Stable order by a key, as the column ``position``; ties keep the order of ``row``.

    Positions come from one range-partitioned sort, written down once: the rows
    before a partition are counted, so no task holds all rows.
    """
    order = F.desc(key) if reverse else F.asc(key)
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, order, F.asc(row)).sortWithinPartitions(order, F.asc(row)).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = ranged.withColumn("_part", part).join(F.broadcast(counts), "_part")  # a row for each partition
    return placed.withColumn("position", (F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_part", "_id", "_base")


def math(df: DataFrame, expression: str, out: str) -> DataFrame:
    names = {c: F.col(c).cast("double") for c, kind in df.dtypes if kind in ("int", "bigint", "float", "double")}
    return df.withColumn(out, compile_expression(expression, names))


def attributes(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n, min, max, mean) over finite values, in one pass."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("x")) for k in keys])).alias("e")).select("e.*")
    fine = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    return stacked.where(fine).groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))


def window(c: Cube, mask: DataFrame, axis: int = 2) -> Cube:
    """Rows of an axis where ``mask(i, keep)`` holds, renumbered from the first."""
    own = c.long()
    kept = mask.where("keep").select(F.col("i").alias(f"i{axis}"))
    first = kept.agg(F.min(f"i{axis}").alias("_first"))
    df = own.df.join(kept, f"i{axis}").join(F.broadcast(first)).withColumn(f"i{axis}", F.col(f"i{axis}") - F.col("_first")).drop("_first")
    return own.derive(df.select(*own.keys, "v"))


def cut(c: Cube, mask: DataFrame, axis: int = 2) -> Cube:
    """0 where ``mask(i, cut)`` holds."""
    own = c.long()
    hit = mask.where("cut").select(F.col("i").alias(f"i{axis}"), F.lit(True).alias("_cut"))
    return own.derive(own.df.join(hit, f"i{axis}", "left").select(*own.keys, F.when(F.col("_cut"), 0.0).otherwise(F.col("v")).alias("v")))


def intbin(df: DataFrame, x: Column, y: Column, value: Column, row: Column, axes: tuple[Axis, Axis]) -> DataFrame:
    """Values on an integer grid; of several in a cell the last row stays, cells without any are 0."""
    return _on_grid(df, [x, y], value, row, axes)


def intbin3(df: DataFrame, x: Column, y: Column, z: Column, value: Column, row: Column, axes: tuple[Axis, Axis, Axis]) -> DataFrame:
    """``intbin`` on a grid of three keys."""
    return _on_grid(df, [x, y, z], value, row, axes)


def _on_grid(df: DataFrame, keys: list[Column], value: Column, row: Column, axes: tuple[Axis, ...]) -> DataFrame:
    names = [f"i{k}" for k in range(1, len(keys) + 1)]
    got = df.select(*((key - int(a.o)).cast("long").alias(name) for key, a, name in zip(keys, axes, names, strict=True)), F.struct(row.alias("r"), value.alias("v")).alias("s"))
    for name, a in zip(names, axes, strict=True):
        got = got.where((F.col(name) >= 0) & (F.col(name) < a.n))
    got = got.groupBy(*names).agg(F.max("s").alias("m"))
    return grid(df.sparkSession, axes).join(got, names, "left").select(*names, F.coalesce("m.v", F.lit(0.0)).alias("v"))


def bin_traces(c: Cube, table: DataFrame, keys: list[str], bounds: list[tuple[int | None, int | None]] | None = None) -> Cube:
    """Whole traces on a grid of two or three integer keys; of several in a cell the last one stays.

    ``table`` has one row (``trace`` and the keys) for each place of axis 2.
    A bound that is not given is the least or greatest key; traces outside are
    dropped.  Which trace wins a cell is settled on (cell, trace number) alone,
    and only winners move, once.  Cells without a trace have no row: the cube
    is sparse, and ``filled`` or a writer puts zeros there.
    """
    own = c.traces()
    if own.rank != 2:
        raise ValueError("traces along axis 2 are needed")
    if len(keys) not in (2, 3) or any(k not in table.columns for k in keys):
        raise ValueError(f"two or three keys of {table.columns} are needed")
    bounds = bounds or [(None, None)] * len(keys)
    whole = [F.floor(F.col(f"`{k}`").cast("double")) for k in keys]
    odd = [F.count_if((F.col(f"`{k}`").cast("double") != x) | F.col(f"`{k}`").isNull()) for k, x in zip(keys, whole, strict=True)]
    got = table.agg(F.count("*"), F.count_distinct("trace"), F.min("trace"), F.max("trace"), *odd, *[x for w in whole for x in (F.min(w), F.max(w))]).first()
    n, m = own.meta.shape[1], len(keys)
    if tuple(got[:4]) != (n, n, 0, n - 1):
        raise ValueError("the table's row count is not that of the traces")
    if any(got[4 : 4 + m]):
        raise ValueError("keys are integer-valued")
    ends = [(int(got[4 + m + 2 * k]) if low is None else low, int(got[5 + m + 2 * k]) if high is None else high) for k, (low, high) in enumerate(bounds)]
    for name, (low, high) in zip(keys, ends, strict=True):
        if low > high:
            raise ValueError(f"the bounds of {name} are out of order")
    cells = [f"i{k}" for k in range(2, m + 2)]
    inside = table.select(F.col("trace").alias("_trace"), *[w.cast("long").alias(k) for w, k in zip(whole, cells, strict=True)])
    for k, (low, high) in zip(cells, ends, strict=True):
        inside = inside.where(F.col(k).between(low, high)).withColumn(k, F.col(k) - low)
    winners = inside.groupBy(*cells).agg(F.max("_trace").alias("_trace"))
    df = winners.join(own.df.select(F.col("i2").alias("_trace"), "samples"), "_trace").select(*cells, "samples")
    axes = [Axis(high - low + 1, float(low), 1.0, k) for k, (low, high) in zip(keys, ends, strict=True)]
    return Cube(df, replace(own.meta, axes=(own.meta.axes[0], *axes)), "trace")


def filled(c: Cube) -> Cube:
    """A sparse cube of traces with zero traces where it has none."""
    own = c.traces()
    rest = own.meta.axes[1:]
    places = grid(own.df.sparkSession, rest).withColumnsRenamed({f"i{k}": f"_i{k}" for k in range(1, len(rest) + 1)}).withColumnsRenamed({f"_i{k}": f"i{k + 1}" for k in range(1, len(rest) + 1)})
    zeros = F.array_repeat(F.lit(0.0), own.meta.axes[0].n)
    return own.derive(places.join(own.df, own.keys[1:], "left").select(*own.keys[1:], F.coalesce("samples", zeros).alias("samples")))
