"""Embedding near-dedup: cosine links within a label, by PCA-ordered tiles.

Vectors are scaled to length 1 and turned into the basis of their principal
components.  The first component alone bounds the cosine (two unit vectors with
cosine t differ by at most sqrt(2 - 2t) in every component), so each label is
cut into slabs of that width and only the same and the next slab are compared.
Slabs are cut further into tiles of bounded size; a task compares two tiles.
It accumulates products over leading components in stages; after each stage a
pair goes on only if its sum so far plus the product of the two suffix norms
still reaches the threshold.  Survivors are settled by the cosine of the vectors
as given, in double precision.

Identical vectors of a label are compared once and counted as often as they
occur.  A task returns counts for each vector and a forest of its links, never
the pairs, so a large group of near copies gives no more rows than vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.components import components, forest
from tracelake.llm.scratch import Scratch, partitions_for

#: Vectors of a tile; rows that the principal components are fitted on (any basis gives right results, a fitted one is fast).
TILE, FIT_ROWS = 1024, 4096
#: Components after which pairs are tested.
STAGES = (8, 24)
#: Turned vectors travel as single floats; the last test takes the vectors as given.
SLACK = 1e-5


def fit_basis(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal basis (columns), principal components first."""
    centred = vectors - vectors.mean(axis=0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1]


def linked_pairs(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows whose cosine is ``threshold`` or more; i < j where both tiles are the same."""
    suffix = lambda m, k: np.sqrt((m[:, k:] ** 2).sum(axis=1))
    k = STAGES[0]
    reach = x[:, :k] @ y[:, :k].T
    i, j = np.nonzero(reach + suffix(x, k)[:, None] * suffix(y, k)[None, :] >= threshold - SLACK)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    sums = reach[i, j]
    for a, b in zip(STAGES, [*STAGES[1:], x.shape[1]], strict=True):
        if a >= x.shape[1]:
            break
        sums = sums + np.einsum("ij,ij->i", x[i, a:b], y[j, a:b])
        keep = sums + suffix(x, b)[i] * suffix(y, b)[j] >= threshold - SLACK
        i, j, sums = i[keep], j[keep], sums[keep]
    norm = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
    exact = np.einsum("ij,ij->i", raw_x[i], raw_y[j]) / (norm(raw_x)[i] * norm(raw_y)[j])
    keep = exact >= threshold
    return i[keep], j[keep]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Only rows with equal, non-null labels and equally long vectors are compared.
    A vector that is null, empty, zero, or holds a null or non-finite component
    links with nothing, as does a row with a null label; such a row is its own
    component.  Rows with equal vectors link with each other.  A null id links
    as any other, but never names a component; one of null ids only has the name
    null, and its rows are all kept.  Rows that repeat an id are vectors of
    their own, each with its own links and component.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed")
    parts = partitions_for(spark)
    v = F.transform(vector, lambda x: x.cast("double"))
    element = "float" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    fine = F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    every = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    # -0.0 and 0.0 are the same component
    every = every.withColumn("same", F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256)))
    rows = scratch.table(every.select("vec_id", "label", "same", "fine"), "rows")
    heads = every.where("fine").groupBy("label", "same").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies"), F.first("v").cast(f"array<{element}>").alias("v"))
    heads = scratch.table(heads.withColumn("head", F.monotonically_increasing_id()), "heads")

    lengths = [r[0] for r in heads.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(64).collect()]
    bases = {}
    for d in lengths:  # a table of vectors has one length; others are compared in their own basis
        rows_d = heads.where(F.size("v") == d).orderBy("same").limit(FIT_ROWS).select("v").toPandas()["v"]
        sample = np.array([np.asarray(x, np.float64) for x in rows_d])
        sample = sample / np.abs(sample).max(axis=1, keepdims=True)  # keeps squares of very large or small components in range
        bases[d] = fit_basis(sample / np.sqrt((sample**2).sum(axis=1, keepdims=True)))
    slab_width = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-6

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            sizes = np.asarray(column.value_lengths())
            for d in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == d))) if len(column) != (sizes == d).sum() else batch
                x = _matrix(own.column(own.schema.get_field_index("v")), d)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # as in the sample
                y = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
                y = y @ bases[d] if d in bases else y
                ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * d)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.floor(y[:, 0] / slab_width).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(y.astype(np.float32).reshape(-1)))], names=[*own.schema.names, "slab", "y"])

    kind = vectors.schema[label].dataType.simpleString()
    kept = f"label {kind}, head long, copies long, v array<{element}>"
    placed = scratch.table(heads.select("label", "head", "copies", "v").mapInArrow(turn, f"{kept}, slab int, y array<float>").withColumn("d", F.size("v")), "placed")
    sizes = placed.groupBy("label", "d", "slab").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = scratch.table(sizes, "sizes")
    near = lambda k, name: sizes.select(F.col("label").alias("l"), F.col("d").alias("dd"), (F.col("slab") + k).alias("s"), F.col("tiles").alias(name))
    own = sizes.withColumnsRenamed({"label": "l", "d": "dd", "slab": "s"})
    own = own.join(near(-1, "after"), ["l", "dd", "s"], "left").join(near(1, "before"), ["l", "dd", "s"], "left").na.fill(0, ["after", "before"])
    own = scratch.table(own, "tiles")
    tiled = placed.join(own, (F.col("label") == F.col("l")) & (F.col("d") == F.col("dd")) & (F.col("slab") == F.col("s")))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("head"), F.col("tiles")).cast("int"))
    pair = lambda s, a, b, side, across: F.struct(s.alias("s"), a.alias("a"), b.alias("b"), F.lit(side).alias("side"), F.lit(across).alias("across"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    t, s = F.col("tile"), F.col("slab")
    jobs = F.concat(
        F.transform(upto("tiles"), lambda k: F.when(k >= t, pair(s, t, k, 0, 0)).otherwise(pair(s, k, t, 1, 0))),
        F.transform(upto("after"), lambda k: pair(s, t, k, 0, 1)),
        F.transform(upto("before"), lambda k: pair(s - 1, k, t, 1, 1)),
    )
    tasks = tiled.select("label", "head", "copies", "v", "y", "d", F.explode(jobs).alias("job")).select("label", "head", "copies", "v", "y", "d", "job.*")

    def compare(group: pa.Table) -> pa.Table:
        d = group.column("d")[0].as_py()
        side = np.asarray(group.column("side"))
        head = np.asarray(group.column("head"))
        copies = np.asarray(group.column("copies"))
        y, v = _matrix(group.column("y").combine_chunks(), d), _matrix(group.column("v").combine_chunks(), d)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        same = group.column("across")[0].as_py() == 0 and group.column("a")[0].as_py() == group.column("b")[0].as_py()
        one = np.arange(len(side)) if same else np.flatnonzero(side == 0)
        two = one if same else np.flatnonzero(side == 1)
        links = np.zeros(len(side), np.int64)
        label = np.arange(len(side))
        if len(one) and len(two):
            i, j = linked_pairs(y[one], y[two], v[one], v[two], threshold, same)
            i, j = one[i], two[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = forest(len(side), i, j)
        keep = np.flatnonzero(links)
        return pa.table({"head": pa.array(head[keep]), "other": pa.array(head[label[keep]]), "links": pa.array(links[keep])})

    got = scratch.table(tasks.repartition(parts, "label", "d", "s", "a", "b", "across").groupBy("label", "d", "s", "a", "b", "across").applyInArrow(compare, "head long, other long, links long"), "links")
    counts = got.groupBy("head").agg(F.sum("links").alias("links")).withColumnRenamed("head", "h")
    groups = components(got.select(F.col("head").alias("a"), F.col("other").alias("b")), scratch).withColumnRenamed("node", "g")
    named = heads.select("label", "same", "head", "name", "copies").join(counts, F.col("head") == F.col("h"), "left").join(groups, F.col("head") == F.col("g"), "left")
    named = scratch.table(named.select("label", "same", "name", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "head").alias("component")), "named")
    names = named.groupBy(F.col("component").alias("c")).agg(F.min("name").alias("component_id"))
    named = named.join(names, F.col("component") == F.col("c")).select(F.col("label").alias("l"), F.col("same").alias("sm"), "n_links", "component_id")
    out = rows.join(named, (F.col("label") == F.col("l")) & (F.col("same") == F.col("sm")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = scratch.table(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull() & F.col("component_id").isNull())), "found")
    scratch.clear(keep=[out])
    return out
