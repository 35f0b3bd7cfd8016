"""Connected components of a distributed edge table.

Each round every task turns its own edges into stars (union-find over a bounded
number of edges), and alternating large-star and small-star steps join the
stars of different tasks: every step replaces each edge by one to the smallest
neighbour, so edges never multiply.  Once all edges are in one task, its stars
are the components.  Minima are aggregated map-side; each round is written to
the shared folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.scratch import Scratch

#: Rounds after which something is wrong: the number needed grows with the logarithm of the largest component's diameter.
MAX_ROUNDS = 60
#: Edges of a task.
TASK_EDGES = 250_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node but the smallest to the smallest one, for each component of up to TASK_EDGES edges at a time."""
    held: list[np.ndarray] = []

    def settle() -> pa.RecordBatch:
        edges = np.concatenate(held, axis=1)
        nodes, at = np.unique(edges, return_inverse=True)
        least = nodes[forest(len(nodes), *at.reshape(2, -1))]
        far = least < nodes
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(least[far])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.array([np.asarray(batch.column(k)) for k in (0, 1)]))
        if sum(h.shape[1] for h in held) >= 2 * TASK_EDGES:
            yield settle()
    if held:
        yield settle()


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = scratch.table(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges(a, b)``.

    Loops and repeated edges do no harm; an empty table gives an empty table.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        got = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum("b")).first()
        tasks = 1 + got[0] // TASK_EDGES
        stars = now.coalesce(tasks).mapInArrow(_stars, "a long, b long")
        if tasks == 1:
            now = scratch.table(stars, "stars")
        if tasks == 1 or got == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen, before = got, now
        now = scratch.table(_star(scratch.table(_star(scratch.table(stars, "stars"), scratch, True), "large"), scratch, False), "small")
        scratch.drop(before)
    raise RuntimeError("connected components did not settle")
