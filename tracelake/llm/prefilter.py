"""A bounded bitmap of keys, to keep rows out of a shuffle that surely have no partner.

The bitmap has at most ``MOST_BITS`` bits, so broadcasting it has a fixed size
bound (words of 64 bits as rows).  When it is too small for the keys it lets
more rows through and the join after it stays exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 14, 1 << 25


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as columns of ``df`` have them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def bitmap(keys: DataFrame, key: str, n: int, mixed: bool = False) -> tuple[DataFrame, int]:
    """(words, bits) for ``n`` keys; about 16 bits a key while the bound allows.  ``mixed``: keys are hashes already."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * n):
        bits *= 2
    at = F.pmod(F.col(key), F.lit(bits)) if mixed else _place(F.col(key), bits)
    words = keys.select(F.shiftright(at, 6).alias("_w"), F.expr("1L").alias("_one"), (at % 64).cast("int").alias("_b"))
    return words.groupBy("_w").agg(F.bit_or(F.expr("shiftleft(_one, _b)")).alias("_bits")), bits


def split(rows: DataFrame, key: str, words: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the keys, rows whose key is surely not)."""
    at, word, mask = unused(rows, "at", "word", "mask")
    seen = rows.withColumn(at, _place(F.col(key), bits)).join(F.broadcast(words.toDF(word, mask)), F.shiftright(at, 6) == F.col(word), "left")  # at most MOST_BITS / 64 rows
    hit = F.coalesce(F.expr(f"shiftright({mask}, cast({at} % 64 as int)) & 1L"), F.lit(0)) == 1
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return seen.where(hit).select(*columns), seen.where(~hit).select(*columns)


def collected(words: DataFrame, bits: int) -> np.ndarray:
    """The bitmap as an array of words, MOST_BITS bits at most."""
    out = np.zeros(bits // 64, np.int64)
    found = words.toPandas()
    out[found["_w"].to_numpy(np.int64)] = found["_bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def among(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each mixed 64-bit key may be among those of a collected bitmap."""
    at = keys & np.uint64(64 * len(words) - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))
