"""Text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a batch are worked on in groups of about this many bytes of text.
CHUNK_BYTES = 8 << 20

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def crc_fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def text_keys(text: str) -> list[Column]:
    """Columns t1 and t2: 128 bits that stand for a text (null as empty)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2")]


def fold_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text after lower-casing A-Z."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``size`` bytes of text and lists (a single longer row stays whole)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        for other in batch.columns:
            if pa.types.is_list(other.type):
                sizes = sizes + 8 * np.array(pa.compute.fill_null(pa.compute.list_value_length(other), 0), dtype=np.int64)
        bins = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def extended(schema: StructType, more: str) -> StructType:
    """A schema with the fields of a DDL string after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])
