"""Tables and files written to the folder that all executors share.

``spark.checkpoint.dir`` names that folder.  Where the setting is absent (a
local session, as in tests) a fresh folder under the machine's temp folder is
used, which is only right because driver and executors are then one process.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, as a URI."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = id(spark.sparkContext)
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    return _LOCAL[key]


#: Rows of an Arrow batch, where the session has Spark's default of 10,000: texts take a few kilobytes each.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of texts that go to Python, for the session; a setting other than the default stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Have the files of a write's exchanges deleted when it is done, where Spark can; else they stay until the driver collects garbage."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)


class Scratch:
    """Intermediate tables of one operator call, under one folder."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it reread: lineage ends here."""
        path = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        with _cleaned(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *unneeded: DataFrame) -> None:
        """Delete tables that are no longer read."""
        self._delete(lambda df: any(df is x for x in unneeded))

    def clear(self, keep: list[DataFrame]) -> None:
        """Delete all tables but those that are still to be read."""
        self._delete(lambda df: not any(df is x for x in keep))

    def _delete(self, chosen: Callable[[DataFrame], bool]) -> None:
        context = self.spark.sparkContext
        for df, path in [t for t in self.tables if chosen(t[0])]:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
            self.tables = [t for t in self.tables if t[0] is not df]


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    """Partitions for an explicit exchange: what the session asks for."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
