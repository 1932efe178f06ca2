"""Session settings, and tables written once and read many times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_scratch: list[tempfile.TemporaryDirectory] = []
_scope: ContextVar[str | None] = ContextVar("run scope", default=None)

# Of input files, which are packed: a task gets several times as much in a shuffle.
PARTITION_BYTES = 2 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_MERGED, _MERGED_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"
_OURS = "basketmill.initialPartitionNum"
_given: set[str | None] = {None}  # numbers of partitions that came from here, or from nobody
# Rows in memory are many times larger than their files: 13 times for bins, 100 for candidates with flags.
# A table sized by its files alone would be copied to the driver when it is far too large for that.
_UNPACKED, _UNPACKED_TIMES = "spark.sql.sources.fileCompressionFactor", "16.0"


def _is_local(spark: SparkSession) -> bool:
    """One process with all its executors; a session that names no master is not."""
    master = spark.conf.get("spark.master", None) or ""
    return master == "local" or master.startswith("local[")


def tune(spark: SparkSession, *tables: DataFrame) -> SparkSession:
    """Runtime settings the plans here are written for; none changes a result.

    With ``tables``, the inputs of a run, shuffles start from as many partitions as
    their estimated bytes ask for, before adaptive execution merges small ones. A number
    that the user set is left as it is.
    """
    set_conf = spark.conf.set
    set_conf("spark.sql.session.timeZone", "UTC")
    set_conf("spark.sql.adaptive.enabled", "true")
    # Hot keys: the join splits their partitions, also where that costs a later shuffle.
    set_conf("spark.sql.adaptive.skewJoin.enabled", "true")
    set_conf("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Small results keep some parallelism: their rows are wide to compute.
    set_conf("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    # Up to this size small ones are merged: sums of many keys fit a task's memory. A user's stays.
    if spark.conf.get(_MERGED, None) is None:
        set_conf(_MERGED, _MERGED_BYTES)
    # What a shuffle measured decides on a copy of a larger table. A user's number stays.
    if spark.conf.get(_UNPACKED, None) is None:
        set_conf(_UNPACKED, _UNPACKED_TIMES)
    # Rows partitioned by customer serve joins on (customer, item) and
    # (customer, category) too, so a wide table is shuffled once, not per key.
    set_conf("spark.sql.requireAllClusterKeysForCoPartition", "false")
    if tables and spark.conf.get(_INITIAL, None) in {spark.conf.get(_OURS, None), *_given}:
        number = str(max(spark.sparkContext.defaultParallelism, _bytes(*tables) // PARTITION_BYTES))
        set_conf(_INITIAL, number)
        set_conf(_OURS, number)
        _given.add(number)
    return spark


def _bytes(*tables: DataFrame) -> int:
    """The optimizer's estimate of the size of the tables, in bytes; of files as they are packed."""
    unpacked = float(tables[0].sparkSession.conf.get(_UNPACKED))

    def size(table: DataFrame) -> int:
        estimate = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return int(estimate / unpacked) if table.inputFiles() else estimate

    return sum(map(size, tables))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _local_scratch:
        _local_scratch.append(tempfile.TemporaryDirectory(prefix="basketmill-"))
    return _local_scratch[0].name


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_scope.get() or scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables stored inside, deleted when the scope closes.

    Frames that read stored tables are lazy: write or collect them inside.
    """
    path = f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _scope.set(path)
    try:
        yield path
    finally:
        _scope.reset(token)
        _delete(spark, path)


def stored(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, parted ``by`` columns, and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, lets every
    later reader prune columns, and gives the optimizer the true size.
    """
    return Stored(df, label, by).df


class Stored:
    """A stored table that can be given up before its scope closes."""

    def __init__(self, df: DataFrame, label: str, by: tuple[str, ...] = ()):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        df.write.partitionBy(*by).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def discard(self) -> None:
        _delete(self.spark, self.path)
