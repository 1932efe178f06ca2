"""What the operators here share: reading, Arrow passes, sorted groups, components.

Every pass sets the Arrow batch size in bytes, so that a task holds some MB of text at
a time whatever the length of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketmill.session import scratch_path, stored

__all__ = ["documents", "map_batches", "stored", "scratch_path", "sorted_groups", "components"]

BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Join batches until a block holds ``size`` bytes or more; a task holds one block."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield _one(held)
            held, total = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(held)


def code_points(data: bytes, text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Turn byte offsets in ``data``, the UTF-8 of ``text``, into code point offsets."""
    if not spans or len(data) == len(text):
        return spans
    place, at, chars = {}, 0, 0
    for offset in sorted({x for _, start, end in spans for x in (start, end)}):
        chars += len(data[at:offset].decode("utf-8", "surrogatepass"))
        place[offset], at = chars, offset
    return [(kind, place[start], place[end]) for kind, start, end in spans]


def one_row_each(df: DataFrame, keys: DataFrame, by: list[str], text: str) -> DataFrame:
    """The rows of ``df`` whose ``by`` are in ``keys``, one per key: that whose ``text`` has the
    smallest hash. ``keys`` is unique on ``by`` and of bounded size, so it is broadcast; rows that
    repeat a key are cut to one in each task, so the result is as bounded as the keys."""
    marked = df.withColumn("_mark", F.xxhash64(text)).join(F.broadcast(keys), by)
    first = marked.groupBy(*by).agg(F.min("_mark").alias("_mark"))
    return marked.join(F.broadcast(first), [*by, "_mark"], "left_semi").dropDuplicates(by).drop("_mark")


def sample_by_hash(df: DataFrame, rows: int, key: str, text: str) -> DataFrame:
    """A row for each of the ``rows`` smallest hashes of ``key``: a sample of bounded size that does
    not depend on the order of rows. Of rows that share a key the one whose ``text`` has
    the smallest hash is taken; a null key never is."""
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    keys = keys.orderBy(F.xxhash64(F.lit(7), key), key).limit(rows)
    return one_row_each(df, keys, [key], text)


def span_digest(spans: list[tuple[str, int, int]]) -> tuple[str, str]:
    """The spans as ``kind:start:end`` joined by commas, and the SHA-256 of that in hex."""
    joined = ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
    return joined, hashlib.sha256(joined.encode()).hexdigest()


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Split batches that are sorted by ``keys`` into one table per distinct key.

    Holds one group and one batch at a time, so the groups must be of bounded size.
    Keys are non-null integers.
    """
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        values = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for v in values:
            change |= v[1:] != v[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for start, end in zip(starts, starts[1:]):
            yield table.slice(start, end - start)
        carry = table.slice(starts[-1])
    if carry is not None:
        yield carry


def components(edges: DataFrame, label: str) -> DataFrame:
    """The smallest node reachable from each node of ``edges(a, b)``: ``node, component``.

    Alternates two steps until nothing changes: every node's larger neighbours are linked
    to its smallest neighbour (or itself), then every node's smaller neighbours likewise.
    Each step is a grouped minimum, which is summed up before the shuffle, and a sort-merge join
    (files of edges are many times smaller than their rows, too small an estimate for a copy),
    which adaptive execution splits when one node has most of the links. Each round is a
    stored table, so a lost executor costs one round. Nodes that occur in no edge are
    not returned.
    """
    current = stored(_linked(edges), label)
    before = _mark(current)
    while before[0]:
        current = stored(_small_star(_large_star(current)), label)
        after = _mark(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _linked(edges: DataFrame) -> DataFrame:
    """Each edge once, larger node first; loops go."""
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _linked(
        both.join(smallest.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` hold the smaller node in ``b``."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    to_smallest = edges.join(smallest.hint("merge"), "a")
    return _linked(
        to_smallest.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            smallest.select("a", F.col("m").alias("b"))
        )
    )


def _mark(edges: DataFrame) -> tuple:
    """Count and hashes of an edge set; equal marks mean that a round changed nothing."""
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            F.bit_xor(F.xxhash64("b", "a")),
        ).first()
    )
