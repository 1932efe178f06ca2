"""The most frequent values of every column, exactly, without counting every cell's value.

Each task keeps at most ``counters`` counts per column: when there are more, the next largest count
is taken off all of them, and those that reach zero go. What was taken off in all is the ``cut``
of the column, so a value's true count is at most its summed count plus the cut. Summed over tasks,
this leaves a few candidates per column and a bound for everything else. A second pass counts the
candidates exactly. Where the k-th of them is above the bound the list is proven; the other
columns (ids, say, whose values are all alike in frequency) are counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmill.functions.relational import top_per

COLUMN, VALUE, ROWS = "column_name", "value", "n"
COUNTERS = 1024
SHORT = 64  # bytes of a value that is its own key
HEAD = 40


def _key(value: Column) -> Column:
    """Short values as they are; of a long one its head and a digest, which is longer than
    any short value."""
    digest = F.concat(F.left(value, F.lit(HEAD)), F.lit("#"), F.md5(value))
    return F.when(F.octet_length(value) <= SHORT, value).otherwise(digest)


class Summary:
    """At most ``counters`` counts of the values of one column, and how much they may miss."""

    def __init__(self, counters: int):
        self.counters, self.cut = counters, 0
        self.held: list[pa.Table] = []
        self.entries = 0

    def add(self, values: pa.Array) -> None:
        counted = values.value_counts()
        self.held.append(pa.table({VALUE: counted.field("values"), ROWS: counted.field("counts")}))
        self.entries += len(counted)
        if self.entries > 8 * self.counters:
            self.shrink()

    def shrink(self) -> pa.Table:
        merged = pa.concat_tables(self.held).group_by(VALUE).aggregate([(ROWS, "sum")])
        values, counts = merged.column(VALUE), merged.column(f"{ROWS}_sum").to_numpy()
        if len(counts) > self.counters:
            place = len(counts) - self.counters - 1
            off = int(np.partition(counts, place)[place])
            self.cut += off
            counts = counts - off
        kept = counts > 0
        table = pa.table({VALUE: values.filter(pa.array(kept)), ROWS: pa.array(counts[kept], pa.int64())})
        self.held, self.entries = [table], len(table)
        return table


@dataclass(frozen=True)
class Bounds:
    """Of a column: candidates with counts (largest first), and what no other value exceeds."""

    candidates: list[tuple[str | None, int]]
    cut: int
    others: int

    def hopeless(self, k: int) -> bool:
        """Whether a recount cannot put the k-th candidate above the other values."""
        kth = self.candidates[k - 1][1] if len(self.candidates) >= k else 0
        return self.others > 0 and kth + self.cut <= self.others


def _summed(keys: DataFrame, names: list[str], counters: int) -> dict[str, Bounds]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = {name: Summary(counters) for name in names}
        for batch in batches:
            for name, summary in summaries.items():
                summary.add(batch.column(name))
        for name, summary in summaries.items():
            if not summary.held:
                continue
            table = summary.shrink()
            cut = pa.table({VALUE: pa.nulls(1, table.schema.field(VALUE).type), ROWS: pa.array([summary.cut], pa.int64())})
            for part, is_cut in ((table, False), (cut, True)):
                part = part.append_column("is_cut", pa.array([is_cut] * len(part), pa.bool_()))
                part = part.append_column(COLUMN, pa.array([name] * len(part), pa.string()))
                yield from part.to_batches()

    parts = keys.mapInArrow(run, f"{VALUE} string, {ROWS} bigint, is_cut boolean, {COLUMN} string")
    merged = parts.groupBy(COLUMN, "is_cut", VALUE).agg(F.sum(ROWS).alias(ROWS))
    order = [F.col(ROWS).desc(), F.col(VALUE).asc_nulls_last()]
    # At most counters + 2 rows a column come to the driver.
    found = top_per(merged, [COLUMN, "is_cut"], order, counters + 1, "_rank").collect()
    out = {}
    for name in names:
        rows = sorted((r for r in found if r[COLUMN] == name and not r.is_cut), key=lambda r: r["_rank"])
        cut = sum(r[ROWS] for r in found if r[COLUMN] == name and r.is_cut)
        counts = [(r[VALUE], r[ROWS]) for r in rows]
        more = counts[counters][1] if len(counts) > counters else 0
        out[name] = Bounds(counts[:counters], cut, cut + more)
    return out


def _matching(long: DataFrame, wanted: list[tuple[str, str | None]]) -> DataFrame:
    """Rows of ``long`` with the wanted (column, key). There are no more than the counters of
    each column, each key of bounded length, so they are broadcast."""
    marks = long.sparkSession.createDataFrame(wanted, "_column string, _key string")
    same = (F.col(COLUMN) == F.col("_column")) & F.col("key").eqNullSafe(F.col("_key"))
    return long.join(F.broadcast(marks), same).drop("_column", "_key")


def _recounted(keys: DataFrame, bounds: dict[str, Bounds]) -> dict[str, list[tuple[str | None, int]]]:
    """The candidates of some columns with their exact counts."""
    if not bounds:
        return {}
    long = keys.select(*bounds).unpivot([], list(bounds), COLUMN, "key")
    wanted = [(name, key) for name, b in bounds.items() for key, _ in b.candidates]
    found = _matching(long, wanted).groupBy(COLUMN, "key").agg(F.count(F.lit(1)).alias(ROWS)).collect()
    out: dict[str, list[tuple[str | None, int]]] = {name: [] for name in bounds}
    for r in found:
        out[r[COLUMN]].append((r.key, r[ROWS]))
    return out


def proven(texts: DataFrame, k: int, counters: int = COUNTERS) -> tuple[DataFrame, list[str]]:
    """``column_name, value, n`` of the columns of ``texts`` (all strings) whose ``k`` most frequent
    values two passes could prove, ties with the k-th included; and the names of the others."""
    names = texts.columns
    keys = texts.select(*[_key(F.col(c)).alias(c) for c in names])
    bounds = _summed(keys, names, counters)
    # Without a cut and without further values the counts are exact as they are.
    exact = {name: b.candidates for name, b in bounds.items() if not b.others}
    exact |= _recounted(keys, {name: b for name, b in bounds.items() if b.others and not b.hopeless(k)})
    rows, left = [], []
    for name in names:
        counts = sorted((n for _, n in exact.get(name, [])), reverse=True)
        kth = counts[k - 1] if len(counts) >= k else 0
        if name not in exact or kth <= bounds[name].others and bounds[name].others:
            left.append(name)
        else:
            rows += [(name, key, n) for key, n in exact[name] if n >= kth]
    spark = texts.sparkSession
    made = spark.createDataFrame(rows, f"{COLUMN} string, key string, {ROWS} bigint")
    digests = [(name, key) for name, key, _ in rows if key is not None and len(key.encode()) > SHORT]
    if not digests:
        return made.withColumnRenamed("key", VALUE), left
    some = sorted({name for name, _ in digests})
    long = texts.select(*some).unpivot([], some, COLUMN, VALUE).where(F.octet_length(VALUE) > SHORT)
    originals = _matching(long.withColumn("key", _key(F.col(VALUE))), digests).dropDuplicates([COLUMN, "key"])
    whole = made.join(originals, [COLUMN, "key"], "left")
    return whole.select(COLUMN, F.coalesce(VALUE, "key").alias(VALUE), ROWS), left
