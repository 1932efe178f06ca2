"""Column profiles of any table, in long form (one row per column).

Missing cells, ranges, means and text lengths are taken in one pass without a shuffle.
Distinct values and repeated rows are counted by 128 bits of hashes, so no cell is shuffled as
text. Frequent values are found from bounded summaries and proven by a recount; ``value_table``
counts all values of a column only where that cannot decide. Exact medians take four passes that
shuffle counts only. A table without columns of a kind gives an empty frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketmill.functions.relational import top_per
from basketmill.operators.frequent import COLUMN, COUNTERS, ROWS, VALUE, proven

NUMERIC = T.NumericType
MOMENTS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _columns(df: DataFrame, kind: str) -> list[str]:
    def kind_of(t: T.DataType) -> str:
        if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            return "nested"
        return "numeric" if isinstance(t, NUMERIC) else "moment" if isinstance(t, MOMENTS) else "text"

    return [f.name for f in df.schema if kind in ("all", kind_of(f.dataType))]


def _unpivot(df: DataFrame, names: list[str], to: str) -> DataFrame:
    return df.select(*[F.col(c).cast(to).alias(c) for c in names]).unpivot([], names, COLUMN, VALUE)


def value_table(df: DataFrame, kind: str = "all", to: str = "string") -> DataFrame:
    """Rows per (column, value), a missing value being a value of its own."""
    long = _unpivot(df, _columns(df, kind), to)
    return long.groupBy(COLUMN, VALUE).agg(F.count(F.lit(1)).alias(ROWS))


def _plain(df: DataFrame, name: str) -> Column:
    """A column that two hashes tell apart: nested values as JSON, as hashes pass over the
    nulls inside them."""
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(F.col(name)) if nested else F.col(name)


def _mark(*parts: Column) -> Column:
    """128 bits of hashes."""
    return F.struct(*[F.xxhash64(F.lit(seed), *parts).alias(f"h{seed}") for seed in (1, 2)])


def distinct_counts(df: DataFrame) -> DataFrame:
    """Distinct values per column, missing ones left out."""
    marks = df.select(*[F.when(F.col(c).isNotNull(), _mark(_plain(df, c))).alias(c) for c in df.columns])
    long = marks.unpivot([], df.columns, COLUMN, "mark").where("mark IS NOT NULL")
    each = long.select(COLUMN, "mark.*").distinct()
    return each.groupBy(COLUMN).agg(F.count(F.lit(1)).alias("unique_count"))


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, missing cells and distinct values per column.

    ``approximate`` estimates the distinct values in the same pass instead of counting
    each column's values.
    """
    names = df.columns
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema], f"{COLUMN} string, type string"
    )
    if not names:
        return types.selectExpr("*", "0L AS null_count", "0D AS null_ratio", "0L AS unique_count")
    stats: dict[str, Callable[[Column], Column]] = {
        "null_count": lambda c: F.count_if(c.isNull()),
        "null_ratio": lambda c: F.round(F.avg(c.isNull().cast("double")), 6),
    }
    if approximate:
        stats["unique_count"] = F.approx_count_distinct
    made = types.join(_per_column(df, names, **stats), COLUMN, "left")
    if not approximate:
        made = made.join(distinct_counts(df), COLUMN, "left")
    return made.fillna(0)


SLOTS = 1 << 16
COLUMNS_AT_ONCE = 64  # whose counts a task holds


def order_keys(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; -0 is 0, and NaN is above all others."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _of_key(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _slot_counts(table: DataFrame, wanted: list[tuple[str, int]], passed: int) -> np.ndarray:
    """Of each ``(column, prefix)``, among values whose key starts with the prefix of ``passed``
    bits, how many have each value of the next 16 bits. One pass; a task adds up its rows."""
    names = sorted({c for c, _ in wanted})
    shift = np.uint64(48 - passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(wanted), SLOTS), dtype=np.int64)
        for batch in batches:
            keys = {c: order_keys(batch.column(c).drop_null().to_numpy()) for c in names}
            for i, (c, prefix) in enumerate(wanted):
                own = keys[c]
                if passed:
                    own = own[own >> np.uint64(64 - passed) == np.uint64(prefix)]
                slots = (own >> shift & np.uint64(SLOTS - 1)).astype(np.int64)
                total[i] += np.bincount(slots, minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", ROWS])

    parts = table.select(*names).mapInArrow(run, f"at bigint, {ROWS} bigint")
    found = parts.groupBy("at").agg(F.sum(ROWS).alias(ROWS)).toArrow()
    out = np.zeros(len(wanted) * SLOTS, dtype=np.int64)
    out[found.column("at").to_numpy()] = found.column(ROWS).to_numpy()
    return out.reshape(len(wanted), SLOTS)


def _medians(df: DataFrame, names: list[str]) -> DataFrame:
    """Exact medians by radix selection: four passes, each of which settles 16 more bits of the
    two middle values of every column. No value is shuffled or sorted, only counts of slots."""
    rows: list[tuple[str, float | None]] = []
    for first in range(0, len(names), COLUMNS_AT_ONCE):
        some = names[first : first + COLUMNS_AT_ONCE]
        table = df.select(*[F.col(c).cast("double").alias(c) for c in some])
        # Of each column and side (lower, upper middle): the prefix so far, and the place among
        # the values that share it.
        prefix = {(c, side): 0 for c in some for side in (0, 1)}
        place: dict[tuple[str, int], int] = {}
        for passed in range(0, 64, 16):
            wanted = sorted({(c, p) for (c, _), p in prefix.items()})
            counts = dict(zip(wanted, _slot_counts(table, wanted, passed))) if wanted else {}
            if not passed:
                sizes = {c: int(counts[c, 0].sum()) for c in some}
                prefix = {(c, side): 0 for c in some if sizes[c] for side in (0, 1)}
                place = {(c, side): (sizes[c] - 1 + side) // 2 for c, side in prefix}
            for (c, side), p in prefix.items():
                upto = counts[c, p].cumsum()
                slot = int(np.searchsorted(upto, place[c, side], side="right"))
                place[c, side] -= int(upto[slot] - counts[c, p][slot])
                prefix[c, side] = p << 16 | slot
        for c in some:
            middle = [_of_key(prefix[c, side]) for side in (0, 1) if (c, side) in prefix]
            rows.append((c, sum(middle) / 2 if middle else None))
    return df.sparkSession.createDataFrame(rows, f"{COLUMN} string, median double")


def _per_column(df: DataFrame, names: list[str], **stats) -> DataFrame:
    """``stats`` of each column, taken in one pass and then laid out by row."""
    row = df.agg(
        *[
            F.struct(F.lit(c).alias(COLUMN), *[f(F.col(c)).alias(n) for n, f in stats.items()]).alias(c)
            for c in names
        ]
    )
    return row.select(F.inline(F.array(*names)))


def numeric_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Range, mean, deviation and median; ``approximate`` estimates the median in the same
    pass, within a ten-thousandth of the rows."""
    names = _columns(df, "numeric")
    stats = {
        "min": F.min,
        "max": F.max,
        "mean": lambda c: F.round(F.avg(c), 6),
        "std": lambda c: F.round(F.stddev_samp(c), 6),
    }
    if not names:
        empty = f"{COLUMN} string, " + ", ".join(f"{n} double" for n in (*stats, "median"))
        return df.sparkSession.createDataFrame([], empty)
    table = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    if approximate:
        return _per_column(
            table, names, **stats, median=lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(10_000))
        )
    made = _per_column(table, names, **stats)
    return made.join(_medians(df, names), COLUMN, "left").withColumn("median", F.round("median", 6))


def datetime_range(df: DataFrame) -> DataFrame:
    names = _columns(df, "moment")
    if not names:
        empty = f"{COLUMN} string, min_date timestamp_ntz, max_date timestamp_ntz"
        return df.sparkSession.createDataFrame([], empty)
    table = df.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in names])
    return _per_column(table, names, min_date=F.min, max_date=F.max)


def text_summary(df: DataFrame, samples: int = 5) -> DataFrame:
    """Mean and largest length, and the smallest few values as examples."""
    names = _columns(df, "text")
    if not names:
        empty = f"{COLUMN} string, avg_length double, max_length int, sample_values string"
        return df.sparkSession.createDataFrame([], empty)
    table = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    stats = _per_column(
        table,
        names,
        avg_length=lambda c: F.round(F.avg(F.char_length(c)), 2),
        max_length=lambda c: F.max(F.char_length(c)),
    )
    # Of each column's distinct values a task passes on only the smallest few.
    distinct = _unpivot(table, names, "string").where(F.col(VALUE).isNotNull()).distinct()
    few = top_per(distinct, [COLUMN], [F.col(VALUE)], samples, "_rank")
    texts = few.groupBy(COLUMN).agg(
        F.array_join(F.sort_array(F.collect_list(VALUE)), ", ").alias("sample_values")
    )
    return stats.join(texts, COLUMN, "left").fillna(0)


def top_values(df: DataFrame, k: int = 10, counters: int = COUNTERS) -> DataFrame:
    """The most frequent values per column, missing included; ties by value. ``counters`` moves
    work between the two ways of counting only."""
    names = _columns(df, "all")
    if not names:
        return df.sparkSession.createDataFrame([], f"{COLUMN} string, {VALUE} string, {ROWS} bigint, rank int")
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    counted, left = proven(texts, k, counters)
    if left:
        counted = counted.unionByName(value_table(texts.select(*left)))
    order = [F.col(ROWS).desc(), F.col(VALUE).asc_nulls_last()]
    return top_per(counted, [COLUMN], order, k, "rank")


def table_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and rows that repeat an earlier one."""
    missing = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0))
    parts = [p for c in df.columns for p in (F.col(c).isNull(), _plain(df, c))]
    marks = df.select(_mark(*parts).alias("mark"), missing.cast("bigint").alias("_missing"))
    copies = marks.groupBy("mark.h1", "mark.h2").agg(
        F.count(F.lit(1)).alias("_copies"), F.sum("_missing").alias("_missing")
    )
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def schema_table(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, f"{COLUMN} string, type string, nullable boolean")


def type_distribution(df: DataFrame) -> DataFrame:
    return schema_table(df).groupBy("type").agg(F.count(F.lit(1)).alias("columns"))


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """Name, size, change time and rows of every Parquet file under ``path``."""
    files = spark.read.option("recursiveFileLookup", True).parquet(path)
    return files.groupBy(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).agg(F.count(F.lit(1)).alias("row_count"))


def preview(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*keys).limit(n)
