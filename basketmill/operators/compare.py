"""Row comparison of two tables, by position and regardless of order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "row_index"


def with_row_index(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows numbered in file order, files taken by name."""
    rows = spark.read.parquet(path).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_place"),
    )
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_rows"))  # one row per file
        .select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    return rows.join(starts, "_file").withColumn(INDEX, F.col("_start") + F.col("_place")).drop(
        "_file", "_place", "_start"
    )


def _side_by_side(left: DataFrame, right: DataFrame, index: str, columns: list[str]) -> DataFrame:
    sides = [
        df.select(F.col(index).alias(INDEX), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        for side, df in (("left", left), ("right", right))
    ]
    return sides[0].join(sides[1], INDEX, "full")


def _same(columns: list[str]) -> Column:
    """True, false, or null where a missing value leaves it open."""
    return reduce(
        lambda a, b: a & b, [F.col(f"left_{c}") == F.col(f"right_{c}") for c in columns]
    )


def positional_summary(
    left: DataFrame, right: DataFrame, index: str, columns: list[str]
) -> DataFrame:
    """Rows compared, equal and different; a missing value on a side is a difference."""
    both = _side_by_side(left, right, index, columns)
    matched = F.count_if(F.coalesce(_same(columns), F.lit(False)))
    return both.agg(
        F.count(F.lit(1)).alias("total_rows"),
        matched.alias("matched_rows"),
        (F.count(F.lit(1)) - matched).alias("different_rows"),
    )


def positional_sample(
    left: DataFrame, right: DataFrame, index: str, columns: list[str], n: int = 10
) -> DataFrame:
    """The first differing rows with both sides, those left open by a null omitted."""
    both = _side_by_side(left, right, index, columns)
    return both.where(~_same(columns)).orderBy(INDEX).limit(n)


def multiset_diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows found in both tables, only left and only right, copies counted."""
    sides = [
        df.select(*columns, F.lit(in_left).alias("_left"), F.lit(1 - in_left).alias("_right"))
        for df, in_left in ((left, 1), (right, 0))
    ]
    counts = (
        sides[0]
        .unionByName(sides[1])
        .groupBy(*columns)
        .agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))
    )
    shared = F.least("_left", "_right")
    return counts.agg(
        F.coalesce(F.sum("_left"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("_right"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(shared), F.lit(0)).alias("matched_rows"),
        F.coalesce(F.sum(F.col("_left") - shared), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.col("_right") - shared), F.lit(0)).alias("only_right"),
    )
