"""Profiles of a growing folder: facts are kept per file, so only new files are read.

A file is known by its path, size and time of change; a file that changed is read again, and
facts of files that are gone no longer count. Facts of a file and column are counts, ranges,
moments and a sketch of its values, all of which add up over files. Distinct values are
estimated from the sketches: the standard error is 1.04 / sqrt(2 ** bits), 1.6 % with the
default of 12 bits; everything else is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketmill.operators.profile import COLUMN, MOMENTS, NUMERIC
from basketmill.sources.tables import path_exists

FILE = ["file_path", "file_size", "modified"]
BITS = 12
NESTED = (T.ArrayType, T.MapType, T.StructType)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        *files.columns,
    )


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The files that hold rows; reads their footers only."""
    return _named(_files(spark, path)).select(*FILE).distinct()


def _facts(field: T.StructField, bits: int) -> Column:
    """What is kept of one column of one file."""
    own, kind = F.col(f"`{field.name}`"), field.dataType
    nothing = F.lit(None)
    number = own.cast("double") if isinstance(kind, NUMERIC) else nothing.cast("double")
    moment = own.cast("timestamp_ntz") if isinstance(kind, MOMENTS) else nothing.cast("timestamp_ntz")
    plain = not isinstance(kind, (NUMERIC, *MOMENTS, *NESTED))
    length = F.char_length(own.cast("string")) if plain else nothing.cast("int")
    text = F.to_json(own) if isinstance(kind, NESTED) else own.cast("string")
    # Zero has two signs, which texts tell apart.
    value = own.cast("bigint") if isinstance(kind, T.IntegralType) else (number + 0.0).cast("string") if isinstance(kind, T.FractionalType) else text
    return F.struct(
        F.lit(field.name).alias(COLUMN),
        F.lit(kind.simpleString()).alias("type"),
        F.count(own).alias("present"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.sum(number).alias("total"),
        (F.var_pop(number) * F.count(number)).alias("squares"),
        F.min(moment).alias("min_date"),
        F.max(moment).alias("max_date"),
        F.sum(length).alias("length_sum"),
        F.max(length).alias("max_length"),
        F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"),
    )


def refresh(spark: SparkSession, path: str, book: str, bits: int = BITS) -> int:
    """Add the facts of files under ``path`` that ``book`` does not know; how many were read.

    Facts are appended in one commit, so a run that dies adds none; two runs at once may add a
    file twice, which ``kept_profile`` counts once.
    """
    new = _listed(spark, path)
    if path_exists(spark, book):
        new = new.join(spark.read.parquet(book).select(*FILE).distinct(), FILE, "left_anti")
    names = [r.file_path for r in new.select("file_path").collect()]
    if not names:
        return 0
    files = _files(spark, path)
    rows = _named(files).where(F.col("file_path").isin(names))
    facts = rows.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("rows"), F.array(*[_facts(f, bits) for f in files.schema]).alias("facts")
    )
    facts.select(*FILE, "rows", F.inline("facts")).write.mode("append").parquet(book)
    return len(names)


def kept_profile(spark: SparkSession, path: str, book: str) -> DataFrame:
    """One row per column over the files that ``path`` holds now and ``book`` knows. A column
    that a file lacks is missing in all its rows."""
    kept = spark.read.parquet(book).join(_listed(spark, path), FILE, "left_semi").dropDuplicates([*FILE, COLUMN])
    total = kept.select(*FILE, "rows").distinct().agg(F.sum("rows").alias("row_count"))
    numbers = kept.where("total IS NOT NULL")
    centre = numbers.groupBy(COLUMN).agg((F.sum("total") / F.sum("present")).alias("centre"))
    off = F.col("total") / F.col("present") - F.col("centre")
    spread = F.sum(F.col("squares") + F.col("present") * off * off)
    moments = numbers.join(centre, COLUMN).groupBy(COLUMN, "centre").agg(
        F.when(F.sum("present") > 1, F.sqrt(spread / (F.sum("present") - 1))).alias("std")
    )
    made = kept.groupBy(COLUMN).agg(
        F.max("type").alias("type"),
        F.sum("present").alias("present"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_count"),
        *[f(c).alias(c) for c, f in (("min", F.min), ("max", F.max), ("min_date", F.min), ("max_date", F.max), ("max_length", F.max))],
        (F.sum("length_sum") / F.sum("present")).alias("avg_length"),
    )
    rows = total.scalar()
    return made.join(moments, COLUMN, "left").select(
        COLUMN,
        "type",
        rows.alias("row_count"),
        (rows - F.col("present")).alias("null_count"),
        F.round((rows - F.col("present")) / rows, 6).alias("null_ratio"),
        "unique_count",
        "min",
        "max",
        F.round("centre", 6).alias("mean"),
        F.round("std", 6).alias("std"),
        "min_date",
        "max_date",
        F.round("avg_length", 2).alias("avg_length"),
        "max_length",
    )
