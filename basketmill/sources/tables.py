"""Readers: the purchase log, the item catalogue, ground truth and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketmill.columns import (
    ATTRIBUTES,
    CATALOG_FACTS,
    CATALOG_PRICE,
    DESC_LEN,
    ITEM,
    PRICE,
    SALE_STATUS,
    TRANSACTION_TYPES,
    USER,
)
from basketmill.functions.relational import top_per
from basketmill.session import stored

LISTS_JSON = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def _typed(df: DataFrame, name: str, wanted: T.DataType) -> Column:
    # A cast hides the column from the Parquet filter, so cast only if needed.
    column = F.col(name)
    return column if df.schema[name].dataType == wanted else column.cast(wanted).alias(name)


def as_transactions(raw: DataFrame) -> DataFrame:
    """The eight typed columns of the log, without rows lacking user or item."""
    return raw.select(*[_typed(raw, n, t) for n, t in TRANSACTION_TYPES.items()]).where(
        F.col(USER).isNotNull() & F.col(ITEM).isNotNull()
    )


def transactions(spark: SparkSession, path: str) -> DataFrame:
    return as_transactions(spark.read.parquet(path))


def as_items(raw: DataFrame) -> DataFrame:
    """The typed catalogue, one row per item: the smallest by all other columns."""
    typed = raw.select(
        F.col(ITEM).cast("string").alias(ITEM),
        F.col(PRICE).cast("double").alias(CATALOG_PRICE),
        *[F.col(c).cast("string").alias(c) for c in ATTRIBUTES],
        F.col("sale_status").cast("tinyint").alias(SALE_STATUS),
        F.char_length(F.col("description").cast("string")).alias(DESC_LEN),
    )
    order = [F.col(c).asc_nulls_last() for c in (CATALOG_PRICE, *ATTRIBUTES, SALE_STATUS, DESC_LEN)]
    return top_per(typed, [ITEM], order, 1, "_copy").select(ITEM, *CATALOG_FACTS, *ATTRIBUTES)


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except Exception as error:  # AnalysisException in both classic and connect sessions
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def items(spark: SparkSession, path: str) -> DataFrame | None:
    """The catalogue, or ``None`` where there is none: everything runs without it."""
    return as_items(spark.read.parquet(path)) if path_exists(spark, path) else None


def _rejoined(spark: SparkSession, path: str) -> DataFrame:
    """The text before each bracket that closes a list, whatever split of the file it lies in.

    A piece ends inside a string if an odd number of quotes precedes its end. Quotes are summed
    inside each split as if it began outside of strings; then one row per split tells whether
    it did, and how many lists end before it. Pieces that neither start nor end inside a string
    are whole entries; only the others are brought together, by the number of their entry.
    """
    split = Window.partitionBy("file", "start").orderBy("at")
    unescaped = F.regexp_replace("value", r"(?s)\\.", "")
    read = spark.read.text(path, lineSep="]").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        (F.regexp_count(unescaped, F.lit('"')) % 2).alias("turns"),
    )
    inside = read.withColumn("inside", F.sum("turns").over(split) % 2)
    earlier = split.rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored(
        inside.withColumn("rank", F.row_number().over(split) - 1).withColumn(
            "ended", F.coalesce(F.sum(1 - F.col("inside")).over(earlier), F.lit(0))
        ),
        "json-pieces",
    )
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        pieces.groupBy("file", "start")
        .agg(F.sum("turns").alias("turns"), F.count_if(F.col("inside") == 0).alias("ends"), F.count_if(F.col("inside") == 1).alias("others"))
        .withColumn("began", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
        .withColumn("ends", F.when(F.col("began") == 0, F.col("ends")).otherwise(F.col("others")))
        .withColumn("entries", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .select("file", "start", "began", "entries")
    )
    ended = F.when(F.col("began") == 0, F.col("ended")).otherwise(F.col("rank") - F.col("ended"))
    placed = (
        pieces.join(splits, ["file", "start"])
        .withColumn("after", (F.col("inside") + F.col("began")) % 2)
        .withColumn("whole", (F.col("after") == 0) & (F.col("turns") == 0))
        .withColumn("entry", F.col("entries") + ended)
    )
    parts = F.sort_array(F.collect_list(F.struct("start", "at", "value")))
    joined = placed.where("NOT whole").groupBy("file", "entry").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "]").alias("value")
    )
    # Null, not filtered: a parser of the texts would be moved before the filter.
    whole = placed.select(F.when(F.col("whole"), F.col("value")).alias("value"))
    return whole.unionByName(joined.select("value"))


def lists_from_json(
    spark: SparkSession, path: str, brackets_in_ids: bool = False
) -> DataFrame:
    """``{"user": ["item", ...], ...}`` as rows (user text, item, position from 1).

    The file is split at the bracket that closes each list, so one large object
    is read by many tasks. Ids that hold a ``]`` need ``brackets_in_ids``, which counts
    quotes to tell brackets inside ids from others; without it such a file is an error,
    not a loss.
    """
    pieces = _rejoined(spark, path) if brackets_in_ids else spark.read.text(path, lineSep="]")
    entry = F.regexp_replace("value", r"^[\s,{]+", "")
    # Null for what follows the last list; Spark may parse before it filters.
    whole = F.when(F.contains("value", F.lit("[")), F.concat(F.lit("{"), entry, F.lit("]}")))
    entries = pieces.select(whole.alias("value"))
    lists = entries.select(F.from_json("value", LISTS_JSON, {"mode": "FAILFAST"}).alias("lists"))
    users = lists.select(F.explode("lists").alias("user", "items"))
    return users.select("user", F.posexplode_outer("items").alias("position", ITEM)).withColumn(
        "position", F.col("position") + 1
    )


def truth_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth as (user, item); a user with an empty list has a null item."""
    rows = lists_from_json(spark, path)
    return rows.select(F.col("user").cast("bigint").alias(USER), ITEM).distinct()


def users_from_truth(spark: SparkSession, path: str) -> DataFrame | None:
    """Distinct users of a ground-truth object, or ``None`` where there is no file."""
    if not path_exists(spark, path):
        return None
    rows = lists_from_json(spark, path)
    return rows.select(F.col("user").cast("bigint").alias(USER)).distinct()
