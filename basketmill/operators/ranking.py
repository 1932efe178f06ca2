"""Ranked item lists per user, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketmill.columns import ITEM, USER
from basketmill.functions.relational import top_per

RECOMMENDATIONS = f"{USER} bigint, items array<string>"


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """The rows of each user's best ``k`` items, and ``rank``; equal scores go by item."""
    order = [F.col("score").desc(), F.col(ITEM)]
    return top_per(scored, [USER], order, k, "rank")


def as_lists(ranked: DataFrame) -> DataFrame:
    """One row per user: the items, best first."""
    entries = F.sort_array(F.collect_list(F.struct("rank", ITEM)))
    return ranked.groupBy(USER).agg(F.transform(entries, lambda e: e[ITEM]).alias("items"))


def write_recommendations(lists: DataFrame, path: str) -> None:
    """JSON, one object per line and user, written in parallel."""
    lists.select(USER, "items").write.mode("errorifexists").json(path)


def read_recommendations(spark: SparkSession, path: str) -> DataFrame:
    """Written lists as (user, item, rank)."""
    lists = spark.read.schema(RECOMMENDATIONS).json(path)
    return lists.select(USER, F.posexplode("items").alias("rank", ITEM)).select(
        USER, ITEM, (F.col("rank") + 1).alias("rank")
    )


def write_rekeyed(lists: DataFrame, path: str) -> None:
    """Re-keyed lists as JSON, one object per line and user: ``customer_id`` where the key is a
    number, else ``user_text``; items best first."""
    entries = F.sort_array(F.collect_list(F.struct("rank", ITEM)))
    lists.groupBy(USER, "user_text").agg(
        F.transform(entries, lambda e: e[ITEM]).alias("items")
    ).write.mode("errorifexists").json(path)


def read_rekeyed(spark: SparkSession, path: str) -> DataFrame:
    """Written re-keyed lists as (user, user text, item, rank)."""
    lists = spark.read.schema(f"{USER} bigint, user_text string, items array<string>").json(path)
    return lists.select(USER, "user_text", F.posexplode("items").alias("rank", ITEM)).withColumn(
        "rank", (F.col("rank") + 1).cast("bigint")
    )


def rekey(lists: DataFrame) -> DataFrame:
    """Lists keyed by user text: whole-number keys to numbers, others kept as text."""
    return lists.select(
        F.col("user").try_cast("bigint").alias(USER),
        F.when(F.col("user").try_cast("bigint").isNull(), F.col("user")).alias("user_text"),
        F.col("position").cast("bigint").alias("rank"),
        F.col(ITEM).cast("string").alias(ITEM),
    )
