"""Labels, negative sampling and ranking groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmill.columns import FEATURES, ITEM, USER
from basketmill.functions.relational import hash_order, smallest_hashes
from basketmill.functions.time import MonthWindow
from basketmill.operators.users import month_truth

LABEL, MONTH = "label", "label_month"


def add_labels(tx: DataFrame, pairs: DataFrame, month: MonthWindow) -> DataFrame:
    """1 where the pair was bought in the month, else 0."""
    bought = month_truth(tx, month).withColumn(LABEL, F.lit(1))
    return pairs.join(bought, [USER, ITEM], "left").withColumn(
        LABEL, F.coalesce(LABEL, F.lit(0)).cast("tinyint")
    )


def narrow_features(df: DataFrame) -> DataFrame:
    """Features as 32-bit floats, the precision every score and rank is taken at."""
    return df.withColumns({f: F.col(f).cast("float") for f in FEATURES if f in df.columns})


def class_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(LABEL) == 1).alias("positives"),
        F.count_if(F.col(LABEL) == 0).alias("negatives"),
    )


def downsample_negatives(
    df: DataFrame, negative_ratio: float, seed: int, group: tuple[str, ...] = (MONTH,)
) -> DataFrame:
    """All positives and ``int(positives * negative_ratio)`` negatives per group.

    A group that lacks one of the classes is kept whole. The negatives kept are
    those with the smallest hash of (seed, user, item). ``df`` is read several
    times: pass a stored table.
    """
    keys = list(group)
    quota = class_counts(df, *keys).select(
        *keys,
        F.when(F.col("positives") == 0, F.col("negatives"))
        .otherwise(F.floor(F.col("positives") * F.lit(negative_ratio)).cast("bigint"))
        .alias("quota"),
    )
    negatives = df.where(F.col(LABEL) == 0)
    kept = smallest_hashes(negatives, hash_order(seed, USER, ITEM), quota, keys)
    return df.where(F.col(LABEL) == 1).unionByName(kept)


def rank_groups(df: DataFrame) -> DataFrame:
    """Rows of users with a positive, and ``group_size``, the user's rows."""
    sizes = (
        df.groupBy(USER)
        .agg(F.count(F.lit(1)).alias("group_size"), F.sum(LABEL).alias("_positives"))
        .where(F.col("_positives") > 0)
        .drop("_positives")
    )
    return df.join(sizes, USER)


def class_weight(df: DataFrame) -> DataFrame:
    """One row: how much a positive weighs against a negative."""
    counts = class_counts(df)
    positives = F.greatest("positives", F.lit(1))
    return counts.select(
        "positives",
        "negatives",
        (F.greatest(F.col("rows") - positives, F.lit(1)).cast("double") / positives).alias(
            "scale_pos_weight"
        ),
    )


def dataset_summary(full: DataFrame, sampled: DataFrame) -> DataFrame:
    """Rows, positives and kept rows per label month."""
    kept = sampled.groupBy(MONTH).agg(F.count(F.lit(1)).alias("kept"))
    return class_counts(full, MONTH).drop("negatives").join(kept, MONTH, "left").fillna(0, ["kept"])
