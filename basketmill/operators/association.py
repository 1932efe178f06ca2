"""How each feature relates to the label, all features at once.

The features are unpivoted and counted by (feature, value): every statistic
follows from that table, however many rows share a value.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmill.columns import FEATURES
from basketmill.functions.relational import running_sums
from basketmill.operators.metrics import average_precision_of_counts
from basketmill.session import stored

LABEL, FEATURE, VALUE = "label", "feature", "value"


@dataclass(frozen=True)
class Thresholds:
    # Default limits of the usefulness classes.
    min_nonzero_rate: float = 0.001
    min_abs_corr: float = 0.01
    min_auc_lift: float = 0.01
    min_positive_rate_lift: float = 0.005


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def value_counts(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Rows and positives per (feature, value); a null counts as the value 0."""
    present = [f for f in features if f in df.columns]
    long = df.select(LABEL, *[F.col(f).cast("float").alias(f) for f in present]).unpivot(
        [LABEL], present, FEATURE, VALUE
    )
    return long.groupBy(FEATURE, F.coalesce(F.col(VALUE), F.lit(0.0).cast("float")).alias(VALUE)).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(LABEL).cast("bigint")).alias("n_pos"),
        F.count_if(F.col(VALUE).isNull()).alias("n_null"),
    )


def totals(counts: DataFrame) -> DataFrame:
    """Sums per feature."""
    value = F.col(VALUE).cast("double")
    negatives = F.col("n") - F.col("n_pos")
    nonzero = F.col(VALUE) != 0
    return counts.groupBy(FEATURE).agg(
        F.sum("n").alias("rows"),
        F.sum("n_pos").alias("positives"),
        F.sum("n_null").alias("nulls"),
        F.count(F.lit(1)).alias("unique_values"),
        F.coalesce(F.sum(F.when(nonzero, F.col("n"))), F.lit(0)).alias("nonzero_rows"),
        F.coalesce(F.sum(F.when(nonzero, F.col("n_pos"))), F.lit(0)).alias("nonzero_positives"),
        F.sum(value * F.col("n")).alias("value_sum"),
        F.sum(value * F.col("n_pos")).alias("value_sum_positive"),
        F.sum(value * negatives).alias("value_sum_negative"),
    )


def _correlation(counts: DataFrame, sums: DataFrame, value: str, mean: str, name: str) -> DataFrame:
    """Correlation of ``value`` with the 0/1 label over counted rows, centred first."""
    centred = counts.join(F.broadcast(sums.select(FEATURE, mean, "rows", "positives")), FEATURE)
    off = F.col(value).cast("double") - F.col(mean)
    moments = centred.groupBy(FEATURE).agg(
        F.sum(off * off * F.col("n")).alias("spread"),
        F.sum(off * F.col("n_pos")).alias("together"),
        F.first("rows").alias("rows"),
        F.first("positives").alias("positives"),
    )
    label_spread = F.col("positives") * (F.col("rows") - F.col("positives")) / F.col("rows")
    return moments.select(
        FEATURE, _zero(F.try_divide("together", F.sqrt(F.col("spread") * label_spread))).alias(name)
    )


def _means(sums: DataFrame) -> DataFrame:
    return sums.withColumns(
        {
            "value_mean": F.col("value_sum") / F.col("rows"),
            "rank_mean": (F.col("rows") + F.lit(1.0)) / F.lit(2.0),
        }
    )


def pearson(counts: DataFrame) -> DataFrame:
    return _correlation(counts, _means(totals(counts)), VALUE, "value_mean", "pearson")


def _ranked(counts: DataFrame) -> DataFrame:
    """Adds the average rank, from 1, of the rows that share a value."""
    lower = running_sums(counts, [FEATURE], VALUE, ["n"])
    return lower.withColumn("rank", F.col("n_before") + (F.col("n") + F.lit(1.0)) / F.lit(2.0))


def spearman(counts: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    # Ranking the label only shifts and scales its two values.
    ranked = _ranked(counts) if ranked is None else ranked
    return _correlation(ranked, _means(totals(counts)), "rank", "rank_mean", "spearman")


def auc(counts: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Area under the ROC curve from the positives' rank sum, whichever way is larger."""
    ranked = _ranked(counts) if ranked is None else ranked
    sums = ranked.groupBy(FEATURE).agg(
        F.sum(F.col("rank") * F.col("n_pos")).alias("rank_sum"),
        F.sum("n").cast("double").alias("rows"),
        F.sum("n_pos").cast("double").alias("positives"),
        F.count(F.lit(1)).alias("unique_values"),
    )
    p = F.col("positives")
    area = F.try_divide(
        F.col("rank_sum") - p * (p + F.lit(1.0)) / F.lit(2.0), p * (F.col("rows") - p)
    )
    either = F.when(F.col("unique_values") > 1, F.greatest(area, F.lit(1.0) - area))
    return sums.select(
        FEATURE, F.coalesce(either, F.lit(0.5)).alias("auc_directionless")
    ).withColumn("auc_lift", F.col("auc_directionless") - F.lit(0.5))


def precision_lift(counts: DataFrame) -> DataFrame:
    """Average precision of the feature as a score, 0 where feature or label is constant."""
    area = average_precision_of_counts(counts, [FEATURE], VALUE)
    sums = totals(counts)
    varies = (F.col("unique_values") > 1) & F.col("positives").between(1, F.col("rows") - 1)
    return area.join(sums.select(FEATURE, "rows", "positives", "unique_values"), FEATURE).select(
        FEATURE,
        F.when(varies, F.col("average_precision")).otherwise(0.0).alias("average_precision"),
    )


def rates(counts: DataFrame) -> DataFrame:
    rate = F.col("positives") / F.col("rows")
    nonzero = _zero(F.try_divide("nonzero_positives", "nonzero_rows"))
    return totals(counts).select(
        FEATURE,
        nonzero.alias("positive_rate_when_nonzero"),
        rate.alias("global_positive_rate"),
        (nonzero - rate).alias("positive_rate_lift"),
    )


def class_means(counts: DataFrame) -> DataFrame:
    negatives = F.col("rows") - F.col("positives")
    positive = _zero(F.try_divide("value_sum_positive", "positives"))
    negative = _zero(F.try_divide(F.col("value_sum_negative"), negatives))
    return totals(counts).select(
        FEATURE,
        positive.alias("mean_positive"),
        negative.alias("mean_negative"),
        (positive - negative).alias("mean_delta"),
    )


def density(counts: DataFrame) -> DataFrame:
    return totals(counts).select(
        FEATURE,
        (F.col("nulls") / F.col("rows")).alias("null_rate"),
        (F.col("nonzero_rows") / F.col("rows")).alias("nonzero_rate"),
        "unique_values",
    )


def classify(report: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Status and reason per feature; the first matching rule counts."""
    signal = (
        (F.greatest("abs_pearson", "abs_spearman") >= limits.min_abs_corr)
        | (F.col("auc_lift") >= limits.min_auc_lift)
        | (F.abs("positive_rate_lift") >= limits.min_positive_rate_lift)
        | (F.round("ap_lift", 12) > 0)  # not by the order of summing
    )
    sparse = F.col("nonzero_rate") < limits.min_nonzero_rate
    # The statuses and their reasons.
    rules = [
        (F.col("unique_values") == 0, "missing", "column was not produced by the pipeline"),
        (F.col("unique_values") <= 1, "constant", "only one value after filling nulls"),
        (F.col("nonzero_rate") == 0, "all_zero", "feature is always zero"),
        (signal & sparse, "usable_sparse", "has label signal but appears in very few rows"),
        (signal, "usable", "passes at least one signal threshold"),
        (sparse, "too_sparse", "too sparse and no clear label signal"),
        (F.lit(True), "weak_signal", "varies but does not pass the signal thresholds"),
    ]
    verdict = F.coalesce(
        *[F.when(rule, F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason")))
          for rule, s, r in rules]
    )
    return report.withColumn("_v", verdict).select(*report.columns, "_v.status", "_v.reason")


def feature_report(
    df: DataFrame, features: tuple[str, ...] = FEATURES, limits: Thresholds = Thresholds()
) -> DataFrame:
    """One row per feature, also for features that ``df`` lacks."""
    counts = stored(value_counts(df, features), "value-counts")
    positives = df.agg(F.coalesce(F.avg(F.col(LABEL).cast("double")), F.lit(0.0)))
    return report_of_counts(counts, positives, features, limits)


def merged(counts: list[DataFrame]) -> DataFrame:
    """The counts of all rows from the counts of parts of them."""
    every = reduce(DataFrame.unionByName, counts)
    return every.groupBy(FEATURE, VALUE).agg(*[F.sum(c).alias(c) for c in ("n", "n_pos", "n_null")])


def positive_rate(counts: DataFrame) -> DataFrame:
    """The share of positives, which any one feature's counts give; 0 without rows."""
    rate = F.max(F.col("positives") / F.col("rows"))
    return totals(counts).agg(F.coalesce(rate, F.lit(0.0)))


def report_of_counts(
    counts: DataFrame,
    positives: DataFrame,
    features: tuple[str, ...] = FEATURES,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """The report from stored counts; ``positives`` holds one value, the share of positives."""
    ranked = _ranked(counts)
    names = counts.sparkSession.createDataFrame([(f,) for f in features], f"{FEATURE} string")
    report = names
    for part in (
        pearson(counts),
        spearman(counts, ranked),
        auc(counts, ranked),
        precision_lift(counts),
        rates(counts),
        class_means(counts),
        density(counts),
    ):
        report = report.join(part, FEATURE, "left")
    rate = F.coalesce(F.col("global_positive_rate"), positives.scalar())
    report = (
        report.withColumn("global_positive_rate", rate)
        .fillna({"null_rate": 1.0, "auc_directionless": 0.5})
        .fillna(0)
        .withColumns(
            {
                "abs_pearson": F.abs("pearson"),
                "abs_spearman": F.abs("spearman"),
                "ap_lift": F.when(F.col("unique_values") == 0, 0.0).otherwise(
                    F.col("average_precision") - F.col("global_positive_rate")
                ),
            }
        )
    )
    return classify(report, limits)


def sorted_report(report: DataFrame, sort_by: str = "abs_spearman") -> DataFrame:
    return report.orderBy(F.col(sort_by).desc(), FEATURE)


def write_report(report: DataFrame, path: str, sort_by: str = "abs_spearman") -> None:
    """CSV with a header, best feature first; a report has one row per feature."""
    sorted_report(report, sort_by).coalesce(1).write.option("header", True).csv(path)


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("features"))


USABLE = ("usable", "usable_sparse")


def usable_features(report: DataFrame, top: int = 30, sort_by: str = "abs_spearman") -> DataFrame:
    return sorted_report(report.where(F.col("status").isin(*USABLE)), sort_by).limit(top)


def features_to_inspect(
    report: DataFrame, top: int = 50, sort_by: str = "abs_spearman"
) -> DataFrame:
    return sorted_report(report.where(~F.col("status").isin(*USABLE)), sort_by).limit(top)
