"""Quality of candidates, scores and ranked lists against what was bought."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketmill.columns import ITEM, USER
from basketmill.functions.relational import running_sums
from basketmill.operators.ranking import top_k

LABEL = "label"
# Fixed value: scores are kept this far from 0 and 1 in the log loss.
LOG_LOSS_EDGE = 1e-6


def _share(top: str, bottom: str) -> Column:
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom)), F.lit(0.0))


def _known(truth: DataFrame) -> DataFrame:
    return truth.where(F.col(ITEM).isNotNull()).select(USER, ITEM).distinct()


def candidate_coverage(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Over users with candidates and purchases: recall, precision, hit rate."""
    offered = candidates.select(USER, ITEM).withColumn("offered", F.lit(1))
    bought = _known(truth).withColumn("bought", F.lit(1))
    per_user = (
        offered.join(bought, [USER, ITEM], "full")
        .groupBy(USER)
        .agg(
            F.count("offered").alias("candidates"),
            F.count("bought").alias("bought"),
            F.count_if(F.col("offered").isNotNull() & F.col("bought").isNotNull()).alias("hits"),
        )
        .where("candidates > 0 AND bought > 0")
    )
    totals = per_user.agg(
        F.count(F.lit(1)).alias("common_users"),
        F.coalesce(F.sum("candidates"), F.lit(0)).alias("total_candidates"),
        F.coalesce(F.sum("bought"), F.lit(0)).alias("total_true_items"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits"),
        F.count_if(F.col("hits") > 0).alias("users_with_hit"),
        F.coalesce(F.avg(F.col("hits") / F.col("bought")), F.lit(0.0)).alias("mean_user_recall"),
    )
    return totals.withColumns(
        {
            "candidate_recall": _share("total_hits", "total_true_items"),
            "candidate_precision": _share("total_hits", "total_candidates"),
            "user_hit_rate": _share("users_with_hit", "common_users"),
        }
    )


def precision_at_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """Mean over users of the labels among the ``k`` best, divided by ``k``."""
    best = top_k(scored.select(USER, ITEM, LABEL, "score"), k)
    per_user = best.groupBy(USER).agg((F.sum(LABEL) / F.lit(float(k))).alias("precision"))
    return per_user.agg(
        F.count(F.lit(1)).alias("users"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision_at_k"),
    )


def list_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Per common user: IoU, reciprocal rank, precision and average precision at k.

    ``ranked`` is (user, item, rank from 1), ``truth`` (user, item), where a
    null item stands for a user who bought nothing.
    """
    bought = _known(truth)
    sizes = truth.groupBy(USER).agg(F.count_distinct(ITEM).alias("bought"))
    hits = (
        ranked.where(F.col("rank") <= k)
        .select(USER, ITEM, "rank")
        .join(bought.withColumn("hit", F.lit(1)), [USER, ITEM], "left")
        .fillna(0, ["hit"])
    )
    so_far = Window.partitionBy(USER).orderBy("rank")
    per_user = (
        hits.withColumn("found", F.sum("hit").over(so_far))
        .groupBy(USER)
        .agg(
            F.count(F.lit(1)).alias("listed"),
            F.sum("hit").alias("hits"),
            F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
            F.sum(F.col("hit") * F.col("found") / F.col("rank")).alias("gain"),
        )
        .join(sizes, USER)
    )
    best = F.least(F.col("bought"), F.lit(k))
    return per_user.select(
        USER,
        F.coalesce(
            F.try_divide(
                F.col("hits").cast("double"), F.col("listed") + F.col("bought") - F.col("hits")
            ),
            F.lit(0.0),
        ).alias("iou"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.col("hits") / F.lit(float(k))).alias("precision"),
        F.coalesce(F.try_divide(F.col("gain"), best), F.lit(0.0)).alias("average_precision"),
    )


LIST_METRICS = {
    "iou": "iou",
    "mrr": "reciprocal_rank",
    "precision": "precision",
    "map": "average_precision",
}


def evaluate_lists(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row: the mean metrics over common users, and over all truth users
    with missing users counted as zero."""
    users = truth.select(USER).distinct().join(
        list_metrics(ranked, truth, k).withColumn("common", F.lit(1)), USER, "left"
    )
    means = users.agg(
        F.count(F.lit(1)).alias("truth_users"),
        F.count("common").alias("common_users"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(m) for m, c in LIST_METRICS.items()],
    )
    lists = ranked.agg(F.count_distinct(USER).alias("submission_users"))
    covered = _share("common_users", "truth_users")
    return means.select(
        "truth_users",
        lists.scalar().alias("submission_users"),
        "common_users",
        (F.col("truth_users") - F.col("common_users")).alias("missing_users"),
        *LIST_METRICS,
        *[(F.col(m) * covered).alias(f"{m}_all_users") for m in LIST_METRICS],
    )


def log_loss(scored: DataFrame) -> DataFrame:
    p = F.least(
        F.greatest(F.col("score"), F.lit(LOG_LOSS_EDGE)), F.lit(1 - LOG_LOSS_EDGE)
    )
    loss = -F.ln(F.when(F.col(LABEL) == 1, p).otherwise(F.lit(1.0) - p))
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.avg(loss).alias("log_loss"))


def average_precision(scored: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Area under the precision/recall steps, one step per distinct score."""
    keys = list(group) or ["_all"]
    table = scored if group else scored.withColumn("_all", F.lit(1))
    steps = table.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(LABEL).cast("bigint")).alias("n_pos")
    )
    return average_precision_of_counts(steps, keys, "score").select(*group, "average_precision")


def average_precision_of_counts(steps: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The same from (keys, score, n, n_pos), unique on keys and score."""
    passed = running_sums(steps, keys, score, ["n", "n_pos"], descending=True)
    hits = F.col("n_pos_before") + F.col("n_pos")
    precision = hits.cast("double") / (F.col("n_before") + F.col("n"))
    return passed.groupBy(*keys).agg(
        F.coalesce(
            F.try_divide(F.sum(F.col("n_pos") * precision), F.sum("n_pos")), F.lit(0.0)
        ).alias("average_precision")
    )


SLICES = 1 << 16


def average_precision_bounds(margins: DataFrame) -> tuple[float, float]:
    """Average precision of log-odds ``score`` from below and above, without a sort.

    Rows are counted in ``SLICES`` slices of equal width of the probability. Inside a slice the
    positives stand last at worst, one by one; at best they stand first and tie."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
    counts = (
        margins.groupBy(F.least(F.floor(p * SLICES), F.lit(SLICES - 1)).alias("slice"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(LABEL).cast("bigint")).alias("n_pos"))
        .orderBy(F.desc("slice"))
        .toArrow()
    )
    n, hits = (counts.column(c).to_numpy().astype(np.float64) for c in ("n", "n_pos"))
    if not hits.sum():
        return 0.0, 0.0
    before, passed = n.cumsum() - n, hits.cumsum() - hits
    high = (hits * (passed + hits) / np.maximum(before + hits, 1)).sum()
    low = 0.0
    for size, own, rows, found in zip(n, hits, before, passed):
        j = np.arange(1, own + 1)
        low += ((found + j) / (rows + size - own + j)).sum()
    # A little wider than the sums' own rounding.
    return float(low / hits.sum()) * (1 - 1e-12), float(high / hits.sum()) * (1 + 1e-12)


def ndcg_at_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """Mean over users with a positive of the discounted gain of the ``k`` best."""
    positives = scored.groupBy(USER).agg(F.sum(LABEL).alias("positives"))
    best = top_k(scored.select(USER, ITEM, LABEL, "score"), k)
    gains = best.groupBy(USER).agg(
        F.sum(F.col(LABEL) / F.log2(F.col("rank") + F.lit(1.0))).alias("gain")
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least("positives", F.lit(k)).cast("int")),
        F.lit(0.0),
        lambda total, rank: total + F.lit(1.0) / F.log2(rank + F.lit(1.0)),
    )
    per_user = gains.join(positives.where("positives > 0"), USER).withColumn(
        "ndcg", F.col("gain") / ideal
    )
    return per_user.agg(
        F.count(F.lit(1)).alias("users"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg_at_k")
    )
