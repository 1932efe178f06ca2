"""Sampling, labels and metrics against hand-computed or plain Python answers."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketmill.functions.relational import running_sums
from basketmill.functions.time import month_window
from basketmill.operators import metrics as E
from basketmill.operators import training as D
from basketmill.operators.ranking import as_lists, top_k

PAIRS = "customer_id bigint, item_id string"


def test_labels_are_the_month_purchases(spark, log):
    tx = log([
        (1, 1, "a", "2025-07-01", 1.0, 0.0, 1.0, 1), (1, 1, "a", "2025-07-31T23:59:59", 1.0, 0.0, 1.0, 1),
        (1, 1, "b", "2025-08-01", 1.0, 0.0, 1.0, 1),
    ])
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], PAIRS)
    rows = D.add_labels(tx, pairs, month_window("2025-07")).collect()
    assert {(r.customer_id, r.item_id): r.label for r in rows} == {(1, "a"): 1, (1, "b"): 0, (2, "a"): 0}


def _labelled(spark, rows):
    return spark.createDataFrame(rows, f"{PAIRS}, label tinyint, label_month string")


def test_negatives_of_a_month_stay_on_their_tasks(spark):
    """Sampling sends no month to one task, also where no table is small enough to be copied."""
    off = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in off}
    rows = spark.range(4000).selectExpr(
        "id % 40 AS customer_id", "CAST(id AS STRING) AS item_id", "CAST(id % 16 = 0 AS TINYINT) AS label",
        "'2025-06' AS label_month",
    ).repartition(6, "item_id")
    try:
        for k in off:
            spark.conf.set(k, "-1")
        kept = D.downsample_negatives(rows, 6.0, 3).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    negatives = [r for r in kept if r.label == 0]
    assert len(negatives) == 1500 and len({r.item_id for r in negatives}) == 1500
    of_task = Counter(r.task for r in negatives)
    assert len(of_task) >= 6 and max(of_task.values()) < 500


def test_negatives_kept_are_the_smallest_hashes(spark):
    rows = [(u, f"i{i}", int(i < 3), "2025-07") for u in range(20) for i in range(40)]
    rows += [(u, "x", 0, "2025-08") for u in range(5)]  # no positive: kept whole
    got = {tuple(r) for r in D.downsample_negatives(_labelled(spark, rows), 2.5, 9).collect()}
    july = [r for r in rows if r[3] == "2025-07" and not r[2]]
    july.sort(key=lambda r: hashlib.md5(f"9|{r[0]}|{r[1]}".encode()).hexdigest())
    want = {r for r in rows if r[2] or r[3] == "2025-08"} | set(july[:150])
    assert got == want


def test_groups_and_weights(spark):
    rows = [(1, "a", 1, "m"), (1, "b", 0, "m"), (2, "a", 0, "m"), (3, "c", 1, "m")]
    df = _labelled(spark, rows)
    groups = {(r.customer_id, r.item_id): r.group_size for r in D.rank_groups(df).collect()}
    assert groups == {(1, "a"): 2, (1, "b"): 2, (3, "c"): 1}
    assert D.class_weight(df).first().scale_pos_weight == 1.0
    none = D.class_weight(df.where("label = 0")).first()
    assert (none.positives, none.scale_pos_weight) == (0, 1.0)
    summary = D.dataset_summary(df, df.where("label = 1")).first()
    assert (summary.rows, summary.positives, summary.kept) == (4, 2, 2)


def test_running_sums_span_tasks(spark):
    rows = [(g, v, random.Random(v).randrange(9)) for g in "ab" for v in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, n bigint").repartition(7)
    for down in (False, True):
        got = {(r.g, r.v): r.n_before for r in running_sums(df, ["g"], "v", ["n"], down).collect()}
        for g, v, _ in rows:
            want = sum(n for h, w, n in rows if h == g and (w > v if down else w < v))
            assert got[g, v] == want


def _evaluated(spark):
    """User 1 hits at ranks 1 and 3, user 2 misses, user 3 has no list, user 4 no purchase,
    user 5 is in no truth."""
    ranked = spark.createDataFrame(
        [(1, "a", 1), (1, "x", 2), (1, "b", 3), (2, "x", 1), (4, "x", 1), (5, "a", 1)],
        f"{PAIRS}, rank int",
    )
    truth = spark.createDataFrame(
        [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "a"), (4, None)], PAIRS
    )
    return ranked, truth


def test_list_metrics_by_hand(spark):
    ranked, truth = _evaluated(spark)
    rows = {r.customer_id: r for r in E.list_metrics(ranked, truth).collect()}
    assert set(rows) == {1, 2, 4}
    assert rows[1].iou == 2 / 4 and rows[1].reciprocal_rank == 1 and rows[1].precision == 0.2
    assert rows[1].average_precision == pytest.approx((1 + 2 / 3) / 3)
    assert (rows[2].iou, rows[4].average_precision) == (0, 0)
    one = E.evaluate_lists(ranked, truth).first()
    assert (one.truth_users, one.submission_users, one.common_users, one.missing_users) == (4, 4, 3, 1)
    assert one.iou == pytest.approx(0.5 / 3)
    assert one.iou_all_users == pytest.approx(0.5 / 3 * 3 / 4)
    short = {r.customer_id: r for r in E.list_metrics(ranked, truth, 2).collect()}[1]
    assert (short.iou, short.precision, short.average_precision) == (1 / 4, 0.5, 0.5)


def test_coverage_by_hand(spark):
    offered = spark.createDataFrame([(1, "a"), (1, "x"), (2, "x"), (4, "x"), (9, "a")], PAIRS)
    _, truth = _evaluated(spark)
    row = E.candidate_coverage(offered, truth).first()
    assert (row.common_users, row.total_candidates, row.total_true_items, row.total_hits) == (2, 3, 4, 1)
    assert row.candidate_recall == 0.25 and row.user_hit_rate == 0.5
    assert row.mean_user_recall == pytest.approx(1 / 6)


def _scored(spark):
    rnd = random.Random(4)
    return [(u, f"i{i:02d}", int(rnd.random() < 0.2), rnd.choice([0.1, 0.2, 0.5, 0.7, 0.9]))
            for u in range(6) for i in range(25)]


def test_score_metrics_match_python(spark):
    rows = _scored(spark)
    df = spark.createDataFrame(rows, f"{PAIRS}, label tinyint, score double")
    positives = sum(r[2] for r in rows)
    area = seen = hits = 0
    for s in sorted({r[3] for r in rows}, reverse=True):
        step = [r[2] for r in rows if r[3] == s]
        seen, hits = seen + len(step), hits + sum(step)
        area += sum(step) / positives * hits / seen
    assert E.average_precision(df).first()[0] == pytest.approx(area)
    loss = -sum(math.log(s if y else 1 - s) for _, _, y, s in rows) / len(rows)
    assert E.log_loss(df).first().log_loss == pytest.approx(loss)
    users = {}
    for u, i, y, s in rows:
        users.setdefault(u, []).append((-s, i, y))
    tops = [[y for _, _, y in sorted(v)[:10]] for v in users.values()]
    assert E.precision_at_k(df).first().precision_at_k == pytest.approx(sum(map(sum, tops)) / 10 / 6)
    gains = []
    for v, top in zip(users.values(), tops):
        n = min(sum(y for *_, y in v), 10)
        if n:
            best = sum(1 / math.log2(r + 2) for r in range(n))
            gains.append(sum(y / math.log2(r + 2) for r, y in enumerate(top)) / best)
    assert E.ndcg_at_k(df).first().ndcg_at_k == pytest.approx(sum(gains) / len(gains))
    lists = {r.customer_id: r["items"] for r in as_lists(top_k(df, 10)).collect()}
    assert lists == {u: [i for _, i, _ in sorted(v)[:10]] for u, v in users.items()}


def test_scores_at_the_edges_stay_finite(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.0), (1, "b", 0, 1.0)], f"{PAIRS}, label tinyint, score double")
    assert E.log_loss(df).first().log_loss == pytest.approx(-math.log(1e-6))
    assert E.average_precision(df.withColumn("label", F.lit(0))).first()[0] == 0
