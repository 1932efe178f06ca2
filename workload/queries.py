"""The registered queries: every operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketmill.columns import (
    ATTRIBUTES,
    BRAND,
    CAT,
    FEATURES,
    ITEM,
    LOC,
    SOURCE_COUNT,
    USER,
)
from basketmill.config import (
    CandidateParams,
    RunParams,
    SplitMonths,
    full_year_months,
    resolve_months,
)
from basketmill.functions.time import month_window, previous_months
from basketmill.operators import association as A
from basketmill.operators import boosting as B
from basketmill.operators import candidates as C
from basketmill.operators import compare as Q8
from basketmill.operators import features as Fe
from basketmill.operators import gradients as G
from basketmill.operators import metrics as E
from basketmill.operators import profile as Q
from basketmill.operators import ranking as R
from basketmill.operators import scorers as M
from basketmill.operators import training as D
from basketmill.operators import users as U
from basketmill.operators.cobuy import shared_bill_counts
from basketmill.operators.listbook import ListBook
from basketmill.operators.ledger import Audience, Ledger, open_audience, open_ledger
from basketmill.operators.outbox import read_parts, write_in_parts, write_object
from basketmill.operators.timeline import open_timeline
from basketmill.plans import kept_profile as K
from basketmill.plans import monthly
from basketmill.plans.association_report import association_report
from basketmill.session import scratch_path, stored, tune
from basketmill.sources import tables as S
from workload.tables import NAME, NAMED, PART, catalogue, purchase_log, read

TRAIN, VALIDATION, TEST = ("2001-04", "2001-05"), "2001-06", "2001-07"
# Small lists, so that every limit binds.
SMALL = CandidateParams(
    personal_top=5,
    global_top=10,
    recent_global_top=10,
    location_top=8,
    recent_location_top=8,
    cobuy_top=6,
    category_top=5,
    brand_top=5,
)
RUN = RunParams(candidates=SMALL)
SAMPLE = 50
Query = Callable[[SparkSession, str], DataFrame]

# Columns that hold sums of amounts; other fractions get more digits.
SUM_DIGITS, DIGITS = 6, 9


def rounded(df: DataFrame) -> DataFrame:
    """Fractions at a precision that does not depend on the order of summing."""
    def digits(name: str) -> int:
        return SUM_DIGITS if name.endswith(("_sum", "qty_90d")) else DIGITS

    return df.select(
        *[
            F.round(F.col(f.name).cast("double"), digits(f.name)).alias(f.name)
            if f.dataType.simpleString() in ("double", "float")
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _test(
    spark: SparkSession, sf: str, item: str = NAMED, items: bool = True
) -> tuple[Ledger, Audience]:
    """A lazy ledger as of the test month, for the users active in it."""
    tx = purchase_log(spark, sf, item)
    month = month_window(TEST)
    meta = catalogue(spark, sf, item) if items else None
    ledger = open_ledger(tx, month.start, meta, SMALL)
    return ledger, open_audience(ledger, U.active_users(tx, month))


def _source(source: Callable[[Ledger, Audience], DataFrame]) -> Query:
    return lambda spark, sf, item=NAMED: source(*_test(spark, sf, item))


def _on_parts(queries: dict[str, Query]) -> dict[str, Query]:
    """The queries, and each once more on items that are parts."""
    return queries | {
        f"{n}_fine": partial(q, item=PART)
        for n, q in queries.items()
        if not n.endswith("_fine") and f"{n}_fine" not in queries
    }


# --- ingest, time, users ------------------------------------------------------


def i04_month_series(spark: SparkSession, sf: str) -> DataFrame:
    months = previous_months(TEST, 12)
    first, last = month_window(months[0]), month_window(months[-1])
    tx = purchase_log(spark, sf)
    span = replace(first, end=last.end)
    counted = U.in_month(tx, span).groupBy(F.date_format("updated_date", "yyyy-MM").alias("month"))
    return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("month").isin(months))


def _truth_file(spark: SparkSession, sf: str, guests: bool = False, ending: str = "") -> str:
    """The test month's purchases as a JSON object in part files, in scratch.

    With ``guests`` some users get a key that is no number; items get the ``ending``.
    """
    truth = U.month_truth(purchase_log(spark, sf), month_window(TEST))
    ids = F.sort_array(F.collect_list(F.concat(ITEM, F.lit(ending))))
    key = F.col(USER).cast("string")
    if guests:
        key = F.when(F.col(USER) % 10 == 3, F.concat(F.lit("guest-"), key)).otherwise(key)
    path = scratch_path(spark, "truth")
    write_object(truth.groupBy(USER).agg(ids.alias("items")).select(key.alias("key"), "items"), path, "key")
    return path


def i10_truth_users(spark: SparkSession, sf: str) -> DataFrame:
    return S.users_from_truth(spark, _truth_file(spark, sf))


def i11_truth_json(spark: SparkSession, sf: str) -> DataFrame:
    return S.truth_from_json(spark, _truth_file(spark, sf))


#: What ends item ids in a file that only counting quotes can split: brackets, quotes, backslashes.
ODD_ENDING = '], "[\\'


def i11_truth_brackets(spark: SparkSession, sf: str) -> DataFrame:
    path = _truth_file(spark, sf, ending=ODD_ENDING)
    return S.lists_from_json(spark, path, brackets_in_ids=True)


def i12_month_truth(spark: SparkSession, sf: str) -> DataFrame:
    tx, month = purchase_log(spark, sf), month_window(TEST)
    return U.month_truth(tx, month, U.users_before(tx, month.start))


def i13_split_months(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the log in each month of three splits: two months before validation, given
    ones, and a full year."""
    splits = {
        "default": resolve_months(VALIDATION, TEST),
        "given": resolve_months(VALIDATION, TEST, ["2001-01", "2000-12"]),
        "full_year": full_year_months(TEST),
    }
    months = [
        (name, role, month, month_window(month).start, month_window(month).end)
        for name, split in splits.items()
        for role, of_role in (
            ("train", split.train), ("validation", (split.validation,)), ("test", (split.test,))
        )
        for month in of_role
    ]
    table = spark.createDataFrame(
        months, "split string, role string, month string, start timestamp_ntz, stop timestamp_ntz"
    )
    tx = purchase_log(spark, sf)
    per_month = tx.groupBy(F.date_format("updated_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return table.join(per_month, "month", "left").fillna(0, ["n"]).select(
        "split", "role", "month", "start", "stop", "n"
    )


def _tx(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: step(purchase_log(spark, sf))


CUTOFF = month_window(TEST).start

INGEST: dict[str, Query] = {
    "i01_transactions": lambda spark, sf: purchase_log(spark, sf, NAME, blanks=True),
    "i02_items_dedup": lambda spark, sf: catalogue(spark, sf, NAME),
    "i04_month_series": i04_month_series,
    "i05_history_before": _tx(lambda tx: U.history_before(tx, CUTOFF)),
    "i06_recent_slice": _tx(lambda tx: U.recent(tx, CUTOFF, 90)),
    "i07_active_users": _tx(lambda tx: U.active_users(tx, month_window(TEST))),
    "i08_sampled_users": _tx(lambda tx: U.active_users(tx, month_window(TEST), SAMPLE)),
    "i09_users_before": _tx(lambda tx: U.users_before(tx, CUTOFF)),
    "i10_truth_users": i10_truth_users,
    "i11_truth_json": i11_truth_json,
    "i11_truth_brackets": i11_truth_brackets,
    "i12_month_truth": i12_month_truth,
    "i13_split_months": i13_split_months,
}

# --- candidates ---------------------------------------------------------------


def c05_user_location(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    return _test(spark, sf, item)[1].places.select(USER, LOC)


def c13_cobuy_pairs(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    ledger, audience = _test(spark, sf, item)
    return C.cobuy_pairs(ledger, C.anchors(ledger, audience))


def day_bills(spark: SparkSession, sf: str, item: str) -> DataFrame:
    """Items of large bills: those of a whole day and a seventh of the orders."""
    lines = U.recent(purchase_log(spark, sf, item), CUTOFF, SMALL.personal_days)
    day = F.concat_ws("/", F.to_date("updated_date"), F.pmod(F.col("bill_id"), F.lit(7)))
    return lines.where("bill_id IS NOT NULL").select(day.alias("bill_id"), ITEM).distinct()


def c13_cobuy_all_anchors(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    """Large bills split into chunks of 500 pairs, for every item as an anchor."""
    bills = day_bills(spark, sf, item)
    return shared_bill_counts(bills, bills.select(ITEM).distinct(), SMALL.cobuy_top, 500)


def c17_kept_lists(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    """All candidates from lists that an earlier run has kept; none is built a second time."""
    tx, window, root = purchase_log(spark, sf, item), month_window(TEST), scratch_path(spark, "lists")
    meta, users = catalogue(spark, sf, item), U.active_users(tx, window)
    first = ListBook(spark, root)
    C.build_candidates(tx, users, window.start, meta, SMALL, first)
    again = ListBook(spark, root)
    made = C.build_candidates(tx, users, window.start, meta, SMALL, again)
    if again.built or not first.built:
        raise AssertionError(f"lists were built again: {again.built}")
    return made


def candidates(
    spark: SparkSession,
    sf: str,
    month: str = TEST,
    items: bool = True,
    item: str = NAMED,
    params: CandidateParams = SMALL,
) -> DataFrame:
    tx, window = purchase_log(spark, sf, item), month_window(month)
    meta = catalogue(spark, sf, item) if items else None
    return C.build_candidates(tx, U.active_users(tx, window), window.start, meta, params)


CANDIDATES: dict[str, Query] = _on_parts({
    "c01_personal": _source(C.personal),
    "c02_repeat_all": _source(C.repeat_all),
    "c03_global": _source(C.popular_everywhere),
    "c04_recent_global": _source(C.recently_popular),
    "c05_user_location": c05_user_location,
    "c06_location": _source(C.popular_at_place),
    "c07_recent_location": _source(C.recently_popular_at_place),
    "c08_user_categories": _source(
        lambda led, aud: C.user_attributes(led, aud, CAT, led.params.user_categories)
    ),
    "c09_recent_category": _source(C.popular_in_categories),
    "c10_user_brands": _source(
        lambda led, aud: C.user_attributes(led, aud, BRAND, led.params.user_brands)
    ),
    "c11_recent_brand": _source(C.popular_in_brands),
    "c12_anchors": _source(C.anchors),
    "c13_cobuy_pairs": c13_cobuy_pairs,
    "c13_cobuy_all_anchors": c13_cobuy_all_anchors,
    "c14_cobuy": _source(C.bought_together),
    "c15_candidates": candidates,
    "c15_candidates_fine": partial(candidates, item=PART, params=CandidateParams()),
    "c16_candidates_no_items": partial(candidates, items=False),
    "c17_kept_lists": c17_kept_lists,
})

# --- features -------------------------------------------------------------------


def f06_item_meta(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    ledger, audience = _test(spark, sf, item)
    return Fe.item_meta(C.popular_everywhere(ledger, audience), ledger.items)


def _user_attribute(attribute: str) -> Query:
    return lambda spark, sf, item=NAMED: Fe.user_attribute_features(
        _test(spark, sf, item)[1], attribute
    )


def _feature(
    step: Callable[[Ledger, Audience], DataFrame], items: bool = True
) -> Query:
    return lambda spark, sf, item=NAMED: rounded(step(*_test(spark, sf, item, items)))


def features(
    spark: SparkSession, sf: str, month: str = TEST, items: bool = True, item: str = NAMED
) -> DataFrame:
    tx = purchase_log(spark, sf, item)
    meta = catalogue(spark, sf, item) if items else None
    users = U.active_users(tx, month_window(month))
    return rounded(monthly.month_features(tx, users, month, meta, RUN))


FEATURE_QUERIES: dict[str, Query] = _on_parts({
    "f01_pair": _feature(Fe.pair_features, items=False),
    "f02_user": _feature(Fe.user_features, items=False),
    "f03_user_location": _feature(Fe.user_location_features, items=False),
    "f04_item": _feature(lambda led, aud: Fe.item_features(led), items=False),
    "f05_location_item": _feature(lambda led, aud: Fe.location_item_features(led), items=False),
    "f06_item_meta": f06_item_meta,
    "f07_user_cat_l1": _user_attribute(ATTRIBUTES[0]),
    "f08_user_cat_l2": _user_attribute(ATTRIBUTES[1]),
    "f09_user_cat_l3": _user_attribute(ATTRIBUTES[2]),
    "f10_user_category": _user_attribute(CAT),
    "f11_user_brand": _user_attribute(BRAND),
    "f12_category": _feature(lambda led, aud: Fe.category_features(led)),
    "f13_location_category": _feature(lambda led, aud: Fe.location_category_features(led)),
    "f14_features": features,
    "f15_features_no_items": partial(features, items=False),
})

# --- training sets ----------------------------------------------------------------


def labelled(
    spark: SparkSession, sf: str, item: str = NAMED, month: str = VALIDATION
) -> DataFrame:
    """Candidates of a month with their labels."""
    tx = purchase_log(spark, sf, item)
    pairs = candidates(spark, sf, month, item=item)
    return D.add_labels(tx, pairs, month_window(month)).withColumn(D.MONTH, F.lit(month))


def _sampled(spark: SparkSession, sf: str, item: str) -> tuple[DataFrame, DataFrame]:
    both = labelled(spark, sf, item, TRAIN[0]).unionByName(labelled(spark, sf, item, TRAIN[1]))
    full = stored(both, "labelled")
    return full, D.downsample_negatives(full, RUN.negative_ratio, RUN.seed)


def d01_labels(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    return labelled(spark, sf, item).select(USER, ITEM, D.LABEL)


def d02_downsample(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    return _sampled(spark, sf, item)[1].select(USER, ITEM, D.MONTH, D.LABEL)


def month_rows(
    spark: SparkSession, sf: str, month: str = VALIDATION, item: str = NAMED
) -> DataFrame:
    tx, meta = purchase_log(spark, sf, item), catalogue(spark, sf, item)
    return monthly.month_dataset(tx, month, meta, RUN)


def _shown(df: DataFrame) -> DataFrame:
    return rounded(df.select(USER, ITEM, D.MONTH, D.LABEL, *FEATURES))


def d03_month_dataset(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    return _shown(month_rows(spark, sf, item=item))


def d04_train_frame(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    tx, meta = purchase_log(spark, sf, item), catalogue(spark, sf, item)
    return _shown(monthly.train_frame(tx, TRAIN, meta, RUN))


def d05_rank_groups(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    return D.rank_groups(stored(labelled(spark, sf, item), "labelled")).select(
        USER, ITEM, D.LABEL, "group_size"
    )


def d06_class_weight(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    return rounded(D.class_weight(labelled(spark, sf, item)))


def d07_dataset_summary(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    return D.dataset_summary(*_sampled(spark, sf, item))


TRAINING: dict[str, Query] = _on_parts({
    "d01_labels": d01_labels,
    "d02_downsample": d02_downsample,
    "d03_month_dataset": d03_month_dataset,
    "d04_train_frame": d04_train_frame,
    "d05_rank_groups": d05_rank_groups,
    "d06_class_weight": d06_class_weight,
    "d07_dataset_summary": d07_dataset_summary,
})

# --- ranking and evaluation -----------------------------------------------------


@dataclass(frozen=True)
class CountScorer:
    """A fixed score that both engines can compute."""

    is_probability: bool = False
    best_trees: int | None = None

    def fit(self, train: DataFrame, validation: DataFrame | None = None, trees: int | None = None):
        return self

    def score(self, df: DataFrame) -> DataFrame:
        count, sources = F.col("ui_tx_count").cast("double"), F.col(SOURCE_COUNT)
        return df.withColumn("score", F.round(count + sources / F.lit(100.0), 2))


# Whole numbers from every grain, so that their sum is exact.
COUNTED = (
    "ui_tx_count", "ui_last_days", "u_tx_count", "u_bill_nunique", "u_location_tx_count",
    "i_user_nunique", "i_tx_90d", "loc_i_tx_count", "u_cat_l1_tx_count", "u_cat_l2_tx_90d",
    "u_cat_l3_tx_count", "u_category_tx_count", "u_brand_tx_90d", "category_tx_30d",
    "loc_category_tx_count", "candidate_cobuy", SOURCE_COUNT,
)


class SumScorer(CountScorer):
    """The sum of features of every grain."""

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", sum((F.col(c).cast("double") for c in COUNTED), F.lit(0.0)))


def scored(
    spark: SparkSession,
    sf: str,
    item: str = NAMED,
    month: str = VALIDATION,
    universe: str = "active",
    truth_users: DataFrame | None = None,
) -> DataFrame:
    """Labelled candidates of a month under the fixed score."""
    tx, meta = purchase_log(spark, sf, item), catalogue(spark, sf, item)
    window = month_window(month)
    ledger = open_ledger(tx, window.start, meta, SMALL, stored=True, for_features=False)
    users = U.target_users(tx, window, universe, truth_users)
    audience = open_audience(ledger, users, stored=True)
    pairs = C.candidates_from(ledger, audience)
    counts = audience.pairs.select(USER, ITEM, F.col("n_all").alias("ui_tx_count"))
    rows = pairs.join(counts, [USER, ITEM], "left").fillna(0, ["ui_tx_count"])
    ranked = CountScorer().score(D.add_labels(tx, rows, window))
    return stored(ranked.select(USER, ITEM, D.LABEL, "score"), "scored")


def _as_probability(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.col("score") / (F.col("score") + F.lit(1.0)))


def r01_scored_month(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    tx, meta = purchase_log(spark, sf, item), catalogue(spark, sf, item)
    users = U.active_users(tx, month_window(VALIDATION))
    rows = monthly.score_month(SumScorer(), tx, users, VALIDATION, meta, RUN)
    return rows.select(USER, ITEM, "score")


def r02_topk(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    return R.top_k(scored(spark, sf, item)).select(USER, ITEM, "rank", "score")


def _joined(lists: DataFrame) -> DataFrame:
    return lists.select(USER, F.array_join("items", ",").alias("items"))


def r03_all_history_topk(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    return _joined(R.as_lists(R.top_k(scored(spark, sf, item, TEST, "history"))))


def r03_truth_topk(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    """Lists for the users of a ground-truth file."""
    users = S.users_from_truth(spark, _truth_file(spark, sf))
    return _joined(R.as_lists(R.top_k(scored(spark, sf, item, TEST, "truth", users))))


def r04_written_lists(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    path = scratch_path(spark, "lists")
    R.write_recommendations(R.as_lists(R.top_k(scored(spark, sf, item))), path)
    return R.read_recommendations(spark, path)


def r04_resumed_lists(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    """Lists written by parts of the users in two sittings."""
    path, rows = scratch_path(spark, "parts"), scored(spark, sf, item)

    def make(users: DataFrame) -> DataFrame:
        return R.as_lists(R.top_k(rows.join(users, USER, "left_semi")))

    for at_most in (2, None):
        write_in_parts(rows.select(USER).distinct(), make, path, parts=4, tag=TEST, at_most=at_most)
    return read_parts(spark, path)


def r05_rekeyed(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of a file with number and text keys, re-keyed, written and read again."""
    path = scratch_path(spark, "rekeyed")
    R.write_rekeyed(R.rekey(S.lists_from_json(spark, _truth_file(spark, sf, guests=True))), path)
    return R.read_rekeyed(spark, path)


def _lists_and_truth(spark: SparkSession, sf: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Lists for all users with history; the truth also holds first-time users."""
    truth = U.month_truth(purchase_log(spark, sf, item), month_window(VALIDATION))
    return R.top_k(scored(spark, sf, item, VALIDATION, "history")), truth


def _list_metric(name: str) -> Query:
    def query(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
        return rounded(E.list_metrics(*_lists_and_truth(spark, sf, item)).select(USER, name))

    return query


def _of_scored(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf, item=NAMED: rounded(step(scored(spark, sf, item)))


def e01_coverage(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    truth = U.month_truth(purchase_log(spark, sf, item), month_window(VALIDATION))
    return rounded(E.candidate_coverage(candidates(spark, sf, VALIDATION, item=item), truth))


def e07_eval_summary(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    return rounded(E.evaluate_lists(*_lists_and_truth(spark, sf, item)))


def e12_month_report(spark: SparkSession, sf: str, item: str = NAMED) -> DataFrame:
    truth = U.month_truth(purchase_log(spark, sf, item), month_window(VALIDATION))
    return rounded(monthly.month_report(_as_probability(scored(spark, sf, item)), truth))


RANKING: dict[str, Query] = _on_parts({
    "r01_scored_month": r01_scored_month,
    "r02_topk": r02_topk,
    "r03_all_history_topk": r03_all_history_topk,
    "r03_truth_topk": r03_truth_topk,
    "r04_written_lists": r04_written_lists,
    "e01_coverage": e01_coverage,
    "e02_precision_at_10": _of_scored(E.precision_at_k),
    "e03_iou": _list_metric("iou"),
    "e04_mrr": _list_metric("reciprocal_rank"),
    "e05_precision_k": _list_metric("precision"),
    "e06_map": _list_metric("average_precision"),
    "e07_eval_summary": e07_eval_summary,
    "e08_log_loss": _of_scored(lambda df: E.log_loss(_as_probability(df))),
    "e09_average_precision": _of_scored(E.average_precision),
    "e10_ndcg_at_10": _of_scored(E.ndcg_at_k),
    "e12_month_report": e12_month_report,
})
RANKING["r05_rekeyed"] = r05_rekeyed
RANKING["r04_resumed_lists"] = r04_resumed_lists

# --- scorers --------------------------------------------------------------------


def _scores(make: Callable[[], object]) -> Query:
    """Train on one month, score the next: all its pairs, and whether each has a score that
    is a number (for a classifier from 0 to 1)."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        tx, meta = purchase_log(spark, sf), catalogue(spark, sf)
        tx = open_timeline(tx, (TRAIN[1], VALIDATION), SMALL)
        fitted = make().fit(monthly.month_dataset(tx, TRAIN[1], meta, RUN))
        rows = monthly.full_month(tx, VALIDATION, meta, RUN)
        score = F.col("score")
        fits = score.isNotNull() & ~F.isnan(score)
        if fitted.is_probability:
            fits = fits & score.between(0.0, 1.0)
        return fitted.score(rows).select(USER, ITEM, fits.alias("scored"))

    return query


FEW = M.TreeParams(trees=5)


def _gradients(step: Callable[[DataFrame], DataFrame]) -> Query:
    """Gradients where the margins are the fixed score."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = scored(spark, sf).withColumnRenamed("score", G.MARGIN)
        return rounded(step(rows).select(USER, ITEM, G.GRAD, G.HESS))

    return query


def _root_splits(step: Callable[[DataFrame], DataFrame], params: M.TreeParams) -> Query:
    """The best first split of every feature over a whole month, from margins of zero: the limit
    up to which rows go left, how many do, and the gain. Features that gain nothing are left out."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = monthly.full_month(purchase_log(spark, sf), VALIDATION, catalogue(spark, sf), RUN)
        cuts = B.cuts_for(rows)
        placed = stored(B.binned(rows, cuts), "root-rows")
        data = placed.select(USER, ITEM, B.CODES).join(step(placed), [USER, ITEM])
        sums = B.passes(data, ROOT_SCALE)(B.Shape(), [0])[0]
        size = B.GrowParams(params.depth, params.leaves, params.child_weight, params.child_rows, params.l2)
        found = []
        for f, name in enumerate(FEATURES):
            split = B.best_split(sums, np.array([f]), ROOT_SCALE, size)
            if split:
                found.append((name, float(cuts[f][split.code]), split.left[2], split.gain))
        made = spark.createDataFrame(found, "feature string, upto double, left_rows bigint, gain double")
        return made.select("feature", F.round("upto", 3).alias("upto"), "left_rows", F.round("gain", 6).alias("gain"))

    return query


# At margins of zero gradients are multiples of a quarter.
ROOT_SCALE = 4.0


def m05_normal_equations(spark: SparkSession, sf: str) -> DataFrame:
    """Of every feature, whether its product with the residuals of least squares on the rows it
    was fitted on is zero (against the lengths of feature and label), as of the best fit."""
    rows = stored(month_rows(spark, sf, TRAIN[1]), "normal-equations")
    fitted = M.make_scorer("linear_regression").fit(rows).score(rows)
    off = F.col(D.LABEL).cast("double") - F.col("score")
    sums = fitted.withColumn("_off", off).agg(
        *[
            (
                F.sum(F.col(f).cast("double") * F.col("_off"))
                / F.greatest(
                    F.sqrt(F.sum(F.col(f).cast("double") ** 2) * F.sum(F.col(D.LABEL).cast("double"))),
                    F.lit(1e-9),
                )
            ).alias(f)
            for f in FEATURES
        ]
    )
    long = sums.unpivot([], list(FEATURES), "feature", "product")
    return long.select("feature", (F.abs("product") < 1e-3).alias("orthogonal"))


def _closed(spark: SparkSession, sf: str) -> monthly.RunResult:
    """A whole run under the fixed score, its lists compared with the test month."""
    tx, meta = purchase_log(spark, sf), catalogue(spark, sf)
    truth = U.month_truth(tx, month_window(TEST))
    months = SplitMonths(TRAIN, VALIDATION, TEST)
    return monthly.run(
        tx, months, CountScorer(), meta, RUN, "truth", truth=truth, evaluate_test=True
    )


def m09_run(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(_closed(spark, sf).lists)


def m09_report(spark: SparkSession, sf: str) -> DataFrame:
    """Validation, test-month evaluation, and the coverage of the delivered candidates."""
    result = _closed(spark, sf)
    parts = {
        "validation": result.validation_report,
        "test": result.test_report,
        "delivered": result.coverage.withColumn("precision_at_k", F.lit(None).cast("double")),
    }
    out = [rounded(df).withColumn("part", F.lit(n)) for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def m09_list_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_closed(spark, sf).list_report)


def m09_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run with a trained scorer: train, validate, refit, recommend."""
    tx, meta = purchase_log(spark, sf), catalogue(spark, sf)
    months = SplitMonths(TRAIN, VALIDATION, TEST)
    scorer = M.make_scorer("linear_regression")
    return _joined(monthly.run(tx, months, scorer, meta, RUN, universe="active").lists)


SCORERS: dict[str, Query] = {
    "m01_gbt_scores": _scores(lambda: M.make_scorer("boosted_trees", "binary", FEW)),
    "m01_gbt_wide_scores": _scores(lambda: M.make_scorer("boosted_trees_wide", "binary", FEW)),
    "m01_root_splits": _root_splits(lambda rows: G.logistic(rows, 3.0), M.TreeParams()),
    "m01_wide_root_splits": _root_splits(
        lambda rows: G.logistic(rows, 3.0), M.TreeParams(**M.WIDE)
    ),
    "m03_root_splits": _root_splits(G.pairwise, M.TreeParams()),
    "m01_gradients": _gradients(lambda rows: G.logistic(rows, 3.0)),
    "m03_pairwise_scores": _scores(lambda: M.make_scorer(objective="rank_pairwise", params=FEW)),
    "m03_gradients": _gradients(G.pairwise),
    "m04_ndcg_scores": _scores(lambda: M.make_scorer(objective="rank_ndcg", params=FEW)),
    "m04_gradients": _gradients(G.ndcg),
    "m05_linear_scores": _scores(lambda: M.make_scorer("linear_regression")),
    "m05_normal_equations": m05_normal_equations,
    "m09_run": m09_run,
    "m09_report": m09_report,
    "m09_list_report": m09_list_report,
    "m09_recommendations": m09_recommendations,
}

# --- association ----------------------------------------------------------------


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return stored(A.value_counts(month_rows(spark, sf)), "value-counts")


REPORT_DIGITS = 6


def _six(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f.name), REPORT_DIGITS).alias(f.name)
            if f.dataType.simpleString() == "double"
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _statistic(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: _six(step(_counts(spark, sf)))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return A.feature_report(month_rows(spark, sf))


def _report_rows(report: DataFrame) -> DataFrame:
    means = ("mean_positive", "mean_negative", "mean_delta")
    return _six(report.withColumns({m: F.round(m, 3) for m in means}))


def a09_months_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report over three months, its counts kept and added up."""
    tx, meta = purchase_log(spark, sf), catalogue(spark, sf)
    params = replace(RUN, lists=scratch_path(spark, "association"))
    return _report_rows(association_report(tx, (*TRAIN, VALIDATION), meta, params))


def p05_report_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The report written as CSV and read back."""
    path = scratch_path(spark, "report")
    report = _report(spark, sf)
    A.write_report(report, path)
    return _report_rows(spark.read.option("header", True).schema(report.schema).csv(path))


ASSOCIATION: dict[str, Query] = {
    "a01_pearson": _statistic(A.pearson),
    "a02_spearman": _statistic(A.spearman),
    "a03_auc": _statistic(A.auc),
    "a04_ap": _statistic(A.precision_lift),
    "a05_rates": _statistic(A.rates),
    "a06_means": lambda spark, sf: A.class_means(_counts(spark, sf)).select(
        A.FEATURE, *[F.round(c, 3).alias(c) for c in ("mean_positive", "mean_negative", "mean_delta")]
    ),
    "a07_density": _statistic(A.density),
    "a08_feature_status": lambda spark, sf: A.feature_report(month_rows(spark, sf)).select(
        A.FEATURE, "status", "reason"
    ),
    "a09_feature_report": lambda spark, sf: _report_rows(A.sorted_report(_report(spark, sf))),
    "a09_months_report": a09_months_report,
    "a10_status_counts": lambda spark, sf: A.status_counts(_report(spark, sf)),
    "a10_usable": lambda spark, sf: _report_rows(A.usable_features(_report(spark, sf))),
    "a10_inspect": lambda spark, sf: _report_rows(A.features_to_inspect(_report(spark, sf))),
    "a11_absent_columns": lambda spark, sf: _report_rows(
        A.feature_report(
            month_rows(spark, sf).drop("ui_tx_count"), ("ui_tx_count", "i_tx_count", "not_there")
        )
    ),
    "p05_report_csv": p05_report_csv,
}

# --- profiling and comparison ----------------------------------------------------

PROFILED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _tables(step: Callable[[DataFrame], DataFrame], *names: str) -> Query:
    """``step`` on each table, with the table's name."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        tables = [read(spark, sf, n) for n in names]
        tune(spark, *tables)
        parts = [step(t).withColumn("table_name", F.lit(n)) for t, n in zip(tables, names)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return query


def _countable(df: DataFrame) -> DataFrame:
    """Columns whose values both engines write alike."""
    return df.select(*[c for c, t in df.dtypes if t in ("string", "int", "bigint")])


def _compared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and orders with some customers changed and some removed."""
    tune(spark)
    left = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    changed = F.expr(
        "CASE WHEN o_orderkey % 77 = 0 THEN NULL"
        " WHEN o_orderkey % 50 = 0 THEN o_custkey + 1 ELSE o_custkey END"
    )
    return left, left.withColumn("o_custkey", changed)


def q01_kept_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The line items as a folder that grows: first the older shipments, then all others."""
    tune(spark)
    data, book = scratch_path(spark, "growing"), scratch_path(spark, "facts")
    lines = read(spark, sf, "lineitem")
    older = F.coalesce(F.col("l_shipdate") < F.lit("1996-01-01"), F.lit(False))
    for part in (older, ~older):
        lines.where(part).write.mode("append").parquet(data)
        K.refresh(spark, data, book)
    made = K.kept_profile(spark, data, book).where("min IS NOT NULL")
    # Four digits: means of cents may lie halfway between two numbers of six.
    rounded_to = [F.round(c, 4).alias(c) for c in ("mean", "std")]
    return made.select("column_name", "row_count", "null_count", "min", "max", *rounded_to)


PAIR = ["o_orderkey", "o_custkey"]

PROFILE: dict[str, Query] = {
    "q01_profile": _tables(lambda t: Q.column_profile(t).drop("type"), *PROFILED),
    "q01_kept_profile": q01_kept_profile,
    "q02_numeric": _tables(Q.numeric_summary, *PROFILED),
    "q03_datetime": _tables(Q.datetime_range, *PROFILED),
    "q04_text": _tables(Q.text_summary, *PROFILED),
    "q05_top_values": _tables(lambda t: Q.top_values(_countable(t)), *PROFILED),
    "q06_overview": _tables(Q.table_overview, *PROFILED),
    "q07_schema": _tables(lambda t: Q.schema_table(t).drop("nullable"), *PROFILED),
    "q07_types": _tables(Q.type_distribution, *PROFILED),
    "q07_files": lambda spark, sf: Q.file_table(spark, f"{sf}/orders.parquet").select(
        "file_name", "row_count"
    ),
    "q08_positional_diff": lambda spark, sf: Q8.positional_summary(
        *_compared(spark, sf), "o_orderkey", PAIR
    ),
    "q08_positional_sample": lambda spark, sf: Q8.positional_sample(
        *_compared(spark, sf), "o_orderkey", PAIR
    ),
    "q09_multiset_diff": lambda spark, sf: Q8.multiset_diff(*_compared(spark, sf), PAIR),
    "q10_preview": lambda spark, sf: Q.preview(read(tune(spark), sf, "orders"), ["o_orderkey"]),
}

QUERIES: dict[str, Query] = {
    **INGEST,
    **CANDIDATES,
    **FEATURE_QUERIES,
    **TRAINING,
    **RANKING,
    **SCORERS,
    **ASSOCIATION,
    **PROFILE,
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Top items per active user of the test month from all candidates and features."""
    tx, meta = purchase_log(spark, sf), catalogue(spark, sf)
    users = U.active_users(tx, month_window(TEST))
    rows = monthly.score_month(CountScorer(), tx, users, TEST, meta, RunParams())
    return R.top_k(rows.select(USER, ITEM, "score")).select(USER, ITEM, "rank", "score")
