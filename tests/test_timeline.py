"""Months from one timeline equal months from the log, and the log is summed once."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketmill.columns import FEATURES, ITEM, USER
from basketmill.config import CandidateParams, RunParams, SplitMonths
from basketmill.functions.time import month_window, previous_months
from basketmill.operators import timeline as T
from basketmill.operators.association import feature_report
from basketmill import session
from basketmill.operators.ledger import open_ledger
from basketmill.operators.listbook import ListBook
from basketmill.operators.scorers import make_scorer
from basketmill.operators.training import downsample_negatives
from basketmill.operators import users as U
from basketmill.plans import association_report as R
from basketmill.plans import monthly
from basketmill.session import stored

SMALL = CandidateParams(personal_top=3, global_top=4, recent_global_top=4, location_top=3, recent_location_top=3, cobuy_top=3,
                        category_top=3, brand_top=3, recent_days=30, personal_days=100)
PARAMS = RunParams(candidates=SMALL)
MONTHS = tuple(previous_months("2025-06", 5))
ITEMS = [(f"i{i}", 1.0 + i, i % 2, 10 * i, f"a{i % 2}", f"b{i % 3}", f"c{i % 4}", f"k{i % 3}", f"m{i % 4}") for i in range(12)]


@pytest.fixture(scope="module")
def rows():
    """Purchases by day and second, on the edges of months and windows too, with nulls."""
    rnd = random.Random(12)
    start = datetime(2024, 9, 1)
    edges = T.edges_of(MONTHS, SMALL)
    out = []
    for n in range(500):
        when = start + timedelta(seconds=rnd.randrange(280 * 86400))
        if n % 5 == 0:
            when = rnd.choice(edges) + timedelta(microseconds=rnd.choice([-1, 0, 1]))
        out.append((rnd.choice([None, *range(60)]), rnd.randrange(9), f"i{rnd.randrange(12)}", when, rnd.choice([None, 2.5, 4.0]),
                    rnd.choice([None, 0.5]), rnd.choice([None, 1.0, 2.0, -1.0]), rnd.choice([None, 1, 2])))
    return out


@pytest.fixture(scope="module")
def tables(log, catalogue, rows):
    return log(rows), catalogue(ITEMS)


def shown(df):
    return sorted(
        tuple(round(v, 6) if isinstance(v, float) else v for v in r)
        for r in df.select(USER, ITEM, "label", *[F.col(f).cast("double").alias(f) for f in FEATURES]).collect()
    )


@pytest.mark.parametrize("month", [MONTHS[0], MONTHS[-1]])
def test_a_month_is_the_same_from_either(spark, tables, month):
    tx, items = tables
    timeline = T.open_timeline(tx, MONTHS, SMALL)
    want = shown(monthly.full_month(tx, month, items, PARAMS))
    assert want and shown(monthly.full_month(timeline, month, items, PARAMS)) == want
    window = month_window(month)
    for ask in (lambda t: U.active_users(t, window), lambda t: U.users_before(t, window.start), lambda t: U.month_truth(t, window)):
        assert sorted(map(tuple, ask(timeline.rows).collect())) == sorted(map(tuple, ask(tx).collect()))


def test_a_ledger_of_the_timeline_stores_totals_only(spark, tables, monkeypatch):
    """No second copy of the rows is written, and users are told apart without measures."""
    tx, items = tables
    timeline, written, write = T.open_timeline(tx, MONTHS, SMALL), [], session.stored
    monkeypatch.setattr(session, "stored", lambda df, label: written.append(label) or write(df, label))
    cutoff = month_window(MONTHS[-1]).start
    plain = open_ledger(tx, cutoff, items, SMALL)
    ledger = timeline.ledger(cutoff, items, SMALL)
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    for table in ("by_item", "by_place"):
        made, want = getattr(ledger, table), getattr(plain, table)
        names = sorted(want.columns)
        assert dict(made.dtypes) == dict(want.dtypes)
        both = [sorted((tuple(map(cell, r)) for r in t.select(names).collect()), key=str) for t in (made, want)]
        assert both[0] == both[1] and both[0]
    assert sorted(written) == ["by-item", "by-place"]


def test_all_cutoffs_share_the_totals_and_rows_hold_their_own_only(spark, tables, monkeypatch):
    """Items, places and their first users are summed once for all months; no line is kept that
    no window holds, and rows of bills and lines carry no amounts."""
    tx, items = tables
    written, write = [], T.stored
    monkeypatch.setattr(T, "stored", lambda df, label, by=(): written.append((label, write(df, label, by))) or written[-1][1])
    timeline = T.open_timeline(tx, MONTHS, SMALL)
    for month in MONTHS[-2:]:
        cutoff = month_window(month).start
        made, plain = timeline.ledger(cutoff, items, SMALL), open_ledger(tx, cutoff, items, SMALL)
        for table, key in (("by_item", [ITEM]), ("by_place", ["location", ITEM])):
            names = [*[k for k in key if k in getattr(plain, table).columns], "n_all", "n_90", "users_all"]
            both = [sorted(map(tuple, getattr(ledger, table).select(names).collect()), key=str) for ledger in (made, plain)]
            assert both[0] == both[1] and both[0]
    assert sorted(label for label, _ in written) == ["timeline", "timeline-bills", "timeline-places", "timeline-users"]
    first = T.edges_of(MONTHS, SMALL)[0]
    assert tx.where(F.col("updated_date") < F.lit(first)).count() > 0
    assert timeline.lines.count() > 0 and timeline.lines.where(F.col("updated_date") < F.lit(first)).count() == 0
    table = dict(written)["timeline"]
    assert table.where("sum_spend IS NOT NULL").count() == timeline.cube.count() < table.count()


def test_a_run_serves_and_evaluates_its_test_month_from_one_set_of_rows(spark, tables, monkeypatch):
    """Users with history and users active in the month, whose sets differ, are served together."""
    tx, items = tables
    window = month_window(MONTHS[-1])
    truth = U.month_truth(tx, window)
    params = replace(PARAMS, max_test_users=20)
    opened, real = [], monthly._opened
    monkeypatch.setattr(monthly, "_opened", lambda tx, users, month, *rest: opened.append(month) or real(tx, users, month, *rest))

    class Scorer:
        is_probability, best_trees = False, None
        fit = lambda self, *tables, **sizes: self
        score = lambda self, df: df.withColumn("score", F.round(F.col("ui_tx_count").cast("double") + F.col("u_tx_count"), 2))

    split = SplitMonths(MONTHS[-3:-2], MONTHS[-2], MONTHS[-1])
    result = monthly.run(tx, split, Scorer(), items, params, "history", truth=truth, evaluate_test=True)
    assert opened.count(MONTHS[-1]) == 1
    timeline = T.open_timeline(tx, MONTHS[-1:], SMALL)
    want, _ = monthly.evaluate_month(Scorer(), timeline, MONTHS[-1], items, params, max_users=20)
    assert result.test_report.collect() == want.collect()
    want = monthly.recommend(Scorer(), timeline, MONTHS[-1], items, params, "history")
    assert sorted(map(tuple, result.lists.collect())) == sorted(map(tuple, want.collect()))


def test_features_are_joined_to_sampled_rows_only(spark, tables, monkeypatch):
    """A train month is the sample of the whole month; rows that it drops get no features."""
    tx, items = tables
    given, features_from = [], monthly.features_from

    def spy(ledger, audience, candidates, *keep):
        given.append(candidates.count())
        return features_from(ledger, audience, candidates, *keep)

    whole = monthly.full_month(tx, MONTHS[-1], items, PARAMS)
    for ratio in (1.0, 2.0):
        want = shown(downsample_negatives(whole, ratio, PARAMS.seed))
        assert 0 < len(want) < whole.count()
        monkeypatch.setattr(monthly, "features_from", spy)
        made = monthly.month_dataset(tx, MONTHS[-1], items, replace(PARAMS, negative_ratio=ratio))
        assert made.schema == whole.schema and shown(made) == want
        assert given.pop() == len(want)


def test_the_log_is_read_as_often_for_many_months_as_for_one(spark, tables, rows):
    tx, items = tables
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = tx.mapInArrow(count, tx.schema)
    read = []
    for months in (MONTHS[-1:], MONTHS[-3:]):
        before = seen.value
        frame = monthly.train_frame(counted, months, items, PARAMS)
        assert frame.select("label_month").distinct().count() == len(months)
        read.append(seen.value - before)
    assert read[0] == read[1] == len(rows)


def test_only_months_it_was_opened_with(spark, tables):
    tx, items = tables
    timeline = T.open_timeline(tx, MONTHS[:1], SMALL)
    with pytest.raises(ValueError):
        timeline.ledger(month_window(MONTHS[2]).start, items, SMALL)
    with pytest.raises(ValueError):
        timeline.ledger(month_window(MONTHS[0]).start, items, CandidateParams(personal_days=99))


def test_an_empty_log(spark, log, catalogue):
    with pytest.raises(ValueError):
        monthly.train_frame(log([]), MONTHS, catalogue(ITEMS), PARAMS)


def test_association_of_months_adds_up_kept_counts(spark, tables, tmp_path):
    """The report of several months equals that of their rows together, and a longer one counts
    only the months that are new."""
    tx, items = tables
    tx.write.parquet(f"{tmp_path}/log")
    tx = spark.read.parquet(f"{tmp_path}/log")
    params = RunParams(candidates=SMALL, lists=f"{tmp_path}/book")
    frame = monthly.train_frame(tx, MONTHS[-2:], items, PARAMS, first_seed=R.REPORT_SEED)
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    want = rounded(feature_report(stored(frame, "frame")))
    assert rounded(R.association_report(tx, MONTHS[-2:], items, params)) == want
    book = ListBook(spark, params.lists)
    assert sorted(e["facts"]["month"] for e in book.entries() if e["name"] == "value-counts") == sorted(MONTHS[-2:])
    before = {e["path"] for e in book.entries()}
    R.month_counts(tx, (*MONTHS[-2:], MONTHS[0]), items, params)
    new = [e for e in book.entries() if e["path"] not in before]
    assert [e["facts"]["month"] for e in new if e["name"] == "value-counts"] == [MONTHS[0]]


def test_a_trained_run_equals_its_steps_in_numpy(spark, tables):
    """Least squares fitted on train months, refitted with validation, and the lists it gives."""
    tx, items = tables
    months = SplitMonths(MONTHS[-4:-2], MONTHS[-2], MONTHS[-1])
    result = monthly.run(tx, months, make_scorer("linear_regression"), items, PARAMS, universe="active")
    lists = {r.customer_id: list(r["items"]) for r in result.lists.collect()}

    def frame(df):
        made = df.select(USER, ITEM, "label", *[F.col(f).cast("float").alias(f) for f in FEATURES]).toPandas()
        return made, np.column_stack([made[list(FEATURES)].to_numpy(np.float64), np.ones(len(made))])

    train = monthly.train_frame(tx, months.train, items, PARAMS)
    validation = monthly.full_month(tx, months.validation, items, PARAMS)
    table, x = frame(train.unionByName(validation))
    weights = np.linalg.lstsq(x, table["label"].to_numpy(float), rcond=1e-11)[0]
    test, x = frame(monthly.full_month(tx, months.test, items, PARAMS))
    test["score"] = x @ weights
    assert set(lists) == set(test[USER])
    for user, rows in test.groupby(USER):
        scores = dict(zip(rows[ITEM], rows["score"]))
        want = sorted(scores, key=lambda i: (-scores[i], i))[: PARAMS.k]
        assert len(lists[user]) == len(want)
        # The same scores in the same order; items may change places where scores are equal.
        assert np.allclose([scores[i] for i in lists[user]], [scores[i] for i in want], atol=1e-4)
    train_only, x = frame(train)
    first = np.linalg.lstsq(x, train_only["label"].to_numpy(float), rcond=1e-11)[0]
    held, x = frame(validation)
    held["score"] = x @ first
    best = held.sort_values(["score", ITEM], ascending=[False, True]).groupby(USER).head(PARAMS.k)
    assert result.validation_report.first().precision_at_k == pytest.approx((best.groupby(USER)["label"].sum() / PARAMS.k).mean(), abs=0.02)
