"""Whole months: datasets, scored pairs, validation and recommendations.

A log is a table of purchases or a timeline of it; plans over several months open one."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmill.columns import ITEM, USER
from basketmill.config import RunParams, SplitMonths
from basketmill.functions.time import month_window
from basketmill.operators import metrics, ranking, training
from basketmill.operators.candidates import candidates_from
from basketmill.operators.features import features_from
from basketmill.operators.ledger import Audience, Ledger, open_audience, open_ledger
from basketmill.operators.listbook import ListBook
from basketmill.operators.outbox import PARTS, write_in_parts
from basketmill.operators.timeline import Timeline, open_timeline
from basketmill.operators.users import active_users, month_truth, target_users
from basketmill.session import stored

# Seed of the first train month and the step to the next.
TRAIN_SEED, SEED_STEP = 42, 10_000


Log = DataFrame | Timeline


def rows_of(tx: Log) -> DataFrame:
    """(user, item, date) for questions about months."""
    return tx.rows if isinstance(tx, Timeline) else tx


def _opened(
    tx: Log, users: DataFrame, month: str, items: DataFrame | None, params: RunParams
) -> tuple[Ledger, Audience]:
    """The stored ledger as of the month's first instant, and the users' part of it. Item lists
    are kept in the folder ``params.lists``, if there is one."""
    cutoff = month_window(month).start
    book = ListBook(users.sparkSession, params.lists, params.refresh_lists) if params.lists else None
    if isinstance(tx, Timeline):
        ledger = tx.ledger(cutoff, items, params.candidates, book=book)
    else:
        ledger = open_ledger(tx, cutoff, items, params.candidates, stored=True, book=book)
    return ledger, open_audience(ledger, users, stored=True)


def month_features(
    tx: Log,
    users: DataFrame,
    month: str,
    items: DataFrame | None = None,
    params: RunParams = RunParams(),
) -> DataFrame:
    """Candidates and their features for the users, as of the month's first instant."""
    ledger, audience = _opened(tx, users, month, items, params)
    return features_from(ledger, audience, candidates_from(ledger, audience))


def _labelled(
    tx: Log, users: DataFrame, month: str, items: DataFrame | None, params: RunParams
) -> tuple[Ledger, Audience, DataFrame]:
    """The ledger, the users and their candidates with labels, still without features."""
    window = month_window(month)
    ledger, audience = _opened(tx, users, month, items, params)
    # A candidate without an item has no profile and so no features.
    pairs = candidates_from(ledger, audience).where(F.col(ITEM).isNotNull())
    labelled = training.add_labels(rows_of(tx), pairs, window)
    return ledger, audience, labelled.withColumn(training.MONTH, F.lit(month))


def _with_features(ledger: Ledger, audience: Audience, labelled: DataFrame) -> DataFrame:
    rows = features_from(ledger, audience, labelled, (training.LABEL, training.MONTH))
    return stored(training.narrow_features(rows), "month")


def full_month(
    tx: Log,
    month: str,
    items: DataFrame | None = None,
    params: RunParams = RunParams(),
    max_users: int | None = None,
) -> DataFrame:
    """Labelled rows of users active in the month (all, or a sample), features narrowed; stored."""
    users = active_users(rows_of(tx), month_window(month), max_users)
    return _with_features(*_labelled(tx, users, month, items, params))


def month_dataset(
    tx: Log,
    month: str,
    items: DataFrame | None = None,
    params: RunParams = RunParams(),
) -> DataFrame:
    """A train month: labelled rows of its users with their negatives sampled; stored. Negatives
    are sampled by user, item and label, so features are only joined to the rows that stay."""
    users = active_users(rows_of(tx), month_window(month), params.max_train_users)
    ledger, audience, labelled = _labelled(tx, users, month, items, params)
    pairs = stored(labelled, "labelled")
    kept = training.downsample_negatives(pairs, params.negative_ratio, params.seed)
    return _with_features(ledger, audience, kept)


def train_frame(
    tx: Log,
    months: tuple[str, ...],
    items: DataFrame | None = None,
    params: RunParams = RunParams(),
    first_seed: int = TRAIN_SEED,
) -> DataFrame:
    """All train months, each sampled with its own seed; an error if there are no rows. However
    many months there are, the log is summed once."""
    tx = tx if isinstance(tx, Timeline) else open_timeline(tx, months, params.candidates)
    parts = [
        month_dataset(tx, month, items, replace(params, seed=first_seed + i * SEED_STEP))
        for i, month in enumerate(months)
    ]
    frame = stored(reduce(DataFrame.unionByName, parts), "train")
    if frame.isEmpty():
        raise ValueError("no training rows: choose months with history before them")
    return frame


def score_month(
    scorer,
    tx: Log,
    users: DataFrame,
    month: str,
    items: DataFrame | None = None,
    params: RunParams = RunParams(),
) -> DataFrame:
    """Every candidate of the users with its score."""
    rows = training.narrow_features(month_features(tx, users, month, items, params))
    return scorer.score(rows)


def recommend(
    scorer,
    tx: Log,
    month: str,
    items: DataFrame | None = None,
    params: RunParams = RunParams(),
    universe: str = "history",
    truth_users: DataFrame | None = None,
) -> DataFrame:
    """The best ``k`` items of every user of the chosen universe, one row per user."""
    users = target_users(rows_of(tx), month_window(month), universe, truth_users, params.max_test_users)
    scored = score_month(scorer, tx, users, month, items, params)
    return ranking.as_lists(ranking.top_k(scored, params.k))


def recommend_in_parts(
    scorer,
    tx: Log,
    month: str,
    path: str,
    items: DataFrame | None = None,
    params: RunParams = RunParams(),
    universe: str = "history",
    truth_users: DataFrame | None = None,
    parts: int = PARTS,
    at_most: int | None = None,
) -> int:
    """As ``recommend``, but written to ``path`` by parts of the users; a run that died goes on
    where it stopped (``write_in_parts``). Gives how many parts are left."""
    tx = tx if isinstance(tx, Timeline) else open_timeline(tx, (month,), params.candidates)
    users = target_users(rows_of(tx), month_window(month), universe, truth_users, params.max_test_users)

    def make(some: DataFrame) -> DataFrame:
        scored = score_month(scorer, tx, some, month, items, params)
        return ranking.as_lists(ranking.top_k(scored, params.k))

    return write_in_parts(users, make, path, parts, f"{month}|{universe}|{params.k}", at_most)


def _rows_of_users(rows: DataFrame, users: DataFrame) -> DataFrame:
    """The users' rows; the user may be null, as in a truth table."""
    own = users.select(F.col(USER).alias("_user"))
    return rows.join(own, F.col(USER).eqNullSafe(F.col("_user")), "left_semi")


def month_report(
    scored: DataFrame, truth: DataFrame, k: int = 10, with_log_loss: bool = True
) -> DataFrame:
    """One row on labelled, scored pairs: coverage, precision and (classifiers) log loss."""
    report = metrics.candidate_coverage(scored, truth)
    precision = metrics.precision_at_k(scored, k).select("precision_at_k")
    report = report.withColumn("precision_at_k", precision.scalar())
    if with_log_loss:
        report = report.withColumn(
            "log_loss", metrics.log_loss(scored).select("log_loss").scalar()
        )
    return report


def evaluate_month(
    scorer,
    tx: Log,
    month: str,
    items: DataFrame | None = None,
    params: RunParams = RunParams(),
    rows: DataFrame | None = None,
    max_users: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The month's report and its recommendations, for its active users (all, or a
    sample). ``rows`` saves building them again."""
    window = month_window(month)
    rows = full_month(tx, month, items, params, max_users) if rows is None else rows
    scored = stored(scorer.score(rows), "scored")
    truth = month_truth(rows_of(tx), window, active_users(rows_of(tx), window, max_users))
    report = month_report(scored, truth, params.k, scorer.is_probability)
    return report, ranking.as_lists(ranking.top_k(scored, params.k))


@dataclass(frozen=True)
class RunResult:
    """What a run gives: each report is one row, ``lists`` one row per user.

    ``coverage`` holds the test month's candidates against its truth, ``list_report`` the
    delivered lists against it, and ``test_report`` the month's evaluation; each is null
    unless asked for, as none exists for a month still to come.
    """

    validation_report: DataFrame
    lists: DataFrame
    coverage: DataFrame | None = None
    list_report: DataFrame | None = None
    test_report: DataFrame | None = None


def run(
    tx: Log,
    months: SplitMonths,
    scorer,
    items: DataFrame | None = None,
    params: RunParams = RunParams(),
    universe: str = "history",
    refit: bool = True,
    truth: DataFrame | None = None,
    evaluate_test: bool = False,
) -> RunResult:
    """Train, validate, refit on both, recommend for the test month, and close the run.

    ``truth`` (user, item) is the test month's ground truth, where it is known: candidates
    and lists are then compared with it, and the universe ``truth`` means its users.
    ``evaluate_test`` evaluates the test month from the log, as validation does.
    """
    tx = open_timeline(tx, (*months.train, months.validation, months.test), params.candidates)
    train = train_frame(tx, months.train, items, params)
    validation = full_month(tx, months.validation, items, params, params.max_validation_users)
    fitted = scorer.fit(train, validation)
    report, _ = evaluate_month(
        fitted, tx, months.validation, items, params, validation, params.max_validation_users
    )
    if refit:
        fitted = scorer.fit(train.unionByName(validation), trees=fitted.best_trees)
    truth_users = None if truth is None else truth.select(USER).distinct()
    users = target_users(
        tx.rows, month_window(months.test), universe, truth_users, params.max_test_users
    )
    rows = None
    if evaluate_test:
        # A candidate and its features hang on no other user: both sets are served at once.
        users = stored(users, "test-users")
        active = active_users(tx.rows, month_window(months.test), params.max_test_users)
        active = stored(active, "test-active")
        both = users.unionByName(active).distinct()
        rows = _with_features(*_labelled(tx, both, months.test, items, params))
        made = fitted.score(_rows_of_users(rows, users))
    else:
        made = score_month(fitted, tx, users, months.test, items, params)
    scored = stored(made.select(USER, ITEM, "score"), "test-scored")
    ranked = ranking.top_k(scored, params.k)
    result = RunResult(report, ranking.as_lists(ranked))
    if truth is not None:
        result = replace(
            result,
            coverage=metrics.candidate_coverage(scored, truth),
            list_report=metrics.evaluate_lists(ranked, truth, params.k),
        )
    if evaluate_test:
        tested, _ = evaluate_month(
            fitted, tx, months.test, items, params, _rows_of_users(rows, active), params.max_test_users
        )
        result = replace(result, test_report=tested)
    return result
