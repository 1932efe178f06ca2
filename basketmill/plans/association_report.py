"""Feature/label association over the sampled datasets of any set of months.

A month is counted by (feature, value) on its own, and the counts of months add up to those of
all their rows, so a report over more months reads the counts of the months it shares with an
earlier one. With a folder in ``params.lists`` they are kept there from run to run; only months
without kept counts are built, from a timeline that is opened if there are any.
"""

from __future__ import annotations

from dataclasses import asdict, replace
from functools import cache

from pyspark.sql import DataFrame

from basketmill.config import RunParams
from basketmill.operators.association import (
    Thresholds,
    merged,
    positive_rate,
    report_of_counts,
    value_counts,
)
from basketmill.operators.ledger import list_facts
from basketmill.operators.listbook import ListBook
from basketmill.operators.timeline import Timeline, open_timeline
from basketmill.plans.monthly import SEED_STEP, month_dataset
from basketmill.session import stored

# This report's own first seed and size of the popular lists.
REPORT_SEED, REPORT_POPULAR = 2026, 120


def report_params(params: RunParams = RunParams()) -> RunParams:
    lists = replace(
        params.candidates, global_top=REPORT_POPULAR, recent_global_top=REPORT_POPULAR
    )
    return replace(params, candidates=lists)


def month_counts(
    tx: DataFrame,
    months: tuple[str, ...],
    items: DataFrame | None = None,
    params: RunParams = RunParams(),
    first_seed: int = REPORT_SEED,
    refresh: bool = False,
) -> list[DataFrame]:
    """Stored counts of each month; months are numbered in the order given, which names their
    samples."""
    book = ListBook(tx.sparkSession, params.lists, refresh) if params.lists else None
    facts = list_facts(tx, items) if book else {}

    @cache
    def timeline() -> Timeline:
        return open_timeline(tx, months, params.candidates)

    def counted(number: int, month: str) -> DataFrame:
        own = replace(params, seed=first_seed + number * SEED_STEP)

        def build() -> DataFrame:
            return value_counts(month_dataset(timeline(), month, items, own))

        if book is None:
            return stored(build(), f"counts-{month}")
        sizes = {k: v for k, v in asdict(own).items() if k not in ("lists", "refresh_lists")}
        return book.keep("value-counts", {**facts, **sizes, "month": month}, build)

    return [counted(i, month) for i, month in enumerate(months)]


def association_report(
    tx: DataFrame,
    months: tuple[str, ...],
    items: DataFrame | None = None,
    params: RunParams | None = None,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """One row per feature over all the months; an error if they have no rows."""
    parts = month_counts(tx, months, items, params or report_params())
    counts = stored(merged(parts), "value-counts")
    if counts.isEmpty():
        raise ValueError("no rows: choose months with history before them")
    return report_of_counts(counts, positive_rate(counts), limits=limits)
