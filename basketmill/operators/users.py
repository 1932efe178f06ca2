"""Slices of the log by time, and the user sets to score."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmill.columns import DATE, ITEM, USER
from basketmill.functions.relational import hash_order, smallest_hashes
from basketmill.functions.time import MonthWindow, back_sql, ntz_sql

SAMPLE_SEED = 42


def history_before(tx: DataFrame, cutoff: datetime) -> DataFrame:
    return tx.where(f"{DATE} < {ntz_sql(cutoff)}")


def recent(history: DataFrame, cutoff: datetime, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the cutoff, first instant included."""
    return history.where(f"{DATE} >= {back_sql(cutoff, days)} AND {DATE} < {ntz_sql(cutoff)}")


def in_month(tx: DataFrame, month: MonthWindow) -> DataFrame:
    return tx.where(f"{DATE} >= {ntz_sql(month.start)} AND {DATE} < {ntz_sql(month.end)}")


def sample_users(users: DataFrame, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly ``min(n, all)`` users, the same ones on every run."""
    one = users.withColumn("_all", F.lit(1))
    quota = users.sparkSession.range(1).select(F.lit(1).alias("_all"), F.lit(n).alias("quota"))
    return smallest_hashes(one, hash_order(seed, USER), quota, ["_all"]).select(USER)


def _capped(users: DataFrame, max_users: int | None) -> DataFrame:
    return sample_users(users, max_users) if max_users else users


def active_users(tx: DataFrame, month: MonthWindow, max_users: int | None = None) -> DataFrame:
    """Users with a purchase in the month. As a test set this looks ahead: a
    deployment scores ``users_before`` instead."""
    return _capped(in_month(tx, month).select(USER).distinct(), max_users)


def users_before(tx: DataFrame, cutoff: datetime, max_users: int | None = None) -> DataFrame:
    return _capped(history_before(tx, cutoff).select(USER).distinct(), max_users)


def month_truth(tx: DataFrame, month: MonthWindow, users: DataFrame | None = None) -> DataFrame:
    """Distinct (user, item) bought in the month, for the given users or all."""
    bought = in_month(tx, month).select(USER, ITEM).distinct()
    return bought if users is None else bought.join(users, USER, "left_semi")


def target_users(
    tx: DataFrame,
    month: MonthWindow,
    universe: str = "active",
    truth_users: DataFrame | None = None,
    max_users: int | None = None,
) -> DataFrame:
    """The users to predict: ``active``, ``history`` or ``truth``."""
    if universe == "history":
        return users_before(tx, month.start, max_users)
    if universe == "truth" and truth_users is not None:
        return _capped(truth_users, max_users)
    if universe not in ("active", "truth"):
        raise ValueError(f"unknown user universe: {universe}")
    return active_users(tx, month, max_users)
