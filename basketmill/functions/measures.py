"""One set of additive measures, rolled up to whatever grain is needed.

``lift`` turns each history row into its measures; ``rollup`` sums them by any
keys. A rollup of a rollup equals the rollup of the rows, so every grain can be
taken from the finest one at hand. All measures are numbers or timestamps, which
keeps the hash aggregate with its map-side combine: a hot key shrinks to one row
per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmill.columns import DATE, DISCOUNT, ITEM, LOC, PRICE, QTY, USER
from basketmill.functions.time import back_sql

# The look-back windows of the features, in days.
FEATURE_WINDOWS = (7, 30, 90)

FIRST, LAST = "first_date", "last_date"

SPEND = f"coalesce({PRICE}, 0D) * coalesce({QTY}, 0D)"
DISCOUNTED = f"coalesce({DISCOUNT}, 0D)"
NET = f"greatest({SPEND} - {DISCOUNTED}, 0D)"


# What a row of the log adds to its totals, whatever the cutoff.
AMOUNTS = {
    "n_price": f"CAST({PRICE} IS NOT NULL AS BIGINT)",
    "n_discount": f"CAST({DISCOUNT} IS NOT NULL AS BIGINT)",
    "n_qty": f"CAST({QTY} IS NOT NULL AS BIGINT)",
    "sum_price": PRICE,
    "sum_qty": QTY,
    "sum_spend": SPEND,
    "sum_discount": DISCOUNTED,
    "sum_net": NET,
    FIRST: DATE,
    LAST: DATE,
}


def lift(history: DataFrame, cutoff: datetime, windows: Iterable[int] = ()) -> DataFrame:
    """Each history row as (user, item, location) and its measures.

    A history of totals, which have the columns of ``AMOUNTS`` and ``n_all`` already, is lifted
    likewise if all rows of a total are on the same side of the cutoff and of each window."""
    days = sorted({*FEATURE_WINDOWS, *windows})
    totals = "n_all" in history.columns
    when, rows, qty = (FIRST, "n_all", "sum_qty") if totals else (DATE, "1L", QTY)
    return history.selectExpr(
        USER,
        ITEM,
        LOC,
        f"{rows} AS n_all",
        *[f"CASE WHEN {when} >= {back_sql(cutoff, d)} THEN {rows} ELSE 0L END AS n_{d}" for d in days],
        f"CASE WHEN {when} >= {back_sql(cutoff, 90)} THEN {qty} END AS sum_qty_90",
        *[name if totals else f"{amount} AS {name}" for name, amount in AMOUNTS.items()],
    )


def total(measure: str) -> str:
    how = {FIRST: "min", LAST: "max"}.get(measure, "sum")
    return f"{how}({measure}) AS {measure}"


def rollup(df: DataFrame, keys: list[str], measures: list[str], *extra: str) -> DataFrame:
    """Total the measures of ``df`` by ``keys``; ``extra`` are further aggregates."""
    return df.groupBy(*keys).agg(*[F.expr(e) for e in (*map(total, measures), *extra)])
