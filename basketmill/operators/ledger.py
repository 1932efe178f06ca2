"""The log as of one cutoff, summed once and read by every source and feature.

``cube`` holds the measures by (user, item, location), ``pairs`` by (user, item),
``by_item`` by item and ``by_place`` by (known location, item); ``pairs`` and
``by_item`` also carry the item's catalogue attributes. Kept lazy, they cost
nothing until read; ``stored`` writes the cube and the two totals with many readers,
so that the log is summed once for all of a month's candidates and features. ``pairs``
is read by ``by_item`` and by the audience only, which stores its users' part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmill.columns import ATTRIBUTES, BILL, ITEM, LOC, USER
from basketmill.config import CandidateParams
from basketmill.functions.measures import LAST, lift, rollup
from basketmill.operators.listbook import Facts, ListBook, input_digest
from basketmill.operators.users import history_before, recent
from basketmill import session

NEW_BILLS = "new_bills"
USERS, USERS_90 = "users_all", "users_90"


@dataclass(frozen=True)
class Ledger:
    cutoff: datetime
    params: CandidateParams
    items: DataFrame | None
    # (user, new_bills), to be added up, and the (bill, item) of the personal window.
    bills: DataFrame
    lines: DataFrame
    cube: DataFrame
    pairs: DataFrame
    # Totals that are taken (and stored) when they are first asked for.
    item_totals: Callable[[], DataFrame]
    place_totals: Callable[[], DataFrame]
    # Where lists are kept from run to run, and what they hang on besides their own sizes.
    book: ListBook | None = None
    facts: Facts = field(default_factory=dict)

    @property
    def by_item(self) -> DataFrame:
        return self.item_totals()

    @property
    def by_place(self) -> DataFrame:
        return self.place_totals()

    def listed(self, name: str, build: Callable[[], DataFrame], **facts: object) -> DataFrame:
        """A list by name: from the book where it holds one for these facts, else built."""
        if self.book is None:
            return build()
        return self.book.keep(name, {**self.facts, **facts}, build)

    @property
    def recent_rows(self) -> str:
        return f"n_{self.params.recent_days}"

    @property
    def personal_rows(self) -> str:
        return f"n_{self.params.personal_days}"

    def user_location(self, users: DataFrame | None = None) -> DataFrame:
        """The place of each user's latest row, which may be unknown (null).

        Of several places at the latest instant the highest number counts,
        unknown being lowest. ``place_rows`` and ``place_last`` are the user's
        rows and latest row there; both are null at an unknown place.
        """
        visits = rollup(self.cube, [USER, LOC], ["n_all", LAST])
        if users is not None:
            visits = visits.join(users, USER, "left_semi")
        visit = f"max_by(struct({LOC}, n_all, {LAST}), struct({LAST}, {LOC})) AS visit"
        return (
            visits.groupBy(USER)
            .agg(F.expr(visit))
            .selectExpr(
                USER,
                f"visit.{LOC}",
                f"CASE WHEN visit.{LOC} IS NOT NULL THEN visit.n_all END AS place_rows",
                f"CASE WHEN visit.{LOC} IS NOT NULL THEN visit.{LAST} END AS place_last",
            )
        )


@dataclass(frozen=True)
class Totals:
    """The lifted rows without users, by (item, location), and how many users they are of: rows of
    (item, users_all, users_90) and of (known location, item, users_all). All are to be added up."""

    rows: DataFrame
    item_users: DataFrame
    place_users: DataFrame


@dataclass(frozen=True)
class Audience:
    """The users to serve (distinct), their pairs of the ledger, and their places.

    ``stored`` writes the users, who come from the log, and their pairs, which nearly
    every source and feature reads."""

    users: DataFrame
    pairs: DataFrame
    places: DataFrame


def open_audience(ledger: Ledger, users: DataFrame, stored: bool = False) -> Audience:
    if stored:
        users = session.stored(users, "users")
    pairs = ledger.pairs.join(users, USER, "left_semi")
    places = ledger.user_location(users)
    if stored:
        pairs = session.stored(pairs, "user-pairs")
    return Audience(users, pairs, places)


def with_attributes(df: DataFrame, items: DataFrame | None) -> DataFrame:
    """Add catalogue attributes by item; nulls where there is no catalogue."""
    if items is None:
        return df.selectExpr("*", *[f"CAST(NULL AS STRING) AS {a}" for a in ATTRIBUTES])
    return df.join(items.select(ITEM, *ATTRIBUTES), ITEM, "left")


def open_ledger(
    tx: DataFrame,
    cutoff: datetime,
    items: DataFrame | None = None,
    params: CandidateParams = CandidateParams(),
    stored: bool = False,
    for_features: bool = True,
    book: ListBook | None = None,
) -> Ledger:
    """``for_features=False`` leaves out the measures that only features read. With a ``book``,
    item lists of the same cutoff, log and catalogue are kept there and taken from there."""
    facts = list_facts(tx, items) if book else {}
    history = history_before(tx, cutoff)
    # A line without a bill counts as one more bill: distinct keeps the null.
    bills = history.select(USER, BILL).distinct().select(USER, F.lit(1).cast("bigint").alias(NEW_BILLS))
    lines = recent(history, cutoff, params.personal_days).where(F.col(BILL).isNotNull()).select(BILL, ITEM)
    rows = lift(history, cutoff, (params.recent_days, params.personal_days))
    return ledger_of(rows, cutoff, items, params, bills, lines, stored, for_features, book, facts)


def list_facts(tx: DataFrame, items: DataFrame | None) -> Facts:
    """What lists hang on besides the cutoff: the log and the catalogue."""
    return {"log": input_digest(tx), "catalogue": None if items is None else input_digest(items)}


def _with_users(
    df: DataFrame, keys: list[str], measures: list[str], own: DataFrame, users: dict[str, str]
) -> DataFrame:
    """Totals of ``df`` by the keys, and of ``users``, expressions on ``own`` with its row per user.

    If that is another table, the two are added up together: measures are summed before they are
    shuffled, and only what tells users apart is shuffled row by row."""
    if not users or own is df:
        return rollup(df, keys, measures, *[f"sum({e}) AS {u}" for u, e in users.items()])
    types = dict(df.dtypes)
    totals = df.selectExpr(*keys, *measures, *[f"0L AS {u}" for u in users])
    counts = own.selectExpr(
        *keys, *[f"CAST(NULL AS {types[m]}) AS {m}" for m in measures], *[f"{e} AS {u}" for u, e in users.items()]
    )
    return rollup(totals.unionByName(counts), keys, measures, *[f"sum({u}) AS {u}" for u in users])


def ledger_of(
    rows: DataFrame,
    cutoff: datetime,
    items: DataFrame | None,
    params: CandidateParams,
    bills: DataFrame,
    lines: DataFrame,
    stored: bool = False,
    for_features: bool = True,
    book: ListBook | None = None,
    facts: Facts | None = None,
    totals: Totals | None = None,
) -> Ledger:
    """The ledger of lifted ``rows``. Where they come from a stored table that has ``totals`` too,
    the rows serve as the cube and the totals are added up from those."""

    def kept(df: DataFrame, label: str) -> DataFrame:
        return session.stored(df, label) if stored else df

    measures = rows.columns[3:]
    item_users = {USERS: "1L", USERS_90: "CAST(n_90 > 0 AS BIGINT)"}
    if not for_features:
        measures = [f"n_{d}" for d in sorted({params.recent_days, params.personal_days})]
        measures, item_users = ["n_all", *measures, LAST], {}
    cube = rows if totals else kept(rollup(rows, [USER, ITEM, LOC], measures), "cube")
    # Unstored tables are read once: from the rows is a shuffle less than via the cube.
    bare = rollup(cube if stored else rows, [USER, ITEM], measures)
    pairs = with_attributes(bare, items)

    @cache
    def by_item() -> DataFrame:
        if totals:
            summed = _with_users(totals.rows, [ITEM], measures, totals.item_users, {u: u for u in item_users})
        else:
            # A row of ``bare`` is one user of the item.
            own = rollup(cube, [USER, ITEM], ["n_90"]) if stored and item_users else bare
            summed = _with_users(cube if stored else bare, [ITEM], measures, own, item_users)
        return kept(with_attributes(summed, items), "by-item")

    @cache
    def by_place() -> DataFrame:
        known = (totals.rows if totals else cube).where(F.col(LOC).isNotNull())
        # A row of a cube is one user at the place.
        own, users = (totals.place_users, USERS) if totals else (known, "1L")
        return kept(_with_users(known, [LOC, ITEM], measures, own, {USERS: users}), "by-place")

    facts = {"cutoff": cutoff.isoformat(), **(facts or {})}
    return Ledger(cutoff, params, items, bills, lines, cube, pairs, by_item, by_place, book, facts)
