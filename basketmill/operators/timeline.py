"""The log summed once for any number of cutoffs.

The starts and ends of months and the starts of all look-back windows before a month cut time
into stretches. Every total is taken inside a stretch, so all of its rows are on one side of any
cutoff and of any window, and its first instant tells which. As of a cutoff the totals before it
add up to the ledger that the log itself would give; the log is not read again.

One pass over the log gives three tables: ``cube`` holds the measures by (user, item, location,
stretch), ``bills`` the number of bills by (user, stretch in which they were first seen), which makes
an exact distinct count a sum, and ``lines`` the (bill, item) of each stretch that a window may hold.
What a user buys again and again within a stretch is one row. A row of one table carries nothing
of the others.

Totals by item and by place need no users. They are summed by (location, item, stretch) once for all
cutoffs, and so are the users by the stretch in which they first bought an item (at a place): a
cutoff adds up both, and only the users of its last days are told apart anew.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmill.columns import BILL, DATE, ITEM, LOC, USER
from basketmill.config import CandidateParams
from basketmill.functions.measures import AMOUNTS, FEATURE_WINDOWS, FIRST, lift, rollup, total
from basketmill.functions.time import back_sql, month_window, ntz_sql
from basketmill.operators.ledger import NEW_BILLS, USERS, USERS_90, Ledger, Totals, ledger_of, list_facts
from basketmill.operators.listbook import ListBook
from basketmill.operators.users import history_before, recent
from basketmill.session import stored

STRETCH, KIND = "stretch", "kind"
CUBE, BILLS, LINES = [USER, ITEM, LOC, STRETCH], [USER, BILL], [BILL, ITEM, STRETCH]
KINDS = (CUBE, BILLS, LINES)


def edges_of(months: Iterable[str], params: CandidateParams) -> tuple[datetime, ...]:
    """All instants that cutoffs and windows of the months start or end at."""
    days = {*FEATURE_WINDOWS, params.recent_days, params.personal_days}
    windows = [month_window(m) for m in months]
    return tuple(
        sorted(
            {w.start for w in windows}
            | {w.end for w in windows}
            | {w.start - timedelta(days=d) for w in windows for d in days}
        )
    )


@dataclass(frozen=True)
class Timeline:
    """Totals by stretch; ``rows`` reads them as a log of (user, item, date)."""

    edges: tuple[datetime, ...]
    cube: DataFrame
    bills: DataFrame
    lines: DataFrame
    log: DataFrame

    @property
    def rows(self) -> DataFrame:
        """For questions about months: who bought what, at the stretch's first instant."""
        return self.cube.select(USER, ITEM, F.col(FIRST).alias(DATE))

    @cached_property
    def places(self) -> DataFrame:
        """The measures by (location, item, stretch); stored when they are first asked for."""
        return stored(rollup(self.cube, [LOC, ITEM, STRETCH], ["n_all", *AMOUNTS]), "timeline-places")

    @cached_property
    def new_users(self) -> DataFrame:
        """How many users bought an item (``KIND`` 1) and an item at a place (0) first in each
        stretch; stored when they are first asked for."""
        first = self.cube.groupingSets([[USER, ITEM, LOC], [USER, ITEM]], USER, ITEM, LOC).agg(
            F.min(STRETCH).alias(STRETCH), F.grouping(LOC).alias(KIND)
        )
        counts = first.groupBy(KIND, LOC, ITEM, STRETCH).agg(F.count(F.lit(1)).alias(USERS))
        return stored(counts, "timeline-users")

    def _totals(self, cutoff: datetime, windows: tuple[int, ...]) -> Totals:
        """What the ledger's totals by item and by place are added up from."""
        before = f"{FIRST} < {ntz_sql(cutoff)}"
        places = self.places.where(before).withColumn(USER, F.lit(None))

        def new(kind: int) -> DataFrame:
            # The cutoff is an edge: up to its number no row of a stretch has passed it.
            return self.new_users.where((F.col(KIND) == kind) & (F.col(STRETCH) <= self.edges.index(cutoff)))

        late = self.cube.where(f"{before} AND {FIRST} >= {back_sql(cutoff, 90)}")
        late = late.select(USER, ITEM).distinct().groupBy(ITEM).agg(F.count(F.lit(1)).alias(USERS_90))
        item_users = new(1).selectExpr(ITEM, USERS, f"0L AS {USERS_90}").unionByName(
            late.selectExpr(ITEM, f"0L AS {USERS}", USERS_90)
        )
        rows = lift(places, cutoff, windows).drop(USER)
        return Totals(rows, item_users, new(0).where(F.col(LOC).isNotNull()).select(LOC, ITEM, USERS))

    def _known(self, *moments: datetime) -> None:
        missing = set(moments) - set(self.edges)
        if missing:
            raise ValueError(f"the timeline has no edge at {sorted(missing)}; open it with the month")

    def ledger(
        self,
        cutoff: datetime,
        items: DataFrame | None = None,
        params: CandidateParams = CandidateParams(),
        for_features: bool = True,
        book: ListBook | None = None,
    ) -> Ledger:
        """The ledger as of a cutoff; its totals are stored, the rows are in the timeline."""
        windows = (params.recent_days, params.personal_days)
        self._known(cutoff, *[cutoff - timedelta(days=d) for d in {*FEATURE_WINDOWS, *windows}])
        rows = lift(self.cube.where(f"{FIRST} < {ntz_sql(cutoff)}"), cutoff, windows)
        bills = history_before(self.bills, cutoff).select(USER, NEW_BILLS)
        lines = recent(self.lines, cutoff, params.personal_days).select(BILL, ITEM)
        facts = list_facts(self.log, items) if book else {}
        totals = self._totals(cutoff, windows)
        return ledger_of(rows, cutoff, items, params, bills, lines, True, for_features, book, facts, totals)


def open_timeline(
    tx: DataFrame, months: Iterable[str], params: CandidateParams = CandidateParams()
) -> Timeline:
    """Totals of the log for the cutoffs at the starts of the months, and for the months."""
    edges = edges_of(months, params)
    passed = " + ".join(f"CAST({DATE} >= {ntz_sql(e)} AS INT)" for e in edges)
    log = history_before(tx, edges[-1]).withColumn(STRETCH, F.expr(passed))
    # One pass for all three tables: of each row one copy for each, with what that table holds only.
    of_kind = [f"{KIND} = {i}" for i in range(len(KINDS))]
    every = log.withColumn(KIND, F.explode(F.array(*[F.lit(i) for i in range(len(KINDS))])))
    # No window starts before the first edge. Lines without a bill share it with no other.
    every = every.where(f"NOT ({of_kind[2]}) OR ({BILL} IS NOT NULL AND {STRETCH} > 0)")

    def only(expression: str, *kinds: int) -> str:
        return f"CASE WHEN {' OR '.join(of_kind[i] for i in kinds)} THEN {expression} END"

    keys = (USER, ITEM, LOC, BILL, STRETCH)
    rows = every.selectExpr(
        KIND,
        *[f"{only(k, *[i for i, held in enumerate(KINDS) if k in held])} AS {k}" for k in keys],
        f"{only(STRETCH, 1)} AS seen",
        f"{only('1L', 0)} AS n_all",
        *[f"{amount if name == FIRST else only(amount, 0)} AS {name}" for name, amount in AMOUNTS.items()],
    )
    sums = rows.groupBy(KIND, *keys).agg(
        *[F.expr(e) for e in map(total, ("n_all", *AMOUNTS))], F.min("seen").alias("seen")
    )
    table = stored(sums, "timeline", (KIND,))

    def of(kind: list[str]) -> DataFrame:
        return table.where(F.col(KIND) == KINDS.index(kind))

    # A line without a bill counts as one more bill of its user.
    bills = of(BILLS).groupBy(USER, "seen").agg(F.count(F.lit(1)).alias(NEW_BILLS), F.min(FIRST).alias(DATE))
    lines = of(LINES).select(BILL, ITEM, F.col(FIRST).alias(DATE))
    return Timeline(
        edges,
        of(CUBE).select(USER, ITEM, LOC, STRETCH, "n_all", *AMOUNTS),
        stored(bills.drop("seen"), "timeline-bills"),
        lines,
        tx,
    )
