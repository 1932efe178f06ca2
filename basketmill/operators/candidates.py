"""Candidate items per user, from nine sources, as of a cutoff.

Every source returns (user, item). Item lists (what is popular globally, per
place, category or brand, and bought together) are taken over all users' rows;
a list is kept as one short array per key, so that joining it to the users does
not multiply rows before the shuffle.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmill.columns import BRAND, CAT, ITEM, LOC, SOURCE_COUNT, SOURCES, USER
from basketmill.config import CandidateParams
from basketmill.functions.measures import LAST, rollup
from basketmill.functions.relational import top_per
from basketmill.operators.cobuy import ANCHOR, CO_ITEM, COUNT, shared_bill_counts
from basketmill.operators.ledger import Audience, Ledger, open_audience, open_ledger
from basketmill.operators.listbook import ListBook, set_digest

PAIR_SCHEMA = f"{USER} bigint, {ITEM} string"


def _no_pairs(ledger: Ledger) -> DataFrame:
    return ledger.cube.sparkSession.createDataFrame([], PAIR_SCHEMA)


def _often_then_latest(rows: str, tie: str) -> list[Column]:
    return [F.col(rows).desc(), F.col(LAST).desc(), F.col(tie)]


# --- a user's own purchases -------------------------------------------------


def _own_items(audience: Audience, rows: str, top: int) -> DataFrame:
    own = audience.pairs.select(USER, ITEM, rows, LAST).where(F.col(rows) > 0)
    return top_per(own, [USER], _often_then_latest(rows, ITEM), top, "_rank").select(USER, ITEM)


def personal(ledger: Ledger, audience: Audience) -> DataFrame:
    return _own_items(audience, ledger.personal_rows, ledger.params.personal_top)


def repeat_all(ledger: Ledger, audience: Audience) -> DataFrame:
    return _own_items(audience, "n_all", ledger.params.personal_top)


def anchors(ledger: Ledger, audience: Audience) -> DataFrame:
    return _own_items(audience, ledger.recent_rows, ledger.params.anchors)


# --- popular items ----------------------------------------------------------


def popular_items(ledger: Ledger, rows: str, top: int) -> DataFrame:
    """The ``top`` items over all users as one row holding an array."""

    def build() -> DataFrame:
        bought = ledger.by_item.where(F.col(rows) > 0)
        ranked = bought.orderBy(F.col(rows).desc(), F.col(ITEM)).limit(top)
        return ranked.agg(F.sort_array(F.collect_list(ITEM)).alias("items"))

    return ledger.listed("popular", build, rows=rows, top=top)


def _to_every_user(users: DataFrame, items: DataFrame) -> DataFrame:
    # The array is a scalar subquery: no join, and at most ``top`` values travel.
    listed = users.select(USER, items.scalar().alias("items"))
    return listed.select(USER, F.explode_outer("items").alias(ITEM)).where(F.col(ITEM).isNotNull())


def popular_everywhere(ledger: Ledger, audience: Audience) -> DataFrame:
    return _to_every_user(audience.users, popular_items(ledger, "n_all", ledger.params.global_top))


def recently_popular(ledger: Ledger, audience: Audience) -> DataFrame:
    top = ledger.params.recent_global_top
    return _to_every_user(audience.users, popular_items(ledger, ledger.recent_rows, top))


# --- items popular at a key: place, category, brand ---------------------------


def _as_lists(ranked: DataFrame, key: str) -> DataFrame:
    return ranked.groupBy(key).agg(F.collect_list(ITEM).alias("items"))


def place_items(ledger: Ledger, rows: str, top: int) -> DataFrame:
    def build() -> DataFrame:
        bought = ledger.by_place.where(F.col(rows) > 0)
        order = [F.col(rows).desc(), F.col(ITEM)]
        return _as_lists(top_per(bought, [LOC], order, top, "_rank"), LOC)

    return ledger.listed("by-place", build, rows=rows, top=top)


def attribute_items(ledger: Ledger, attribute: str, top: int) -> DataFrame:
    rows = ledger.recent_rows

    def build() -> DataFrame:
        bought = ledger.by_item.where((F.col(rows) > 0) & F.col(attribute).isNotNull())
        order = _often_then_latest(rows, ITEM)
        return _as_lists(top_per(bought, [attribute], order, top, "_rank"), attribute)

    return ledger.listed(f"by-{attribute}", build, rows=rows, top=top)


def _offer(keyed_users: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    joined = keyed_users.select(USER, key).join(lists, key)
    return joined.select(USER, F.explode("items").alias(ITEM))


def popular_at_place(ledger: Ledger, audience: Audience) -> DataFrame:
    lists = place_items(ledger, "n_all", ledger.params.location_top)
    return _offer(audience.places, lists, LOC)


def recently_popular_at_place(ledger: Ledger, audience: Audience) -> DataFrame:
    lists = place_items(ledger, ledger.recent_rows, ledger.params.recent_location_top)
    return _offer(audience.places, lists, LOC)


def user_attributes(ledger: Ledger, audience: Audience, attribute: str, top: int) -> DataFrame:
    """The attribute values a user bought most in the recent window."""
    rows = ledger.recent_rows
    own = audience.pairs.where((F.col(rows) > 0) & F.col(attribute).isNotNull())
    counted = rollup(own, [USER, attribute], [rows, LAST])
    order = _often_then_latest(rows, attribute)
    return top_per(counted, [USER], order, top, "_rank").select(USER, attribute)


def popular_in_categories(ledger: Ledger, audience: Audience) -> DataFrame:
    own = user_attributes(ledger, audience, CAT, ledger.params.user_categories)
    return _offer(own, attribute_items(ledger, CAT, ledger.params.category_top), CAT)


def popular_in_brands(ledger: Ledger, audience: Audience) -> DataFrame:
    own = user_attributes(ledger, audience, BRAND, ledger.params.user_brands)
    return _offer(own, attribute_items(ledger, BRAND, ledger.params.brand_top), BRAND)


# --- bought together ----------------------------------------------------------


def baskets(ledger: Ledger) -> DataFrame:
    return ledger.lines.distinct()


def cobuy_pairs(ledger: Ledger, own_anchors: DataFrame) -> DataFrame:
    """The best partners of the anchors; a kept list hangs on which items these are."""
    params, wanted = ledger.params, own_anchors.select(ITEM).distinct()

    def build() -> DataFrame:
        return shared_bill_counts(baskets(ledger), wanted, params.cobuy_top, params.pairs_per_chunk)

    if ledger.book is None:
        return build()
    anchors_digest = set_digest(wanted, ITEM)
    return ledger.listed(
        "cobuy", build, anchors=anchors_digest, days=params.personal_days, top=params.cobuy_top
    )


def bought_together(ledger: Ledger, audience: Audience) -> DataFrame:
    own_anchors = anchors(ledger, audience)
    partners = (
        cobuy_pairs(ledger, own_anchors)
        .groupBy(ANCHOR)
        .agg(F.collect_list(F.struct(CO_ITEM, COUNT)).alias("partners"))
    )
    offers = own_anchors.withColumnRenamed(ITEM, ANCHOR).join(partners, ANCHOR)
    scored = (
        offers.select(USER, F.inline("partners"))
        .groupBy(USER, F.col(CO_ITEM).alias(ITEM))
        .agg(F.sum(COUNT).alias("score"))
    )
    order = [F.col("score").desc(), F.col(ITEM)]
    return top_per(scored, [USER], order, ledger.params.personal_top, "_rank").select(USER, ITEM)


# --- all sources --------------------------------------------------------------


def candidates_from(ledger: Ledger, audience: Audience) -> DataFrame:
    """Unique (user, item) with a flag per source and the number of sources."""
    params, with_items = ledger.params, ledger.items is not None
    offers = {
        "candidate_personal": (params.personal_top, lambda: personal(ledger, audience)),
        "candidate_repeat_all": (params.personal_top, lambda: repeat_all(ledger, audience)),
        "candidate_global": (params.global_top, lambda: popular_everywhere(ledger, audience)),
        "candidate_location": (
            params.location_top,
            lambda: popular_at_place(ledger, audience),
        ),
        "candidate_recent_global": (
            params.recent_global_top,
            lambda: recently_popular(ledger, audience),
        ),
        "candidate_recent_location": (
            params.recent_location_top,
            lambda: recently_popular_at_place(ledger, audience),
        ),
        "candidate_recent_category": (
            params.category_top if with_items else 0,
            lambda: popular_in_categories(ledger, audience),
        ),
        "candidate_recent_brand": (
            params.brand_top if with_items else 0,
            lambda: popular_in_brands(ledger, audience),
        ),
        "candidate_cobuy": (
            min(params.cobuy_top, params.personal_top),
            lambda: bought_together(ledger, audience),
        ),
    }
    # One bit per source: a narrow row to shuffle, and the union is a bitwise or.
    union = _no_pairs(ledger).withColumn("sources", F.lit(0))
    for bit, source in enumerate(SOURCES):
        top, offer = offers[source]
        if top > 0:
            union = union.unionByName(offer().withColumn("sources", F.lit(1 << bit)))
    merged = union.groupBy(USER, ITEM).agg(F.bit_or("sources").alias("sources"))
    return merged.selectExpr(
        USER,
        ITEM,
        *[f"shiftright(sources, {bit}) & 1 AS {source}" for bit, source in enumerate(SOURCES)],
        f"bit_count(sources) AS {SOURCE_COUNT}",
    )


def build_candidates(
    tx: DataFrame,
    users: DataFrame,
    cutoff: datetime,
    items: DataFrame | None = None,
    params: CandidateParams = CandidateParams(),
    book: ListBook | None = None,
) -> DataFrame:
    """Candidates of ``users`` (distinct) from the log before ``cutoff``; item lists that
    another run has kept in the ``book`` are not built again."""
    ledger = open_ledger(tx, cutoff, items, params, stored=True, for_features=False, book=book)
    return candidates_from(ledger, open_audience(ledger, users, stored=True))
