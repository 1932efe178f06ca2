"""Point-in-time features of (user, item) pairs.

One table per grain, each a rollup of the ledger. Tables of the same key are
merged before they meet the pairs: all that depends on the item, the user's
place or both is one profile per (place, item), all that depends on the user
alone is one row per user. The pairs are then joined nine times, the last five
(customer and attribute) by one shuffle by customer.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmill.columns import (
    ATTRIBUTES,
    CAT,
    FEATURES,
    ITEM,
    LOC,
    USER,
    USER_ATTRIBUTE_PREFIX,
)
from basketmill.config import CandidateParams
from basketmill.functions.measures import FIRST, LAST, rollup
from basketmill.functions.time import whole_days_sql
from basketmill.operators.ledger import NEW_BILLS, Audience, Ledger, open_audience, open_ledger
from basketmill.session import stored


def _ratio(top: str, bottom: str) -> str:
    """``top / (bottom + 1)``; null where the divisor is zero (a sum of refunds)."""
    return f"try_divide(CAST({top} AS DOUBLE), {bottom} + 1D)"


# --- one table per grain --------------------------------------------------------


def pair_features(ledger: Ledger, audience: Audience) -> DataFrame:
    base = audience.pairs.selectExpr(
        USER,
        ITEM,
        "n_all AS ui_tx_count",
        "sum_qty AS ui_qty_sum",
        "sum_spend AS ui_spend_sum",
        "sum_discount AS ui_discount_sum",
        "sum_net AS ui_net_spend_sum",
        "try_divide(sum_price, n_price) AS ui_avg_price",
        "try_divide(sum_discount, n_discount) AS ui_avg_discount",
        "try_divide(sum_qty, n_qty) AS ui_avg_qty",
        f"{whole_days_sql(LAST, ledger.cutoff)} AS ui_last_days",
        f"{whole_days_sql(FIRST, ledger.cutoff)} AS ui_first_days",
        "n_7 AS ui_tx_7d",
        "n_30 AS ui_tx_30d",
        "n_90 AS ui_tx_90d",
        "sum_qty_90 AS ui_qty_90d",
    )
    return base.selectExpr(
        "*",
        f"{_ratio('ui_discount_sum', 'ui_spend_sum')} AS ui_discount_rate",
        "ui_first_days - ui_last_days AS ui_active_span_days",
        f"{_ratio('ui_net_spend_sum', 'ui_tx_count')} AS ui_net_spend_per_tx",
        "(ui_first_days - ui_last_days) / CAST(greatest(ui_tx_count - 1, 1) AS DOUBLE)"
        " AS ui_repeat_interval_days",
    )


def user_features(ledger: Ledger, audience: Audience) -> DataFrame:
    own = ledger.bills.join(audience.users, USER, "left_semi")
    bills = own.groupBy(USER).agg(F.sum(NEW_BILLS).alias("u_bill_nunique"))
    sums = ["sum_qty", "sum_spend", "sum_discount", "sum_net", "sum_price"]
    counts = ["n_all", "n_30", "n_90", "n_price", "n_discount"]
    base = rollup(audience.pairs, [USER], counts + sums, "count(1) AS items").selectExpr(
        USER,
        "n_all AS u_tx_count",
        "items AS u_item_nunique",
        "sum_qty AS u_qty_sum",
        "sum_spend AS u_spend_sum",
        "sum_discount AS u_discount_sum",
        "sum_net AS u_net_spend_sum",
        "try_divide(sum_price, n_price) AS u_avg_price",
        "try_divide(sum_discount, n_discount) AS u_avg_discount",
        "n_30 AS u_tx_30d",
        "n_90 AS u_tx_90d",
    )
    return base.join(bills, USER).selectExpr(
        "*",
        f"{_ratio('u_discount_sum', 'u_spend_sum')} AS u_discount_rate",
        f"{_ratio('u_tx_count', 'u_bill_nunique')} AS u_tx_per_bill",
        f"{_ratio('u_tx_30d', 'u_tx_count')} AS u_recent_30_share",
        f"{_ratio('u_tx_90d', 'u_tx_count')} AS u_recent_90_share",
    )


def user_location_features(ledger: Ledger, audience: Audience) -> DataFrame:
    return audience.places.selectExpr(
        USER,
        LOC,
        "place_rows AS u_location_tx_count",
        f"{whole_days_sql('place_last', ledger.cutoff)} AS u_location_last_days",
    )


def item_features(ledger: Ledger) -> DataFrame:
    return ledger.by_item.selectExpr(
        ITEM,
        "n_all AS i_tx_count",
        "users_all AS i_user_nunique",
        "sum_qty AS i_qty_sum",
        "try_divide(sum_qty, n_qty) AS i_avg_qty",
        "n_30 AS i_tx_30d",
        "n_90 AS i_tx_90d",
        "users_90 AS i_user_90d",
        f"{_ratio('n_30', 'n_all')} AS i_recent_30_share",
    )


def location_item_features(ledger: Ledger) -> DataFrame:
    """(location, item), unknown locations left out."""
    return ledger.by_place.selectExpr(
        LOC,
        ITEM,
        "n_all AS loc_i_tx_count",
        "n_all AS loc_item_tx_count",
        "users_all AS loc_item_user_nunique",
        "sum_qty AS loc_i_qty_sum",
        "n_30 AS loc_item_tx_30d",
        "n_90 AS loc_i_tx_90d",
        "n_90 AS loc_item_tx_90d",
        "sum_qty_90 AS loc_i_qty_90d",
        f"{_ratio('n_90', 'n_all')} AS loc_item_recent_share",
    )


def item_meta(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Catalogue columns of each candidate pair."""
    return pairs.select(USER, ITEM).join(items, ITEM, "left")


def user_attribute_features(audience: Audience, attribute: str) -> DataFrame:
    """A user's rows per value of one catalogue attribute."""
    prefix = USER_ATTRIBUTE_PREFIX[attribute]
    known = audience.pairs.where(F.col(attribute).isNotNull())
    return rollup(known, [USER, attribute], ["n_all", "n_90"]).selectExpr(
        USER, attribute, f"n_all AS {prefix}_tx_count", f"n_90 AS {prefix}_tx_90d"
    )


def category_features(ledger: Ledger) -> DataFrame:
    known = ledger.by_item.where(F.col(CAT).isNotNull())
    return rollup(known, [CAT], ["n_all", "n_30", "n_90"]).selectExpr(
        CAT,
        "n_all AS category_tx_count",
        "n_30 AS category_tx_30d",
        "n_90 AS category_tx_90d",
    )


def location_category_features(ledger: Ledger) -> DataFrame:
    known = ledger.by_place.join(ledger.items.select(ITEM, CAT), ITEM)
    return rollup(known.where(F.col(CAT).isNotNull()), [LOC, CAT], ["n_all", "n_90"]).selectExpr(
        LOC, CAT, "n_all AS loc_category_tx_count", "n_90 AS loc_category_tx_90d"
    )


# --- assembly -------------------------------------------------------------------


PLACE = f"coalesce(CAST({LOC} AS STRING), 'unknown') AS place"


def _profiles(ledger: Ledger, keys: DataFrame) -> DataFrame:
    """One row per wanted (location or unknown, item): all facts of the two."""
    profile = keys.join(item_features(ledger), ITEM, "left").join(
        location_item_features(ledger), [LOC, ITEM], "left"
    )
    if ledger.items is not None:
        profile = profile.join(ledger.items, ITEM, "left")
        profile = profile.join(category_features(ledger), CAT, "left")
        profile = profile.join(location_category_features(ledger), [LOC, CAT], "left")
    return profile.selectExpr("*", PLACE).drop(LOC)


# share = numerator / (denominator + 1), taken before nulls become 0.
SHARES = {
    "ui_share_of_user_tx": ("ui_tx_count", "u_tx_count"),
    "ui_share_of_item_tx": ("ui_tx_count", "i_tx_count"),
    "ui_share_of_user_qty": ("ui_qty_sum", "u_qty_sum"),
    "ui_share_of_item_qty": ("ui_qty_sum", "i_qty_sum"),
    "u_cat_l1_share": ("u_cat_l1_tx_count", "u_tx_count"),
    "u_cat_l2_share": ("u_cat_l2_tx_count", "u_tx_count"),
    "u_cat_l3_share": ("u_cat_l3_tx_count", "u_tx_count"),
    "u_category_share": ("u_category_tx_count", "u_tx_count"),
    "u_brand_share": ("u_brand_tx_count", "u_tx_count"),
    "user_item_price_ratio": ("ui_avg_price", "u_avg_price"),
    "item_catalog_user_price_ratio": ("item_catalog_price", "u_avg_price"),
    "category_item_tx_share": ("i_tx_count", "category_tx_count"),
    "category_item_recent_share": ("i_tx_90d", "category_tx_90d"),
    "loc_i_share_of_item_tx": ("loc_i_tx_count", "i_tx_count"),
    "loc_item_share_of_item_tx": ("loc_item_tx_count", "i_tx_count"),
}


def features_from(
    ledger: Ledger, audience: Audience, candidates: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(user, item), the 94 features and the columns to ``keep``; one row per candidate of the
    audience. A row's features hang on no other candidate."""
    users = user_features(ledger, audience).join(user_location_features(ledger, audience), USER)
    base = stored(candidates.join(users, USER, "left").selectExpr("*", PLACE), "candidate-users")
    profiles = _profiles(ledger, base.select(LOC, ITEM).distinct())
    wide = base.join(profiles, ["place", ITEM])
    wide = wide.join(pair_features(ledger, audience), [USER, ITEM], "left")
    if ledger.items is not None:
        # Dealt by customer on both sides the wide rows move once for all joins below; left to the
        # planner they move for each, by customer and attribute, as the narrow totals do.
        wide = wide.repartition(USER)
        for attribute in ATTRIBUTES:
            own = user_attribute_features(audience, attribute).repartition(USER)
            wide = wide.join(own, [USER, attribute], "left")
    present = set(wide.columns)

    def value(feature: str) -> str:
        if feature in present:
            return feature
        top, bottom = SHARES.get(feature, (feature, feature))
        # Without a catalogue its features are zero.
        return _ratio(top, bottom) if {top, bottom} <= present else "0D"

    return wide.selectExpr(USER, ITEM, *[f"coalesce({value(f)}, 0) AS {f}" for f in FEATURES], *keep)


def add_features(
    tx: DataFrame,
    candidates: DataFrame,
    cutoff: datetime,
    items: DataFrame | None = None,
    params: CandidateParams = CandidateParams(),
) -> DataFrame:
    """Features of the candidates from the whole log before ``cutoff``."""
    ledger = open_ledger(tx, cutoff, items, params, stored=True)
    users = candidates.select(USER).distinct()
    return features_from(ledger, open_audience(ledger, users, stored=True), candidates)
