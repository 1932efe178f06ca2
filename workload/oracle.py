"""The same results as plain SQL for DuckDB, written from the definitions.

Each statement stands alone: common tables are prefixed as WITH clauses.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from basketmill.columns import FEATURES, SOURCES
from basketmill.config import CandidateParams
from basketmill.functions.time import month_window, previous_months
from workload.queries import (
    COUNTED,
    DIGITS,
    PROFILED,
    REPORT_DIGITS,
    RUN,
    SAMPLE,
    SMALL,
    SUM_DIGITS,
    TEST,
    TRAIN,
    VALIDATION,
)
from workload.tables import NAME, NAMED, PART


def ts(moment: datetime) -> str:
    return f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S}'"


def back(cutoff: datetime, days: int) -> str:
    return ts(cutoff - timedelta(days=days))


def with_(tables: dict[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS (\n{q}\n)" for n, q in tables.items()) + "\n" + final


def digits(name: str) -> int:
    return SUM_DIGITS if name.endswith(("_sum", "qty_90d")) else DIGITS


def log_tables(item: str = NAMED, blanks: bool = False) -> dict[str, str]:
    """The purchase log and the catalogue as views over the order tables."""
    item = {
        NAMED: "p_name || ' ' || p_brand", PART: "CAST(p_partkey AS VARCHAR)", NAME: "p_name"
    }[item]
    return {
        "tx": f"""
SELECT CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_orderkey END AS bill_id,
  o_custkey AS customer_id, {item} AS item_id,
  o_orderdate + to_seconds(CAST((o_orderkey * 7919) % 86400 AS BIGINT)) AS updated_date,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE p_retailprice END AS price,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE l_discount * 100 END AS discount,
  l_quantity AS quantity,
  CASE WHEN l_suppkey % 10 = 7 THEN NULL ELSE CAST(s_nationkey AS BIGINT) END AS location
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""
        + (" WHERE o_orderkey % 211 <> 0" if blanks else ""),
        "raw_items": f"""
SELECT {item} AS item_id, p_retailprice AS item_catalog_price, p_type AS category_l1,
  split_part(p_name, ' ', 2) AS category_l2, p_name AS category_l3,
  p_type || '/' || split_part(p_name, ' ', 2) AS category,
  CASE WHEN p_size = 1 THEN NULL ELSE p_brand END AS brand,
  CAST(p_size % 3 AS TINYINT) AS item_sale_status,
  CAST(length(p_name || ' ' || p_type) AS INTEGER) AS item_description_len
FROM part""",
        "items": """
SELECT item_id, item_catalog_price, item_sale_status, item_description_len,
  category_l1, category_l2, category_l3, category, brand
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY
    item_catalog_price NULLS LAST, category_l1 NULLS LAST, category_l2 NULLS LAST,
    category_l3 NULLS LAST, category NULLS LAST, brand NULLS LAST,
    item_sale_status NULLS LAST, item_description_len NULLS LAST) AS copy
  FROM raw_items) WHERE copy = 1""",
    }


def in_month(month: str) -> str:
    window = month_window(month)
    return f"updated_date >= {ts(window.start)} AND updated_date < {ts(window.end)}"


def history_tables(month: str = TEST, universe: str = "active") -> dict[str, str]:
    cutoff = month_window(month).start
    chosen = in_month(month) if universe == "active" else f"updated_date < {ts(cutoff)}"
    return {
        "hist": f"SELECT * FROM tx WHERE updated_date < {ts(cutoff)}",
        "users": f"SELECT DISTINCT customer_id FROM tx WHERE {chosen}",
        "truth": f"SELECT DISTINCT customer_id, item_id FROM tx WHERE {in_month(month)}",
    }


def base(
    month: str = TEST, universe: str = "active", item: str = NAMED, blanks: bool = False
) -> dict[str, str]:
    return {**log_tables(item, blanks), **history_tables(month, universe)}


def top_own(since: str | None, k: int) -> str:
    where = f"WHERE updated_date >= {since}" if since else ""
    return f"""
SELECT customer_id, item_id FROM (
  SELECT customer_id, item_id, row_number() OVER (PARTITION BY customer_id
    ORDER BY count(*) DESC, max(updated_date) DESC, item_id) AS place
  FROM hist JOIN users USING (customer_id) {where} GROUP BY customer_id, item_id)
WHERE place <= {k}"""


def top_global(since: str | None, k: int) -> str:
    where = f"WHERE updated_date >= {since}" if since else ""
    return f"""
SELECT customer_id, item_id FROM users, (
  SELECT item_id FROM hist {where} GROUP BY item_id ORDER BY count(*) DESC, item_id LIMIT {k})"""


def top_place(since: str | None, k: int) -> str:
    where = f"AND updated_date >= {since}" if since else ""
    return f"""
SELECT customer_id, item_id FROM user_location JOIN (
  SELECT location, item_id, row_number() OVER (PARTITION BY location
    ORDER BY count(*) DESC, item_id) AS place
  FROM hist WHERE location IS NOT NULL {where} GROUP BY location, item_id) USING (location)
WHERE place <= {k}"""


def user_top_attribute(attribute: str, since: str, k: int) -> str:
    return f"""
SELECT customer_id, {attribute} FROM (
  SELECT customer_id, {attribute}, row_number() OVER (PARTITION BY customer_id
    ORDER BY count(*) DESC, max(updated_date) DESC, {attribute}) AS place
  FROM hist JOIN items USING (item_id) JOIN users USING (customer_id)
  WHERE updated_date >= {since} AND {attribute} IS NOT NULL GROUP BY customer_id, {attribute})
WHERE place <= {k}"""


def top_attribute(users: str, attribute: str, since: str, k: int) -> str:
    return f"""
SELECT customer_id, item_id FROM {users} JOIN (
  SELECT {attribute}, item_id, row_number() OVER (PARTITION BY {attribute}
    ORDER BY count(*) DESC, max(updated_date) DESC, item_id) AS place
  FROM hist JOIN items USING (item_id)
  WHERE updated_date >= {since} AND {attribute} IS NOT NULL
  GROUP BY {attribute}, item_id) USING ({attribute})
WHERE place <= {k}"""


def candidate_tables(
    month: str = TEST, params: CandidateParams = SMALL, with_items: bool = True
) -> dict[str, str]:
    cutoff = month_window(month).start
    recent, personal = back(cutoff, params.recent_days), back(cutoff, params.personal_days)
    tables = {
        "personal": top_own(personal, params.personal_top),
        "repeat_all": top_own(None, params.personal_top),
        "global": top_global(None, params.global_top),
        "recent_global": top_global(recent, params.recent_global_top),
        "user_location": """
SELECT customer_id, location FROM (
  SELECT customer_id, location, row_number() OVER (PARTITION BY customer_id
    ORDER BY updated_date DESC, location DESC NULLS LAST) AS place
  FROM hist JOIN users USING (customer_id)) WHERE place = 1""",
        "location": top_place(None, params.location_top),
        "recent_location": top_place(recent, params.recent_location_top),
        "anchors": top_own(recent, params.anchors),
        "baskets": f"""
SELECT DISTINCT bill_id, item_id FROM hist
WHERE updated_date >= {personal} AND bill_id IS NOT NULL""",
        "cobuy_pairs": f"""
SELECT anchor_item, co_item, cobuy_count FROM (
  SELECT a.item_id AS anchor_item, b.item_id AS co_item, count(*) AS cobuy_count,
    row_number() OVER (PARTITION BY a.item_id ORDER BY count(*) DESC, b.item_id) AS place
  FROM baskets a JOIN baskets b ON a.bill_id = b.bill_id AND a.item_id <> b.item_id
  WHERE a.item_id IN (SELECT item_id FROM anchors) GROUP BY a.item_id, b.item_id)
WHERE place <= {params.cobuy_top}""",
        "cobuy": f"""
SELECT customer_id, item_id FROM (
  SELECT customer_id, co_item AS item_id, row_number() OVER (PARTITION BY customer_id
    ORDER BY sum(cobuy_count) DESC, co_item) AS place
  FROM anchors JOIN cobuy_pairs ON anchors.item_id = anchor_item GROUP BY customer_id, co_item)
WHERE place <= {params.personal_top}""",
    }
    if with_items:
        tables |= {
            "user_categories": user_top_attribute("category", recent, params.user_categories),
            "recent_category": top_attribute(
                "user_categories", "category", recent, params.category_top
            ),
            "user_brands": user_top_attribute("brand", recent, params.user_brands),
            "recent_brand": top_attribute("user_brands", "brand", recent, params.brand_top),
        }
    flags = {s: s.removeprefix("candidate_") for s in SOURCES}
    union = "\nUNION ALL ".join(
        f"SELECT customer_id, item_id, '{table}' AS source FROM \"{table}\""
        for table in flags.values()
        if table in tables
    )
    marks = [
        f"CAST(max(CASE WHEN source = '{table}' THEN 1 ELSE 0 END) AS INTEGER) AS {source}"
        for source, table in flags.items()
    ]
    tables["cand"] = f"""
SELECT customer_id, item_id, {", ".join(marks)},
  CAST(count(DISTINCT source) AS INTEGER) AS candidate_source_count
FROM ({union}) GROUP BY customer_id, item_id"""
    return {f'"{n}"': q for n, q in tables.items()}


SPEND = "coalesce(price, 0) * coalesce(quantity, 0)"
DISC = "coalesce(discount, 0)"
NET = f"greatest({SPEND} - {DISC}, 0.0)"


def ratio(top: str, bottom: str) -> str:
    return f"({top}) / nullif(({bottom}) + 1.0, 0)"


def grain_tables(month: str = TEST, with_items: bool = True) -> dict[str, str]:
    cutoff = month_window(month).start

    def last(days: int) -> str:
        return f"updated_date >= {back(cutoff, days)}"

    def rows(days: int, alias: str) -> str:
        return f"count(*) FILTER (WHERE {last(days)}) AS {alias}"

    def age(moment: str) -> str:
        return f"date_sub('day', {moment}, {ts(cutoff)})"

    tables = {
        "pair_f": f"""
SELECT *, {ratio("ui_discount_sum", "ui_spend_sum")} AS ui_discount_rate,
  ui_first_days - ui_last_days AS ui_active_span_days,
  {ratio("ui_net_spend_sum", "ui_tx_count")} AS ui_net_spend_per_tx,
  CAST(ui_first_days - ui_last_days AS DOUBLE) / greatest(ui_tx_count - 1, 1)
    AS ui_repeat_interval_days
FROM (SELECT customer_id, item_id, count(*) AS ui_tx_count, sum(quantity) AS ui_qty_sum,
  sum({SPEND}) AS ui_spend_sum, sum({DISC}) AS ui_discount_sum, sum({NET}) AS ui_net_spend_sum,
  avg(price) AS ui_avg_price, avg(discount) AS ui_avg_discount, avg(quantity) AS ui_avg_qty,
  {age("max(updated_date)")} AS ui_last_days, {age("min(updated_date)")} AS ui_first_days,
  {rows(7, "ui_tx_7d")}, {rows(30, "ui_tx_30d")}, {rows(90, "ui_tx_90d")},
  sum(quantity) FILTER (WHERE {last(90)}) AS ui_qty_90d
  FROM hist GROUP BY customer_id, item_id)""",
        "user_f": f"""
SELECT *, {ratio("u_discount_sum", "u_spend_sum")} AS u_discount_rate,
  {ratio("u_tx_count", "u_bill_nunique")} AS u_tx_per_bill,
  {ratio("u_tx_30d", "u_tx_count")} AS u_recent_30_share,
  {ratio("u_tx_90d", "u_tx_count")} AS u_recent_90_share
FROM (SELECT customer_id, count(*) AS u_tx_count,
  count(DISTINCT bill_id) + max(CASE WHEN bill_id IS NULL THEN 1 ELSE 0 END) AS u_bill_nunique,
  count(DISTINCT item_id) AS u_item_nunique, sum(quantity) AS u_qty_sum,
  sum({SPEND}) AS u_spend_sum, sum({DISC}) AS u_discount_sum, sum({NET}) AS u_net_spend_sum,
  avg(price) AS u_avg_price, avg(discount) AS u_avg_discount,
  {rows(30, "u_tx_30d")}, {rows(90, "u_tx_90d")}
  FROM hist JOIN users USING (customer_id) GROUP BY customer_id)""",
        "place_f": f"""
SELECT u.customer_id, u.location,
  CASE WHEN u.location IS NOT NULL THEN count(h.customer_id) END AS u_location_tx_count,
  {age("max(h.updated_date)")} AS u_location_last_days
FROM user_location u LEFT JOIN hist h
  ON u.customer_id = h.customer_id AND u.location = h.location
GROUP BY u.customer_id, u.location""",
        "item_f": f"""
SELECT *, {ratio("i_tx_30d", "i_tx_count")} AS i_recent_30_share FROM (
SELECT item_id, count(*) AS i_tx_count, count(DISTINCT customer_id) AS i_user_nunique,
  sum(quantity) AS i_qty_sum, avg(quantity) AS i_avg_qty,
  {rows(30, "i_tx_30d")}, {rows(90, "i_tx_90d")},
  count(DISTINCT customer_id) FILTER (WHERE {last(90)}) AS i_user_90d
FROM hist GROUP BY item_id)""",
        "loc_item_f": f"""
SELECT *, loc_i_tx_count AS loc_item_tx_count, loc_i_tx_90d AS loc_item_tx_90d,
  {ratio("loc_i_tx_90d", "loc_i_tx_count")} AS loc_item_recent_share FROM (
SELECT location, item_id, count(*) AS loc_i_tx_count,
  count(DISTINCT customer_id) AS loc_item_user_nunique, sum(quantity) AS loc_i_qty_sum,
  {rows(30, "loc_item_tx_30d")}, {rows(90, "loc_i_tx_90d")},
  sum(quantity) FILTER (WHERE {last(90)}) AS loc_i_qty_90d
FROM hist WHERE location IS NOT NULL GROUP BY location, item_id)""",
    }
    if with_items:
        for attribute, prefix in USER_GRAINS.items():
            tables[f"{prefix}_f"] = f"""
SELECT customer_id, {attribute}, count(*) AS {prefix}_tx_count, {rows(90, f"{prefix}_tx_90d")}
FROM hist JOIN items USING (item_id) WHERE {attribute} IS NOT NULL
GROUP BY customer_id, {attribute}"""
        tables["category_f"] = f"""
SELECT category, count(*) AS category_tx_count, {rows(30, "category_tx_30d")},
  {rows(90, "category_tx_90d")}
FROM hist JOIN items USING (item_id) WHERE category IS NOT NULL GROUP BY category"""
        tables["loc_category_f"] = f"""
SELECT location, category, count(*) AS loc_category_tx_count, {rows(90, "loc_category_tx_90d")}
FROM hist JOIN items USING (item_id) WHERE category IS NOT NULL AND location IS NOT NULL
GROUP BY location, category"""
    return tables


USER_GRAINS = {
    "category_l1": "u_cat_l1",
    "category_l2": "u_cat_l2",
    "category_l3": "u_cat_l3",
    "category": "u_category",
    "brand": "u_brand",
}

SHARE_OF = {
    "ui_share_of_user_tx": ("ui_tx_count", "u_tx_count"),
    "ui_share_of_item_tx": ("ui_tx_count", "i_tx_count"),
    "ui_share_of_user_qty": ("ui_qty_sum", "u_qty_sum"),
    "ui_share_of_item_qty": ("ui_qty_sum", "i_qty_sum"),
    "user_item_price_ratio": ("ui_avg_price", "u_avg_price"),
    "loc_i_share_of_item_tx": ("loc_i_tx_count", "i_tx_count"),
    "loc_item_share_of_item_tx": ("loc_item_tx_count", "i_tx_count"),
}
ITEM_SHARE_OF = {
    "u_cat_l1_share": ("u_cat_l1_tx_count", "u_tx_count"),
    "u_cat_l2_share": ("u_cat_l2_tx_count", "u_tx_count"),
    "u_cat_l3_share": ("u_cat_l3_tx_count", "u_tx_count"),
    "u_category_share": ("u_category_tx_count", "u_tx_count"),
    "u_brand_share": ("u_brand_tx_count", "u_tx_count"),
    "item_catalog_user_price_ratio": ("item_catalog_price", "u_avg_price"),
    "category_item_tx_share": ("i_tx_count", "category_tx_count"),
    "category_item_recent_share": ("i_tx_90d", "category_tx_90d"),
}
ITEM_FEATURES = (
    {"item_catalog_price", "item_sale_status", "item_description_len"}
    | set(ITEM_SHARE_OF)
    | {f"{p}_tx_{x}" for p in USER_GRAINS.values() for x in ("count", "90d")}
    | {"category_tx_30d", "category_tx_90d", "loc_category_tx_count", "loc_category_tx_90d"}
)


def feature_tables(month: str = TEST, with_items: bool = True) -> dict[str, str]:
    """``feat``: candidates with their features, fractions unrounded."""
    shares = {**SHARE_OF, **(ITEM_SHARE_OF if with_items else {})}
    columns = []
    for f in FEATURES:
        if f in ITEM_FEATURES and not with_items:
            value = "CAST(0 AS DOUBLE)"
        elif f in shares:
            value = f"coalesce({ratio(*shares[f])}, 0)"
        else:
            value = f"coalesce({f}, 0)"
        columns.append(f"{value} AS {f}")
    meta = ""
    if with_items:
        meta = """
LEFT JOIN items ON items.item_id = cand.item_id
LEFT JOIN category_f ON category_f.category = items.category
LEFT JOIN loc_category_f ON loc_category_f.location = place_f.location
  AND loc_category_f.category = items.category""" + "".join(
            f"""
LEFT JOIN {p}_f ON {p}_f.customer_id = cand.customer_id AND {p}_f.{a} = items.{a}"""
            for a, p in USER_GRAINS.items()
        )
    return {
        **grain_tables(month, with_items),
        "feat": f"""
SELECT cand.customer_id, cand.item_id, {", ".join(columns)}
FROM cand
LEFT JOIN pair_f ON pair_f.customer_id = cand.customer_id AND pair_f.item_id = cand.item_id
LEFT JOIN user_f ON user_f.customer_id = cand.customer_id
LEFT JOIN place_f ON place_f.customer_id = cand.customer_id
LEFT JOIN item_f ON item_f.item_id = cand.item_id
LEFT JOIN loc_item_f ON loc_item_f.location = place_f.location
  AND loc_item_f.item_id = cand.item_id{meta}""",
    }


FRACTIONS = {
    *SHARE_OF, *ITEM_SHARE_OF,
    "ui_discount_rate", "ui_net_spend_per_tx", "ui_repeat_interval_days", "u_discount_rate",
    "u_tx_per_bill", "u_recent_30_share", "u_recent_90_share", "i_recent_30_share",
    "loc_item_recent_share", "ui_avg_price", "ui_avg_discount", "ui_avg_qty", "u_avg_price",
    "u_avg_discount", "i_avg_qty", "item_catalog_price", "ui_qty_sum", "ui_spend_sum",
    "ui_discount_sum", "ui_net_spend_sum", "ui_qty_90d", "u_qty_sum", "u_spend_sum",
    "u_discount_sum", "u_net_spend_sum", "i_qty_sum", "loc_i_qty_sum", "loc_i_qty_90d",
}


def shown(names: list[str] | tuple[str, ...], zero: bool = False) -> str:
    return ", ".join(
        f"round(CAST({n} AS DOUBLE), {digits(n)}) AS {n}" if n in FRACTIONS or zero and n in ITEM_FEATURES else n
        for n in names
    )


def everything(
    month: str = TEST, with_items: bool = True, item: str = NAMED, universe: str = "active"
) -> dict[str, str]:
    return {
        **base(month, universe, item),
        **candidate_tables(month, SMALL, with_items),
        **feature_tables(month, with_items),
    }


# --- training -------------------------------------------------------------------


def labelled_tables(
    month: str = VALIDATION, universe: str = "active", item: str = NAMED
) -> dict[str, str]:
    """``lab``: candidates of the month with label and fixed score."""
    return {
        **base(month, universe, item),
        **candidate_tables(month),
        "lab": f"""
SELECT c.customer_id, c.item_id, '{month}' AS label_month,
  CAST(CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS TINYINT) AS label,
  round(coalesce(n.rows, 0) + candidate_source_count / 100.0, 2) AS score
FROM cand c
LEFT JOIN truth t ON t.customer_id = c.customer_id AND t.item_id = c.item_id
LEFT JOIN (SELECT customer_id, item_id, CAST(count(*) AS DOUBLE) AS rows FROM hist
  GROUP BY customer_id, item_id) n ON n.customer_id = c.customer_id AND n.item_id = c.item_id""",
    }


def nested(tables: dict[str, str], final: str) -> str:
    return "SELECT * FROM (" + with_(tables, final) + ")"


def two_months(pick: str, item: str) -> str:
    return "\nUNION ALL ".join(nested(labelled_tables(m, item=item), pick) for m in TRAIN)


def kept(rows: str, seed: str) -> str:
    """Positives, and the negatives with the smallest hashes up to the quota."""
    ratio_ = RUN.negative_ratio
    return f"""
SELECT * EXCLUDE (place, positives) FROM (
  SELECT *, sum(label) OVER (PARTITION BY label_month) AS positives,
    row_number() OVER (PARTITION BY label_month, label
      ORDER BY md5({seed} || '|' || customer_id || '|' || item_id)) AS place
  FROM {rows})
WHERE label = 1 OR positives = 0 OR place <= floor(positives * {ratio_})"""


def month_rows(month: str, seed: int, item: str = NAMED) -> dict[str, str]:
    """``sampled``: the month's labelled features, negatives sampled."""
    return {
        **everything(month, item=item),
        "full_rows": f"""
SELECT f.*, '{month}' AS label_month,
  CAST(CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS TINYINT) AS label
FROM feat f LEFT JOIN truth t ON t.customer_id = f.customer_id AND t.item_id = f.item_id""",
        "sampled": kept("full_rows", f"'{seed}'"),
    }


def narrow(name: str) -> str:
    """A feature as a 32-bit float, rounded like the query's."""
    return f"round(CAST(CAST({name} AS FLOAT) AS DOUBLE), {digits(name)}) AS {name}"


SHOWN_SQL = (
    "SELECT customer_id, item_id, label_month, label, "
    + ", ".join(map(narrow, FEATURES))
    + " FROM sampled"
)


def simple(final: str, **kwargs) -> str:
    return with_(base(**kwargs), final)


def cand(final: str, item: str = NAMED, **kwargs) -> str:
    return with_({**base(item=item), **candidate_tables(**kwargs)}, final)


def grain(final: str, item: str = NAMED, with_items: bool = True) -> str:
    return with_(
        {
            **base(item=item),
            **candidate_tables(with_items=with_items),
            **grain_tables(TEST, with_items),
        },
        final,
    )


ORACLE: dict[str, str] = {}

CUTOFF = month_window(TEST).start
MONTHS = previous_months(TEST, 12)
SPLITS = f"""
SELECT split, role, start FROM (
  SELECT unnest(['default', 'given', 'full_year']) AS split, DATE '{TEST}-01' AS last)
JOIN LATERAL (
  SELECT 'test' AS role, CAST(last AS TIMESTAMP) AS start
  UNION ALL SELECT 'validation', last - INTERVAL 1 MONTH
  UNION ALL SELECT 'train', unnest(CASE split
    WHEN 'default' THEN [last - INTERVAL 2 MONTH, last - INTERVAL 3 MONTH]
    WHEN 'given' THEN [TIMESTAMP '2001-01-01', TIMESTAMP '2000-12-01']
    ELSE [last - to_months(CAST(m AS INTEGER)) FOR m IN range(2, 13)] END)) ON true"""

ORACLE |= {
    "i01_transactions": simple("SELECT * FROM tx", item=NAME, blanks=True),
    "i02_items_dedup": simple("SELECT * FROM items", item=NAME),
    "i04_month_series": simple(
        f"""SELECT strftime(updated_date, '%Y-%m') AS month, count(*) AS n FROM tx
WHERE updated_date >= {ts(month_window(MONTHS[0]).start)} AND updated_date < {ts(CUTOFF)} GROUP BY 1"""
    ),
    "i05_history_before": simple("SELECT * FROM hist"),
    "i06_recent_slice": simple(f"SELECT * FROM hist WHERE updated_date >= {back(CUTOFF, 90)}"),
    "i07_active_users": simple("SELECT * FROM users"),
    "i08_sampled_users": simple(
        f"SELECT customer_id FROM users ORDER BY md5('42|' || customer_id) LIMIT {SAMPLE}"
    ),
    "i09_users_before": simple("SELECT * FROM users", universe="history"),
    "i10_truth_users": simple("SELECT * FROM users"),
    "i11_truth_json": simple("SELECT * FROM truth"),
    "i11_truth_brackets": simple(
        """SELECT CAST(customer_id AS VARCHAR) AS "user", item_id || '], "[' || chr(92) AS item_id,
  CAST(row_number() OVER (PARTITION BY customer_id ORDER BY item_id) AS INTEGER) AS position FROM truth"""
    ),
    "i12_month_truth": simple(
        "SELECT * FROM truth WHERE customer_id IN (SELECT customer_id FROM hist)"
    ),
    "i13_split_months": simple(
        f"""SELECT split, role, strftime(start, '%Y-%m') AS month, start,
  start + INTERVAL 1 MONTH AS stop, coalesce(n, 0) AS n
FROM ({SPLITS}) LEFT JOIN
  (SELECT date_trunc('month', updated_date) AS start, count(*) AS n FROM tx GROUP BY 1) USING (start)"""
    ),
}

SOURCE_TABLES = {
    "c01_personal": "personal",
    "c02_repeat_all": "repeat_all",
    "c03_global": "global",
    "c04_recent_global": "recent_global",
    "c05_user_location": "user_location",
    "c06_location": "location",
    "c07_recent_location": "recent_location",
    "c08_user_categories": "user_categories",
    "c09_recent_category": "recent_category",
    "c10_user_brands": "user_brands",
    "c11_recent_brand": "recent_brand",
    "c12_anchors": "anchors",
    "c13_cobuy_pairs": "cobuy_pairs",
    "c14_cobuy": "cobuy",
    "c15_candidates": "cand",
}


def large_bills(item: str) -> str:
    """Bills of a day and a seventh of the orders, paired in full."""
    return with_(
        {
            **base(item=item),
            "bills": f"""
SELECT DISTINCT strftime(updated_date, '%Y-%m-%d') || '/' || (bill_id % 7) AS bill_id, item_id
FROM hist WHERE bill_id IS NOT NULL AND updated_date >= {back(CUTOFF, SMALL.personal_days)}""",
        },
        f"""
SELECT anchor_item, co_item, cobuy_count FROM (
  SELECT a.item_id AS anchor_item, b.item_id AS co_item, count(*) AS cobuy_count,
    row_number() OVER (PARTITION BY a.item_id ORDER BY count(*) DESC, b.item_id) AS place
  FROM bills a JOIN bills b ON a.bill_id = b.bill_id AND a.item_id <> b.item_id
  GROUP BY a.item_id, b.item_id)
WHERE place <= {SMALL.cobuy_top}""",
    )


def candidate_family(item: str) -> dict[str, str]:
    sources = {n: cand(f'SELECT * FROM "{t}"', item) for n, t in SOURCE_TABLES.items()}
    return sources | {
        "c13_cobuy_all_anchors": large_bills(item),
        "c17_kept_lists": cand("SELECT * FROM cand", item),
        "c16_candidates_no_items": cand("SELECT * FROM cand", item, with_items=False),
    }


PAIR_COLUMNS = [f for f in FEATURES if f.startswith("ui_") and f not in SHARE_OF]
USER_COLUMNS = [
    f
    for f in FEATURES
    if f.startswith("u_") and f not in ITEM_FEATURES and not f.startswith("u_location")
]
ITEM_COLUMNS = [f for f in FEATURES if f.startswith("i_")]
PLACE_COLUMNS = [
    f
    for f in FEATURES
    if f.startswith("loc_") and f not in SHARE_OF and f not in ITEM_FEATURES
]

def feature_family(item: str) -> dict[str, str]:
    return {
        "f01_pair": grain(
            f"SELECT customer_id, item_id, {shown(PAIR_COLUMNS)} FROM pair_f SEMI JOIN users USING (customer_id)",
            item,
        ),
        "f02_user": grain(f"SELECT customer_id, {shown(USER_COLUMNS)} FROM user_f", item),
        "f03_user_location": grain("SELECT * FROM place_f", item),
        "f04_item": grain(f"SELECT item_id, {shown(ITEM_COLUMNS)} FROM item_f", item),
        "f05_location_item": grain(
            f"SELECT location, item_id, {shown(PLACE_COLUMNS)} FROM loc_item_f",
            item,
        ),
        "f06_item_meta": cand('SELECT * FROM "global" LEFT JOIN items USING (item_id)', item),
        **{
            f"f{i:02d}_{name}": grain(
                f"SELECT * FROM {prefix}_f SEMI JOIN users USING (customer_id)",
                item,
            )
            for i, (name, prefix) in enumerate(
                {
                    "user_cat_l1": "u_cat_l1",
                    "user_cat_l2": "u_cat_l2",
                    "user_cat_l3": "u_cat_l3",
                    "user_category": "u_category",
                    "user_brand": "u_brand",
                }.items(),
                7,
            )
        },
        "f12_category": grain("SELECT * FROM category_f", item),
        "f13_location_category": grain("SELECT * FROM loc_category_f", item),
        "f14_features": with_(
            everything(item=item), f"SELECT customer_id, item_id, {shown(FEATURES)} FROM feat"
        ),
        "f15_features_no_items": with_(
            everything(with_items=False, item=item),
            f"SELECT customer_id, item_id, {shown(FEATURES, zero=True)} FROM feat",
        ),
    }


def training_family(item: str) -> dict[str, str]:
    lab = labelled_tables(item=item)
    return {
        "d01_labels": with_(lab, "SELECT customer_id, item_id, label FROM lab"),
        "d02_downsample": with_(
            {"all_rows": two_months("SELECT * FROM lab", item)},
            f"SELECT customer_id, item_id, label_month, label FROM ({kept("all_rows", repr('42'))})",
        ),
        "d03_month_dataset": with_(month_rows(VALIDATION, 42, item), SHOWN_SQL),
        "d04_train_frame": "\nUNION ALL ".join(
            nested(month_rows(m, 42 + i * 10_000, item), SHOWN_SQL) for i, m in enumerate(TRAIN)
        ),
        "d05_rank_groups": with_(
            lab,
            """SELECT customer_id, item_id, label, group_size FROM (
    SELECT *, count(*) OVER (PARTITION BY customer_id) AS group_size,
      sum(label) OVER (PARTITION BY customer_id) AS positives FROM lab) WHERE positives > 0""",
        ),
        "d06_class_weight": with_(
            lab,
            f"""SELECT positives, negatives,
      round(CAST(greatest(positives + negatives - greatest(positives, 1), 1) AS DOUBLE)
        / greatest(positives, 1), {DIGITS}) AS scale_pos_weight
    FROM (SELECT count(*) FILTER (WHERE label = 1) AS positives,
      count(*) FILTER (WHERE label = 0) AS negatives FROM lab)""",
        ),
        "d07_dataset_summary": with_(
            {"all_rows": two_months("SELECT * FROM lab", item), "kept_rows": kept("all_rows", "'42'")},
            """SELECT label_month, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives,
      max(kept) AS kept
    FROM all_rows JOIN (SELECT label_month, count(*) AS kept FROM kept_rows GROUP BY 1)
      USING (label_month) GROUP BY label_month""",
        ),
    }


# --- ranking and evaluation -------------------------------------------------------

RANKED = {
    "ranked": """
SELECT * FROM (SELECT customer_id, item_id, label, score, CAST(row_number() OVER (
  PARTITION BY customer_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM lab)
WHERE rank <= 10""",
}
LIST_TABLES = {
    "hits": """
SELECT r.customer_id, r.rank, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit
FROM ranked r LEFT JOIN truth t ON t.customer_id = r.customer_id AND t.item_id = r.item_id""",
    "sizes": "SELECT customer_id, count(*) AS bought FROM truth GROUP BY customer_id",
    "per_user": """
SELECT customer_id, sum(hit) / CAST(count(*) + max(bought) - sum(hit) AS DOUBLE) AS iou,
  coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0) AS reciprocal_rank,
  sum(hit) / 10.0 AS precision,
  sum(hit * found / CAST(rank AS DOUBLE)) / least(max(bought), 10) AS average_precision
FROM (SELECT *, sum(hit) OVER (PARTITION BY customer_id ORDER BY rank) AS found FROM hits)
JOIN sizes USING (customer_id) GROUP BY customer_id""",
}
PROB = "SELECT *, score / (score + 1.0) AS p FROM lab"
LOG_LOSS = """avg(-ln(CASE WHEN label = 1 THEN least(greatest(p, 1e-6), 1 - 1e-6)
  ELSE 1 - least(greatest(p, 1e-6), 1 - 1e-6) END))"""
COVERAGE = {
    "user_cover": """
SELECT c.customer_id, count(*) AS candidates, max(bought) AS bought, count(t.item_id) AS hits
FROM cand c LEFT JOIN truth t ON t.customer_id = c.customer_id AND t.item_id = c.item_id
JOIN (SELECT customer_id, count(*) AS bought FROM truth GROUP BY customer_id) s
  ON s.customer_id = c.customer_id GROUP BY c.customer_id""",
    "coverage": f"""
SELECT count(*) AS common_users, CAST(sum(candidates) AS BIGINT) AS total_candidates,
  CAST(sum(bought) AS BIGINT) AS total_true_items, CAST(sum(hits) AS BIGINT) AS total_hits,
  count(*) FILTER (WHERE hits > 0) AS users_with_hit,
  round(avg(hits / CAST(bought AS DOUBLE)), {DIGITS}) AS mean_user_recall,
  round(sum(hits) / CAST(sum(bought) AS DOUBLE), {DIGITS}) AS candidate_recall,
  round(sum(hits) / CAST(sum(candidates) AS DOUBLE), {DIGITS}) AS candidate_precision,
  round(count(*) FILTER (WHERE hits > 0) / CAST(count(*) AS DOUBLE), {DIGITS}) AS user_hit_rate
FROM user_cover""",
}
PRECISION_10 = "SELECT customer_id, sum(label) / 10.0 AS p10 FROM ranked GROUP BY customer_id"
STEPS = """
SELECT {keys} {score}, count(*) AS n, sum(label) AS n_pos FROM {table} GROUP BY ALL"""


def list_tables(item: str) -> dict[str, str]:
    return {**labelled_tables(VALIDATION, "history", item), **RANKED, **LIST_TABLES}


def metric(name: str, item: str) -> str:
    return with_(
        list_tables(item), f"SELECT customer_id, round({name}, {DIGITS}) AS {name} FROM per_user"
    )


METRIC_NAMES = {
    "iou": "iou",
    "mrr": "reciprocal_rank",
    "precision": "precision",
    "map": "average_precision",
}

LISTED = "SELECT customer_id, string_agg(item_id, ',' ORDER BY rank) AS items FROM ranked GROUP BY 1"
EVALUATED = {
    "means": "SELECT count(*) AS truth_users, count(p.customer_id) AS common_users, "
    + ", ".join(f"avg({c}) AS {m}" for m, c in METRIC_NAMES.items())
    + " FROM sizes LEFT JOIN per_user p USING (customer_id)",
    "evaluated": "SELECT truth_users,"
    " (SELECT count(DISTINCT customer_id) FROM ranked) AS submission_users,"
    " common_users, truth_users - common_users AS missing_users, "
    + ", ".join(
        f"round({m}, {DIGITS}) AS {m},"
        f" round({m} * common_users / truth_users, {DIGITS}) AS {m}_all_users"
        for m in METRIC_NAMES
    )
    + " FROM means",
}


def ranking_family(item: str) -> dict[str, str]:
    lab = labelled_tables(item=item)
    ranked = {**lab, **RANKED}
    probable = {**lab, "prob": PROB}
    counted = " + ".join(f"coalesce({c}, 0)" for c in COUNTED)
    return {
        "r01_scored_month": with_(
            everything(VALIDATION, item=item),
            f"SELECT customer_id, item_id, CAST({counted} AS DOUBLE) AS score FROM feat",
        ),
        "r02_topk": with_(ranked, "SELECT customer_id, item_id, rank, score FROM ranked"),
        "r03_all_history_topk": with_(
            {**labelled_tables(TEST, "history", item), **RANKED}, LISTED
        ),
        "r03_truth_topk": with_({**labelled_tables(TEST, item=item), **RANKED}, LISTED),
        "r04_written_lists": with_(ranked, "SELECT customer_id, item_id, rank FROM ranked"),
        "e01_coverage": with_({**lab, **COVERAGE}, "SELECT * FROM coverage"),
        "e02_precision_at_10": with_(
            {**ranked, "p": PRECISION_10},
            f"SELECT count(*) AS users, round(avg(p10), {DIGITS}) AS precision_at_k FROM p",
        ),
        "e03_iou": metric("iou", item),
        "e04_mrr": metric("reciprocal_rank", item),
        "e05_precision_k": metric("precision", item),
        "e06_map": metric("average_precision", item),
        "e07_eval_summary": with_({**list_tables(item), **EVALUATED}, "SELECT * FROM evaluated"),
        "e08_log_loss": with_(
            probable, f"SELECT count(*) AS rows, round({LOG_LOSS}, {DIGITS}) AS log_loss FROM prob"
        ),
        "e09_average_precision": with_(
            {**lab, "steps": STEPS.format(keys="", score="score", table="lab")},
            f"""SELECT round(sum(n_pos * hits / CAST(seen AS DOUBLE)) / sum(n_pos), {DIGITS})
  AS average_precision
FROM (SELECT *, sum(n) OVER (ORDER BY score DESC) AS seen,
  sum(n_pos) OVER (ORDER BY score DESC) AS hits FROM steps)""",
        ),
        "e10_ndcg_at_10": with_(
            {
                **ranked,
                "ideal": "SELECT n, (SELECT sum(1.0 / log2(i + 1)) FROM range(1, n + 1) t(i))"
                " AS best FROM range(1, 11) r(n)",
            },
            f"""SELECT count(*) AS users, round(avg(gain / best), {DIGITS}) AS ndcg_at_k
FROM (SELECT customer_id, sum(label / log2(rank + 1.0)) AS gain FROM ranked GROUP BY 1)
JOIN (SELECT customer_id, least(sum(label), 10) AS n FROM lab GROUP BY 1 HAVING sum(label) > 0)
  USING (customer_id) JOIN ideal USING (n)""",
        ),
        "e12_month_report": with_(
            {**probable, **RANKED, **COVERAGE, "p10": PRECISION_10},
            f"""SELECT *, (SELECT round(avg(p10), {DIGITS}) FROM p10) AS precision_at_k,
  (SELECT round({LOG_LOSS}, {DIGITS}) FROM prob) AS log_loss FROM coverage""",
        ),
    }


ORACLE["r05_rekeyed"] = simple(
    """SELECT CASE WHEN customer_id % 10 = 3 THEN NULL ELSE customer_id END AS customer_id,
  CASE WHEN customer_id % 10 = 3 THEN 'guest-' || customer_id END AS user_text,
  row_number() OVER (PARTITION BY customer_id ORDER BY item_id) AS rank, item_id FROM truth"""
)

for family in (candidate_family, feature_family, training_family, ranking_family):
    ORACLE |= family(NAMED)
    ORACLE |= {f"{name}_fine": sql for name, sql in family(PART).items()}
ORACLE["c15_candidates_fine"] = with_(
    {**base(item=PART), **candidate_tables(params=CandidateParams())}, "SELECT * FROM cand"
)

ORACLE["r04_resumed_lists"] = ORACLE["r04_written_lists"]

# --- scorers --------------------------------------------------------------------------

# The pull of each pair of a bought and an unbought item of a user; ``w`` weighs the pair.
PULLS = """
SELECT p.customer_id, p.item_id AS up, n.item_id AS down, 1 / (1 + exp(p.score - n.score)) AS rho,
  {weight} AS w
FROM placed p JOIN placed n ON p.customer_id = n.customer_id AND p.label = 1 AND n.label = 0"""
PLACED = """
SELECT *, CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END AS discount,
  (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(bought, 10) AS BIGINT) + 1) t(i)) AS ideal
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item_id) AS place,
  sum(label) OVER (PARTITION BY customer_id) AS bought FROM lab)"""
GRADED = f"""
SELECT customer_id, item_id, round(sum(g), {DIGITS}) AS grad, round(sum(h), {DIGITS}) AS hess FROM (
  SELECT customer_id, up AS item_id, -rho * w AS g, rho * (1 - rho) * w AS h FROM pulls
  UNION ALL SELECT customer_id, down, rho * w, rho * (1 - rho) * w FROM pulls)
GROUP BY customer_id, item_id"""
LAB = labelled_tables()
ALL_SCORED = with_(
    {**base(VALIDATION), **candidate_tables(VALIDATION)},
    "SELECT customer_id, item_id, true AS scored FROM cand",
)
REPORT_COLUMNS = (
    "common_users, total_candidates, total_true_items, total_hits, users_with_hit,"
    " mean_user_recall, candidate_recall, candidate_precision, user_hit_rate"
)


def month_summary(month: str, part: str, precision: bool = True) -> str:
    value = f"(SELECT round(avg(p10), {DIGITS}) FROM p10)" if precision else "CAST(NULL AS DOUBLE)"
    return nested(
        {**labelled_tables(month), **RANKED, **COVERAGE, "p10": PRECISION_10},
        f"SELECT {REPORT_COLUMNS}, {value} AS precision_at_k, '{part}' AS part FROM coverage",
    )


ORACLE |= {
    name: ALL_SCORED
    for name in (
        "m01_gbt_scores", "m01_gbt_wide_scores", "m03_pairwise_scores", "m04_ndcg_scores",
        "m05_linear_scores",
    )
}
# Each feature's best first split, by sums over its values in order.
PULLED_ZERO = """
SELECT *, sum(label) OVER (PARTITION BY customer_id) AS bought,
  sum(1 - label) OVER (PARTITION BY customer_id) AS not_bought FROM full_rows"""


def root_splits(grad: str, hess: str, rows: str, child_weight: float, child_rows: int) -> str:
    long = "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS FLOAT) AS value, {grad} AS g, {hess} AS h FROM graded" for f in FEATURES
    )
    return with_(
        {
            **month_rows(VALIDATION, 42),
            "pulled": PULLED_ZERO,
            "graded": f"SELECT * FROM pulled WHERE {rows}",
            "picked": """
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('7|' || customer_id || '|' || item_id)) AS turn
  FROM full_rows) WHERE turn <= 32768""",
            "sample": "\nUNION ALL ".join(
                f"SELECT '{f}' AS feature, CAST({f} AS FLOAT) AS value FROM picked" for f in FEATURES
            ),
            "spread": """
SELECT feature, count(*) AS n, count(DISTINCT value) AS kinds, max(value) AS top FROM sample GROUP BY feature""",
            "cuts": """
SELECT DISTINCT s.feature, s.value AS cut FROM (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS pos FROM sample) s
JOIN spread USING (feature)
WHERE s.value < top AND (kinds <= 256 OR pos IN (SELECT i * n // 256 FROM range(1, 256) r(i)))""",
            "long": long,
            "binned": """
SELECT l.feature, c.cut, count(*) AS n, sum(g) AS g, sum(h) AS h
FROM long l ASOF LEFT JOIN cuts c ON l.feature = c.feature AND l.value <= c.cut GROUP BY l.feature, c.cut""",
            "sides": """
SELECT feature, cut, sum(n) OVER up AS nl, sum(g) OVER up AS gl, sum(h) OVER up AS hl,
  sum(n) OVER whole AS n, sum(g) OVER whole AS g, sum(h) OVER whole AS h FROM binned
WINDOW up AS (PARTITION BY feature ORDER BY cut NULLS LAST), whole AS (PARTITION BY feature)""",
            "gained": f"""
SELECT feature, cut, nl, gl * gl / (hl + 2.0) + (g - gl) * (g - gl) / (h - hl + 2.0) - g * g / (h + 2.0) AS gain
FROM sides WHERE cut IS NOT NULL AND nl >= {child_rows} AND n - nl >= {child_rows}
  AND hl >= {child_weight} AND h - hl >= {child_weight}""",
        },
        """SELECT feature, round(CAST(cut AS DOUBLE), 3) AS upto, CAST(nl AS BIGINT) AS left_rows, round(gain, 6) AS gain
FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, cut) AS place FROM gained)
WHERE place = 1 AND gain > 1e-6""",
    )


LOGISTIC = (
    "CAST((CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END) * (0.5 - label) AS DOUBLE)",
    "CAST((CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END) * 0.25 AS DOUBLE)",
    "true",
)
PAIRWISE = (
    "CAST(CASE WHEN label = 1 THEN -0.5 * not_bought ELSE 0.5 * bought END AS DOUBLE)",
    "CAST(CASE WHEN label = 1 THEN 0.25 * not_bought ELSE 0.25 * bought END AS DOUBLE)",
    "bought > 0 AND not_bought > 0",
)
ORACLE |= {
    "m01_root_splits": root_splits(*LOGISTIC, 10.0, 1),
    "m01_wide_root_splits": root_splits(*LOGISTIC, 0.001, 40),
    "m03_root_splits": root_splits(*PAIRWISE, 10.0, 1),
}

ORACLE |= {
    "m01_gradients": with_(
        {**LAB, "p": "SELECT *, 1 / (1 + exp(-score)) AS p FROM lab"},
        f"""SELECT customer_id, item_id,
  round((CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END) * (p - label), {DIGITS}) AS grad,
  round((CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END) * p * (1 - p), {DIGITS}) AS hess FROM p""",
    ),
    "m03_gradients": with_(
        {**LAB, "placed": PLACED, "pulls": PULLS.format(weight="1.0")}, GRADED
    ),
    "m04_gradients": with_(
        {
            **LAB,
            "placed": PLACED,
            "pulls": PULLS.format(weight="abs(p.discount - n.discount) / p.ideal"),
            "graded": GRADED,
        },
        """SELECT customer_id, item_id, coalesce(grad, 0) AS grad, coalesce(hess, 0) AS hess
FROM (SELECT customer_id, item_id FROM placed WHERE bought > 0) LEFT JOIN graded
  USING (customer_id, item_id)""",
    ),
    "m05_normal_equations": "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, true AS orthogonal" for f in FEATURES
    ),
    "m09_run": with_({**labelled_tables(TEST), **RANKED}, LISTED),
    "m09_report": "\nUNION ALL ".join(
        (
            month_summary(VALIDATION, "validation"),
            month_summary(TEST, "test"),
            month_summary(TEST, "delivered", precision=False),
        )
    ),
    "m09_list_report": with_(
        {**labelled_tables(TEST), **RANKED, **LIST_TABLES, **EVALUATED}, "SELECT * FROM evaluated"
    ),
}

# --- association --------------------------------------------------------------------

LONG = {
    **month_rows(VALIDATION, 42),
    "long": "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS FLOAT) AS value, CAST(label AS INTEGER) AS label FROM sampled"
        for f in FEATURES
    ),
    "ranked_values": """
SELECT *, rank() OVER (PARTITION BY feature ORDER BY value)
  + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS place FROM long""",
    "plain": f"""
SELECT feature, count(*) AS n, sum(label) AS pos, count(DISTINCT value) AS unique_values,
  CASE WHEN count(DISTINCT value) > 1 AND count(DISTINCT label) > 1
    THEN corr(CAST(value AS DOUBLE), CAST(label AS DOUBLE)) ELSE 0 END AS pearson,
  CASE WHEN count(DISTINCT value) > 1 AND count(DISTINCT label) > 1
    THEN corr(place, CAST(label AS DOUBLE)) ELSE 0 END AS spearman,
  (sum(place) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0)
    / nullif(CAST(sum(label) * (count(*) - sum(label)) AS DOUBLE), 0) AS auc,
  coalesce(avg(label) FILTER (WHERE value <> 0), 0) AS positive_rate_when_nonzero,
  avg(label) AS global_positive_rate,
  coalesce(avg(CAST(value AS DOUBLE)) FILTER (WHERE label = 1), 0) AS mean_positive,
  coalesce(avg(CAST(value AS DOUBLE)) FILTER (WHERE label = 0), 0) AS mean_negative,
  CAST(0 AS DOUBLE) AS null_rate, count(*) FILTER (WHERE value <> 0) / CAST(count(*) AS DOUBLE) AS nonzero_rate
FROM ranked_values GROUP BY feature""",
    "value_steps": STEPS.format(keys="feature,", score="value", table="long"),
    "areas": """
SELECT feature, sum(n_pos * hits / CAST(seen AS DOUBLE)) / nullif(sum(n_pos), 0) AS ap
FROM (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value DESC) AS seen,
  sum(n_pos) OVER (PARTITION BY feature ORDER BY value DESC) AS hits FROM value_steps)
GROUP BY feature""",
    "stats": """
SELECT feature, coalesce(pearson, 0) AS pearson, coalesce(spearman, 0) AS spearman,
  CASE WHEN unique_values > 1 THEN coalesce(greatest(auc, 1 - auc), 0.5) ELSE 0.5 END
    AS auc_directionless,
  CASE WHEN unique_values > 1 AND pos BETWEEN 1 AND n - 1 THEN ap ELSE 0 END AS average_precision,
  positive_rate_when_nonzero, global_positive_rate,
  positive_rate_when_nonzero - global_positive_rate AS positive_rate_lift,
  mean_positive, mean_negative, mean_positive - mean_negative AS mean_delta,
  null_rate, nonzero_rate, unique_values
FROM plain JOIN areas USING (feature)""",
    "lifts": """
SELECT *, auc_directionless - 0.5 AS auc_lift, abs(pearson) AS abs_pearson,
  abs(spearman) AS abs_spearman, average_precision - global_positive_rate AS ap_lift FROM stats""",
    "verdicts": """
SELECT *, greatest(abs_pearson, abs_spearman) >= 0.01 OR auc_lift >= 0.01
  OR abs(positive_rate_lift) >= 0.005 OR round(ap_lift, 12) > 0 AS signal FROM lifts""",
    "report": """
SELECT *, CASE WHEN unique_values <= 1 THEN 'constant' WHEN nonzero_rate = 0 THEN 'all_zero'
  WHEN signal AND nonzero_rate < 0.001 THEN 'usable_sparse' WHEN signal THEN 'usable'
  WHEN nonzero_rate < 0.001 THEN 'too_sparse' ELSE 'weak_signal' END AS status,
  CASE WHEN unique_values <= 1 THEN 'only one value after filling nulls'
  WHEN nonzero_rate = 0 THEN 'feature is always zero'
  WHEN signal AND nonzero_rate < 0.001 THEN 'has label signal but appears in very few rows'
  WHEN signal THEN 'passes at least one signal threshold'
  WHEN nonzero_rate < 0.001 THEN 'too sparse and no clear label signal'
  ELSE 'varies but does not pass the signal thresholds' END AS reason FROM verdicts""",
}
REPORT_NUMBERS = (
    "pearson", "spearman", "abs_pearson", "abs_spearman", "auc_directionless", "auc_lift",
    "average_precision", "ap_lift", "positive_rate_when_nonzero", "global_positive_rate",
    "positive_rate_lift", "null_rate", "nonzero_rate",
)


def six(*names: str, to: int = REPORT_DIGITS) -> str:
    return ", ".join(f"round({n}, {to}) AS {n}" for n in names)


REPORT_ROWS = (
    six(*REPORT_NUMBERS)
    + ", "
    + six("mean_positive", "mean_negative", "mean_delta", to=3)
    + ", unique_values, status, reason"
)
# A column that is not there, in the order of the rows above.
ABSENT = {
    **{c: "0.0" for c in REPORT_NUMBERS},
    "auc_directionless": "0.5",
    "null_rate": "1.0",
    "mean_positive": "0.0",
    "mean_negative": "0.0",
    "mean_delta": "0.0",
    "unique_values": "0",
    "status": "'missing'",
    "reason": "'column was not produced by the pipeline'",
}


def stats(columns: str, table: str = "lifts") -> str:
    return with_(LONG, f"SELECT feature, {columns} FROM {table}")


ORACLE |= {
    "a01_pearson": stats(six("pearson")),
    "a02_spearman": stats(six("spearman")),
    "a03_auc": stats(six("auc_directionless", "auc_lift")),
    "a04_ap": stats(six("average_precision")),
    "a05_rates": stats(
        six("positive_rate_when_nonzero", "global_positive_rate", "positive_rate_lift")
    ),
    "a06_means": stats(six("mean_positive", "mean_negative", "mean_delta", to=3)),
    "a07_density": stats(six("null_rate", "nonzero_rate") + ", unique_values"),
    "a08_feature_status": stats("status, reason", "report"),
    "a09_feature_report": stats(REPORT_ROWS, "report"),
    "a09_months_report": with_(
        {
            "sampled": "\nUNION ALL ".join(
                nested(month_rows(m, 2026 + i * 10_000), "SELECT * FROM sampled")
                for i, m in enumerate((*TRAIN, VALIDATION))
            ),
            **{k: v for k, v in LONG.items() if list(LONG).index(k) >= list(LONG).index("long")},
        },
        f"SELECT feature, {REPORT_ROWS} FROM report",
    ),
    "a10_usable": with_(
        LONG,
        f"""SELECT feature, {REPORT_ROWS} FROM report WHERE status IN ('usable', 'usable_sparse')
ORDER BY abs_spearman DESC, feature LIMIT 30""",
    ),
    "a10_inspect": with_(
        LONG,
        f"""SELECT feature, {REPORT_ROWS} FROM report WHERE status NOT IN ('usable', 'usable_sparse')
ORDER BY abs_spearman DESC, feature LIMIT 50""",
    ),
    "a11_absent_columns": with_(
        LONG,
        f"SELECT feature, {REPORT_ROWS} FROM report WHERE feature = 'i_tx_count'"
        + "".join(
            f"""
UNION ALL SELECT '{f}', {", ".join("round(rate, 6)" if c == "global_positive_rate" else v
              for c, v in ABSENT.items())} FROM (SELECT avg(label) AS rate FROM sampled)"""
            for f in ("ui_tx_count", "not_there")
        ),
    ),
    "p05_report_csv": stats(REPORT_ROWS, "report"),
    "a10_status_counts": with_(
        LONG, "SELECT status, count(*) AS features FROM report GROUP BY status"
    ),
}

# --- profiling and comparison ---------------------------------------------------------

# Columns of the driver's tables by kind.
NUMERIC = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey", "n_regionkey"),
    "customer": ("c_custkey", "c_nationkey", "c_acctbal"),
    "supplier": ("s_suppkey", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_totalprice"),
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax",
    ),
    "events": ("event_id", "user_id", "value"),
    "documents": ("doc_id", "n_chars"),
    "embeddings": ("vec_id", "label"),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn"),
}
FRACTIONAL = {
    "c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "value",
}
WHOLE = {t: tuple(c for c in names if c not in FRACTIONAL) for t, names in NUMERIC.items()}
MOMENTS = {"orders": ("o_orderdate",), "events": ("ts",), "lineitem": ("l_shipdate",)}
TEXT = {
    "region": ("r_name",),
    "nation": ("n_name",),
    "customer": ("c_name", "c_mktsegment"),
    "supplier": ("s_name",),
    "part": ("p_name", "p_brand", "p_type"),
    "orders": ("o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_returnflag", "l_linestatus"),
    "events": ("event_type", "props"),
    "documents": ("text", "lang", "source"),
    "pages": ("url", "html"),
    "benchmark": ("text",),
    "conversations": ("role", "text"),
}
NESTED = {"embeddings": ("embedding",)}
KINDS = (NUMERIC, MOMENTS, TEXT, NESTED)
TABLE_LIST = ", ".join(f"'{t}'" for t in PROFILED)
SPARK_TYPE = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END"""


def per_column(select: str, kinds: list[dict[str, tuple[str, ...]]], tables) -> str:
    return "\nUNION ALL ".join(
        select.format(c=c, t=t) for t in tables for kind in kinds for c in kind.get(t, ())
    )


COMPARED = {
    "changed": """
SELECT o_orderkey, CASE WHEN o_orderkey % 77 = 0 THEN NULL
  WHEN o_orderkey % 50 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders""",
    "sides": """
SELECT coalesce(l.o_orderkey, r.o_orderkey) AS row_index, l.o_orderkey AS left_o_orderkey,
  l.o_custkey AS left_o_custkey, r.o_orderkey AS right_o_orderkey, r.o_custkey AS right_o_custkey,
  l.o_orderkey = r.o_orderkey AND l.o_custkey = r.o_custkey AS same
FROM orders l FULL JOIN changed r ON l.o_orderkey = r.o_orderkey""",
}

ORACLE |= {
    "q01_profile": per_column(
        """SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_count,
  round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS null_ratio,
  count(DISTINCT {c}) AS unique_count FROM {t}""",
        KINDS,
        PROFILED,
    ),
    "q01_kept_profile": per_column(
        """SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std FROM {t}""",
        [NUMERIC],
        ["lineitem"],
    ),
    "q02_numeric": per_column(
        """SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min,
  CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(CAST(median({c}) AS DOUBLE), 6) AS median FROM {t}""",
        [NUMERIC],
        PROFILED,
    ),
    "q03_datetime": per_column(
        """SELECT '{t}' AS table_name, '{c}' AS column_name, min({c}) AS min_date,
  max({c}) AS max_date FROM {t}""",
        [MOMENTS],
        PROFILED,
    ),
    "q04_text": per_column(
        """SELECT '{t}' AS table_name, '{c}' AS column_name, round(avg(length({c})), 2) AS avg_length,
  CAST(max(length({c})) AS INTEGER) AS max_length,
  (SELECT string_agg(v, ', ' ORDER BY v) FROM
    (SELECT DISTINCT {c} AS v FROM {t} ORDER BY v LIMIT 5)) AS sample_values FROM {t}""",
        [TEXT],
        PROFILED,
    ),
    "q05_top_values": per_column(
        """SELECT * FROM (SELECT '{t}' AS table_name, '{c}' AS column_name,
  CAST({c} AS VARCHAR) AS value, count(*) AS n, CAST(row_number() OVER (
    ORDER BY count(*) DESC, CAST({c} AS VARCHAR) NULLS LAST) AS INTEGER) AS rank
FROM {t} GROUP BY 3) WHERE rank <= 10""",
        [WHOLE, TEXT],
        PROFILED,
    ),
    "q06_overview": "\nUNION ALL ".join(
        f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count,
  CAST({sum(len(kind.get(t, ())) for kind in KINDS)} AS BIGINT) AS column_count,
  (SELECT CAST(sum({" + ".join(
      f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END"
      for kind in KINDS for c in kind.get(t, ())
  )}) AS BIGINT) FROM {t}) AS missing_cells,
  (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows"""
        for t in PROFILED
    ),
    "q07_schema": f"""SELECT table_name, column_name, {SPARK_TYPE} AS type
FROM information_schema.columns WHERE table_name IN ({TABLE_LIST})""",
    "q07_types": f"""SELECT table_name, {SPARK_TYPE} AS type, count(*) AS columns
FROM information_schema.columns WHERE table_name IN ({TABLE_LIST}) GROUP BY ALL""",
    "q07_files": "SELECT 'orders.parquet' AS file_name, count(*) AS row_count FROM orders",
    "q08_positional_diff": with_(
        COMPARED,
        """SELECT count(*) AS total_rows, count(*) FILTER (WHERE same) AS matched_rows,
  count(*) - count(*) FILTER (WHERE same) AS different_rows FROM sides""",
    ),
    "q08_positional_sample": with_(
        COMPARED, "SELECT * EXCLUDE (same) FROM sides WHERE NOT same ORDER BY row_index LIMIT 10"
    ),
    "q09_multiset_diff": with_(
        {
            **COMPARED,
            "l": "SELECT o_orderkey, o_custkey, count(*) AS n FROM orders GROUP BY ALL",
            "r": "SELECT o_orderkey, o_custkey, count(*) AS n FROM changed GROUP BY ALL",
            "m": """SELECT sum(least(l.n, r.n)) AS matched FROM l JOIN r
  ON l.o_orderkey = r.o_orderkey AND l.o_custkey IS NOT DISTINCT FROM r.o_custkey""",
            "t": "SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM changed) AS b, "
            "CAST(matched AS BIGINT) AS matched FROM m",
        },
        """SELECT a AS left_rows, b AS right_rows, matched AS matched_rows,
  a - matched AS only_left, b - matched AS only_right FROM t""",
    ),
    "q10_preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
}
