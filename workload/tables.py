"""A purchase log and an item catalogue made from the driver's order tables.

The rules that put nulls into some columns exercise null handling only; every
row of the tables is read. Rows without a user are dropped by the reader, so users are
blanked only where that itself is the feature (``blanks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketmill.session import tune
from basketmill.sources.tables import as_items, as_transactions


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# What names an item: names and brands repeat (about 1,600), parts hardly do, and bare
# names (64) give a catalogue with copies.
NAMED, PART, NAME = "named", "part", "name"
ITEM_OF = {
    NAMED: "p_name || ' ' || p_brand",
    PART: "CAST(p_partkey AS STRING)",
    NAME: "p_name",
}


def purchase_log(
    spark: SparkSession, sf_dir: str, item: str = NAMED, blanks: bool = False
) -> DataFrame:
    lines, orders, part, supplier = (
        read(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier")
    )
    tune(spark, lines, orders, part, supplier)
    user = "CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE o_custkey END" if blanks else "o_custkey"
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(part, lines.l_partkey == part.p_partkey)
        .join(supplier, lines.l_suppkey == supplier.s_suppkey)
    )
    raw = joined.select(
        F.expr("CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_orderkey END").alias("bill_id"),
        F.expr(user).alias("customer_id"),
        F.expr(ITEM_OF[item]).alias("item_id"),
        F.expr(
            "timestampadd(SECOND, CAST((o_orderkey * 7919) % 86400 AS INT), o_orderdate)"
        ).alias("updated_date"),
        F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE p_retailprice END").alias("price"),
        F.expr("CASE WHEN l_linenumber = 6 THEN NULL ELSE l_discount * 100 END").alias("discount"),
        F.col("l_quantity").alias("quantity"),
        F.expr(
            "CASE WHEN l_suppkey % 10 = 7 THEN NULL ELSE CAST(s_nationkey AS BIGINT) END"
        ).alias("location"),
    )
    return as_transactions(raw)


def catalogue(spark: SparkSession, sf_dir: str, item: str = NAMED) -> DataFrame:
    part = read(spark, sf_dir, "part")
    word = "split_part(p_name, ' ', 2)"
    raw = part.select(
        F.expr(ITEM_OF[item]).alias("item_id"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("category_l1"),
        F.expr(word).alias("category_l2"),
        F.col("p_name").alias("category_l3"),
        F.expr(f"p_type || '/' || {word}").alias("category"),
        F.expr("CASE WHEN p_size = 1 THEN NULL ELSE p_brand END").alias("brand"),
        F.expr("p_size % 3").alias("sale_status"),
        F.expr("p_name || ' ' || p_type").alias("description"),
    )
    return as_items(raw)
