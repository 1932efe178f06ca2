import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketmill.columns import TRANSACTION_TYPES  # noqa: E402
from basketmill.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture(scope="session")
def log(spark):
    """Rows (bill, user, item, date, price, discount, quantity, location) as a log."""
    schema = T.StructType([T.StructField(n, t) for n, t in TRANSACTION_TYPES.items()])

    def build(rows):
        return spark.createDataFrame(
            [(b, u, i, d if isinstance(d, datetime) else datetime.fromisoformat(d), p, s, q, loc)
             for b, u, i, d, p, s, q, loc in rows],
            schema,
        )

    return build


@pytest.fixture(scope="session")
def catalogue(spark):
    schema = (
        "item_id string, item_catalog_price double, item_sale_status tinyint,"
        " item_description_len int, category_l1 string, category_l2 string, category_l3 string,"
        " category string, brand string"
    )

    def build(rows):
        return spark.createDataFrame(rows, schema)

    return build
