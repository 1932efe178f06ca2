import os

import pytest
from llm_cases import SCHEMA, TEXTS, rows_of

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case, and columns whose names clash with those of operators."""
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def save(tmp_path_factory):
    """Writes tables into a folder that a query reads."""

    def write(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        return str(path)

    return write
