import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidemark-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cells(spark):
    """Build a table of text columns with ``_row_id`` from rows of tuples."""

    def build(columns, rows):
        schema = ", ".join(f"`{c}` string" for c in columns)
        data = [(i, *row) for i, row in enumerate(rows)]
        return spark.createDataFrame(data, f"_row_id bigint, {schema}")

    return build
