import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def events(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet")


@pytest.fixture
def logs_of(spark):
    """Canonical logs from dicts; missing fields are null."""
    from datetime import datetime

    from sentinel.sources.logs import LOG_SCHEMA

    def build(rows):
        filled = []
        for i, row in enumerate(rows):
            row = {"event_id": i, "index_name": "app-logs", **row}
            row["ts"] = datetime.fromisoformat(row["ts"])
            row.setdefault("message_template", row.get("message"))
            filled.append(tuple(row.get(f.name) for f in LOG_SCHEMA.fields))
        return spark.createDataFrame(filled, LOG_SCHEMA)

    return build
