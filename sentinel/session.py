"""Session helpers: UTC clock, shared work folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_WORK_DIRS: dict[str, str] = {}


def use_utc(spark: SparkSession) -> SparkSession:
    """All windows are UTC; NTZ timestamps are read as UTC wall clock."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_WORK_DIRS:
        _LOCAL_WORK_DIRS[app] = tempfile.mkdtemp(prefix="sentinel-")
    return _LOCAL_WORK_DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/sentinel/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once, read many: the result no longer depends on executors that may be lost."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
