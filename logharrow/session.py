"""Session defaults and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the engine is designed for; a cluster profile may override any of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "logharrow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, or, where that is unset, under the warehouse.

    Both are shared by the driver and all executors of a cluster; a machine's own
    temporary folder is never used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/logharrow/{purpose}-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over all cores, where a file of one row group, or a broker with few parts, would keep few at work."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def in_time_order(df: DataFrame, column: str, purpose: str) -> DataFrame:
    """``df`` settled by ranges of a time, two for each core: a task that stores some of them by day holds few days, so a day has few files."""
    return settled(df.repartitionByRange(2 * df.sparkSession.sparkContext.defaultParallelism, column), purpose)


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to a fresh work folder and read again: computed once, lineage cut."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
