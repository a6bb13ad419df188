"""The overview across all log types."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharrow import registry
from logharrow.functions.columns import country_code, country_label
from logharrow.functions.time import ntz
from logharrow.operators.lookup import lookup_join

COLUMNS = ("source_ip", "ts", "country", "country_code")


def union_types(tables: dict[str, DataFrame]) -> DataFrame:
    """All types' rows as ``log_type`` and the columns every type has."""
    return reduce(
        DataFrame.unionAll,
        [df.select(F.lit(name).alias("log_type"), *COLUMNS) for name, df in tables.items()],
    )


def overview_base(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Counts per (type, source, country), from which every panel follows.

    One scan instead of one per panel. Its size is that of the dimensions, not of
    the log: senders times the countries each of them saw.
    """
    since = ntz((as_of - timedelta(hours=24)).replace(microsecond=0))
    return rows.groupBy(
        "log_type", "source_ip",
        country_label(F.col("country")).alias("country"),
        country_code(F.col("country_code")).alias("code"),
    ).agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= since).alias("n24"))


def by_type(base: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Total and last-day rows per type; registered types without rows show 0."""
    spark: SparkSession = base.sparkSession
    wanted = F.array(*[F.lit(name) for name in (names or registry.names())])
    types = spark.range(1).select(F.explode(wanted).alias("log_type"))
    counted = base.groupBy("log_type").agg(F.sum("n").alias("total"), F.sum("n24").alias("last24"))
    return types.join(counted, "log_type", "left").select(
        "log_type",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("last24", F.lit(0)).alias("last24"),
    )


def by_source(base: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows per sender, named where a name is configured.

    Senders are counted by address: two with the same name stay two rows.
    """
    counted = base.groupBy("source_ip").agg(F.sum("n").alias("count"))
    named = lookup_join(counted, sources.select(F.col("ip").alias("source_ip"), "name"), "source_ip")
    return named.select("source_ip", F.coalesce("name", "source_ip").alias("label"), "count")


def by_country(base: DataFrame) -> DataFrame:
    return base.groupBy("code", F.col("country").alias("name")).agg(F.sum("n").alias("count"))


def totals(base: DataFrame) -> DataFrame:
    """One row: all rows, last day, average per minute of the last day, countries."""
    last24 = F.coalesce(F.sum("n24"), F.lit(0))
    return base.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        last24.alias("last24"),
        F.round(last24 / F.lit(1440.0), 2).alias("avg_per_min"),
        F.count_distinct(F.nullif("code", F.lit(""))).alias("country_count"),
    )
