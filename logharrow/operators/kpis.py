"""Headline counters: one row per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharrow.functions.columns import part_pct
from logharrow.operators.quantile import exact_quantile


def has_data(df: DataFrame) -> bool:
    """Whether a table has any row; stops at the first."""
    return not df.isEmpty()


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_rows"))


def _counters(df: DataFrame, client: str, sums: dict[str, Column]) -> DataFrame:
    """Exact distinct clients and countries beside plain sums, in one scan.

    Rows collapse by (client, country code) before any distinct count, so the raw
    rows are aggregated once, map-side, instead of being repeated per distinct.
    """
    partial = df.groupBy(client, "country_code").agg(
        F.count("*").alias("_rows"), *[c.alias(f"_{name}") for name, c in sums.items()]
    )
    return partial.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("_rows"),
        F.count_distinct(F.col(client)).alias("_clients"),
        F.count_distinct(F.nullif("country_code", F.lit(""))).alias("_countries"),
        *[F.sum(f"_{name}").alias(f"_{name}") for name in sums],
    )


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def web_kpis(df: DataFrame) -> DataFrame:
    """Requests, distinct clients and countries, bytes, errors and the error rate."""
    return _counters(df, "remote_host", {
        "bytes": F.sum("bytes"),
        "errors": F.count_if(F.col("status") >= 400),
    }).select(
        F.col("_rows").alias("requests"),
        F.col("_clients").alias("unique_ips"),
        F.col("_countries").alias("countries"),
        _or_zero("_bytes").alias("total_bytes"),
        _or_zero("_errors").alias("errors"),
        part_pct(_or_zero("_errors"), F.col("_rows")).alias("error_rate"),
    )


def proxy_kpis(df: DataFrame, p95: str = "exact") -> DataFrame:
    """Web counters plus mean and 95th percentile of the duration, NULLs ignored.

    ``p95``: ``exact`` (interpolated) or ``sketch`` (a bounded-error rank value).
    """
    counters = _counters(df, "remote_host", {
        "bytes": F.sum("bytes"),
        "errors": F.count_if(F.col("status") >= 400),
        "ms": F.sum("duration_ms"),
        "timed": F.count("duration_ms"),
    })
    if p95 == "exact":
        tail = exact_quantile(df, "duration_ms", 0.95)
    elif p95 == "sketch":
        tail = df.agg(F.percentile_approx("duration_ms", 0.95, 10_000).alias("quantile"))
    else:
        raise ValueError(f"unknown p95 method '{p95}'")
    return counters.select(
        F.col("_rows").alias("requests"),
        F.col("_clients").alias("unique_ips"),
        F.col("_countries").alias("countries"),
        _or_zero("_bytes").alias("total_bytes"),
        _or_zero("_errors").alias("errors"),
        part_pct(_or_zero("_errors"), F.col("_rows")).alias("error_rate"),
        F.when(F.col("_timed") > 0, F.col("_ms") / F.col("_timed")).alias("avg_ms"),
        tail.scalar().alias("p95_ms"),
    )


def firewall_kpis(df: DataFrame) -> DataFrame:
    """Events, denials and their rate, distinct sources and countries, bytes."""
    return _counters(df, "src_ip", {
        "bytes": F.sum("bytes"),
        "denied": F.count_if(F.col("action") == "deny"),
    }).select(
        F.col("_rows").alias("events"),
        _or_zero("_denied").alias("denied"),
        part_pct(_or_zero("_denied"), F.col("_rows")).alias("deny_rate"),
        F.col("_clients").alias("sources"),
        F.col("_countries").alias("countries"),
        _or_zero("_bytes").alias("total_bytes"),
    )
