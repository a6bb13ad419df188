"""Declared schemas. Nothing is ever inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TS = T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW_ENVELOPE = _struct(("peer_ip", _S), ("payload", _S), ("received_at", _TS))

ENVELOPE = _struct(
    ("source_ip", _S), ("hostname", _S), ("tag", _S), ("raw", _S), ("received_at", _TS)
)

CLF = _struct(
    ("source_ip", _S), ("remote_host", _S), ("ident", _S), ("auth_user", _S), ("ts", _TS),
    ("method", _S), ("path", _S), ("protocol", _S), ("status", _I), ("bytes", _L),
    ("referer", _S), ("user_agent", _S), ("country", _S), ("country_code", _S),
    ("received_at", _TS), ("raw", _S),
)

TRAEFIK = _struct(
    ("source_ip", _S), ("remote_host", _S), ("ts", _TS), ("method", _S), ("path", _S),
    ("protocol", _S), ("status", _I), ("bytes", _L), ("router", _S), ("service", _S),
    ("duration_ms", _D), ("user_agent", _S), ("host", _S), ("country", _S),
    ("country_code", _S), ("received_at", _TS), ("raw", _S),
)

CADDY = _struct(
    ("source_ip", _S), ("remote_host", _S), ("ts", _TS), ("method", _S), ("path", _S),
    ("protocol", _S), ("status", _I), ("bytes", _L), ("bytes_read", _L), ("duration_ms", _D),
    ("user_agent", _S), ("referer", _S), ("host", _S), ("country", _S), ("country_code", _S),
    ("received_at", _TS), ("raw", _S),
)

HAPROXY = _struct(
    ("source_ip", _S), ("remote_host", _S), ("ts", _TS), ("method", _S), ("path", _S),
    ("protocol", _S), ("status", _I), ("bytes", _L), ("duration_ms", _D), ("frontend", _S),
    ("backend", _S), ("server", _S), ("termination", _S), ("country", _S),
    ("country_code", _S), ("received_at", _TS), ("raw", _S),
)

FIREWALL = _struct(
    ("source_ip", _S), ("ts", _TS), ("action", _S), ("protocol", _S), ("src_ip", _S),
    ("src_port", _I), ("dst_ip", _S), ("dst_port", _I), ("src_zone", _S), ("dst_zone", _S),
    ("rule", _S), ("bytes", _L), ("event_type", _S), ("application", _S), ("country", _S),
    ("country_code", _S), ("received_at", _TS), ("raw", _S),
)

SOURCES = T.StructType([
    T.StructField("ip", _S, False),
    T.StructField("name", _S, False),
    T.StructField("log_type", _S, False),
    T.StructField("created_at", _TS, True),
])

GEO_RANGES = _struct(("lo", _S), ("hi", _S), ("country_code", _S), ("country", _S))

# Columns our writer adds for pruning, retention and idempotent commits.
PARTITIONS = ("event_date", "ingest_batch")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give ``df`` exactly the declared columns, adding absent ones as NULL.

    This is the additive schema evolution of the event tables: old data read
    under a newer schema gains the new columns, and unknown columns are dropped.
    """
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def with_event_date(df: DataFrame) -> DataFrame:
    """Add the partition column: the day a row ages by."""
    return df.withColumn("event_date", F.to_date(F.coalesce("ts", "received_at")))
