"""Log tables derived from the given tables, in SQL both engines accept."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

# "Now" for the long ranges and for the short ones; events end on 30 January 2024.
AS_OF = datetime(2024, 1, 31)
NOON = datetime(2024, 1, 30, 12, 34, 56, 789000)


def _address(first: str, key: str) -> str:
    return (
        f"concat('{first}.', cast(cast(floor({key} / 65536) AS bigint) % 256 AS string), '.', "
        f"cast(cast(floor({key} / 256) AS bigint) % 256 AS string), '.', cast({key} % 256 AS string))"
    )


ENVELOPE = {
    "event_id": "event_id",
    "source_ip": _address("10", "user_id"),
    "ts": "CASE WHEN event_id % 101 = 0 THEN NULL ELSE ts END",
    "received_at": "ts + INTERVAL 2 SECOND",
    "raw": "concat('line ', cast(event_id AS string), ' ', event_type)",
    "bytes": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id * 7 % 5000 END",
    "country_code": "CASE user_id % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN '' "
    "WHEN 3 THEN 'FR' WHEN 4 THEN 'fr' ELSE NULL END",
    "country": "CASE user_id % 6 WHEN 0 THEN 'United States' WHEN 1 THEN 'Germany' "
    "WHEN 2 THEN 'Private network' WHEN 3 THEN 'France' WHEN 4 THEN 'France' ELSE NULL END",
}
REQUEST = {
    "remote_host": "concat('203.0.', cast(user_id % 7 AS string), '.', cast(user_id % 251 AS string))",
    "method": "CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END",
    "path": "CASE WHEN event_id % 29 = 0 THEN '' ELSE concat('/', event_type, '/', "
    "cast(event_id % 40 AS string)) END",
    "protocol": "CASE WHEN event_id % 2 = 0 THEN 'HTTP/1.1' ELSE 'HTTP/2.0' END",
    "status": "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type = 'error' "
    "THEN 400 + cast(event_id % 200 AS int) WHEN event_type = 'signup' THEN 301 ELSE 200 END",
    "user_agent": "concat('Agent/', cast(user_id % 5 AS string), ' (x; y)')",
    "referer": "CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('https://ref-', "
    "cast(user_id % 9 AS string), '.example/') END",
}
CLF = {**ENVELOPE, **REQUEST, "ident": "'-'", "auth_user": "concat('u', cast(user_id AS string))"}
PROXY = {
    **ENVELOPE,
    **REQUEST,
    "duration_ms": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END",
    "bytes_read": "event_id % 77",
    "host": "concat('h', cast(user_id % 4 AS string), '.example')",
    "router": "CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('r', cast(event_id % 14 AS string), '@file') END",
    "service": "concat('s', cast(user_id % 12 AS string))",
    "frontend": "concat('fe', cast(user_id % 3 AS string), '~')",
    "backend": "concat('be', chr(92), cast(event_id % 9 AS string))",
    "server": "CASE WHEN event_type = 'error' THEN '<NOSRV>' ELSE concat('srv', cast(event_id % 17 AS string)) END",
    "termination": "CASE WHEN event_type = 'error' THEN 'CC--' ELSE '----' END",
}
FIREWALL = {
    **ENVELOPE,
    "action": "CASE WHEN event_type IN ('error', 'signup') THEN 'deny' ELSE 'allow' END",
    "protocol": "CASE WHEN event_id % 4 = 0 THEN 'udp' ELSE 'tcp' END",
    "src_ip": REQUEST["remote_host"],
    "src_port": "1024 + cast(event_id % 60000 AS int)",
    "dst_ip": "concat('10.0.0.', cast(event_id % 20 AS string))",
    "dst_port": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE cast(event_id % 12 * 100 + 22 AS int) END",
    "src_zone": "concat('z', cast(user_id % 3 AS string))",
    "dst_zone": "'inside'",
    "rule": "CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('rule-', cast(event_id % 30 AS string)) END",
    "event_type": "event_type",
    "application": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END",
}
SOURCES = {
    "ip": _address("10", "s_suppkey"),
    "name": "CASE WHEN s_suppkey % 10 = 3 THEN 'shared name' ELSE s_name END",
    "log_type": "CASE s_suppkey % 7 WHEN 0 THEN 'apache' WHEN 1 THEN 'caddy' WHEN 2 THEN 'cisco_asa' "
    "WHEN 3 THEN 'haproxy' WHEN 4 THEN 'nginx' WHEN 5 THEN 'panos' ELSE 'traefik' END",
    "created_at": "TIMESTAMP '2024-01-01 00:00:00'",
}
SOURCES_SPARK = {**SOURCES, "created_at": "TIMESTAMP_NTZ '2024-01-01 00:00:00'"}
# 64-wide slots from 203.0.0.0 with gaps between them; one has no code, one no name.
GEO = {
    "lo": "3405774848 + cast(n_nationkey AS bigint) * 64",
    "hi": "3405774848 + cast(n_nationkey AS bigint) * 64 + 40",
    "country_code": "CASE WHEN n_nationkey = 7 THEN '' ELSE concat(chr(65 + cast(n_nationkey AS int)), "
    "chr(65 + cast(n_regionkey AS int))) END",
    "country": "CASE WHEN n_nationkey = 9 THEN NULL ELSE n_name END",
}
# Addresses of every kind: public, private, malformed.
VISITOR = (
    "CASE event_type WHEN 'signup' THEN concat('10.1.', cast(user_id % 256 AS string), '.9') "
    "WHEN 'error' THEN concat('host-', cast(user_id AS string)) "
    "WHEN 'view' THEN concat(' 203.0.', cast(user_id % 7 AS string), '.', cast(user_id % 300 AS string), ' ') "
    f"ELSE {REQUEST['remote_host']} END"
)


def sql(columns: dict[str, str], table: str = "events") -> str:
    """The derivation as SQL text."""
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def clf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(read(spark, sf_dir, "events"), CLF)


def proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(read(spark, sf_dir, "events"), PROXY)


def firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(read(spark, sf_dir, "events"), FIREWALL)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(read(spark, sf_dir, "supplier"), SOURCES_SPARK)


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(read(spark, sf_dir, "nation"), GEO)
