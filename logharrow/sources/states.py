"""Headline counters kept with the commits: sums and mergeable sketches by file and hour.

A HyperLogLog sketch of the clients and a KLL sketch of the durations stand for the values of an
hour; merged over any hours they say what one sketch over all the rows would. So the counters of
a month or a year need no log line but those of the hour in which the range begins.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharrow import registry
from logharrow.functions.columns import part_pct
from logharrow.functions.time import cutoff, micros, micros_of
from logharrow.sources import commits

# Buckets of the client sketch, as a power of two (about 0.8 % standard error), and size of the duration sketch.
CLIENT_BITS = 14
DURATION_K = 400
VALUES = (
    "n long, bytes long, errors long, denied long, ms double, timed long, codes array<string>, clients binary, durations binary"
)
SCHEMA = "log_type string, day string, batch string, file string, hour long, " + VALUES


def _has(name: str, column: str) -> bool:
    return column in registry.get(name).schema.names


def _values(name: str) -> list[Column]:
    """What is kept of some rows of a type."""
    firewall = registry.get(name).report.family == "firewall"
    client = F.col("src_ip" if firewall else "remote_host")
    ms = F.col("duration_ms") if _has(name, "duration_ms") else F.lit(None).cast("double")
    number = F.when(~F.isnan(ms), ms)
    return [
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"),
        (F.lit(0) if firewall else F.count_if(F.col("status") >= 400)).cast("long").alias("errors"),
        (F.count_if(F.col("action") == "deny") if firewall else F.lit(0)).cast("long").alias("denied"),
        F.sum(ms).alias("ms"), F.count(ms).alias("timed"),
        F.collect_set(F.nullif("country_code", F.lit(""))).alias("codes"),  # country codes: few by nature
        F.hll_sketch_agg(client, F.lit(CLIENT_BITS)).alias("clients"),
        F.kll_sketch_agg_double(number, F.lit(DURATION_K)).alias("durations"),
    ]


def states_path(counts: str) -> str:
    return counts.replace("/counts/", "/states/")


def write_states(spark: SparkSession, root: str, folders: Iterable[commits.Key], counts: str) -> None:
    """Store the states of new folders, by file and hour, beside their ``counts``; rows without a time are in none."""
    root, by_table = root.rstrip("/"), {}
    for table, day, batch in folders:
        by_table.setdefault(table, []).append(f"{root}/{table}/{day}/{batch}")
    place = F.split(F.col("_from"), "/")
    frames = []
    for name, paths in by_table.items():
        rows = spark.read.schema(registry.get(name).schema).option("basePath", f"{root}/{name}").parquet(*paths)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_from")).where("ts IS NOT NULL")
        kept = rows.groupBy("_from", F.floor(micros_of(F.col("ts")) / commits.HOUR).alias("hour")).agg(*_values(name))
        keys = [F.element_at(place, -i).alias(c) for i, c in ((3, "day"), (2, "batch"), (1, "file"))]
        frames.append(kept.select(F.lit(name).alias("log_type"), *keys, "hour", *columns()))
    if frames:
        reduce(DataFrame.unionAll, frames).write.parquet(f"{root}/{states_path(counts)}")


def columns() -> list[str]:
    return [part.split()[0] for part in VALUES.split(", ")]


def states_of(spark: SparkSession, snapshot: commits.Snapshot, name: str) -> DataFrame:
    """The stored states of a type's live files."""
    portions = [p for p in snapshot.of(name) if p.counts]
    paths = sorted({states_path(p.counts) for p in portions})
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    # Of a commit whose folders are not all live any more, those that are.
    live = spark.createDataFrame([(p.day, p.batch) for p in portions], "day string, batch string")
    rows = spark.read.schema(SCHEMA).parquet(*[f"{snapshot.root}/{path}" for path in paths])
    return rows.where(F.col("log_type") == name).join(live, ["day", "batch"], "left_semi")


def of_rows(rows: DataFrame, name: str) -> DataFrame:
    """The state of some rows of a type, one row."""
    return rows.agg(*_values(name)).select(*columns())


def merged(states: DataFrame) -> DataFrame:
    """One state for many."""
    sums = [F.sum(c).alias(c) for c in ("n", "bytes", "errors", "denied", "ms", "timed")]
    return states.agg(
        *sums, F.array_distinct(F.flatten(F.collect_set("codes"))).alias("codes"),
        F.hll_union_agg("clients").alias("clients"), F.kll_merge_agg_double("durations").alias("durations"),
    )


def kpis_of(state: DataFrame, name: str) -> DataFrame:
    """The counters of a report, see ``operators.kpis``, from a state: clients and percentile are estimates."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    clients = F.coalesce(F.hll_sketch_estimate("clients"), F.lit(0)).cast("long")
    countries = F.coalesce(F.size("codes"), F.lit(0)).cast("long")
    if registry.get(name).report.family == "firewall":
        return state.select(
            zero("n").alias("events"), zero("denied").alias("denied"), part_pct(zero("denied"), zero("n")).alias("deny_rate"),
            clients.alias("sources"), countries.alias("countries"), zero("bytes").alias("total_bytes"),
        )
    columns = [
        zero("n").alias("requests"), clients.alias("unique_ips"), countries.alias("countries"), zero("bytes").alias("total_bytes"),
        zero("errors").alias("errors"), part_pct(zero("errors"), zero("n")).alias("error_rate"),
    ]
    if registry.get(name).report.family == "proxy":
        timed = F.kll_sketch_get_n_double("durations") > 0
        columns += [
            F.when(F.col("timed") > 0, F.col("ms") / F.col("timed")).alias("avg_ms"),
            F.when(timed, F.kll_sketch_get_quantile_double("durations", F.lit(0.95))).alias("p95_ms"),
        ]
    return state.select(*columns)


def whole_hours(range_: str, as_of: datetime) -> tuple[int, int]:
    """Where a range begins, in microseconds, and its first whole hour."""
    since = micros(cutoff(range_, as_of))
    return since, -(-since // commits.HOUR)

