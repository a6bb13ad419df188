"""Event tables: one Parquet table per log type, partitioned by day and batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharrow import registry
from logharrow.operators.geo import GeoIndex, with_country
from logharrow.schemas import PARTITIONS, conform, with_event_date
from logharrow.sources import commits, files, rewrites

# Tables written at the same time; the end of one, like naming its files, keeps no core from the others.
TABLES_AT_ONCE = 4


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def stored_schema(spec: registry.LogTypeSpec) -> T.StructType:
    partitions = T.StructType().add("event_date", T.DateType()).add("ingest_batch", T.StringType())
    return T.StructType(spec.schema.fields + partitions.fields)


def init_tables(spark: SparkSession, root: str) -> None:
    """Create every registered type's table, leaving existing ones alone."""
    for name, spec in registry.REGISTRY.items():
        path = table_path(root, name)
        if not files.exists(spark, path):
            # An unpartitioned empty write leaves a folder that reads as no rows.
            spark.createDataFrame([], spec.schema).write.mode("ignore").parquet(path)


def open_table(spark: SparkSession, root: str, name: str, snapshot: commits.Snapshot | None = None) -> DataFrame:
    """Scan a type's table under the schema declared today.

    Columns added since a file was written read as NULL. The files are those of the latest
    commit, or of a ``snapshot``; no data folder is listed. Within ``commits.pinned`` they
    stay until the block ends; else a prune or compaction may delete them under a long scan.
    """
    path = table_path(root, name)
    snapshot = snapshot or commits.latest(spark, root)
    hidden = rewrites.hidden(spark, path, name in snapshot.tables)
    if name in snapshot.tables:
        rows = read_portions(spark, root, name, snapshot.of(name))
    else:  # filled, or created, without a log
        rows = spark.read.schema(stored_schema(registry.get(name))).parquet(path)
    return rows if hidden is None else rows.where(~hidden)


def read_portions(spark: SparkSession, root: str, name: str, portions: list[commits.Portion]) -> DataFrame:
    """Rows of some folders of a table."""
    return read_files(spark, root, name, [(p, f) for p in portions for f in p.files])


def read_files(spark: SparkSession, root: str, name: str, chosen: list[tuple[commits.Portion, commits.File]]) -> DataFrame:
    """Rows of some files of a table."""
    path, schema = table_path(root, name), stored_schema(registry.get(name))
    if not chosen:
        return spark.createDataFrame([], schema)
    paths = [f"{root.rstrip('/')}/{p.folder}/{f.name}" for p, f in chosen]
    return spark.read.schema(schema).option("basePath", path).parquet(*paths)


def to_events(envelope: DataFrame, name: str, geo: GeoIndex | None) -> DataFrame:
    """Envelope rows of one type to event rows: parse, keep what parsed, add country."""
    return as_events(registry.get(name).parse(envelope), name, geo)


def as_events(parsed: DataFrame, name: str, geo: GeoIndex | None) -> DataFrame:
    """Event rows of one type from parsed lines."""
    spec = registry.get(name)
    return conform(with_country(parsed.where("parsed"), spec.geo_column, geo), spec.schema)


def append_batch(events: DataFrame, path: str, batch: str | int) -> None:
    """Store one batch. Storing the same batch again replaces it.

    ``batch`` names the batch among all that ever go into the table: a stream's batches
    are named by stream and number, see ``stream_batch``. Rows are written to folders of
    their own and show with one commit, which drops what an earlier try committed; so a batch
    that was cut short or delivered twice is stored exactly once, and readers see the old rows or
    the new. Rows are not reshuffled; ``compact`` merges the small files later.
    """
    root, name = rewrites.split_path(path)
    append_batches({name: events}, root, batch)


def append_batches(events: dict[str, DataFrame], root: str, batch: str | int) -> None:
    """``append_batch`` for several tables of a root, by name: they are written side by side, and show the batch with one commit."""
    spark, names = next(iter(events.values())).sparkSession, list(events)
    for name in names:
        commits.adopt(spark, root, name, rewrites.described)

    def store(name: str) -> list[commits.Key]:
        return write_attempt(with_event_date(events[name]), table_path(root, name), attempt)

    with staged(spark, root, batch) as attempt:
        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            folders = sum(pool.map(inheritable_thread_target(spark)(store), names), [])
        commit_batch(spark, root, batch, rewrites.described(spark, root, folders), names)


def batch_of(folder: str) -> str:
    """The batch a folder belongs to, whichever try wrote it."""
    return folder.split("=", 1)[1].split(".try-")[0]


@contextmanager
def staged(spark: SparkSession, root: str, batch: str | int) -> Iterator[str]:
    """A name for this try of a batch, under which nothing was written before.

    A note keeps the name from being used again while the try may have left files.
    """
    batch = str(batch)
    now = commits.latest(spark, root)
    note = f"{root.rstrip('/')}/{commits.LOG}/tries/{batch}"
    used = any(batch_of(key[2]) == batch for key in [*now.live, *now.dropped])
    first = files.create_new(spark, note, "") and not used
    yield batch if first else f"{batch}.try-{uuid.uuid4().hex[:12]}"
    files.remove(spark, note)


def write_attempt(dated: DataFrame, path: str, attempt: str) -> list[commits.Key]:
    """Write rows that have an ``event_date`` as one try of a batch; the folders it made.

    Nobody reads them before a commit.
    """
    spark, seen = dated.sparkSession, Observation()
    dated = dated.observe(
        seen, F.min("event_date").alias("low"), F.max("event_date").alias("high"), F.count("*").alias("n"), F.count("event_date").alias("dated")
    )
    (
        dated.withColumn("ingest_batch", F.lit(attempt))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )
    found = seen.get
    if not found["n"]:
        return []
    days = []
    for day in files.list_dirs(spark, path):
        value = day.removeprefix("event_date=")
        if value == day:
            continue
        if value == "__HIVE_DEFAULT_PARTITION__":
            if found["dated"] < found["n"]:
                days.append(day)
        elif found["low"] is not None and str(found["low"]) <= value <= str(found["high"]):
            days.append(day)
    return rewrites.folders_of(spark, path, attempt, days)


def commit_batch(
    spark: SparkSession, root: str, batch: str | int, portions: list[commits.Portion], names: list[str], streams: dict | None = None
) -> None:
    """Make a batch count in all its tables at once, in the place of an earlier try that was committed."""
    while True:
        now = commits.latest(spark, root)
        new = {p.key for p in portions}
        old = [key for key in now.live if key[0] in names and batch_of(key[2]) == str(batch) and key not in new]
        try:
            commits.commit(spark, root, portions, old, tables=names, streams=streams or {})
            return
        except commits.Superseded:
            continue


def stream_batch(stream: str, number: int) -> str:
    """The name of a stream's batch. Streams count from 0 each, so the number alone is no name."""
    return f"{stream}-{number}"
