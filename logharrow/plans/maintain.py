"""Retention and compaction of the event tables."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logharrow import registry
from logharrow.functions.columns import ageing_time
from logharrow.functions.time import micros, ntz
from logharrow.schemas import PARTITIONS
from logharrow.sources import commits, leases, rewrites
from logharrow.sources.tables import read_portions, table_path

TARGET_FILE_BYTES = 256 * 1024 * 1024
# A day is worth compacting from this many files more than its bytes need, or with this share
# of undersized files when it holds more than one target file.
COMPACT_FILES = 8
COMPACT_SMALL_RATIO = 0.30
# Tables worked on at the same time; each is one or two Spark jobs.
TABLES_AT_ONCE = 4


def retention_cutoff(retention_days: int, as_of: datetime) -> datetime:
    return (as_of - timedelta(days=retention_days)).replace(microsecond=0)


def survivors(df: DataFrame, retention_days: int, as_of: datetime) -> DataFrame:
    """Rows young enough to keep; 0 days keeps everything.

    A row ages by its event time, or by its arrival when it has none.
    """
    if retention_days == 0:
        return df
    age = ageing_time(F.col("ts"), F.col("received_at"))
    return df.where(F.coalesce(age >= ntz(retention_cutoff(retention_days, as_of)), F.lit(True)))


def _day_of(folder: str) -> date | None:
    value = folder.split("=", 1)[1]
    try:
        return date.fromisoformat(value)
    except ValueError:
        return None  # rows without any time are never pruned


def _replace(spark: SparkSession, path: str, old: list[commits.Portion], rows: DataFrame | None) -> bool:
    """Put ``rows``, if any, in the place of some folders, see ``rewrites``; False if another rewrite was first."""
    rewrite = rewrites.begin(spark, path, [(p.day, p.batch) for p in old])
    if rows is not None:
        (
            rows.withColumn(PARTITIONS[1], F.lit(rewrite.batch))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*PARTITIONS).parquet(path)
        )
    try:
        rewrites.commit(spark, path, rewrite)
    except commits.Superseded:
        return False
    return True


def prune_table(
    spark: SparkSession, root: str, name: str, retention_days: int, as_of: datetime, keep_seconds: float = 0.0
) -> int:
    """Remove rows older than the window from one table; returns how many.

    The log knows the ages in each folder: those that are old as a whole are dropped unread, and
    those with old and young rows are rewritten without the old ones, all with one commit. What
    streams add meanwhile stays, and is pruned by the next run. Files go when no pinned reader needs them.
    """
    if retention_days == 0:
        return 0
    path, cutoff = table_path(root, name), micros(retention_cutoff(retention_days, as_of))
    rewrites.recover(spark, path)
    commits.adopt(spark, root, name, rewrites.described)
    removed = 0
    with commits.pinned(spark, root) as now:
        old = [p for p in now.of(name) if any(f.oldest is not None and f.oldest < cutoff for f in p.files)]
        edge = [p for p in old if not all(f.aged == f.rows and f.youngest < cutoff for f in p.files)]
        young = survivors(read_portions(spark, root, name, edge), retention_days, as_of) if edge else None
        left = young.count() if edge else 0
        if old and _replace(spark, path, old, young):
            removed = sum(p.rows for p in old) - left
    commits.sweep(spark, root, keep_seconds)
    return removed


def _each_table(spark: SparkSession, root: str, keep_seconds: float, work) -> dict[str, int]:
    """``work`` for every registered table, several at a time; what one kept from the others' sweeps goes last."""
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        done = dict(zip(registry.names(), pool.map(work, registry.names())))
    commits.sweep(spark, root, keep_seconds)
    return done


def prune(spark: SparkSession, root: str, retention_days: int, as_of: datetime, keep_seconds: float = 0.0) -> dict[str, int]:
    """Prune every registered table; rows removed by type."""
    return _each_table(spark, root, keep_seconds, lambda name: prune_table(spark, root, name, retention_days, as_of, keep_seconds))


def needs_compaction(sizes: list[int], target: int = TARGET_FILE_BYTES) -> bool:
    """Whether a day is scattered over enough files to be worth rewriting, however small it is."""
    needed = -(-sum(sizes) // target)
    if len(sizes) <= max(needed, 1):
        return False
    small = sum(1 for size in sizes if size < target // 2)
    return len(sizes) - needed >= COMPACT_FILES or (needed > 1 and small / len(sizes) >= COMPACT_SMALL_RATIO)


def compact_table(
    spark: SparkSession, root: str, name: str, days: list[date], target: int = TARGET_FILE_BYTES, force: bool = False,
    keep_seconds: float = 0.0,
) -> int:
    """Merge the small files of some days of one table, all in one job; returns the days rewritten.

    Rows are dealt out by day and range of time, so that each file covers a stretch of time
    and its statistics let reports skip it. Batches that streams add to those days
    meanwhile are left alone, and readers that pinned the old files keep them.
    """
    path = table_path(root, name)
    rewrites.recover(spark, path)
    commits.adopt(spark, root, name, rewrites.described)
    done = 0
    with commits.pinned(spark, root) as now:
        by_day: dict[date | None, list[commits.Portion]] = {}
        for portion in now.of(name):
            by_day.setdefault(_day_of(portion.day), []).append(portion)
        chosen, old, parts = [], [], 0
        for day in days:
            sizes = [f.bytes for p in by_day.get(day, []) for f in p.files]
            if sizes and (force or needs_compaction(sizes, target)):
                chosen.append(day)
                old += by_day[day]
                parts += max(1, -(-sum(sizes) // target))
        if old:
            rows = read_portions(spark, root, name, old)
            ordered = rows.repartitionByRange(parts, PARTITIONS[0], "ts").sortWithinPartitions(PARTITIONS[0], "ts")
            done = len(chosen) if _replace(spark, path, old, ordered) else 0
    commits.sweep(spark, root, keep_seconds)
    return done


def compact(
    spark: SparkSession, root: str, before: date, target: int = TARGET_FILE_BYTES, keep_seconds: float = 0.0
) -> dict[str, int]:
    """Compact every day before a date that is worth it, in every table; days rewritten by type."""

    def work(name: str) -> int:
        days = {_day_of(p.day) for p in commits.adopt(spark, root, name, rewrites.described).of(name)}
        return compact_table(spark, root, name, sorted(d for d in days if d and d < before), target, keep_seconds=keep_seconds)

    return _each_table(spark, root, keep_seconds, work)


def run(
    spark: SparkSession, root: str, retention_days: int, as_of: datetime, target: int = TARGET_FILE_BYTES, keep_seconds: float = 0.0
) -> dict[str, dict[str, int]]:
    """The regular maintenance of all tables: prune, then compact the days before today.

    One run at a time works on a root: a second one raises ``leases.Busy`` and changes nothing.
    """
    with leases.held(spark, root, "maintenance"):
        return {
            "pruned": prune(spark, root, retention_days, as_of, keep_seconds),
            "compacted": compact(spark, root, as_of.date(), target, keep_seconds),
        }


def start_regular(
    spark: SparkSession, root: str, retention_days: int, checkpoint: str, clock=datetime.now, every: str = "1 hour",
    first_after: str = "60 seconds", keep_seconds: float = 3600.0,
) -> StreamingQuery:
    """Maintenance as a stream of ticks: a first run after ``first_after``, then one ``every`` so often.

    A run that finds another at work leaves it to that one. ``clock`` gives the time runs go by, in UTC.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    begun, wait, period = time.monotonic(), _seconds(first_after), _seconds(every)
    due = [begun + wait]

    def tick(batch: DataFrame, _: int) -> None:
        if time.monotonic() < due[0]:
            return
        due[0] = time.monotonic() + period
        try:
            run(batch.sparkSession, root, retention_days, clock(), keep_seconds=keep_seconds)
        except leases.Busy:
            return

    pace = f"{max(1, min(int(wait), int(period)) // 2)} seconds"
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=pace).start()


def _seconds(text: str) -> float:
    number, unit = text.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
