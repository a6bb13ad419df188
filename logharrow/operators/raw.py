"""The lines behind a report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logharrow.functions.columns import ts_text
from logharrow.functions.time import epoch, ntz
from logharrow.session import settled

RECENT = 50

# Fixed value: the columns of the recent feed.
RECENT_COLUMNS = (
    "source_ip", "remote_host", "auth_user", "ts", "method", "path", "protocol",
    "status", "bytes", "user_agent", "received_at",
)


def _newest_first() -> list:
    return [F.desc("ts"), F.desc("received_at"), F.asc_nulls_last("raw")]


@dataclass(frozen=True)
class Cursor:
    """The last line of a page; the next page starts behind it. ``ts`` None: among lines without a time."""

    ts: datetime | None
    received_at: datetime | None
    raw: str | None


def behind(df: DataFrame, cursor: Cursor) -> DataFrame:
    """Lines after the cursor in the order of a listing: newest first, no time last."""
    ts, received, raw = F.col("ts"), F.col("received_at"), F.col("raw")

    def older(c, value):
        return F.lit(False) if value is None else c.isNull() | (c < ntz(value))

    def same(c, value):
        return c.isNull() if value is None else c.eqNullSafe(ntz(value))

    later_line = F.lit(False) if cursor.raw is None else raw.isNull() | (raw > F.lit(cursor.raw))
    tie = same(received, cursor.received_at) & later_line
    return df.where(older(ts, cursor.ts) | (same(ts, cursor.ts) & (older(received, cursor.received_at) | tie)))


def raw_page(df: DataFrame, limit: int, after: Cursor | None = None) -> DataFrame:
    """The newest ``limit`` lines, or those behind a cursor: ``pos``, ``ts`` text, ``line``, ``has_more``.

    One line more is read to learn whether there are more. ``key`` holds what a cursor for
    the next page needs; lines equal in all of it are one place in the order.
    """
    rows = df.select("ts", "received_at", "raw")
    if after is not None:
        rows = behind(rows, after)
    page = rows.orderBy(*_newest_first()).limit(limit + 1)
    everything = Window.partitionBy()  # limit + 1 rows
    return (
        page.withColumns({
            "pos": F.row_number().over(everything.orderBy(*_newest_first())),
            "has_more": F.count("*").over(everything) > limit,
            "key": F.struct("ts", "received_at", "raw"),
        })
        .where(F.col("pos") <= limit)
        .select(
            "pos",
            F.coalesce(ts_text(F.col("ts")), F.lit("")).alias("ts"),
            F.coalesce("raw", F.lit("")).alias("line"),
            "has_more",
            "key",
        )
    )


def _cut_older(df: DataFrame, rows: int) -> DataFrame:
    """Rows of the newest moments that together hold at least ``rows`` rows.

    Counts per minute find the minute in which the list ends (half a million
    minutes a year), counts per millisecond of that minute (60,000) the moment.
    Nothing that belongs to the list is cut: whole milliseconds are kept.
    """
    minute = F.floor(epoch(F.col("ts")) / 60)
    millis = F.floor(F.extract(F.lit("SECOND"), F.col("ts")) * 1000).cast("int")

    def newer(order: str):
        earlier = Window.partitionBy().orderBy(F.desc(order))
        return F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    timed = df.select(minute.alias("_minute"), millis.alias("_millis")).where(F.col("_minute").isNotNull())
    last_minute = (
        timed.groupBy("_minute").agg(F.count("*").alias("_n"))
        .withColumn("_newer", newer("_minute"))
        .where(F.col("_newer") < rows)
        .agg(F.min("_minute").alias("_minute"), F.max("_newer").alias("_before"))
    )
    last = (
        timed.join(F.broadcast(last_minute), "_minute")  # one row
        .groupBy("_minute", "_before", "_millis").agg(F.count("*").alias("_n"))
        .withColumn("_newer", F.col("_before") + newer("_millis"))
        .where(F.col("_newer") < rows)
        .agg(F.struct(F.min("_minute").alias("minute"), F.min("_millis").alias("millis")))
    )
    end = last.scalar()
    kept = (minute > end.getField("minute")) | (
        (minute == end.getField("minute")) & (millis >= end.getField("millis"))
    )
    return df.where(kept | F.col("ts").isNull())


def export_lines(df: DataFrame, cap: int | None = None) -> DataFrame:
    """All matching lines as text, newest first: ``pos``, ``value``.

    With a ``cap`` the list ends there, and a last line says so if any were left out.
    Without one, lines are sorted by ranges of time over all tasks; a line's position is
    its place in its range plus what the ranges before hold, so no task sees them all.
    """
    wanted = df.where(F.col("ts").isNotNull()).select("ts", "received_at", "raw")
    line = F.concat(ts_text(F.col("ts")), F.lit(" "), F.coalesce("raw", F.lit(""))).alias("value")
    if cap is None:
        ordered = settled(wanted.orderBy(*_newest_first()).select(line, F.spark_partition_id().alias("part"), "ts", "received_at", "raw"), "export")
        per = Window.partitionBy("part").orderBy(*_newest_first())
        sizes = ordered.groupBy("part").agg(F.count("*").alias("_n"))  # one row for each range
        before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select("part", before.alias("_before"))
        placed = ordered.withColumn("_place", F.row_number().over(per)).join(F.broadcast(starts), "part")
        return placed.select((F.col("_before") + F.col("_place")).alias("pos"), "value")
    newest = _cut_older(wanted, cap + 1).orderBy(*_newest_first()).limit(cap + 1)
    pos = F.row_number().over(Window.partitionBy().orderBy(*_newest_first()))  # cap + 1 rows
    marker = F.lit(f"# {cap} lines written; older ones match too and were left out")
    return newest.withColumn("pos", pos.cast("bigint")).select(
        "pos", F.when(F.col("pos") > cap, marker).otherwise(line).alias("value")
    )


def write_export(df: DataFrame, path: str, cap: int | None = None) -> None:
    """Write an export as text files; read by name, one behind the other, they are in order."""
    lines = export_lines(df, cap)
    lines.orderBy("pos").select("value").write.text(path)


def recent(df: DataFrame, n: int = RECENT) -> DataFrame:
    """The ``n`` rows that arrived last, times as text."""
    newest = df.orderBy(F.desc("received_at"), F.asc_nulls_last("raw")).limit(n)
    return newest.select(*[
        ts_text(F.col(c)).alias(c) if c in ("ts", "received_at") else F.col(c) for c in RECENT_COLUMNS
    ])


def recent_json(df: DataFrame, n: int = RECENT) -> DataFrame:
    """The recent feed as one JSON text per row; absent values are written as null."""
    shown = recent(df, n)
    return shown.select(
        F.to_json(F.struct(*shown.columns), {"ignoreNullFields": "false"}).alias("value")
    )
