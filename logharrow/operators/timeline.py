"""Zero-filled timelines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logharrow.functions.columns import bar_pct
from logharrow.functions.time import BUCKET_SECONDS, bucket, epoch, ntz, range_key, spine_bounds, spine_end


def spine(spark: SparkSession, range_: str, as_of: datetime) -> DataFrame:
    """Every bucket of a timeline (``bucket`` epoch seconds, ``label``), oldest first.

    12 five-minute, 24 hour, 7 or 30 day, or 12 month buckets, the last of which
    holds ``as_of``.
    """
    key = range_key(range_)
    first, last = spine_bounds(key, as_of)
    width = BUCKET_SECONDS[key]
    step = F.expr("INTERVAL 1 MONTH" if width is None else f"INTERVAL {width} SECOND")
    text = F.col("start").cast("string")  # yyyy-MM-dd HH:mm:ss
    shown = {"7d": (6, 5), "30d": (6, 5), "1y": (1, 7)}.get(key, (12, 5))
    return (
        spark.range(1)
        .select(F.explode(F.sequence(ntz(first), ntz(last), step)).alias("start"))
        .select(epoch(F.col("start")).alias("bucket"), F.substring(text, *shown).alias("label"))
    )


def on_spine(ts: Column, range_: str, as_of: datetime) -> Column:
    """Whether a time falls in any bucket of the timeline."""
    first, _ = spine_bounds(range_, as_of)
    return (ts >= ntz(first)) & (ts < ntz(spine_end(range_, as_of)))


def count_buckets(df: DataFrame, range_: str, as_of: datetime) -> DataFrame:
    """Rows per bucket; at most as many rows as the timeline has buckets."""
    return (
        df.where(on_spine(F.col("ts"), range_, as_of))
        .groupBy(bucket(F.col("ts"), range_).alias("bucket"))
        .agg(F.count("*").alias("count"))
    )


def fill(counts: DataFrame, range_: str, as_of: datetime) -> DataFrame:
    """Lay bucket counts (``bucket``, ``count``) on the full timeline."""
    filled = (
        spine(counts.sparkSession, range_, as_of)
        .join(F.broadcast(counts), "bucket", "left")  # 30 rows at most
        .select("bucket", "label", F.coalesce("count", F.lit(0)).alias("count"))
    )
    biggest = F.max("count").over(Window.partitionBy())
    return filled.withColumn("pct", bar_pct(F.col("count"), biggest)).orderBy("bucket")


def timeline(df: DataFrame, range_: str, as_of: datetime) -> DataFrame:
    """``bucket``, ``label``, ``count``, ``pct`` for every bucket of a range.

    The timeline begins at a bucket boundary, so it may show fewer rows than the
    counters, which cover the exact range and have no upper bound.
    """
    return fill(count_buckets(df, range_, as_of), range_, as_of)
