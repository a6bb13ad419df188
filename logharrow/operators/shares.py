"""Shares of a whole with the small ones rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 8


def share(counts: DataFrame) -> DataFrame:
    """Slices of ``counts`` (``label``, ``count``), biggest first.

    Up to eight labels are shown as they are; of more, seven are kept and the rest
    become ``Other``, unless they sum to nothing. Gives ``pos``, ``label``,
    ``count``, ``pct`` of the whole, and the running ``start_pct`` and ``end_pct``.

    Only eight rows are ever ranked together: the rest is known from the totals.
    """
    counts = counts.select("label", F.col("count").cast("bigint").alias("count"))
    totals = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("labels")
    ).select(F.struct("total", "labels"))
    order = (F.desc("count"), F.asc_nulls_last("label"))
    top = (
        counts.orderBy(*order).limit(SHOWN)
        .withColumn("pos", F.row_number().over(Window.partitionBy().orderBy(*order)))
        .withColumn("_t", totals.scalar())
        .select("pos", "label", "count", F.col("_t.total").alias("total"), F.col("_t.labels").alias("labels"))
        .where((F.col("labels") <= SHOWN) | (F.col("pos") < SHOWN))
    )
    # The remainder goes behind the last of the few kept rows.
    kept = F.sum("count").over(Window.partitionBy())
    own = F.struct("pos", "label", "count")
    other = F.struct(
        F.lit(SHOWN).alias("pos"), F.lit("Other").alias("label"), F.col("rest").alias("count")
    )
    rolled_up = (F.col("labels") > SHOWN) & (F.col("pos") == SHOWN - 1) & (F.col("rest") > 0)
    slices = (
        top.withColumn("rest", F.col("total") - kept)
        .select("total", F.explode(F.when(rolled_up, F.array(own, other)).otherwise(F.array(own))).alias("_s"))
        .select("total", "_s.pos", "_s.label", "_s.count")
    )
    pct = F.when(F.col("total") > 0, F.col("count") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    running = Window.partitionBy().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("pct").over(running)
    return (
        slices.withColumn("pct", pct)
        .withColumn("end_pct", end)
        .select("pos", "label", "count", "pct", (F.col("end_pct") - F.col("pct")).alias("start_pct"), "end_pct")
        .orderBy("pos")
    )
