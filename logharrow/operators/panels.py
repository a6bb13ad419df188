"""Breakdowns and top-N panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logharrow.functions.columns import bar_pct, class_label, country_label, port_text, status_class
from logharrow.registry import ReportSpec

TOP = 10


def _weight(weight: str | None) -> Column:
    return F.count("*") if weight is None else F.sum(weight)


def _scaled(df: DataFrame, *panel: str) -> DataFrame:
    """Add the bar length within each panel. Panels are small by construction."""
    biggest = F.max("count").over(Window.partitionBy(*panel))
    return df.withColumn("pct", bar_pct(F.col("count"), biggest))


def status_breakdown(df: DataFrame, mode: str = "rounded", weight: str | None = None) -> DataFrame:
    """Count per status class, by class; rows without a status are left out."""
    counted = (
        df.where(F.col("status").isNotNull())
        .groupBy(status_class(F.col("status"), mode).alias("class"))
        .agg(_weight(weight).alias("count"))
    )
    shown = counted.select("class", class_label(F.col("class")).alias("label"), "count")
    return _scaled(shown).orderBy("class")


def action_breakdown(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Count per action, biggest first."""
    counted = df.groupBy(F.col("action").alias("label")).agg(_weight(weight).alias("count"))
    return _scaled(counted).orderBy(F.desc("count"), F.asc_nulls_last("label"))


def top_n(
    df: DataFrame,
    value: Column,
    n: int = TOP,
    drop_empty: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """The ``n`` most frequent values: count descending, then label ascending."""
    labelled = df.select(value.alias("label"), *([weight] if weight else []))
    if drop_empty:
        labelled = labelled.where(F.col("label").isNotNull() & (F.col("label") != ""))
    counted = labelled.groupBy("label").agg(_weight(weight).alias("count"))
    top = counted.orderBy(F.desc("count"), F.asc_nulls_last("label")).limit(n)
    return _scaled(top).orderBy(F.desc("count"), F.asc_nulls_last("label"))


def panel_columns(spec: ReportSpec) -> dict[str, Column]:
    """Top-N panels of a report, by name."""
    if spec.family == "firewall":
        panels = {
            "source": F.col("src_ip"),
            "destination": F.col("dst_ip"),
            "port": port_text(F.col("dst_port")),
        }
    else:
        panels = {"path": F.col("path"), "client": F.col("remote_host")}
    panels["country"] = country_label(F.col("country"))
    return {**panels, **{name: F.col(name) for name in spec.extra}}


def top_panels(
    df: DataFrame, panels: dict[str, Column], n: int = TOP, drop_empty: bool = False
) -> DataFrame:
    """All top-N panels in one scan and one shuffle: ``panel``, ``rank``, ``label``, ``count``, ``pct``.

    Each row becomes one (panel, value) pair per panel, counted map-side first.
    Ranking keeps ``n`` rows per panel and partition before anything is gathered, so
    a panel with a billion values still gathers only ``n`` rows from each task.
    """
    pairs = F.array(*[
        F.struct(F.lit(i).alias("id"), value.alias("label"))
        for i, value in enumerate(panels.values())
    ])
    exploded = df.select(F.explode(pairs).alias("_p")).select("_p.id", "_p.label")
    if drop_empty:
        exploded = exploded.where(F.col("label").isNotNull() & (F.col("label") != ""))
    counted = exploded.groupBy("id", "label").agg(F.count("*").alias("count"))
    order = Window.partitionBy("id").orderBy(F.desc("count"), F.asc_nulls_last("label"))
    ranked = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    names = F.array(*[F.lit(name) for name in panels])
    return _scaled(ranked, "id").select(
        F.get(names, F.col("id")).alias("panel"), "rank", "label", "count", "pct"
    )
