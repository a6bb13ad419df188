"""Per-country counts and the shading of a country map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logharrow.functions.columns import country_code, country_label
from logharrow.functions.text import strip

STEPS = 5


def country_counts(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows per country, all of them: ``code`` ('' when not located), ``name``, ``count``."""
    return df.groupBy(
        country_code(F.col("country_code")).alias("code"),
        country_label(F.col("country")).alias("name"),
    ).agg((F.count("*") if weight is None else F.sum(weight)).alias("count"))


def _located(counts: DataFrame) -> DataFrame:
    return counts.where(strip(F.col("code")) != "")


def shade(count: Column, biggest: Column) -> Column:
    """Shading step 1-5 of a count, on a log scale."""
    ratio = F.ln(count + F.lit(1.0)) / F.ln(biggest + F.lit(1.0))
    step = F.least(F.greatest(F.ceil(ratio * STEPS), F.lit(1)), F.lit(STEPS))
    return (
        F.when((count <= 0) | (biggest <= 0), 1)
        .when(biggest == 1, STEPS)
        .otherwise(step)
        .cast("bigint")
    )


def country_levels(counts: DataFrame) -> DataFrame:
    """Located countries with their shading ``level``.

    Codes are compared in upper case. Where one code carries two names, counts are
    added up and the first name in order is shown.
    """
    merged = (
        _located(counts)
        .where(F.col("count") > 0)
        .groupBy(F.upper(strip(F.col("code"))).alias("code"))
        .agg(F.min("name").alias("name"), F.sum("count").alias("count"))
    )
    biggest = F.max("count").over(Window.partitionBy())  # one row per country code
    return merged.withColumn("level", shade(F.col("count"), biggest))


def country_legend(levels: DataFrame) -> DataFrame:
    """The range of counts each shading step covers: ``step``, ``from_count``, ``to_count``.

    Steps that cover no count are left out; the rest are contiguous and end at the
    biggest count.
    """
    biggest, step = F.col("biggest"), F.col("step")
    bound = F.floor(F.pow(biggest + F.lit(1.0), step / F.lit(float(STEPS))) - F.lit(1.0)).cast("bigint")
    before = Window.partitionBy().orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return (
        levels.agg(F.max("count").alias("biggest"))
        .where(biggest > 0)
        .select("biggest", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"))
        .withColumn("to_count", F.when(step == STEPS, biggest).otherwise(F.least(bound, biggest)))
        .withColumn("from_count", F.coalesce(F.max("to_count").over(before), F.lit(0)) + 1)
        .where(F.col("to_count") >= F.col("from_count"))
        .select("step", "from_count", "to_count")
        .orderBy("step")
    )


def map_summary(counts: DataFrame) -> DataFrame:
    """One row: countries on the map, rows without a place, whether the map has data."""
    code = strip(F.col("code"))
    located = code != ""
    return counts.agg(
        F.count_distinct(F.when(located & (F.col("count") > 0), F.upper(code))).alias("countries"),
        F.coalesce(F.sum(F.when(~located, F.col("count"))), F.lit(0)).alias("unlocated"),
        F.coalesce(F.max(F.when(located, F.col("count"))) > 0, F.lit(False)).alias("has_data"),
    )


def with_region(counts: DataFrame, regions: DataFrame) -> DataFrame:
    """Add the columns of a region table keyed by ISO ``code`` (one row per country)."""
    keyed = regions.withColumn("code", F.upper("code"))
    return counts.withColumn("code", F.upper(strip(F.col("code")))).join(keyed, "code", "left")
