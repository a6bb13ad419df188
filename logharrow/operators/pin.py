"""Compute a costly column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns whose values are computed exactly once per row.

    A filter on a column derived from a plain ``withColumn`` is pushed below it by
    copying the expression into the filter, once per mention; for a line match used
    by a dozen fields that repeats the match many times over. The one-row generator
    used here keeps filters and later projections on the computed value.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select("*", F.inline(F.array(row)))
