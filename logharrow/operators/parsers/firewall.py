"""The shared shape of firewall events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise(df: DataFrame) -> DataFrame:
    """Fall back to the arrival time, so that a firewall row always has a time."""
    return df.withColumn("ts", F.coalesce("ts", "received_at"))
