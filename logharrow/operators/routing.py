"""Route messages to log types by sender, and account for what happened to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharrow.operators.lookup import lookup_join


def _by_sender(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("ip").alias("source_ip"), "log_type")


def route(envelope: DataFrame, sources: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Envelope rows of known senders, with their ``log_type``."""
    return lookup_join(envelope, _by_sender(sources), "source_ip", "inner", broadcast)


def unknown_senders(
    envelope: DataFrame, sources: DataFrame, broadcast: bool | None = None
) -> DataFrame:
    """Envelope rows no source is configured for. They are counted, not stored."""
    return lookup_join(envelope, _by_sender(sources), "source_ip", "left_anti", broadcast)


def mark_outcome(
    envelope: DataFrame, sources: DataFrame, broadcast: bool | None = None
) -> DataFrame:
    """Every envelope row with its ``log_type``, NULL for an unknown sender."""
    return lookup_join(envelope, _by_sender(sources), "source_ip", "left", broadcast)


def minute_stats(outcomes: DataFrame) -> DataFrame:
    """Counts per arrival minute: received, stored, unparsed, unknown source.

    ``outcomes`` has ``received_at``, ``log_type`` (NULL: unknown sender) and
    ``parsed``. Minutes without a message give no row.
    """
    known = F.col("log_type").isNotNull()
    parsed = F.coalesce(F.col("parsed"), F.lit(False))
    minute = F.window("received_at", "1 minute").start
    return (
        outcomes.groupBy(minute.alias("minute"))
        .agg(
            F.count("*").alias("received"),
            F.count_if(known & parsed).alias("stored"),
            F.count_if(known & ~parsed).alias("unparsed"),
            F.count_if(~known).alias("unknown_source"),
        )
    )
