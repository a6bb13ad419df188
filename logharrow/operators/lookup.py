"""Joins against lookup tables, safe for hot keys and for tables that grew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a lookup table may have to be broadcast; checked by counting, never assumed.
BROADCAST_ROWS = 200_000
# A key is hot when it holds at least one row in this many, so there are never more.
HOT_KEYS = 2_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``max_rows`` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    broadcast: bool | None = None,
) -> DataFrame:
    """Join ``left`` to a table that is unique on text column ``key``.

    ``how`` is ``left``, ``inner`` or ``left_anti``. A table within the checked bound
    is broadcast, so ``left`` is not shuffled and a hot key costs nothing. A bigger
    one is joined by shuffle, but for the hot keys of ``left``: those, at most
    HOT_KEYS by definition, are looked up by broadcast and their rows spread evenly,
    so no task meets more of one key than one row in HOT_KEYS.
    """
    if broadcast is None:
        broadcast = fits(table)
    if broadcast:
        return left.join(F.broadcast(table), key, how)
    if left.isStreaming:
        raise ValueError("keys of a stream cannot be counted ahead: look up within foreachBatch")
    return _join_without_hot_keys(left, table, key, how)


def _join_without_hot_keys(left: DataFrame, table: DataFrame, key: str, how: str) -> DataFrame:
    values = [c for c in table.columns if c != key]
    table = table.select(
        F.col(key).alias("_tkey"), F.struct(F.lit(True).alias("_found"), *values).alias("_value")
    )
    rows = left.agg(F.count("*"))
    hot = (
        left.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_hkey"))
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") * HOT_KEYS >= rows.scalar())
        .select("_hkey")
    )
    hot_values = table.join(F.broadcast(hot), F.col("_tkey") == F.col("_hkey"), "inner").select(
        "_tkey", F.col("_value").alias("_hot_value")
    )
    answered = hot.join(F.broadcast(hot_values), F.col("_hkey") == F.col("_tkey"), "left").select(
        "_hkey", "_hot_value"
    )
    marked = left.join(F.broadcast(answered), F.col(key) == F.col("_hkey"), "left")
    # Rows that need no lookup get keys that match nothing and fall evenly on tasks.
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(1_000_000))  # of the row itself: the same when computed again
    nowhere = F.concat(F.lit("\u0000"), spread.cast("string"))
    probe = F.when(F.col("_hkey").isNull(), F.col(key))
    joined = marked.withColumn("_probe", F.coalesce(probe, nowhere)).join(
        table, F.col("_probe") == F.col("_tkey"), "left"
    )
    joined = joined.withColumn("_value", F.coalesce("_hot_value", "_value"))
    own = [F.col(c) for c in left.columns]
    if how == "left_anti":
        return joined.where(F.col("_value").isNull()).select(*own)
    if how == "inner":
        joined = joined.where(F.col("_value").isNotNull())
    return joined.select(*own, *[F.col("_value").getField(c).alias(c) for c in values])
