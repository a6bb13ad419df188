"""The two small tables: senders and country ranges."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharrow.functions.ip import is_valid_ip
from logharrow.functions.text import strip
from logharrow.functions.time import ntz
from logharrow.operators.geo import GeoIndex
from logharrow.operators.networks import build_nested_index, read_ranges
from logharrow.registry import REGISTRY
from logharrow.schemas import SOURCES, conform
from logharrow.sources.files import create_new, exists, list_files, read_text, remove, version_path, versions


def load_geo_ranges(spark: SparkSession, *paths: str) -> GeoIndex | None:
    """Index of the first range table that exists; None turns lookups off.

    Tables may be Parquet or CSV, of ranges or of networks, also one within the other.
    """
    for path in paths:
        if path and exists(spark, path):
            return build_nested_index(read_ranges(spark, path))
    return None


# Earlier versions of the sender table that are kept.
KEPT = 8


class EditConflict(Exception):
    """The sender table was saved by somebody else since it was read."""


def sources_version(spark: SparkSession, path: str) -> int:
    """The number of the sender table last saved, 0 before the first."""
    heads = [int(n) for n in list_files(spark, f"{path}/_heads") if n.isdigit()]
    # A head that is just being written does not count yet.
    return max((n for n in heads if read_text(spark, _head(path, n))), default=0)


def _head(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/_heads/{number:012d}"


def load_sources(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The sender table as last saved, or as of a version; empty only when none was ever saved."""
    number = sources_version(spark, path) if version is None else version
    if number:
        return spark.read.schema(SOURCES).parquet(f"{path.rstrip('/')}/{read_text(spark, _head(path, number))}")
    saved = versions(spark, path)  # saved before versions had heads
    if not saved:
        return spark.createDataFrame([], SOURCES)
    return spark.read.schema(SOURCES).parquet(version_path(path, saved[-1]))


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("name", "ip")


def upsert_sources(sources: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """Insert or replace senders by address; an existing one keeps ``created_at``.

    ``changes`` has ``ip``, ``name`` and ``log_type``. Rows with an empty name, an invalid
    address or an unregistered type are left out; ``rejected_sources`` lists them. Of
    several good rows of one address the first by name, then type, is taken.
    """
    good = _checked(changes).where(F.col("problem").isNull())
    wanted = good.groupBy("ip").agg(F.min(F.struct("name", "log_type")).alias("one")).select("ip", "one.*")
    known = sources.select("ip", "created_at")
    changed = wanted.join(known, "ip", "left").select(
        "ip", "name", "log_type", F.coalesce("created_at", ntz(as_of)).alias("created_at")
    )
    kept = sources.join(wanted.select("ip"), "ip", "left_anti")
    return conform(kept.unionByName(changed), SOURCES)


def rejected_sources(changes: DataFrame) -> DataFrame:
    """Changes that cannot be taken, with the reason."""
    return _checked(changes).where(F.col("problem").isNotNull())


def _checked(changes: DataFrame) -> DataFrame:
    trimmed = changes.withColumns({"ip": strip(F.col("ip")), "name": strip(F.col("name"))})
    problem = (
        F.when(~F.coalesce(F.col("log_type").isin(*sorted(REGISTRY)), F.lit(False)), "unknown log type")
        .when(F.coalesce(F.col("name"), F.lit("")) == "", "name is required")
        .when(~is_valid_ip(F.col("ip")), "not a valid IP address")
    )
    return trimmed.withColumn("problem", problem)


def delete_source(sources: DataFrame, ip: str) -> DataFrame:
    return sources.where(F.col("ip") != F.lit(ip.strip()))


def unique_sources(sources: DataFrame) -> DataFrame:
    """``sources``, with a check that fails where an address occurs twice.

    A message of such an address would be stored once for each row.
    """
    message = F.concat(F.lit("sender listed twice: "), F.col("ip"))
    counted = sources.groupBy("ip").agg(F.count("*").alias("_rows"), *[
        F.min(c).alias(c) for c in sources.columns if c != "ip"
    ])
    checked = counted.where(F.when(F.col("_rows") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*sources.columns)


def save_sources(spark: SparkSession, sources: DataFrame, path: str, based_on: int | None = None) -> int:
    """Save the sender table as a new version, also when ``sources`` was read from the old one; its number.

    ``based_on`` is the version the edit began with (by default the last one): if another was saved
    since, ``EditConflict`` is raised and nothing changes. The rows are written first; creating the head
    of the next number, which one editor alone can do, then makes them the table. The KEPT versions before
    the last two stay for readers and editors that still hold them.
    """
    base = sources_version(spark, path) if based_on is None else based_on
    folder = f"s-{uuid.uuid4().hex}"
    unique_sources(sources).write.parquet(f"{path.rstrip('/')}/{folder}")
    if sources_version(spark, path) != base or not create_new(spark, _head(path, base + 1), folder):
        remove(spark, f"{path.rstrip('/')}/{folder}")
        raise EditConflict(f"version {base} of {path} is not the last one any more")
    for old in [int(n) for n in list_files(spark, f"{path}/_heads") if n.isdigit() and int(n) < base - KEPT]:
        remove(spark, f"{path.rstrip('/')}/{read_text(spark, _head(path, old))}")
        remove(spark, _head(path, old))
    return base + 1


def edit_sources(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
    """Apply a change to the sender table as it is, once more if somebody else saved meanwhile; no edit is lost."""
    for left in reversed(range(tries)):
        version = sources_version(spark, path)
        try:
            return save_sources(spark, change(load_sources(spark, path, version)), path, version)
        except EditConflict:
            if not left:
                raise
    raise ValueError("tries must be positive")
