"""Reports on stored tables that read no more than the log of commits says they must."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharrow import registry
from logharrow.filters import Filter
from logharrow.functions.columns import country_code, country_label
from logharrow.functions.time import cutoff, from_micros, micros, micros_of
from logharrow.operators import overview, raw
from logharrow.plans import reports
from logharrow.sources import commits, files, states, textindex
from logharrow.sources.tables import open_table, read_files, table_path

Files = list[tuple[commits.Portion, commits.File]]


def files_in_range(snapshot: commits.Snapshot, name: str, flt: Filter, as_of: datetime) -> Files:
    """The files of a type that can hold rows of a filter's range."""
    oldest = micros(cutoff(flt.normalised().range_key, as_of))
    return [(p, f) for p in snapshot.of(name) for f in p.files if f.high is not None and f.high >= oldest]


def files_for(spark: SparkSession, snapshot: commits.Snapshot, name: str, flt: Filter, as_of: datetime) -> Files:
    """The files that can hold rows under a filter: by its range, and by the trigrams of its search."""
    flt = flt.normalised()
    found = files_in_range(snapshot, name, flt, as_of)
    return found if flt.q is None else textindex.may_hold(spark, snapshot.root, name, flt.q, found)


def rows_in_range(spark: SparkSession, name: str, flt: Filter, as_of: datetime, snapshot: commits.Snapshot, status_mode: str = "rounded") -> DataFrame:
    """Rows under a filter; files that can hold none are not even opened."""
    rows = read_files(spark, snapshot.root, name, files_for(spark, snapshot, name, flt, as_of))
    return flt.apply(rows, registry.get(name).report, as_of, status_mode)


def _newest(
    spark: SparkSession, snapshot: commits.Snapshot, name: str, files: Files, bound: Callable[[commits.File], int | None],
    column: str, wanted: Callable[[DataFrame], DataFrame], need: int,
) -> DataFrame:
    """Wanted rows of the files, newest first, that hold the ``need`` newest of them all.

    Files are taken from the highest bound down, first as few as could do, then twice as many
    and so on, until ``need`` wanted rows lie above the bound of the first file left out: no row of
    that file, or of a later one, can come before them.
    """
    files = sorted(files, key=lambda pf: (bound(pf[1]) is not None, bound(pf[1]) or 0, pf[1].name), reverse=True)
    take, rows = 0, 0
    while take < len(files) and rows < need:
        rows, take = rows + files[take][1].rows, take + 1
    while True:
        found = wanted(read_files(spark, snapshot.root, name, files[:take]))
        if take >= len(files):
            return found
        next_bound = bound(files[take][1])
        above = found.where(F.col(column).isNotNull())
        if next_bound is not None:
            above = above.where(F.col(column) > from_micros(F.lit(next_bound)))
        if above.limit(need).count() >= need:
            return found
        take = min(2 * take, len(files))


def stored_page(
    spark: SparkSession, name: str, flt: Filter, as_of: datetime, snapshot: commits.Snapshot,
    status_mode: str = "rounded", after: raw.Cursor | None = None,
) -> DataFrame:
    """``reports.raw_report`` of a stored table, from the newest files that hold the page."""
    flt, spec = flt.normalised(), registry.get(name).report
    files = files_for(spark, snapshot, name, flt, as_of)
    if after is not None and after.ts is not None:  # nothing behind the cursor lies in newer files
        files = [(p, f) for p, f in files if f.low <= micros(after.ts)]

    def wanted(rows: DataFrame) -> DataFrame:
        rows = flt.apply(rows, spec, as_of, status_mode)
        return rows if after is None else raw.behind(rows, after)

    rows = _newest(spark, snapshot, name, files, lambda f: f.high, "ts", wanted, flt.page_size + 1)
    return raw.raw_page(rows, flt.page_size)


def stored_recent(spark: SparkSession, name: str, snapshot: commits.Snapshot, n: int = raw.RECENT) -> DataFrame:
    """``raw.recent`` of a stored table, from the files that arrived last."""
    files = [(p, f) for p in snapshot.of(name) for f in p.files]
    rows = _newest(spark, snapshot, name, files, lambda f: f.arrived, "received_at", lambda rows: rows, n)
    return raw.recent(rows, n)


def stored_kpis(spark: SparkSession, name: str, range_: str, as_of: datetime, snapshot: commits.Snapshot) -> DataFrame:
    """The counters of a whole range, see ``operators.kpis``, from the states kept with the commits.

    Sums and countries are exact; clients and the 95th percentile are the sketches' estimates, see
    ``states``. Of the log only the rows of the hour in which the range begins are read.
    """
    since, first_whole = states.whole_hours(range_, as_of)
    kept = states.states_of(spark, snapshot, name).where(F.col("hour") >= first_whole)
    parts, end = [kept.select(*states.columns())], first_whole * commits.HOUR
    met = [(p, f) for p in snapshot.of(name) for f in p.files if f.high is not None and f.high >= since and f.low < end]
    if since < end and met:
        at = micros_of(F.col("ts"))
        parts.append(states.of_rows(read_files(spark, snapshot.root, name, met).where((at >= since) & (at < end)), name))
    return states.kpis_of(states.merged(reduce(DataFrame.unionByName, parts)), name)


def stored_base(spark: SparkSession, snapshot: commits.Snapshot, as_of: datetime, names: list[str] | None = None) -> DataFrame:
    """``overview.overview_base`` from the counts stored with the commits.

    Counts are by hour. Where the last day begins within an hour, that hour is counted in the
    files whose bounds it meets; no other log line is read.
    """
    names = names or registry.names()
    since = micros((as_of - timedelta(hours=24)).replace(microsecond=0))
    first_whole = -(-since // commits.HOUR)
    counts = commits.counts_of(spark, snapshot, names)
    last_day = F.when(F.col("hour") >= first_whole, F.col("n")).otherwise(F.lit(0))
    base = counts.select("log_type", "source_ip", "country", "code", "n", last_day.alias("n24"))
    end = first_whole * commits.HOUR
    for name in names if since < end else ():
        met = [(p, f) for p in snapshot.of(name) for f in p.files if f.high is not None and f.high >= since and f.low < end]
        if not met:
            continue
        at = micros_of(F.col("ts"))
        rows = read_files(spark, snapshot.root, name, met).where((at >= since) & (at < end))
        begun = rows.groupBy(
            "source_ip", country_label(F.col("country")).alias("country"), country_code(F.col("country_code")).alias("code")
        ).agg(F.count("*").alias("n24"))
        base = base.unionByName(begun.select(F.lit(name).alias("log_type"), "source_ip", "country", "code", F.lit(0).cast("long").alias("n"), "n24"))
    return base.groupBy("log_type", "source_ip", "country", "code").agg(F.sum("n").alias("n"), F.sum("n24").alias("n24"))


def stored_overview(spark: SparkSession, sources: DataFrame, as_of: datetime, snapshot: commits.Snapshot) -> reports.Report:
    """``reports.overview_report`` of stored tables, without reading the log.

    Tables filled before there was a log of commits are scanned as before.
    """
    logged = [name for name in registry.names() if name in snapshot.tables]
    base = stored_base(spark, snapshot, as_of, logged)
    older = {
        name: open_table(spark, snapshot.root, name, snapshot) for name in registry.names()
        if name not in snapshot.tables and files.exists(spark, table_path(snapshot.root, name))
    }
    if older:
        base = base.unionByName(overview.overview_base(overview.union_types(older), as_of))
    return reports.overview_of(base.persist(), sources, snapshot.root)
