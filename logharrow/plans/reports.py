"""The composite reports: a dictionary of small DataFrames each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharrow.filters import Filter
from logharrow.functions.columns import country_code, country_label
from logharrow.functions.time import GRANULARITY, bucket
from logharrow.operators import countries, kpis, overview, panels, raw, shares, timeline
from logharrow.registry import LogTypeSpec, ReportSpec
from logharrow.sources.files import table_size


class Report(dict):
    """Frames by name. ``release`` frees what the report keeps cached."""

    def __init__(self, frames: dict[str, DataFrame], cached: list[DataFrame], **facts):
        super().__init__(frames)
        self.facts = facts
        self._cached = cached

    def release(self) -> None:
        for df in self._cached:
            df.unpersist()


def _spec(spec: ReportSpec | LogTypeSpec) -> ReportSpec:
    return spec.report if isinstance(spec, LogTypeSpec) else spec


def _cube(df: DataFrame, spec: ReportSpec, range_: str, as_of: datetime) -> DataFrame:
    """Counts by bucket, outcome and country, from which all small panels follow.

    Its size is bounded by the dimensions (buckets, status codes, countries), so it
    is cached while the log itself never is. Rows off the timeline share one NULL
    bucket: they count everywhere but on the timeline.
    """
    ts = F.col("ts")
    outcome = "action" if spec.family == "firewall" else "status"
    return df.groupBy(
        F.when(timeline.on_spine(ts, range_, as_of), bucket(ts, range_)).alias("bucket"),
        outcome,
        country_label(F.col("country")).alias("country"),
        country_code(F.col("country_code")).alias("country_code"),
    ).agg(F.count("*").alias("n"))


def type_report(
    df: DataFrame,
    flt: Filter,
    as_of: datetime,
    spec: ReportSpec | LogTypeSpec,
    status_mode: str = "rounded",
    p95: str = "exact",
) -> Report:
    """Report on one log type under a filter.

    ``kpis``, ``timeline``, ``statuses`` or ``actions``, ``panels`` (all top-10
    lists, long form), ``countries`` with shading, ``legend`` and ``map``.
    """
    spec, flt = _spec(spec), flt.normalised()
    rows = flt.apply(df, spec, as_of, status_mode)
    cube = _cube(rows, spec, flt.range_key, as_of).persist()
    buckets = (
        cube.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("n").alias("count"))
    )
    counts = countries.country_counts(cube, weight="n")
    levels = countries.country_levels(counts)
    frames = {
        "timeline": timeline.fill(buckets, flt.range_key, as_of),
        "panels": panels.top_panels(
            rows, panels.panel_columns(spec), drop_empty=spec.family == "firewall"
        ),
        "countries": levels,
        "legend": countries.country_legend(levels),
        "map": countries.map_summary(counts),
    }
    if spec.family == "firewall":
        frames["kpis"] = kpis.firewall_kpis(rows)
        frames["actions"] = panels.action_breakdown(cube, weight="n")
    else:
        frames["kpis"] = kpis.proxy_kpis(rows, p95) if spec.family == "proxy" else kpis.web_kpis(rows)
        frames["statuses"] = panels.status_breakdown(cube, status_mode, weight="n")
    return Report(
        frames, [cube], range=flt.range_key, granularity=GRANULARITY[flt.range_key],
        has_data=kpis.has_data(df),
    )


def raw_report(
    df: DataFrame,
    flt: Filter,
    as_of: datetime,
    spec: ReportSpec | LogTypeSpec,
    status_mode: str = "rounded",
    after: raw.Cursor | None = None,
) -> DataFrame:
    """The lines a report under the same filter is made of, newest first, or a later page of them."""
    flt = flt.normalised()
    return raw.raw_page(flt.apply(df, _spec(spec), as_of, status_mode), flt.page_size, after)


def export_report(
    df: DataFrame,
    flt: Filter,
    as_of: datetime,
    spec: ReportSpec | LogTypeSpec,
    path: str,
    cap: int | None = None,
    status_mode: str = "rounded",
) -> None:
    """Write the lines a report is made of as a text file."""
    raw.write_export(flt.normalised().apply(df, _spec(spec), as_of, status_mode), path, cap)


def overview_report(
    tables: dict[str, DataFrame],
    sources: DataFrame,
    as_of: datetime,
    root: str | None = None,
) -> Report:
    """Report across all log types: totals, three share lists and the map.

    With ``root`` the storage the tables occupy is reported too.
    """
    base = overview.overview_base(overview.union_types(tables), as_of).persist()
    return overview_of(base, sources, root)


def overview_of(base: DataFrame, sources: DataFrame, root: str | None = None) -> Report:
    """The overview from a cached base of counts, see ``overview.overview_base``."""
    by_type = overview.by_type(base)
    by_source = overview.by_source(base, sources)
    by_country = overview.by_country(base)
    levels = countries.country_levels(by_country)
    frames = {
        "totals": overview.totals(base),
        "by_type": by_type,
        "by_source": by_source,
        "by_country": by_country,
        "type_share": shares.share(by_type.select(F.col("log_type").alias("label"), F.col("total").alias("count"))),
        "source_share": shares.share(by_source),
        "country_share": shares.share(by_country.select(F.col("name").alias("label"), "count")),
        "countries": levels,
        "legend": countries.country_legend(levels),
        "map": countries.map_summary(by_country),
        "source_count": sources.agg(F.count("*").alias("source_count")),
    }
    spark: SparkSession = sources.sparkSession
    if root is not None:
        frames["storage"] = table_size(spark, root)
    return Report(frames, [base])
