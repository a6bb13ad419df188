"""Counters, timelines, breakdowns, panels, maps and whole reports."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharrow import registry
from logharrow.filters import Filter
from logharrow.functions.columns import country_label, fmt_ms, fmt_pct, human_bytes, port_text
from logharrow.operators import countries, kpis, overview, panels, raw, shares, timeline
from logharrow.operators.quantile import exact_quantiles
from logharrow.plans import maintain, reports, stored
from logharrow.schemas import conform
from logharrow.session import in_time_order, work_dir
from logharrow.sources import commits
from logharrow.sources.tables import append_batch, append_batches, stream_batch, table_path
from workload import derive
from workload.catalog import ORACLES, query
from workload.derive import AS_OF, NOON, sql

WEB, TRAEFIK, HAPROXY, PANOS = (registry.get(n).report for n in ("apache", "traefik", "haproxy", "panos"))
CLF_SQL, PROXY_SQL, FIREWALL_SQL = sql(derive.CLF), sql(derive.PROXY), sql(derive.FIREWALL)
SOURCES_SQL = sql(derive.SOURCES, "supplier")
DAYS = {"1h": "INTERVAL 1 HOUR", "24h": "INTERVAL 24 HOUR", "7d": "INTERVAL 7 DAY",
        "30d": "INTERVAL 30 DAY", "1y": "INTERVAL 365 DAY"}
COUNTRY = "coalesce(nullif(country, ''), 'Unknown')"
CODE = "coalesce(country_code, '')"


def now_of(range_: str) -> datetime:
    return NOON if range_ in ("1h", "24h") else AS_OF


def since(range_: str) -> str:
    cutoff = f"date_trunc('second', TIMESTAMP '{now_of(range_)}' - {DAYS[range_]})"
    return f"ts >= {cutoff}"


def bounded(df: DataFrame, spec, range_: str = "7d", **conditions) -> DataFrame:
    return Filter(range=range_, **conditions).apply(df, spec, now_of(range_))


# --- counters -------------------------------------------------------------------

_SHARED = (
    "count(DISTINCT country_code) FILTER (WHERE country_code <> '') AS countries, "
    "CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes"
)
_WEB_KPIS = (
    f"count(*) AS requests, count(DISTINCT remote_host) AS unique_ips, {_SHARED}, "
    "count(*) FILTER (WHERE status >= 400) AS errors, CASE WHEN count(*) > 0 THEN "
    "CAST(count(*) FILTER (WHERE status >= 400) AS DOUBLE) * 100 / count(*) ELSE 0.0 END AS error_rate"
)
_DURATIONS = (
    "round(avg(duration_ms), 4) AS avg_ms, round(quantile_cont(duration_ms, 0.95), 4) AS p95_ms"
)
_FIREWALL_KPIS = (
    f"count(*) AS events, count(*) FILTER (WHERE action = 'deny') AS denied, {_SHARED}, "
    "count(DISTINCT src_ip) AS sources, CASE WHEN count(*) > 0 THEN "
    "CAST(count(*) FILTER (WHERE action = 'deny') AS DOUBLE) * 100 / count(*) ELSE 0.0 END AS deny_rate"
)


def _rounded_durations(df: DataFrame) -> DataFrame:
    return df.withColumns({"avg_ms": F.round("avg_ms", 4), "p95_ms": F.round("p95_ms", 4)})


@query("web_kpis_7d", f"SELECT {_WEB_KPIS} FROM ({CLF_SQL}) WHERE {since('7d')}")
def _(spark, sf_dir):
    return kpis.web_kpis(bounded(derive.clf(spark, sf_dir), WEB))


@query("proxy_kpis_7d", f"SELECT {_WEB_KPIS}, {_DURATIONS} FROM ({PROXY_SQL}) WHERE {since('7d')}")
def _(spark, sf_dir):
    return _rounded_durations(kpis.proxy_kpis(bounded(derive.proxy(spark, sf_dir), TRAEFIK)))


@query("firewall_kpis_7d", f"SELECT {_FIREWALL_KPIS} FROM ({FIREWALL_SQL}) WHERE {since('7d')}")
def _(spark, sf_dir):
    return kpis.firewall_kpis(bounded(derive.firewall(spark, sf_dir), PANOS))


@query("kpis_of_nothing", f"SELECT {_WEB_KPIS}, {_DURATIONS} FROM ({PROXY_SQL}) WHERE path = 'none'")
def _(spark, sf_dir):
    return _rounded_durations(kpis.proxy_kpis(derive.proxy(spark, sf_dir).where("path = 'none'")))


@query("total_rows", "SELECT count(*) AS total_rows FROM events")
def _(spark, sf_dir):
    return kpis.total_rows(derive.clf(spark, sf_dir))


@query(
    "price_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS measure, CAST({q} AS DOUBLE) AS q, round(quantile_cont({c}, {q}), 4) AS quantile FROM lineitem"
        for c in ("l_extendedprice", "l_discount") for q in (0.05, 0.5, 0.95)
    ),
)
def _(spark, sf_dir):
    lines = derive.read(spark, sf_dir, "lineitem")
    qs = [0.05, 0.5, 0.95]
    rows = [(c, q, v) for c in ("l_extendedprice", "l_discount") for q, v in zip(qs, exact_quantiles(lines, c, qs))]
    found = spark.createDataFrame(rows, "measure string, q double, quantile double")
    return found.withColumn("quantile", F.round("quantile", 4))


@query(
    "kpi_display",
    f"""SELECT CASE WHEN b < 1024 THEN concat(b, ' B')
        WHEN b < 1048576 THEN concat(CAST(round_even(b / 1024, 1) AS DECIMAL(18,1)), ' KB')
        WHEN b < 1073741824 THEN concat(CAST(round_even(b / 1048576, 1) AS DECIMAL(18,1)), ' MB')
        ELSE concat(CAST(round_even(b / 1073741824, 1) AS DECIMAL(18,1)), ' GB') END AS total_bytes,
        concat(CAST(round_even(r, 1) AS DECIMAL(9,1)), '%') AS error_rate,
        concat(CAST(round_even(a, 0) AS BIGINT), ' ms') AS avg_ms, '—' AS no_ms
        FROM (SELECT coalesce(sum(bytes), 0) AS b, avg(duration_ms) AS a,
        CAST(count(*) FILTER (WHERE status >= 400) AS DOUBLE) * 100 / count(*) AS r
        FROM ({PROXY_SQL}) WHERE {since('30d')})""",
)
def _(spark, sf_dir):
    row = kpis.proxy_kpis(bounded(derive.proxy(spark, sf_dir), TRAEFIK, "30d"))
    return row.select(
        human_bytes(F.col("total_bytes")).alias("total_bytes"),
        fmt_pct(F.col("error_rate")).alias("error_rate"),
        fmt_ms(F.col("avg_ms")).alias("avg_ms"),
        fmt_ms(F.lit(None).cast("double")).alias("no_ms"),
    )


# --- timelines ------------------------------------------------------------------

_SPINE = {
    "1h": ("time_bucket(INTERVAL '5 minutes', {t})", "INTERVAL 5 MINUTE", 11, "%H:%M"),
    "24h": ("date_trunc('hour', {t})", "INTERVAL 1 HOUR", 23, "%H:%M"),
    "7d": ("date_trunc('day', {t})", "INTERVAL 1 DAY", 6, "%m-%d"),
    "30d": ("date_trunc('day', {t})", "INTERVAL 1 DAY", 29, "%m-%d"),
    "1y": ("date_trunc('month', {t})", "INTERVAL 1 MONTH", 11, "%Y-%m"),
}


def spine_sql(range_: str) -> str:
    expr, step, back, label = _SPINE[range_]
    last = f"CAST({expr.format(t=f'''TIMESTAMP '{now_of(range_)}' ''')} AS TIMESTAMP)"
    return (
        f"SELECT CAST(epoch(b) AS BIGINT) AS bucket, strftime(b, '{label}') AS label FROM "
        f"(SELECT unnest(generate_series({last} - {back} * {step}, {last}, {step})) AS b)"
    )


def timeline_sql(table: str, range_: str) -> str:
    expr = _SPINE[range_][0].format(t="ts")
    return f"""SELECT bucket, label, n AS count,
        CASE WHEN max(n) OVER () > 0 THEN n * 100 // max(n) OVER () ELSE 0 END AS pct
        FROM (SELECT s.bucket, s.label, coalesce(c.n, 0) AS n FROM ({spine_sql(range_)}) s LEFT JOIN
        (SELECT CAST(epoch({expr}) AS BIGINT) AS bucket, count(*) AS n FROM ({table})
        WHERE {since(range_)} GROUP BY 1) c ON s.bucket = c.bucket)"""


def _timeline(range_: str) -> None:
    @query(f"timeline_{range_}", timeline_sql(CLF_SQL, range_))
    def _(spark, sf_dir):
        rows = bounded(derive.clf(spark, sf_dir), WEB, range_)
        return timeline.timeline(rows, range_, now_of(range_))


for _range in DAYS:
    _timeline(_range)


# --- breakdowns and panels ------------------------------------------------------

_SCALE = "CASE WHEN max(count) OVER ({w}) > 0 THEN count * 100 // max(count) OVER ({w}) ELSE 0 END AS pct"


def status_sql(table: str, where: str, mode: str) -> str:
    klass = "status // 100" if mode == "floor" else "CAST(status / 100 AS INTEGER)"
    return (
        f"SELECT *, {_SCALE.format(w='')} FROM (SELECT CAST({klass} AS INTEGER) AS class, "
        f"concat({klass}, 'xx') AS label, count(*) AS count FROM ({table}) "
        f"WHERE status IS NOT NULL AND {where} GROUP BY 1, 2)"
    )


def action_sql(where: str) -> str:
    return (
        f"SELECT *, {_SCALE.format(w='')} FROM (SELECT action AS label, count(*) AS count "
        f"FROM ({FIREWALL_SQL}) WHERE {where} GROUP BY 1)"
    )


def top_sql(table: str, column: str, where: str, drop_empty: bool = False) -> str:
    kept = f" AND {column} IS NOT NULL AND {column} <> ''" if drop_empty else ""
    return (
        f"SELECT *, {_SCALE.format(w='')} FROM (SELECT {column} AS label, count(*) AS count FROM ({table}) "
        f"WHERE {where}{kept} GROUP BY 1 ORDER BY 2 DESC, 1 ASC NULLS LAST LIMIT 10)"
    )


def panels_sql(table: str, columns: dict[str, str], where: str, drop_empty: bool) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS panel, CAST(row_number() OVER (ORDER BY count DESC, label ASC NULLS LAST) AS INTEGER) "
        f"AS rank, * FROM ({top_sql(table, column, where, drop_empty)})"
        for name, column in columns.items()
    )


for _mode in ("floor", "rounded"):
    @query(f"status_breakdown_{_mode}", status_sql(CLF_SQL, since("7d"), _mode))
    def _(spark, sf_dir, mode=_mode):
        return panels.status_breakdown(bounded(derive.clf(spark, sf_dir), WEB), mode)


@query("action_breakdown", action_sql(since("7d")))
def _(spark, sf_dir):
    return panels.action_breakdown(bounded(derive.firewall(spark, sf_dir), PANOS))


PORT = "CAST(dst_port AS VARCHAR)"
WEB_PANELS = {"path": "path", "client": "remote_host", "country": COUNTRY}
FIREWALL_PANELS = {
    "source": "src_ip", "destination": "dst_ip", "port": PORT, "country": COUNTRY,
    "application": "application", "rule": "rule",
}


@query("top_paths", top_sql(CLF_SQL, "path", since("30d")))
def _(spark, sf_dir):
    return panels.top_n(bounded(derive.clf(spark, sf_dir), WEB, "30d"), F.col("path"))


@query("top_clients", top_sql(CLF_SQL, "remote_host", since("30d")))
def _(spark, sf_dir):
    return panels.top_n(bounded(derive.clf(spark, sf_dir), WEB, "30d"), F.col("remote_host"))


@query("top_countries", top_sql(CLF_SQL, COUNTRY, since("30d")))
def _(spark, sf_dir):
    return panels.top_n(bounded(derive.clf(spark, sf_dir), WEB, "30d"), country_label(F.col("country")))


@query("top_ports", top_sql(FIREWALL_SQL, PORT, since("30d"), True))
def _(spark, sf_dir):
    rows = bounded(derive.firewall(spark, sf_dir), PANOS, "30d")
    return panels.top_n(rows, port_text(F.col("dst_port")), drop_empty=True)


@query("top_extra", top_sql(PROXY_SQL, "router", since("30d")))
def _(spark, sf_dir):
    return panels.top_n(bounded(derive.proxy(spark, sf_dir), TRAEFIK, "30d"), F.col("router"))


@query("top_panels_proxy", panels_sql(
    PROXY_SQL, {**WEB_PANELS, "backend": "backend", "server": "server"}, since("7d"), False))
def _(spark, sf_dir):
    rows = bounded(derive.proxy(spark, sf_dir), HAPROXY)
    return panels.top_panels(rows, panels.panel_columns(HAPROXY))


@query("top_panels_firewall", panels_sql(FIREWALL_SQL, FIREWALL_PANELS, since("7d"), True))
def _(spark, sf_dir):
    rows = bounded(derive.firewall(spark, sf_dir), PANOS)
    return panels.top_panels(rows, panels.panel_columns(PANOS), drop_empty=True)


# --- filters --------------------------------------------------------------------

def _filtered(name, load, spec, table, where, range_="30d", **conditions) -> None:
    oracle = f"SELECT event_id, raw FROM ({table}) WHERE {since(range_)} AND {where}"

    @query(name, oracle)
    def _(spark, sf_dir):
        return bounded(load(spark, sf_dir), spec, range_, **conditions).select("event_id", "raw")


def any_like(columns, pattern: str) -> str:
    return "(" + " OR ".join(f"{c} ILIKE '{pattern}'" for c in columns) + ")"


_filtered(
    "filter_web", derive.clf, WEB, CLF_SQL,
    f"CAST(status / 100 AS INTEGER) = 4 AND {COUNTRY} = 'Unknown' AND path = '/error/12'",
    status=4, country="Unknown", path="/error/12",
)
_filtered(
    "filter_client", derive.clf, WEB, CLF_SQL, "remote_host = '203.0.1.8'", ip=" 203.0.1.8 ",
)
_filtered(
    "filter_proxy", derive.proxy, TRAEFIK, PROXY_SQL, "router = 'r4@file' AND service = 's4'",
    router="r4@file", service="s4", backend="not declared by this type",
)
_filtered(
    "filter_backend", derive.proxy, HAPROXY, PROXY_SQL, "backend = 'be\\4' AND server = 'srv3'",
    backend="be\\4", server="srv3",
)
_filtered(
    "filter_firewall", derive.firewall, PANOS, FIREWALL_SQL,
    "dst_ip = '10.0.0.7' AND dst_port = 722 AND action = 'allow' AND protocol = 'tcp' "
    "AND rule = 'rule-7' AND application = 'view'",
    dst="10.0.0.7", port=722, action="allow", protocol="tcp", rule="rule-7", application="view",
)
_filtered(
    "filter_source", derive.firewall, PANOS, FIREWALL_SQL,
    f"src_ip = '203.0.3.3' AND {COUNTRY} = 'France'", src="203.0.3.3", country="France", action="bogus",
)
_filtered(
    "search_ilike", derive.clf, WEB, CLF_SQL, any_like(WEB.search, "%SIGNUP/3%"), q="SIGNUP/3",
)
_filtered(
    "search_wildcards", derive.proxy, TRAEFIK, PROXY_SQL, any_like(TRAEFIK.search, "%r_@f%e%"), q="r_@f%e",
)
_filtered(
    "search_backslash", derive.proxy, HAPROXY, PROXY_SQL, any_like(HAPROXY.search, "%\\4%"), q="\\4",
)
_filtered(
    "search_port", derive.firewall, PANOS, FIREWALL_SQL,
    any_like([c if c != "dst_port" else PORT for c in PANOS.search], "%112%"), q="112",
)


# --- countries ------------------------------------------------------------------

def counts_sql(table: str, where: str) -> str:
    return f"SELECT {CODE} AS code, {COUNTRY} AS name, count(*) AS count FROM ({table}) WHERE {where} GROUP BY 1, 2"


def levels_sql(counts: str) -> str:
    return f"""SELECT code, name, count, CAST(CASE WHEN mx = 1 THEN 5 ELSE
        least(greatest(ceil(ln(count + 1) / ln(mx + 1) * 5), 1), 5) END AS BIGINT) AS level
        FROM (SELECT *, max(count) OVER () AS mx FROM (SELECT upper(code) AS code, min(name) AS name,
        CAST(sum(count) AS BIGINT) AS count FROM ({counts}) WHERE code <> '' GROUP BY 1))"""


def legend_sql(counts: str) -> str:
    return f"""SELECT step, from_count, to_count FROM (
        SELECT step, to_count, coalesce(max(to_count) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) + 1 AS from_count FROM (
        SELECT CAST(step AS INTEGER) AS step, CASE WHEN step = 5 THEN mx ELSE
        least(CAST(floor(pow(mx + 1, CAST(step AS DOUBLE) / 5) - 1) AS BIGINT), mx) END AS to_count
        FROM (SELECT max(count) AS mx FROM ({levels_sql(counts)})), generate_series(1, 5) g(step)))
        WHERE to_count >= from_count"""


def map_sql(counts: str) -> str:
    return f"""SELECT count(DISTINCT upper(code)) FILTER (WHERE code <> '') AS countries,
        CAST(coalesce(sum(count) FILTER (WHERE code = ''), 0) AS BIGINT) AS unlocated,
        coalesce(max(count) FILTER (WHERE code <> '') > 0, false) AS has_data FROM ({counts})"""


COUNTS_30D = counts_sql(CLF_SQL, since("30d"))


def _counts(spark, sf_dir) -> DataFrame:
    return countries.country_counts(bounded(derive.clf(spark, sf_dir), WEB, "30d"))


@query("country_counts", COUNTS_30D)
def _(spark, sf_dir):
    return _counts(spark, sf_dir)


@query("country_levels", levels_sql(COUNTS_30D))
def _(spark, sf_dir):
    return countries.country_levels(_counts(spark, sf_dir))


@query("country_legend", legend_sql(COUNTS_30D))
def _(spark, sf_dir):
    return countries.country_legend(countries.country_levels(_counts(spark, sf_dir)))


@query("country_map", map_sql(COUNTS_30D))
def _(spark, sf_dir):
    return countries.map_summary(_counts(spark, sf_dir))


_REGIONS = "CASE r_regionkey WHEN 0 THEN 'us' WHEN 1 THEN 'DE' ELSE concat('X', cast(r_regionkey AS string)) END"


@query(
    "country_region",
    f"SELECT c.code, c.name, c.count, c.level, r.region FROM ({levels_sql(COUNTS_30D)}) c LEFT JOIN "
    f"(SELECT upper({_REGIONS}) AS code, r_name AS region FROM region) r ON c.code = r.code",
)
def _(spark, sf_dir):
    regions = derive.derive(derive.read(spark, sf_dir, "region"), {"code": _REGIONS, "region": "r_name"})
    return countries.with_region(countries.country_levels(_counts(spark, sf_dir)), regions)


# --- overview -------------------------------------------------------------------

# nginx has no rows and must still be listed.
_TABLES = {
    "apache": derive.CLF, "caddy": derive.PROXY, "cisco_asa": derive.FIREWALL,
    "haproxy": derive.PROXY, "panos": derive.FIREWALL, "traefik": derive.PROXY,
}
_UNION = " UNION ALL ".join(
    f"SELECT '{name}' AS log_type, source_ip, ts, country, country_code FROM ({sql(columns)})"
    for name, columns in _TABLES.items()
)
_NAMES = ", ".join(f"('{name}')" for name in registry.names())
_LAST24 = f"count(*) FILTER (WHERE {since('24h')})"
BY_TYPE = (
    f"SELECT t.log_type, coalesce(c.total, 0) AS total, coalesce(c.last24, 0) AS last24 "
    f"FROM (VALUES {_NAMES}) t(log_type) LEFT JOIN (SELECT log_type, count(*) AS total, {_LAST24} AS last24 "
    f"FROM ({_UNION}) GROUP BY 1) c ON t.log_type = c.log_type"
)
BY_SOURCE = (
    f"SELECT c.source_ip, coalesce(s.name, c.source_ip) AS label, c.count FROM (SELECT source_ip, count(*) AS count "
    f"FROM ({_UNION}) GROUP BY 1) c LEFT JOIN ({SOURCES_SQL}) s ON c.source_ip = s.ip"
)
BY_COUNTRY = f"SELECT {CODE} AS code, {COUNTRY} AS name, count(*) AS count FROM ({_UNION}) GROUP BY 1, 2"
TOTALS = (
    f"SELECT count(*) AS total, {_LAST24} AS last24, round({_LAST24} / 1440, 2) AS avg_per_min, "
    f"count(DISTINCT nullif(country_code, '')) AS country_count FROM ({_UNION})"
)


def share_sql(counts: str) -> str:
    return f"""WITH r AS (SELECT label, CAST(count AS BIGINT) AS count,
        row_number() OVER (ORDER BY count DESC, label) AS rn, count(*) OVER () AS labels FROM ({counts})),
        kept AS (SELECT CASE WHEN labels > 8 AND rn > 7 THEN 8 ELSE rn END AS pos,
        CASE WHEN labels > 8 AND rn > 7 THEN 'Other' ELSE label END AS label, count FROM r),
        slices AS (SELECT pos, label, CAST(sum(count) AS BIGINT) AS count FROM kept GROUP BY 1, 2),
        shown AS (SELECT * FROM slices WHERE NOT (pos = 8 AND label = 'Other' AND count = 0)),
        pcts AS (SELECT *, coalesce(CAST(count AS DOUBLE) * 100 / nullif(sum(count) OVER (), 0), 0) AS pct FROM shown)
        SELECT CAST(pos AS INTEGER) AS pos, label, count, round(pct, 6) AS pct,
        round(sum(pct) OVER (ORDER BY pos) - pct, 6) AS start_pct,
        round(sum(pct) OVER (ORDER BY pos), 6) AS end_pct FROM pcts"""


def rounded_share(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("pct", "start_pct", "end_pct")})


def _base(spark, sf_dir) -> DataFrame:
    events = derive.read(spark, sf_dir, "events")
    tables = {name: derive.derive(events, columns) for name, columns in _TABLES.items()}
    return overview.overview_base(overview.union_types(tables), NOON)


@query("overview_by_type", BY_TYPE)
def _(spark, sf_dir):
    return overview.by_type(_base(spark, sf_dir))


@query("overview_by_source", BY_SOURCE)
def _(spark, sf_dir):
    return overview.by_source(_base(spark, sf_dir), derive.sources(spark, sf_dir))


@query("overview_by_country", BY_COUNTRY)
def _(spark, sf_dir):
    return overview.by_country(_base(spark, sf_dir))


@query("overview_totals", TOTALS)
def _(spark, sf_dir):
    return overview.totals(_base(spark, sf_dir))


@query("overview_share_source", share_sql(BY_SOURCE))
def _(spark, sf_dir):
    return rounded_share(shares.share(overview.by_source(_base(spark, sf_dir), derive.sources(spark, sf_dir))))


@query("overview_share_type", share_sql(f"SELECT log_type AS label, total AS count FROM ({BY_TYPE})"))
def _(spark, sf_dir):
    types = overview.by_type(_base(spark, sf_dir))
    return rounded_share(shares.share(types.select(F.col("log_type").alias("label"), F.col("total").alias("count"))))


@query("overview_share_country", share_sql(f"SELECT name AS label, count FROM ({BY_COUNTRY})"))
def _(spark, sf_dir):
    found = overview.by_country(_base(spark, sf_dir)).select(F.col("name").alias("label"), "count")
    return rounded_share(shares.share(found))


# --- raw lines ------------------------------------------------------------------

_NEWEST = "ts DESC, received_at DESC, raw ASC"


def _page_sql(first: int, last: int) -> str:
    return (
        f"SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS pos, ts, line, has_more FROM (SELECT row_number() OVER "
        f"(ORDER BY {_NEWEST}) AS pos, CAST(ts AS VARCHAR) AS ts, raw AS line, count(*) OVER () > {last} AS has_more "
        f"FROM ({CLF_SQL}) WHERE {since('7d')}) WHERE pos BETWEEN {first} AND {last}"
    )


@query("raw_page", _page_sql(1, 250))
def _(spark, sf_dir):
    rows = derive.clf(spark, sf_dir)
    return reports.raw_report(rows, Filter(range="7d", limit=250), AS_OF, WEB).drop("key")


@query("raw_page_next", _page_sql(251, 500))
def _(spark, sf_dir):
    rows = derive.clf(spark, sf_dir)
    first = reports.raw_report(rows, Filter(range="7d", limit=250), AS_OF, WEB)
    last = raw.Cursor(*first.orderBy(F.desc("pos")).select("key.*").first())
    return reports.raw_report(rows, Filter(range="7d", limit=250), AS_OF, WEB, after=last).drop("key")


@query(
    "raw_export",
    f"SELECT row_number() OVER (ORDER BY {_NEWEST}) AS pos, concat(CAST(ts AS VARCHAR), ' ', raw) AS value "
    f"FROM ({CLF_SQL}) WHERE {since('30d')}",
)
def _(spark, sf_dir):
    return raw.export_lines(bounded(derive.clf(spark, sf_dir), WEB, "30d"))


@query(
    "raw_export_truncated",
    f"SELECT pos, CASE WHEN pos > 1000 THEN '# 1000 lines written; older ones match too and were left out' "
    f"ELSE value END AS value FROM (SELECT row_number() OVER (ORDER BY {_NEWEST}) AS pos, "
    f"concat(CAST(ts AS VARCHAR), ' ', raw) AS value FROM ({CLF_SQL}) WHERE ts IS NOT NULL) WHERE pos <= 1001",
)
def _(spark, sf_dir):
    return raw.export_lines(derive.clf(spark, sf_dir), cap=1000)


@query(
    "raw_recent",
    f"SELECT source_ip, remote_host, auth_user, CAST(ts AS VARCHAR) AS ts, method, path, protocol, status, bytes, "
    f"user_agent, CAST(received_at AS VARCHAR) AS received_at FROM ({CLF_SQL}) ORDER BY received_at DESC, raw LIMIT 50",
)
def _(spark, sf_dir):
    return raw.recent(derive.clf(spark, sf_dir))


# --- whole reports --------------------------------------------------------------

def _long(section: str, df: DataFrame, label: str, number: str) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), F.col(label).cast("string").alias("label"),
        F.col(number).cast("double").alias("value"),
    )


def _facts(section: str, df: DataFrame, names: list[str]) -> DataFrame:
    facts = F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(section).alias("section"), F.explode(facts).alias("f")).select("section", "f.*")


def _long_sql(section: str, inner: str, label: str, number: str) -> str:
    return f"SELECT '{section}' AS section, CAST({label} AS VARCHAR) AS label, CAST({number} AS DOUBLE) AS value FROM ({inner})"


def _facts_sql(section: str, inner: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{n}' AS label, CAST({n} AS DOUBLE) AS value FROM ({inner})" for n in names
    )


_WEB_FACTS = ["requests", "unique_ips", "countries", "total_bytes", "errors", "error_rate"]
_FIREWALL_FACTS = ["events", "denied", "sources", "countries", "total_bytes", "deny_rate"]
_MAP_FACTS = ["countries", "unlocated", "has_data"]


def _long_report(report, facts: list[str]) -> DataFrame:
    parts = [
        _facts("kpis", report["kpis"], facts),
        _long("timeline", report["timeline"], "bucket", "count"),
        _long("breakdown", report["actions" if "actions" in report else "statuses"], "label", "count"),
        _long("panels", report["panels"].withColumn("l", F.concat_ws("|", "panel", "rank", "label")), "l", "count"),
        _long("countries", report["countries"], "code", "level"),
        _long("country_counts", report["countries"], "name", "count"),
        _long("legend", report["legend"], "step", "to_count"),
        _long("legend_from", report["legend"], "step", "from_count"),
        _facts("map", report["map"], _MAP_FACTS),
    ]
    return reduce(DataFrame.unionAll, parts)


def _report_sql(table, range_, kpi_sql, facts, breakdown, columns, drop_empty) -> str:
    where = since(range_)
    counts = counts_sql(table, where)
    label = "concat_ws('|', panel, rank, label)"
    return " UNION ALL ".join([
        _facts_sql("kpis", f"SELECT {kpi_sql} FROM ({table}) WHERE {where}", facts),
        _long_sql("timeline", timeline_sql(table, range_), "bucket", "count"),
        _long_sql("breakdown", breakdown, "label", "count"),
        _long_sql("panels", panels_sql(table, columns, where, drop_empty), label, "count"),
        _long_sql("countries", levels_sql(counts), "code", "level"),
        _long_sql("country_counts", levels_sql(counts), "name", "count"),
        _long_sql("legend", legend_sql(counts), "step", "to_count"),
        _long_sql("legend_from", legend_sql(counts), "step", "from_count"),
        _facts_sql("map", map_sql(counts), _MAP_FACTS),
    ])


@query("report_web", _report_sql(
    CLF_SQL, "30d", _WEB_KPIS, _WEB_FACTS, status_sql(CLF_SQL, since("30d"), "rounded"), WEB_PANELS, False))
def _(spark, sf_dir):
    report = reports.type_report(derive.clf(spark, sf_dir), Filter(range="30d"), AS_OF, WEB)
    return _long_report(report, _WEB_FACTS)


@query("report_proxy", _report_sql(
    PROXY_SQL, "24h", f"{_WEB_KPIS}, round(avg(duration_ms), 4) AS avg_ms, round(quantile_cont(duration_ms, 0.95), 4) AS p95_ms",
    [*_WEB_FACTS, "avg_ms", "p95_ms"],
    status_sql(PROXY_SQL, since("24h"), "rounded"),
    {**WEB_PANELS, "router": "router", "service": "service"}, False))
def _(spark, sf_dir):
    report = reports.type_report(derive.proxy(spark, sf_dir), Filter(), NOON, TRAEFIK)
    report["kpis"] = _rounded_durations(report["kpis"])
    return _long_report(report, [*_WEB_FACTS, "avg_ms", "p95_ms"])


@query("report_firewall", _report_sql(
    FIREWALL_SQL, "7d", _FIREWALL_KPIS, _FIREWALL_FACTS, action_sql(since("7d")), FIREWALL_PANELS, True))
def _(spark, sf_dir):
    report = reports.type_report(derive.firewall(spark, sf_dir), Filter(range="7d"), AS_OF, PANOS)
    return _long_report(report, _FIREWALL_FACTS)


@query("report_overview", " UNION ALL ".join([
    _facts_sql("totals", TOTALS, ["total", "last24", "country_count"]),
    _long_sql("types", BY_TYPE, "log_type", "total"),
    _long_sql("type_share", share_sql(f"SELECT log_type AS label, total AS count FROM ({BY_TYPE})"), "label", "count"),
    _long_sql("by_country", BY_COUNTRY, "name", "count"),
    _long_sql("legend", legend_sql(BY_COUNTRY), "step", "to_count"),
    _long_sql("sources", BY_SOURCE, "source_ip", "count"),
    _long_sql("share", share_sql(f"SELECT name AS label, count FROM ({BY_COUNTRY})"), "label", "count"),
    _long_sql("countries", levels_sql(BY_COUNTRY), "code", "level"),
    _facts_sql("map", map_sql(BY_COUNTRY), _MAP_FACTS),
    _facts_sql("sources", "SELECT count(*) AS source_count FROM supplier", ["source_count"]),
]))
def _(spark, sf_dir):
    events = derive.read(spark, sf_dir, "events")
    tables = {name: derive.derive(events, columns) for name, columns in _TABLES.items()}
    return _long_overview(reports.overview_report(tables, derive.sources(spark, sf_dir), NOON))


def _long_overview(report: reports.Report) -> DataFrame:
    return reduce(DataFrame.unionAll, [
        _facts("totals", report["totals"], ["total", "last24", "country_count"]),
        _long("types", report["by_type"], "log_type", "total"),
        _long("type_share", report["type_share"], "label", "count"),
        _long("by_country", report["by_country"], "name", "count"),
        _long("legend", report["legend"], "step", "to_count"),
        _long("sources", report["by_source"], "source_ip", "count"),
        _long("share", report["country_share"], "label", "count"),
        _long("countries", report["countries"], "code", "level"),
        _facts("map", report["map"], _MAP_FACTS),
        _facts("sources", report["source_count"], ["source_count"]),
    ])


_KEPT_DAYS = 20
_KEPT = " UNION ALL ".join(
    f"SELECT '{name}' AS log_type, source_ip, ts, country, country_code FROM ({sql(columns)}) "
    f"WHERE coalesce(ts, received_at) >= TIMESTAMP '{(NOON - timedelta(days=_KEPT_DAYS)).replace(microsecond=0)}'"
    for name, columns in _TABLES.items()
)


@query("report_overview_stored", ORACLES["report_overview"].replace(_UNION, _KEPT))
def _(spark, sf_dir):
    """The overview of stored tables after two streams, retention and compaction, from the counts of the commits."""
    root = work_dir(spark, "overview")
    events = in_time_order(derive.read(spark, sf_dir, "events"), "ts", "events")
    rows = {name: conform(derive.derive(events, columns), registry.get(name).schema) for name, columns in _TABLES.items()}
    for stream in range(2):
        part = F.pmod(F.xxhash64("raw"), F.lit(2)) == stream
        append_batches({name: df.where(part) for name, df in rows.items()}, root, stream_batch(f"stream{stream}", 0))
    maintain.run(spark, root, _KEPT_DAYS, NOON)
    return _long_overview(stored.stored_overview(spark, derive.sources(spark, sf_dir), NOON, commits.latest(spark, root)))


_STORED_KPIS = {"apache": derive.CLF, "traefik": derive.PROXY, "panos": derive.FIREWALL}


def _stored_kpis_sql(name: str) -> str:
    table = sql(_STORED_KPIS[name])
    outcome, client = ("action = 'deny'", "src_ip") if name == "panos" else ("status >= 400", "remote_host")
    return (
        f"SELECT '{name}' AS log_type, r AS range, count(*) AS n, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, "
        f"count(*) FILTER (WHERE {outcome}) AS bad, count(DISTINCT nullif(country_code, '')) AS countries, "
        f"count(DISTINCT {client}) > 0 AS near FROM ({table}), (VALUES ('24h', {DAYS['24h']}), ('30d', {DAYS['30d']}), ('1y', {DAYS['1y']})) v(r, d) "
        f"WHERE ts >= date_trunc('second', TIMESTAMP '{NOON}' - d) GROUP BY r"
    )


def _near_p95(rows: DataFrame, found: DataFrame):
    """Whether the wanted rank lies among those of the value found, give or take 2 %."""
    value, ms = found.select("p95_ms").scalar(), F.col("duration_ms")
    ranks = rows.agg(F.count_if(ms < value).alias("below"), F.count_if(ms <= value).alias("upto"), F.count(ms).alias("n"))
    r = ranks.select(F.struct("*")).scalar()
    return (r["below"] <= 0.97 * r["n"]) & (r["upto"] >= 0.93 * r["n"])


@query("kpis_stored", " UNION ALL ".join(map(_stored_kpis_sql, _STORED_KPIS)))
def _(spark, sf_dir):
    """Counters from the states kept with two batches; ``near``: clients are within 2 % of the exact number, and
    the percentile's rank is within 2 % of all ranks."""
    root = work_dir(spark, "states")
    events, found = derive.read(spark, sf_dir, "events"), []
    for name, columns in _STORED_KPIS.items():
        rows = conform(derive.derive(events, columns), registry.get(name).schema)
        for batch in range(2):
            part = rows.where(F.pmod(F.xxhash64("raw"), F.lit(2)) == batch)
            append_batch(part, table_path(root, name), stream_batch("given", batch))
        now = commits.latest(spark, root)
        for range_ in ("24h", "30d", "1y"):
            inside = Filter(range=range_).apply(rows, registry.get(name).report, NOON)
            exact = kpis.firewall_kpis(inside) if name == "panos" else kpis.proxy_kpis(inside) if name == "traefik" else kpis.web_kpis(inside)
            truth = exact.select(F.struct("*")).scalar()
            near = lambda c: F.abs(F.col(c) - truth[c]) <= 0.02 * truth[c]
            both = stored.stored_kpis(spark, name, range_, NOON, now)
            n, bad, client = ("events", "denied", "sources") if name == "panos" else ("requests", "errors", "unique_ips")
            found.append(both.select(
                F.lit(name).alias("log_type"), F.lit(range_).alias("range"), F.col(n).alias("n"), F.col("total_bytes").alias("bytes"),
                F.col(bad).alias("bad"), "countries",
                (near(client) & near("avg_ms") & _near_p95(inside, both) if name == "traefik" else near(client)).alias("near"),
            ))
    return reduce(DataFrame.unionAll, found)


@query("filter_edited", f"SELECT event_id FROM ({CLF_SQL}) WHERE {since('30d')} AND method IS NOT NULL AND {COUNTRY} = 'Germany'")
def _(spark, sf_dir):
    """A filter from text parameters, narrowed by one drill-down and widened by another."""
    flt = Filter.from_params({"range": "30d", "path": "/view/1", "status": "none"})
    flt = flt.with_(country="Germany").without("path")
    return flt.apply(derive.derive(derive.read(spark, sf_dir, "events"), derive.CLF), WEB, AS_OF).select("event_id")
