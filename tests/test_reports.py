import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logharrow import registry
from logharrow.filters import Filter
from logharrow.functions.columns import fmt_ms, human_bytes, status_class
from logharrow.functions.time import cutoff, spine_bounds
from logharrow.operators import countries, kpis, panels, raw, shares, timeline
from logharrow.operators.quantile import exact_quantile, exact_quantiles
from logharrow.plans import reports
from logharrow.schemas import CLF, FIREWALL, HAPROXY, conform

NOW = datetime(2026, 3, 15, 12, 34, 56, 700000)
WEB = registry.get("apache").report


def web(spark, rows):
    df = spark.createDataFrame(rows, "ts timestamp_ntz, remote_host string, path string, status int, country string, country_code string")
    return conform(df, CLF)


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


@pytest.mark.parametrize(("status", "rounded", "floor"), [
    (499, 5, 4), (451, 5, 4), (450, 4, 4), (350, 4, 3), (550, 6, 5), (599, 6, 5), (200, 2, 2), (404, 4, 4),
])
def test_status_class(spark, status, rounded, floor):
    row = spark.range(1).select(
        status_class(F.lit(status)).alias("r"), status_class(F.lit(status), "floor").alias("f")
    ).first()
    assert (row.r, row.f) == (rounded, floor)


def test_filter_is_normalised():
    f = Filter(range="2h", ip="  ", path=" /a ", action="drop", q="").normalised()
    assert f == Filter(path="/a")
    assert f.range_key == "24h"
    assert Filter(action="deny", range="7d").normalised() == Filter(action="deny", range="7d")


def test_filter_edits():
    f = Filter(range="7d", ip="1.1.1.1").with_(path="/x")
    assert f.without("ip") == Filter(range="7d", path="/x")
    assert f.with_(ip="2.2.2.2").ip == "2.2.2.2"
    assert [Filter(limit=n).page_size for n in (None, 5, 500, 10**6)] == [200, 5, 500, 10**6]


def test_range_is_cut_to_seconds_and_has_no_upper_bound(spark):
    edge = cutoff("1h", NOW)
    assert edge == datetime(2026, 3, 15, 11, 34, 56)
    df = web(spark, [
        (edge, "a", "/", 200, "", ""), (datetime(2026, 3, 15, 11, 34, 55, 999999), "b", "/", 200, "", ""),
        (datetime(2027, 1, 1), "future", "/", 200, "", ""), (None, "none", "/", 200, "", ""),
    ])
    got = Filter(range="1h").apply(df, WEB, NOW)
    assert sorted(r.remote_host for r in got.collect()) == ["a", "future"]
    assert kpis.web_kpis(got).first().requests == 2
    assert sum(r["count"] for r in timeline.timeline(got, "1h", NOW).collect()) == 0  # before the first bucket, and after the last


def test_undeclared_dimensions_do_not_filter(spark):
    flt = Filter(router="x", backend="y", status=2)
    count = lambda name: len(flt.conditions(registry.get(name).report, NOW))
    assert (count("apache"), count("caddy"), count("traefik"), count("haproxy"), count("panos")) == (2, 2, 3, 3, 1)


def test_search(spark):
    rows = [(NOW, "h", p, 200, "", "") for p in ("/A/b", "/a_b", "/axb", "c\\d", "100%")]
    df = web(spark, rows)

    def found(q):
        return sorted(r.path for r in Filter(q=q).apply(df, WEB, NOW).collect())

    assert found("a/B") == ["/A/b"]
    assert found("a_b") == ["/A/b", "/a_b", "/axb"]  # _ is a wildcard
    assert found("c\\d") == ["c\\d"]
    assert found("\\") == ["c\\d"]
    assert found("nothing") == []


@pytest.mark.parametrize(("range_", "first", "last", "count"), [
    ("1h", (2026, 3, 15, 11, 35), (2026, 3, 15, 12, 30), 12),
    ("24h", (2026, 3, 14, 13, 0), (2026, 3, 15, 12, 0), 24),
    ("7d", (2026, 3, 9), (2026, 3, 15), 7),
    ("30d", (2026, 2, 14), (2026, 3, 15), 30),
    ("1y", (2025, 4, 1), (2026, 3, 1), 12),
])
def test_spine(spark, range_, first, last, count):
    assert spine_bounds(range_, NOW) == (datetime(*first), datetime(*last))
    rows = timeline.spine(spark, range_, NOW).orderBy("bucket").collect()
    assert len(rows) == count
    epoch = lambda t: int((datetime(*t) - datetime(1970, 1, 1)).total_seconds())
    assert (rows[0].bucket, rows[-1].bucket) == (epoch(first), epoch(last))
    label = {"1h": "12:30", "24h": "12:00", "7d": "03-15", "30d": "03-15", "1y": "2026-03"}[range_]
    assert rows[-1].label == label


def test_times_do_not_depend_on_the_session_zone(spark, envelope):
    from logharrow.operators.parsers import parse_asa, parse_clf
    from test_parsers import ASA_DENY, COMBINED

    own = "Mar  8 2026 02:30:00: " + ASA_DENY  # an hour New York skips
    df = web(spark, [(datetime(2026, 3, 8, h, 30), "h", "/", 200, "", "") for h in (1, 2, 3)])
    now = datetime(2026, 3, 8, 5)
    expected = values(timeline.timeline(df, "24h", now), "bucket", "label", "count")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert values(timeline.timeline(df, "24h", now), "bucket", "label", "count") == expected
        assert parse_clf(envelope(COMBINED)).first().ts == datetime(2026, 3, 21, 0, 37, 8)
        assert parse_asa(envelope(own)).select(F.col("ts").cast("string")).first()[0] == "2026-03-08 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_empty_labels(spark):
    df = web(spark, [(NOW, h, "", 200, None, None) for h in ("a", "a", "", None)])
    assert values(panels.top_n(df, F.col("remote_host")), "label", "count") == [("a", 2), ("", 1), (None, 1)]
    assert values(panels.top_n(df, F.col("remote_host"), drop_empty=True), "label", "count") == [("a", 2)]


def test_hot_key_is_counted_whole(spark):
    hot = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    row = panels.top_panels(hot, {"k": F.col("k"), "same": F.lit("x")}).where("rank = 1").orderBy("panel").collect()
    assert [(r.panel, r.label, r["count"]) for r in row] == [("k", "hot", 6667), ("same", "x", 20_000)]


def test_ranking_is_limited_before_it_gathers(spark):
    df = web(spark, [(NOW, "a", "/", 200, "", "")])
    plan = panels.top_panels(df, panels.panel_columns(WEB))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def level(count, biggest):
    if count <= 0 or biggest <= 0:
        return 1
    if biggest == 1:
        return 5
    return min(max(math.ceil(math.log(count + 1) / math.log(biggest + 1) * 5), 1), 5)


def counted(spark, rows):
    return spark.createDataFrame(rows, "code string, name string, count bigint")


@pytest.mark.parametrize("biggest", [1, 2, 5, 37, 1000, 250_000])
def test_legend_is_the_inverse_of_shading(spark, biggest):
    levels = countries.country_levels(counted(spark, [("US", "u", biggest)]))
    steps = values(countries.country_legend(levels), "step", "from_count", "to_count")
    expected = 1
    for step, low, high in steps:
        assert low == expected and level(low, biggest) == level(high, biggest) == step
        expected = high + 1
    assert steps[-1][2] == biggest


def test_map(spark):
    rows = counted(spark, [("US", "United States", 100), ("DE", "Germany", 1), ("", "Private network", 7)])
    assert countries.map_summary(rows).first().asDict() == {"countries": 2, "unlocated": 7, "has_data": True}
    levels = countries.country_levels(rows)
    assert sorted(values(levels, "code", "level")) == [("DE", 1), ("US", 5)]
    legend = values(countries.country_legend(levels), "from_count", "to_count")
    assert (legend[0][0], legend[-1][1]) == (1, 100)


def test_empty_map(spark):
    rows = counted(spark, [("", "Unknown", 3)])
    assert countries.map_summary(rows).first().asDict() == {"countries": 0, "unlocated": 3, "has_data": False}
    assert countries.country_legend(countries.country_levels(rows)).count() == 0


def expected_share(items):
    items = sorted(items, key=lambda i: (-i[1], i[0]))
    rest = 0
    if len(items) > 8:
        rest = sum(n for _, n in items[7:])
        items = items[:7]
    if rest > 0:
        items = [*items, ("Other", rest)]
    total = sum(n for _, n in items)
    return [(label, n, n * 100 / total if total else 0.0) for label, n in items]


@pytest.mark.parametrize("counts", [
    [], [0], [5], [1] * 8, [1] * 9, [9, 8, 7, 6, 5, 4, 3, 2, 1, 0], [4] * 7 + [0, 0], [0] * 9, list(range(100)),
])
def test_share(spark, counts):
    items = [(f"l{i:03}", n) for i, n in enumerate(counts)]
    got = shares.share(spark.createDataFrame(items, "label string, count bigint")).collect()
    want = expected_share(items)
    assert [(r.label, r["count"]) for r in got] == [w[:2] for w in want]
    assert [r.pct for r in got] == pytest.approx([w[2] for w in want])
    assert [r.end_pct for r in got] == pytest.approx(list(np.cumsum([w[2] for w in want])))


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 1e-9, 1e300, -1e300])), min_size=1, max_size=50),
    st.sampled_from([0.0, 0.5, 0.95, 1.0]),
)
def test_quantile_is_exact(spark, numbers, q):
    df = spark.createDataFrame([(v,) for v in [*numbers, None, float("nan")]], "v double")
    assert exact_quantile(df, "v", q).first()[0] == pytest.approx(np.quantile(numbers, q), rel=1e-9, abs=1e-12)


def test_quantile_with_a_hot_value(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7.25).otherwise(F.col("id") / 7).alias("v"))
    expected = np.quantile([7.25 if i % 3 == 0 else i / 7 for i in range(30_000)], 0.95)
    assert exact_quantile(df, "v", 0.95).first()[0] == pytest.approx(expected, rel=1e-12)
    assert exact_quantile(df.where("v < 0"), "v", 0.95).first()[0] is None


@pytest.mark.parametrize("scale", [(1.7e12, 1e-3), (0.0, 1e-15), (-1e300, 1e297), (5.0, 0.0)])
def test_quantile_of_clustered_values(spark, monkeypatch, scale):
    """Values far from zero, below a nanosecond, huge, or all the same: never many rows in one place."""
    start, step = scale
    numbers = start + step * np.arange(5000)
    df = spark.createDataFrame([(float(x),) for x in numbers], "v double").repartition(3)
    got = exact_quantiles(df, "v", [0.0, 0.3, 0.95, 1.0])
    assert got == pytest.approx(list(np.quantile(numbers, [0.0, 0.3, 0.95, 1.0])), rel=1e-12)
    assert exact_quantiles(df.where("v IS NULL"), "v", [0.5]) == [None]


def test_empty_reports(spark):
    nothing = spark.createDataFrame([], HAPROXY)
    report = reports.type_report(nothing, Filter(), NOW, registry.get("haproxy"))
    row = report["kpis"].first().asDict()
    assert row == {"requests": 0, "unique_ips": 0, "countries": 0, "total_bytes": 0, "errors": 0,
                   "error_rate": 0.0, "avg_ms": None, "p95_ms": None}
    assert report["timeline"].count() == 24 and report["panels"].count() == 0
    assert report.facts == {"range": "24h", "granularity": "time", "has_data": False}
    report.release()
    firewall = reports.type_report(spark.createDataFrame([], FIREWALL), Filter(range="1y"), NOW, registry.get("panos"))
    assert firewall["kpis"].first().deny_rate == 0.0
    assert firewall.facts["granularity"] == "month"


@pytest.mark.parametrize("rows", [1, 7, 500, 2999, 3000, 5000])
def test_long_lists_are_cut_exactly(spark, rows):
    """A third of all rows share one moment; ties and neighbours must come out whole."""
    moment = F.when(F.col("id") % 3 == 0, F.lit(60_000_000)).otherwise(F.col("id") * 77_777)
    df = spark.range(3000).select(
        F.timestamp_add("MICROSECOND", moment, F.lit("2026-03-15 10:00:00").cast("timestamp_ntz")).alias("ts"),
        F.lit(NOW).cast("timestamp_ntz").alias("received_at"), F.col("id").cast("string").alias("raw"),
    ).persist()
    order = [F.desc("ts"), F.asc("raw")]
    want = [r.raw for r in df.orderBy(*order).limit(rows).collect()]
    assert [r.raw for r in raw._cut_older(df, rows).orderBy(*order).limit(rows).collect()] == want
    assert raw._cut_older(df, rows).count() <= rows + 1001


def test_raw_page_and_export(spark, tmp_path):
    rows = spark.createDataFrame(
        [(datetime(2026, 3, 15, 10, i % 3), NOW, f"line {i}") for i in range(10)] + [(None, NOW, "untimed")],
        "ts timestamp_ntz, received_at timestamp_ntz, raw string",
    )
    page = raw.raw_page(rows.where("ts IS NOT NULL"), 4).collect()
    assert [r.line for r in page] == ["line 2", "line 5", "line 8", "line 1"] and page[0].has_more
    assert not raw.raw_page(rows, 11).first().has_more
    assert [r.line for r in raw.raw_page(rows, 4).collect()] == ["line 2", "line 5", "line 8", "line 1"]
    assert raw.raw_page(rows, 11).count() == 11
    for cap, marked in ((10, False), (9, True), (2, True)):
        lines = [r.value for r in raw.export_lines(rows, cap).orderBy("pos").collect()]
        assert len(lines) == min(10, cap + 1)
        assert lines[-1].startswith(f"# {cap} lines written") is marked
        assert lines[0] == "2026-03-15 10:02:00 line 2"
    raw.write_export(rows, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(f.read_text() for f in files).splitlines()
    assert len(text) == 10 and text[0] == "2026-03-15 10:02:00 line 2"


def test_pages_follow_each_other(spark):
    times = [datetime(2026, 3, 15, 10, i % 3) for i in range(10)] + [None, None]
    rows = spark.createDataFrame(
        [(t, None if i % 4 == 0 else NOW, None if i == 7 else f"line {i}") for i, t in enumerate(times)],
        "ts timestamp_ntz, received_at timestamp_ntz, raw string",
    )
    whole = [r.line for r in raw.raw_page(rows, 100).orderBy("pos").collect()]
    seen, cursor = [], None
    while True:
        page = raw.raw_page(rows, 5, cursor).orderBy("pos").collect()
        seen += [r.line for r in page]
        if not page[-1].has_more:
            break
        cursor = raw.Cursor(*page[-1].key)
    assert seen == whole and len(seen) == 12


def test_export_is_whole_by_default(spark):
    rows = spark.range(700_000).select(
        F.timestamp_seconds(F.col("id") % 90_000).cast("timestamp_ntz").alias("ts"),
        F.lit(NOW).cast("timestamp_ntz").alias("received_at"), F.col("id").cast("string").alias("raw"),
    )
    got = raw.export_lines(rows).agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.countDistinct("value")).first()
    assert tuple(got) == (700_000, 700_000, 1, 700_000, 700_000)


def test_filter_from_parameters():
    flt = Filter.from_params({"port": " 443 ", "status": "x", "range": "7d", "q": " ", "other": "1", "limit": "50", "src": "10.0.0.1 "})
    assert flt == Filter(port=443, range="7d", limit=50, src="10.0.0.1")


def test_display(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 5 * 1024**2: "5.0 MB", 3 * 1024**5: "3072.0 TB"}
    df = spark.createDataFrame([(n,) for n in cases], "n bigint")
    assert {r.n: r.t for r in df.select("n", human_bytes(F.col("n")).alias("t")).collect()} == cases
    row = spark.range(1).select(fmt_ms(F.lit(2.5)).alias("a"), fmt_ms(F.lit(None).cast("double")).alias("b")).first()
    assert (row.a, row.b) == ("2 ms", "—")


def test_registry():
    assert registry.names() == ["apache", "caddy", "cisco_asa", "haproxy", "nginx", "panos", "traefik"]
    nav = registry.by_category()
    assert list(nav) == ["web", "firewall"]
    assert [s.label for s in nav["web"]] == ["Apache", "Caddy", "HAProxy", "Traefik", "nginx"]
    with pytest.raises(ValueError):
        registry.get("unheard of")
