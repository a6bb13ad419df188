"""The exact quantile in two scans, against sorting."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from logharrow.operators import kpis, quantile
from logharrow.operators.quantile import exact_quantile


def want(values, q):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    if not values:
        return None
    place = (len(values) - 1) * q
    a, b = values[math.floor(place)], values[math.ceil(place)]
    return a + (b - a) * (place - math.floor(place)) if place % 1 else a


draw = random.Random(4)
CASES = {
    "even": [draw.random() for _ in range(3000)],
    "tied": [1.5] * 900 + [2.5] * 80 + [draw.random() for _ in range(20)],
    "wide": [math.exp(draw.uniform(-300, 300)) * draw.choice([-1, 1]) for _ in range(1500)],
    "huge": [1e308, -1e308, 0.0, 5e-324] * 20,
    "endless": [math.inf] * 30 + [-math.inf] * 30 + [1.0, 2.0, 3.0],
    "few": [3.0], "two": [1.0, 2.0], "none": [], "nothing": [None, math.nan], "mixed": [None, math.nan, 4.0, -0.0, 0.0, 7.25],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact(spark, case, q):
    df = spark.createDataFrame([(v,) for v in CASES[case]], "v double").repartition(3)
    got, exact = exact_quantile(df, "v", q).collect()[0][0], want(CASES[case], q)
    assert got == exact or exact is not None and (math.isclose(got, exact, rel_tol=1e-12) or math.isnan(exact) and (got is None or math.isnan(got)))


def test_small_bins_and_sketches(spark, monkeypatch):
    monkeypatch.setattr(quantile, "BINS", 4)
    monkeypatch.setattr(quantile, "SKETCH_K", 64)
    values = [draw.gauss(0, 10) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.05, 0.5, 0.95):
        assert exact_quantile(df, "v", q).collect()[0][0] == pytest.approx(want(values, q), rel=1e-12)


def test_a_rank_out_of_bounds_fails(spark, monkeypatch):
    monkeypatch.setattr(quantile, "MARGIN", -200)  # bounds the wrong way round
    df = spark.range(5000).select((F.col("id") * 1.0).alias("v"))
    with pytest.raises(Exception, match="outside the sketch"):
        exact_quantile(df, "v", 0.5).collect()


def scans(df):
    """Scans of files in the plan that ran: those of its own tree, and one for each subquery that is not a reused one."""
    df.collect()
    plan = df._jdf.queryExecution()
    own = plan.executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(plan, "formatted")
    return own + len(set(re.findall(r"Hosting Expression = Subquery subquery#(\d+)", text)))


def test_two_scans_and_none_before_the_report_is_read(spark, tmp_path):
    path = str(tmp_path / "durations")
    rows = spark.range(20_000).select((F.col("id") * 7919 % 10_007 / 3.0).alias("duration_ms"))
    rows.write.parquet(path)
    df = spark.read.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    frame = exact_quantile(df, "duration_ms", 0.95)
    assert len(tracker.getJobIdsForGroup(None)) == before  # nothing ran
    assert scans(frame) == 2
    assert frame.collect()[0][0] == pytest.approx(want([i * 7919 % 10_007 / 3.0 for i in range(20_000)], 0.95))


def test_proxy_kpis_are_lazy(spark):
    rows = spark.range(100).selectExpr(
        "cast(id % 7 as string) AS remote_host", "'DE' AS country_code", "id AS bytes", "200 + id % 300 AS status", "id * 1.0D AS duration_ms")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    frame = kpis.proxy_kpis(rows)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert frame.first().p95_ms == pytest.approx(94.05)
    assert kpis.proxy_kpis(rows.limit(0)).first().p95_ms is None
