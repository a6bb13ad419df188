"""Exact interpolated quantiles without gathering the values in one place."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bins into which the stretch that holds a wanted rank is cut in each pass.
BINS = 4_096
# A stretch of positive values this many times wider than its start is cut on a log scale.
WIDE = 1_000.0
# Size of the sketch that bounds a rank, and how many times its usual error the bounds are apart.
SKETCH_K = 4_096
MARGIN = 5


@dataclass(frozen=True)
class Stretch:
    """Values from ``low`` to ``high``; ``before`` values are smaller."""

    low: float
    high: float
    before: int

    def bin(self, v: Column) -> Column:
        """An order-preserving number of the bin of a value; the ends never share one."""
        low, high = F.lit(self.low), F.lit(self.high)
        if self.low > 0 and self.high / self.low > WIDE:
            share = F.ln(v / low) / F.ln(high / low)
        else:  # halves, so that the difference of two huge values does not overflow
            share = (v / 2 - low / 2) / (high / 2 - low / 2)
        inner = F.floor(share * (BINS - 2)).cast("int") + 1
        return F.when(v <= low, 0).when(v >= high, BINS - 1).otherwise(
            F.least(F.greatest(inner, F.lit(1)), F.lit(BINS - 2))
        )


def exact_quantiles(df: DataFrame, value: str, qs: list[float]) -> list[float | None]:
    """The exact quantiles of a column, each interpolated between two ranks.

    A search for all wanted ranks at once: each pass counts values by bins of the
    stretches that still hold one, and goes on within the bins found, until each is a
    single value. A pass is one scan with a map-side aggregation into at most BINS rows
    for each rank, and those counts alone come to the driver; no task ever holds or
    ranks the values, however they cluster. NULL and NaN are ignored; without a value all
    quantiles are None.
    """
    v = F.col("_v")
    values = df.select(F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    n, low, high = values.agg(F.count("*"), F.min(v), F.max(v)).first()
    if not n:
        return [None] * len(qs)
    places = [(n - 1) * q for q in qs]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    found = dict.fromkeys(ranks, Stretch(low, high, 0))
    while wanted := sorted({s for s in found.values() if s.low < s.high}, key=lambda s: s.low):
        which, bins = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, stretch in enumerate(wanted):
            inside = v.between(stretch.low, stretch.high)
            which, bins = F.when(inside, i).otherwise(which), F.when(inside, stretch.bin(v)).otherwise(bins)
        rows = (
            values.select("_v", which.alias("s"), bins.alias("b")).where("s IS NOT NULL")
            .groupBy("s", "b").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
            .collect()  # BINS rows for each stretch
        )
        for i, stretch in enumerate(wanted):
            before = stretch.before
            for row in sorted((r for r in rows if r.s == i), key=lambda r: r.b):
                for rank, held in found.items():
                    if held == stretch and before <= rank < before + row["n"]:
                        found[rank] = Stretch(row.low, row.high, before)
                before += row["n"]
    lower = [found[math.floor(p)].low for p in places]
    upper = [found[math.ceil(p)].low for p in places]
    return [a + (b - a) * (p - math.floor(p)) for a, b, p in zip(lower, upper, places)]


def exact_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row, ``quantile``: the exact one, interpolated between two ranks, in two lazy scans.

    A KLL sketch gives two values between which the wanted ranks surely lie, MARGIN times further
    apart than its usual error. The second scan counts what is below, and each value of that
    narrow band; the band is cut into BINS bins, and only the values of the bins that hold the ranks
    are ranked. NULL and NaN are ignored; without a value the quantile is NULL. Should the sketch err
    by more than the margin, which its bounds put beyond one in 10**20, the query fails and gives no
    wrong number.
    """
    v = F.col("_v")
    values = df.select(F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    near = values.agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_v", F.lit(SKETCH_K)).alias("sketch"))
    place = (F.col("n") - 1) * F.lit(float(q))
    # The ranks of SKETCH_K values and more are within two of as many from q; of fewer, all are the band.
    error = MARGIN * 2.296 / SKETCH_K**0.9723 + 2 / SKETCH_K
    at = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(max(0.0, min(share, 1.0))))
    bound = lambda share, end: F.when(F.col("n") < SKETCH_K, at(end)).otherwise(at(share))
    bounds = near.where("n > 0").select(F.struct(
        "n", place.alias("place"), F.floor(place).alias("r0"), F.ceil(place).alias("r1"),
        bound(q - error, 0.0).alias("low"), bound(q + error, 1.0).alias("high"),
    ).alias("b"))
    b = bounds.scalar()
    low, high = b["low"], b["high"]
    # One row for all that lies below the band, and one for each value in it.
    counts = values.where(v <= high).select(F.when(v >= low, v).alias("w")).groupBy("w").agg(F.count("*").alias("m"))
    w = F.col("w")
    share = (w / 2 - low / 2) / (high / 2 - low / 2)
    inner = F.when(F.isnan(share), 0).otherwise(F.floor(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * (BINS - 2)).cast("int")) + 1
    number = F.when(w.isNull(), -1).when(w <= low, 0).when(w >= high, BINS).otherwise(inner)
    binned = counts.select("w", "m", number.alias("bin"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows
    bins = binned.groupBy("bin").agg(F.sum("m").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    holds = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("held"))
    chosen = bins.where((F.col("bin") >= 0) & (holds(b["r0"]) | holds(b["r1"]))).select("bin", "before")  # one or two rows
    own = Window.partitionBy("bin").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.join(F.broadcast(chosen), "bin").select("w", "m", (F.col("before") + F.sum("m").over(own)).alias("upto"))
    value_at = lambda r: F.max(F.when((F.col("upto") - F.col("m") <= r) & (r < F.col("upto")), w))
    ends = ranked.agg(value_at(b["r0"]).alias("lower"), value_at(b["r1"]).alias("upper"))
    lost = F.raise_error(F.lit("the wanted rank lies outside the sketch's bounds"))
    part = b["place"] - b["r0"]
    exact = F.col("lower") + F.when(part > 0, (F.col("upper") - F.col("lower")) * part).otherwise(F.lit(0.0))
    return ends.select(
        F.when(b["n"].isNotNull() & (F.col("lower").isNull() | F.col("upper").isNull()), lost).otherwise(exact).cast("double").alias("quantile")
    )
