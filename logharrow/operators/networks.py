"""Country tables as they are published: networks, one within the other, made into disjoint ranges.

The most specific network of an address says its country. A sweep makes that explicit once, so that
lookups need not know of nesting: networks are cut at the borders of coarse prefixes, and within each
prefix a walk in order of their starts keeps the open ones on a stack and writes what belongs to the
innermost. The walk streams; it holds the stack alone, which nesting bounds by the bits of an address.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharrow.functions.ip import ip_key
from logharrow.operators.geo import GeoIndex, _coarse, _prefixes, build_index, normalise_ranges, rejected_ranges
from logharrow.operators.pin import pin

RANGES = "lo string, hi string, country_code string, country string"


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """A country table from Parquet, or from text with a header line where the path ends in ``.csv`` or ``.csv.gz``."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def from_networks(networks: DataFrame, column: str = "network") -> DataFrame:
    """Ranges (lo, hi, country_code, country) of networks written as address/bits, or of single addresses.

    Bits beyond the prefix are ignored, as in 10.1.2.3/8. What is no network gets NULL ends, which
    ``build_nested_index`` refuses and ``geo.rejected_ranges`` shows.
    """
    text = F.trim(F.col(column))
    rows = pin(networks.select(text.alias("_text"), "country_code", "country"), _key=ip_key(F.split_part(F.col("_text"), F.lit("/"), F.lit(1))))
    key, given = F.col("_key"), F.split_part(F.col("_text"), F.lit("/"), F.lit(2))
    digits = F.when(key.startswith("4"), 8).otherwise(32)
    bits = F.when(given == "", digits * 4).otherwise(F.when(F.rlike(given, F.lit(r"^[0-9]{1,3}\z")), given.try_cast("int")))
    good = (bits <= digits * 4) & (F.size(F.split(F.col("_text"), "/")) <= 2)
    rows = pin(rows, _digits=digits, _bits=F.when(good, bits))
    digits, bits = F.col("_digits"), F.col("_bits")
    whole = F.floor(bits / 4).cast("int")
    # The digit in which the prefix ends keeps its first bits.
    step = F.element_at(F.array(*[F.lit(1 << k) for k in (4, 3, 2, 1)]), bits % 4 + 1)
    digit = F.conv(F.substring(key, whole + 2, F.lit(1)), 16, 10).cast("int")
    rows = pin(rows, _whole=whole, _step=step, _low=F.when(whole < digits, digit - digit % step))
    whole, low = F.col("_whole"), F.col("_low")
    head = F.substring(key, F.lit(2), whole)
    start, stop = (F.coalesce(F.hex(n.cast("bigint")), F.lit("")) for n in (low, low + F.col("_step") - 1))
    end = lambda middle, fill: F.when(bits.isNotNull(), F.rpad(F.concat(head, middle), digits, F.lit(fill)))
    return rows.select(end(start, "0").alias("lo"), end(stop, "F").alias("hi"), "country_code", "country")


def disjoint(ranges: DataFrame) -> DataFrame:
    """Normalised ranges, which may lie within each other, as disjoint ones of the innermost each.

    Ranges that overlap without one holding the other are refused, as are two of the same ends that differ
    in what they say. One task takes the networks of one or more coarse prefixes, /8 or /16 of IPv6.
    """
    lo, hi = F.col("lo"), F.col("hi")
    spread = ranges.distinct().withColumn("prefix", F.explode(_prefixes(_coarse(lo), _coarse(hi))))
    width = F.length(lo)
    first, last = F.rpad("prefix", width, F.lit("0")), F.rpad("prefix", width, F.lit("F"))
    cut = spread.select(
        "prefix", F.greatest(lo, first).alias("lo"), F.least(hi, last).alias("hi"), "country_code", "country",
        lo.alias("own_lo"), hi.alias("own_hi"),
    )
    # Of equal cut ends the wider range comes first: it holds the other.
    ordered = cut.repartition("prefix").sortWithinPartitions("prefix", "lo", F.desc("hi"), "own_lo", F.desc("own_hi"))
    return ordered.mapInArrow(_sweep, RANGES)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[int, tuple]] = []  # end of an open range, and the range
    at, prefix, before = 0, None, None
    out: list[tuple] = []

    def given(upto: int) -> None:
        """What lies from ``at`` up to a place belongs to the innermost open range."""
        nonlocal at
        if stack and at <= upto:
            row = stack[-1][1]
            digits = len(row[1]) - 1
            out.append((f"{row[1][0]}{at:0{digits}X}", f"{row[1][0]}{upto:0{digits}X}", row[3], row[4]))
        at = max(at, upto + 1)

    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            low, high = int(row[1][1:], 16), int(row[2][1:], 16)
            if row[0] != prefix:
                while stack:
                    given(stack[-1][0])
                    stack.pop()
                prefix, at, before = row[0], low, None
            while stack and stack[-1][0] < low:
                given(stack[-1][0])
                stack.pop()
            if stack and high > stack[-1][0]:
                raise ValueError(f"ranges overlap without one holding the other: {row[5]} to {row[6]}")
            if before is not None and before[5:7] == row[5:7]:
                raise ValueError(f"one range with two countries: {row[5]} to {row[6]}")
            given(low - 1)
            at = low
            stack.append((high, row))
            before = row
        yield _batch(out)
        out.clear()
    while stack:
        given(stack[-1][0])
        stack.pop()
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["lo", "hi", "country_code", "country"])


def build_nested_index(ranges: DataFrame) -> GeoIndex:
    """An index for ``geo.with_country`` of ranges or networks (column ``network``) that may be nested."""
    if "network" in ranges.columns:
        ranges = from_networks(ranges)
    if not rejected_ranges(ranges).isEmpty():
        raise ValueError("geo ranges with unreadable or reversed ends")
    plain = disjoint(normalise_ranges(ranges))
    # Hexadecimal digits without the sign of the kind, as ``build_index`` reads them.
    digits = lambda c: F.substring(c, 2, 32)
    return build_index(plain.select(digits("lo").alias("lo"), digits("hi").alias("hi"), "country_code", "country"))
