"""IP to country: an equi-join on network prefixes instead of a range join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logharrow.functions.ip import ip_key, is_private, v4_key
from logharrow.operators.lookup import fits, lookup_join
from logharrow.operators.pin import pin
from logharrow.session import settled

# Index rows that may be broadcast (about 100 bytes each), checked by counting.
BROADCAST_INDEX_ROWS = 2_000_000
# A range over more fine prefixes than this is indexed by its coarse prefixes.
MAX_FINE_PREFIXES = 4096


def _fine(key: Column) -> Column:
    """/16 of an IPv4 key, /32 of an IPv6 key."""
    return F.when(key.startswith("4"), F.left(key, F.lit(5))).otherwise(F.left(key, F.lit(9)))


def _coarse(key: Column) -> Column:
    """/8 of an IPv4 key, /16 of an IPv6 key."""
    return F.when(key.startswith("4"), F.left(key, F.lit(3))).otherwise(F.left(key, F.lit(5)))


def _number(prefix: Column) -> Column:
    return F.conv(F.substring(prefix, 2, 16), 16, 10).try_cast("bigint")


def _prefixes(lo: Column, hi: Column) -> Column:
    """All prefixes from ``lo`` to ``hi``, in the form of ``lo``."""
    numbers = F.sequence(_number(lo), _number(hi))
    width = F.length(lo) - 1
    return F.transform(numbers, lambda n: F.concat(F.left(lo, F.lit(1)), F.lpad(F.hex(n), width, F.lit("0"))))


def _keyed(ranges: DataFrame) -> DataFrame:
    """Ranges with both ends as address keys beside them, ``_lo`` and ``_hi``.

    Ends may be IPv4 numbers, address text, or 8/32 hexadecimal digits.
    """

    def key(name: str) -> Column:
        if dict(ranges.dtypes)[name] != "string":
            return v4_key(F.col(name))
        text = F.col(name)
        digits = F.upper(text)
        return (
            F.when(F.rlike(text, F.lit(r"[.:]")), ip_key(text))
            .when(F.rlike(digits, F.lit(r"^[0-9A-F]{8}\z")), F.concat(F.lit("4"), digits))
            .when(F.rlike(digits, F.lit(r"^[0-9A-F]{32}\z")), F.concat(F.lit("6"), digits))
        )

    return ranges.withColumns({"_lo": key("lo"), "_hi": key("hi")})


def _usable() -> Column:
    same_kind = F.left("_lo", F.lit(1)) == F.left("_hi", F.lit(1))
    return F.coalesce(same_kind & (F.col("_lo") <= F.col("_hi")), F.lit(False))


def normalise_ranges(ranges: DataFrame) -> DataFrame:
    """The usable ranges, with both ends as address keys."""
    return _keyed(ranges).where(_usable()).select(
        F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "country_code", "country"
    )


def rejected_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges whose ends cannot be read, are of two kinds, or are the wrong way round."""
    return _keyed(ranges).where(~_usable()).drop("_lo", "_hi")


@dataclass(frozen=True)
class GeoIndex:
    """A range table, and its index by network prefix for lookups by broadcast."""

    ranges: DataFrame
    fine: DataFrame
    coarse: DataFrame
    broadcast: bool


def overlapping(ranges: DataFrame) -> DataFrame:
    """Normalised ranges that begin inside an earlier one."""
    spread = ranges.withColumn("_p", F.explode(_prefixes(_coarse(F.col("lo")), _coarse(F.col("hi")))))
    earlier = Window.partitionBy("_p").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return spread.withColumn("_reach", F.max("hi").over(earlier)).where(F.col("lo") <= F.col("_reach"))


def build_index(ranges: DataFrame, check: bool = True) -> GeoIndex:
    """Index a range table (``lo``, ``hi``, ``country_code``, ``country``).

    Each range is repeated per prefix it touches: per fine prefix, or per coarse
    one when it is wide. Ranges must not overlap, so an address has one country, and a
    table with a range that cannot be used is refused; ``rejected_ranges`` shows them.
    """
    if check and not rejected_ranges(ranges).isEmpty():
        raise ValueError("geo ranges with unreadable or reversed ends")
    keyed = settled(normalise_ranges(ranges), "geo-ranges")
    if check and not overlapping(keyed).isEmpty():
        raise ValueError("geo ranges overlap; an address would have two countries")
    lo, hi = F.col("lo"), F.col("hi")
    wide = _number(_fine(hi)) - _number(_fine(lo)) >= MAX_FINE_PREFIXES
    columns = ("prefix", "lo", "hi", "country_code", "country")
    fine = keyed.where(~wide).withColumn("prefix", F.explode(_prefixes(_fine(lo), _fine(hi))))
    coarse = keyed.where(wide).withColumn("prefix", F.explode(_prefixes(_coarse(lo), _coarse(hi))))
    # Written once, so that neither reports nor every batch of a stream build it again.
    fine = settled(fine.select(*columns), "geo-index")
    coarse = settled(coarse.select(*columns), "geo-index")
    return GeoIndex(keyed, fine, coarse, fits(fine.unionAll(coarse), BROADCAST_INDEX_ROWS))


def _probe(df: DataFrame, index: DataFrame, prefix: Column, name: str) -> DataFrame:
    """Left-join one prefix level by broadcast; the hit lands in struct column ``name``."""
    table = index.select(
        F.col("prefix").alias("_p"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
        F.struct("country_code", "country").alias(name),
    )
    on = (prefix == F.col("_p")) & F.col("_key").between(F.col("_lo"), F.col("_hi"))
    return df.join(F.broadcast(table), on, "left").drop("_p", "_lo", "_hi")


def _resolve(df: DataFrame, index: GeoIndex) -> DataFrame:
    public = F.when(~F.col("_private"), F.col("_key"))
    df = _probe(df, index.fine, _fine(public), "_near")
    df = _probe(df, index.coarse, _coarse(public), "_far")
    return df.withColumn("_hit", F.coalesce("_near", "_far")).drop("_near", "_far")


def resolve_in_order(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """``_hit`` for distinct addresses (``_key``) by walking addresses and range starts in order.

    Both are dealt out together by ranges of the key, so slices are even however the
    addresses cluster; no prefix gathers in one task. The last range begun before an address
    is the only one that can hold it. A slice that begins within a range gets that range
    from the slices before, of which one row each is looked at.
    """
    begun = F.struct("lo", "hi", "country_code", "country")
    none = F.lit(None).cast("struct<lo:string,hi:string,country_code:string,country:string>")
    rows = ranges.select(F.col("lo").alias("_key"), F.lit(0).alias("_probe"), begun.alias("_range")).union(
        addresses.select("_key", F.lit(1).alias("_probe"), none.alias("_range"))
    )
    slices = rows.repartitionByRange("_key", "_probe").withColumn("_slice", F.spark_partition_id())
    slices = settled(slices, "geo-slices")
    so_far = Window.partitionBy("_slice").orderBy("_key", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    ends = slices.groupBy("_slice").agg(F.max(F.when(F.col("_probe") == 0, F.col("_range"))).alias("_end"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    carried = ends.select("_slice", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    placed = slices.withColumn("_last", F.last("_range", ignorenulls=True).over(so_far)).where("_probe = 1")
    found = placed.join(F.broadcast(carried), "_slice").withColumn("_found", F.coalesce("_last", "_carried"))
    hit = F.when(F.col("_found.hi") >= F.col("_key"), F.struct("_found.country_code", "_found.country"))
    return found.select("_key", hit.alias("_hit"))


def with_country(df: DataFrame, address: str, index: GeoIndex | None) -> DataFrame:
    """Add ``country_code`` and ``country`` for the address in column ``address``.

    Unparsable: ('', Unknown). Private: ('', Private network). No table, no match or
    no code: ('', Unknown). A code without a name: (code, Unknown).

    An index within the checked bound is broadcast and rows stay where they are.
    Otherwise each distinct public address is looked up once and the answers are
    joined back by address, with hot addresses kept out of the shuffle.
    """
    # In two steps: fields, private networks and countries in one were a method too long for the JVM to compile.
    df = pin(pin(df, _key=ip_key(F.col(address))), _private=is_private(F.col("_key")))
    key, private = F.col("_key"), F.col("_private")
    if index is None:
        empty = F.lit(None).cast("struct<country_code:string,country:string>")
        df = df.withColumn("_hit", empty)
    elif index.broadcast:
        df = _resolve(df, index)
    else:
        public = df.where(key.isNotNull() & ~private).select("_key").distinct()
        df = lookup_join(df, resolve_in_order(public, index.ranges), "_key", "left", False)
    code = F.coalesce(F.col("_hit.country_code"), F.lit(""))
    name = F.coalesce(F.col("_hit.country"), F.lit("Unknown"))
    return df.withColumns({
        "country_code": F.when(key.isNull() | private, "").otherwise(code),
        "country": F.when(key.isNull(), "Unknown")
        .when(private, "Private network")
        .when(code == "", "Unknown")
        .otherwise(name),
    }).drop("_key", "_private", "_hit")
