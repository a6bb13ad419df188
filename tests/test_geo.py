import ipaddress
import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logharrow.functions.ip import ip_key, is_private
from logharrow.operators import geo

ADDRESSES = [
    "0.0.0.0", "255.255.255.255", "1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.4.5", "256.1.1.1", "1.2.3.4 ", "", "x",
    "::", "::1", "1::", "1::2", "2001:db8::8a2e:370:7334", "2001:DB8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
    "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", ":::", "12345::",
    "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "1.2.3.4::",
    "g::1", "fe80::1", "::1%eth0", "not-an-ip", "1:2:3:4:5:6:7:8::",
]


def expected_key(text):
    try:
        address = ipaddress.ip_address(text.strip())
    except ValueError:
        return None
    if "%" in text:
        return None  # scoped addresses are not plain addresses
    return f"4{int(address):08X}" if address.version == 4 else f"6{int(address):032X}"


def keys(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    return [r.k for r in df.select("i", ip_key(F.col("a")).alias("k")).orderBy("i").collect()]


def test_keys_match_the_standard_library(spark):
    assert dict(zip(ADDRESSES, keys(spark, ADDRESSES))) == {a: expected_key(a) for a in ADDRESSES}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.ip_addresses().map(str), st.ip_addresses(v=6).map(lambda a: a.exploded)), min_size=1, max_size=60))
def test_keys_of_any_address(spark, texts):
    assert keys(spark, texts) == [expected_key(t) for t in texts]


PRIVATE = {
    "10.0.0.1": True, "9.255.255.255": False, "11.0.0.0": False, "172.15.255.255": False, "172.16.0.0": True,
    "172.31.255.255": True, "172.32.0.0": False, "192.168.1.20": True, "192.169.0.0": False, "127.0.0.1": True,
    "128.0.0.0": False, "169.254.9.9": True, "169.253.0.0": False, "0.0.0.0": True, "0.0.0.1": False, "::1": True,
    "::": True, "::2": False, "fc00::1": True, "fdff::1": True, "fe00::1": False, "8.8.8.8": False, "fe80::1": False,
    "100.64.0.1": False,
}


def test_private(spark):
    df = spark.createDataFrame([(a,) for a in PRIVATE], "a string")
    got = {r.a: r.p for r in df.select("a", is_private(ip_key(F.col("a"))).alias("p")).collect()}
    assert got == PRIVATE


def test_without_a_table(spark):
    df = spark.createDataFrame([(a,) for a in ("10.0.0.1", "192.168.1.20", "127.0.0.1", "::1", "not-an-ip", "8.8.8.8")], "a string")
    got = [(r.country_code, r.country) for r in geo.with_country(df, "a", None).collect()]
    assert got == [("", "Private network")] * 4 + [("", "Unknown")] * 2


def make_ranges(rng):
    """Disjoint ranges of all widths, both families, from random cut points."""
    rows = []
    for version, bits in ((4, 32), (6, 128)):
        cuts = {0, 2**bits - 1}
        while len(cuts) < 60:
            base = rng.randrange(2**bits)
            cuts |= {base, min(base + 2 ** rng.randrange(bits), 2**bits - 1)}
        cuts = sorted(cuts)
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if i % 4 != 3:
                make = ipaddress.IPv4Address if version == 4 else ipaddress.IPv6Address
                code = "" if i % 7 == 6 else f"{version}{i}"
                rows.append((str(make(lo)), str(make(hi - 1)), code, None if i % 5 == 4 else f"name {version} {i}"))
    return [r for r in rows if ipaddress.ip_address(r[0]) <= ipaddress.ip_address(r[1])]


@pytest.mark.parametrize("broadcast", [True, False])
def test_lookup_equals_brute_force(spark, broadcast):
    rng = random.Random(5)
    ranges = make_ranges(rng)
    parsed = [(ipaddress.ip_address(lo), ipaddress.ip_address(hi), c, n) for lo, hi, c, n in ranges]
    texts = ["bogus", ""] + [r[0] for r in ranges] + [r[1] for r in ranges]
    texts += [str(ipaddress.IPv4Address(rng.randrange(2**32))) for _ in range(150)]
    texts += [str(ipaddress.IPv6Address(rng.randrange(2**128))) for _ in range(150)]
    texts += ["203.0.113.5"] * 200

    def answer(text):
        key = expected_key(text)
        if key is None:
            return "", "Unknown"
        address = ipaddress.ip_address(text)
        v4_private = address.version == 4 and any(
            address in ipaddress.ip_network(n)
            for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/32")
        )
        v6_private = address.version == 6 and any(address in ipaddress.ip_network(n) for n in ("::/127", "fc00::/7"))
        if v4_private or v6_private:
            return "", "Private network"
        for lo, hi, code, name in parsed:
            if lo.version == address.version and lo <= address <= hi:
                return ("", "Unknown") if not code else (code, name or "Unknown")
        return "", "Unknown"

    index = geo.build_index(spark.createDataFrame(ranges, "lo string, hi string, country_code string, country string"))
    index = replace(index, broadcast=broadcast)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    got = {r.i: (r.country_code, r.country) for r in geo.with_country(df, "a", index).collect()}
    assert len(got) == len(texts)
    assert got == {i: answer(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("ends", [("10.0.0.9", "10.0.0.1"), ("here", "there"), ("10.0.0.0/8", None), ("10.0.0.1", "2001:db8::1")])
def test_ranges_that_cannot_be_used_are_refused(spark, ends):
    ranges = spark.createDataFrame([(*ends, "XX", "X"), ("8.8.8.0", "8.8.8.255", "US", "United States")], "lo string, hi string, country_code string, country string")
    assert [r.lo for r in geo.rejected_ranges(ranges).collect()] == [ends[0]]
    with pytest.raises(ValueError, match="unreadable"):
        geo.build_index(ranges)


def test_overlap_is_refused(spark):
    rows = [("1.0.0.0", "1.255.255.255", "A", "a"), ("1.2.3.0", "1.2.3.255", "B", "b")]
    with pytest.raises(ValueError, match="overlap"):
        geo.build_index(spark.createDataFrame(rows, "lo string, hi string, country_code string, country string"))


def test_no_nested_loop_join(spark):
    index = geo.build_index(spark.createDataFrame(
        [("1.0.0.0", "1.0.0.255", "A", "a"), ("2.0.0.0", "9.0.0.0", "B", "b")],
        "lo string, hi string, country_code string, country string",
    ))
    for broadcast in (True, False):
        df = geo.with_country(spark.createDataFrame([("1.0.0.1",)], "a string"), "a",
                              replace(index, broadcast=broadcast))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
        assert not broadcast or "SortMergeJoin" not in plan


def test_addresses_of_one_prefix_are_spread(spark):
    """All addresses in one IPv6 /32, over many ranges: slices stay even."""
    n = 4000
    rows = [(f"2001:db8:{i:x}::", f"2001:db8:{i:x}:ffff::", f"C{i}", f"c{i}") for i in range(0, n, 2)]
    index = geo.build_index(spark.createDataFrame(rows, "lo string, hi string, country_code string, country string"))
    df = spark.range(n).select(F.concat(F.lit("2001:db8:"), F.lower(F.hex("id")), F.lit("::7")).alias("a"), "id")
    got = geo.with_country(df, "a", replace(index, broadcast=False))
    assert {r.id: r.country_code for r in got.collect()} == {i: "" if i % 2 else f"C{i}" for i in range(n)}
    keys = df.select(ip_key(F.col("a")).alias("_key"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so small an input would be one slice
    try:
        found = geo.resolve_in_order(keys, index.ranges).select("_hit.country_code").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sum(r[0] is not None for r in found) == n // 2


def test_no_step_of_a_lookup_is_too_long_to_be_compiled(spark, tmp_path):
    """The JVM only interprets methods of more than 8,000 bytes of code."""
    from logharrow.schemas import CLF
    from logharrow.sources.tables import as_events

    ranges = spark.createDataFrame([("1.0.0.0", "1.0.0.255", "AU", "Australia")], "lo string, hi string, country_code string, country string")
    path = str(tmp_path / "parsed")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CLF.fields if f.name not in ("country", "country_code")) + ", parsed boolean"
    spark.createDataFrame([], schema).write.parquet(path)
    df = as_events(spark.read.schema(schema).parquet(path), "apache", geo.build_index(ranges))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = df._sc._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(part.split(";")[0]) for part in text.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8000, sizes
