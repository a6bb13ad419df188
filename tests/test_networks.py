"""Nested networks against looking for the longest prefix."""

import ipaddress
import random

import pytest

from logharrow.operators import geo, networks
from logharrow.sources import dimensions

SCHEMA = "network string, country_code string, country string"


def longest(rows, address):
    found = [(ipaddress.ip_network(n, strict=False), c) for n, c, _ in rows]
    found = [(n.prefixlen, c) for n, c in found if n.version == address.version and address in n]
    return max(found)[1] if found else ""


def made(seed):
    draw, rows = random.Random(seed), {}
    for i in range(120):
        if draw.random() < 0.6:
            bits = draw.choice([5, 8, 11, 16, 23, 24, 29, 31, 32])
            base = draw.choice([0x08080000, 0x08FF0000, 0x51000000, draw.getrandbits(32)]) | draw.getrandbits(12)
            net = ipaddress.ip_network((base, bits), strict=False)
        else:
            bits = draw.choice([3, 16, 20, 32, 47, 64, 128])
            net = ipaddress.ip_network(((0x2A << 120) | draw.getrandbits(draw.choice([20, 100, 121])), bits), strict=False)
        rows[str(net)] = (str(net), f"C{i}", f"Country {i}")
    return list(rows.values())


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("broadcast", [True, False])
def test_the_most_specific_network_wins(spark, seed, broadcast):
    from dataclasses import replace

    rows, draw = made(seed), random.Random(seed + 9)
    index = replace(networks.build_nested_index(spark.createDataFrame(rows, SCHEMA)), broadcast=broadcast)
    addresses = set()
    for text, *_ in rows:
        net = ipaddress.ip_network(text)
        for place in (0, net.num_addresses - 1, draw.randrange(net.num_addresses)):
            addresses.add(net[place])
        if int(net[0]):
            addresses.add(net[0] - 1)
    addresses = [a for a in addresses if a.is_global]
    df = spark.createDataFrame([(str(a),) for a in addresses], "address string")
    got = {r.address: r.country_code for r in geo.with_country(df, "address", index).collect()}
    assert got == {str(a): longest(rows, a) for a in addresses}


def test_disjoint_ranges_cover_what_the_networks_cover(spark):
    rows = [("8.0.0.0/7", "A", "a"), ("8.8.0.0/16", "B", "b"), ("8.8.8.0/24", "C", "c"), ("8.8.8.8", "D", "d"), ("2000::/3", "E", "e")]
    ranges = networks.disjoint(geo.normalise_ranges(networks.from_networks(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert sum(int(r.hi[1:], 16) - int(r.lo[1:], 16) + 1 for r in ranges if r.lo[0] == "4") == 2**25
    assert sum(int(r.hi[1:], 16) - int(r.lo[1:], 16) + 1 for r in ranges if r.lo[0] == "6") == 2**125
    assert sum(int(r.hi[1:], 16) - int(r.lo[1:], 16) + 1 for r in ranges if r.country_code == "C") == 255
    assert geo.overlapping(spark.createDataFrame(ranges)).isEmpty()


@pytest.mark.parametrize("rows, problem", [
    ([("8.8.8.0/24", "A", "a"), ("8.8.8.0/24", "B", "b")], "two countries"),
    ([("8.8.8.0/33", "A", "a")], "unreadable"), ([("8.8.8/24", "A", "a")], "unreadable"), ([("", "A", "a")], "unreadable"),
    ([(None, "A", "a")], "unreadable"), ([("8.8.8.0/2/4", "A", "a")], "unreadable"), ([("::/129", "A", "a")], "unreadable"),
])
def test_bad_tables_are_refused(spark, rows, problem):
    with pytest.raises(Exception, match=problem):
        networks.build_nested_index(spark.createDataFrame(rows, SCHEMA))


def test_crossing_ranges_are_refused_and_repeated_ones_are_not(spark):
    schema = "lo string, hi string, country_code string, country string"
    crossing = [("8.0.0.0", "8.0.0.9", "A", "a"), ("8.0.0.5", "8.0.0.20", "B", "b")]
    with pytest.raises(Exception, match="overlap without"):
        networks.build_nested_index(spark.createDataFrame(crossing, schema))
    same = spark.createDataFrame([crossing[0]] * 3, schema)
    assert networks.build_nested_index(same).ranges.count() == 1
    assert networks.build_nested_index(same.limit(0)).ranges.count() == 0


def test_tables_from_files(spark, tmp_path):
    rows = [("8.0.0.0/8", "A", "Alpha, North"), ("8.8.0.0/16", "B", None), ("2a00::/12", "C", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "nets"))
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "nets.csv"))
    for name in ("nets", "nets.csv"):
        index = dimensions.load_geo_ranges(spark, str(tmp_path / name))
        seen = spark.createDataFrame([("8.1.1.1",), ("8.8.1.1",), ("2a01::5",), ("9.9.9.9",)], "a string")
        got = [tuple(r)[1:] for r in geo.with_country(seen, "a", index).orderBy("a").collect()]
        assert got == [("C", "c"), ("A", "Alpha, North"), ("B", "Unknown"), ("", "Unknown")]
