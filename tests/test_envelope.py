from datetime import datetime

import pytest

from conftest import ARRIVED
from logharrow.operators.lookup import lookup_join
from logharrow.operators.routing import mark_outcome, minute_stats, route, unknown_senders
from logharrow.schemas import RAW_ENVELOPE, SOURCES
from logharrow.sources.messages import decode_payload, parse_envelope, read_messages, split_lines


def parse(spark, *lines):
    df = spark.createDataFrame([("192.0.2.1", line, ARRIVED) for line in lines], RAW_ENVELOPE)
    return [(r.hostname, r.tag, r.raw) for r in parse_envelope(df).collect()]


CLF = '2001:db8::1 - - [13/Jun/2026:15:59:18 +0000] "GET / HTTP/1.1" 200 5'


@pytest.mark.parametrize(("line", "expected"), [
    ("<34>Oct 11 22:14:15 mymachine su: 'su root' failed", ("mymachine", "su", "'su root' failed")),
    ("<13>Feb  5 17:32:18 10.0.0.99 app[77]: hello: world", ("10.0.0.99", "app", "hello: world")),
    ("<13>2026-08-16T10:00:00.1Z host prog: x", ("host", "prog", "x")),
    ("<134>%ASA-4-106023: Deny tcp", (None, "%ASA-4-106023", "Deny tcp")),
    ("<134>Aug 16 2026 10:00:00: %ASA-4-106023: Deny tcp", (None, "%ASA-4-106023", "Deny tcp")),
    ("<134>Aug 16 10:00:00 fw1 : %ASA-4-106023: Deny", ("fw1", None, ": %ASA-4-106023: Deny")),
    ("<14>Aug 16 10:00:00 fw 1,2026/08/16 10:00:05,0018,TRAFFIC,end",
     ("fw", None, "1,2026/08/16 10:00:05,0018,TRAFFIC,end")),
    ("<14>Aug 16 10:00:00 1,2026/08/16 10:00:05,0018,TRAFFIC,end",
     (None, None, "1,2026/08/16 10:00:05,0018,TRAFFIC,end")),
    ('<14>Aug 16 10:00:00 web {"a": 1}', ("web", None, '{"a": 1}')),
    ('{"a": 1}', (None, None, '{"a": 1}')),
    (f"<14>Aug 16 10:00:00 web {CLF}", ("web", None, CLF)),
    (f"<14>{CLF}", (None, None, CLF)),
    (CLF, (None, None, CLF)),
    ("<165>1 2003-10-11T22:14:15.003Z host.example evntslog - ID47 [x@1 a=\"b\\\"]c\"][y] An event",
     ("host.example", "evntslog", "An event")),
    ("<165>1 2003-10-11T22:14:15.003Z - - - - - body\nmore", (None, None, "body\nmore")),
    ("<165>1 2003-10-11T22:14:15.003Z h a - - -", ("h", "a", "")),
    ("", (None, None, "")),
])
def test_envelope(spark, line, expected):
    assert parse(spark, line) == [expected]


def test_long_structured_data_does_not_exhaust_the_stack(spark):
    data = '[x a="' + '\\"' * 30_000 + '"]' + "[y]" * 10_000
    assert parse(spark, f"<1>1 - h a - - {data} tail") == [("h", "a", "tail")]


def test_lossy_decode(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "payload binary")
    assert decode_payload(df).first().payload == "a�b"


def test_split_lines(spark):
    df = spark.createDataFrame([("a\r\nb\n\nc\n",), ("x",), ("\n",), ("",), ("y\r",)], "payload string")
    assert [r.payload for r in split_lines(df).collect()] == ["a", "b", "", "c", "x", "", "y\r"]


def test_read_messages(spark, tmp_path):
    rows = [("192.0.2.1", "hello", ARRIVED)]
    spark.createDataFrame(rows, RAW_ENVELOPE).write.json(str(tmp_path / "in"))
    back = read_messages(spark, str(tmp_path / "in"), "json")
    assert [tuple(r) for r in back.collect()] == rows


@pytest.mark.parametrize("broadcast", [True, False, None])
def test_routing(spark, broadcast):
    envelope = spark.createDataFrame(
        [(ip, None, None, "x", ARRIVED) for ip in ["1.1.1.1"] * 50 + ["2.2.2.2", "3.3.3.3", "3.3.3.3"]],
        "source_ip string, hostname string, tag string, raw string, received_at timestamp_ntz",
    )
    sources = spark.createDataFrame(
        [("1.1.1.1", "a", "apache", None), ("2.2.2.2", "b", "panos", None)], SOURCES
    )
    counts = {r.log_type: r["count"] for r in route(envelope, sources, broadcast).groupBy("log_type").count().collect()}
    assert counts == {"apache": 50, "panos": 1}
    assert [r.source_ip for r in unknown_senders(envelope, sources, broadcast).collect()] == ["3.3.3.3"] * 2
    assert mark_outcome(envelope, sources, broadcast).count() == 53


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_big_table_join_equals_a_plain_join(spark, how):
    left = spark.range(9000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL WHEN id % 7 = 2 THEN 'hot but unknown' "
        "ELSE cast(id % 4000 as string) END AS k", "id")
    table = spark.range(5000).selectExpr("CASE id WHEN 0 THEN 'hot' ELSE cast(id * 2 as string) END AS k", "id AS v")
    columns = ["k", "id"] + ([] if how == "left_anti" else ["v"])
    want = left.join(table, "k", how).select(*columns)
    got = lookup_join(left, table, "k", how, broadcast=False).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_minute_stats(spark):
    at = [datetime(2026, 1, 1, 10, 0, s) for s in (0, 59)] + [datetime(2026, 1, 1, 10, 2, 0)]
    df = spark.createDataFrame(
        [(at[0], "apache", True), (at[1], "apache", False), (at[1], None, False), (at[2], "panos", True)],
        "received_at timestamp_ntz, log_type string, parsed boolean",
    )
    got = {r.minute.minute: (r.received, r.stored, r.unparsed, r.unknown_source) for r in minute_stats(df).collect()}
    assert got == {0: (3, 1, 1, 1), 2: (1, 1, 0, 0)}
