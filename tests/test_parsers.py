from datetime import datetime

import pytest

from conftest import ARRIVED
from logharrow.operators.parsers import (
    parse_asa, parse_caddy, parse_clf, parse_haproxy, parse_panos, parse_traefik,
)

COMBINED = (
    '198.51.100.24 - maria [21/Mar/2026:06:07:08 +0530] "GET /shop/lamps.html HTTP/1.1" 200 5120 '
    '"https://shop.test/index" "TestBrowser/2.1 (X11; rv:7)"'
)
COMMON = '203.0.113.80 - - [02/Feb/2026:23:01:59 +0000] "HEAD /status/ HTTP/1.0" 204 88'
DASHES = '192.0.2.14 - - [09/Sep/2026:12:30:00 +0000] "PUT /forms/7 HTTP/1.1" 403 - "-" "wget/1.21"'
TRAEFIK = (
    '{"ClientHost":"198.51.100.61","RequestMethod":"PATCH","RequestPath":"/cart/18",'
    '"RequestProtocol":"HTTP/2.0","DownstreamStatus":202,"DownstreamContentSize":777,'
    '"RouterName":"cart@file","ServiceName":"cart-pool@file","Duration":2500000,'
    '"StartUTC":"2026-05-04T03:02:01Z","request_User-Agent":"probe/3.3"}'
)
CADDY = (
    '{"level":"info","ts":1767225600.25,"logger":"http.log.access","msg":"handled request",'
    '"request":{"remote_ip":"192.0.2.200","client_ip":"198.51.100.9","proto":"HTTP/2.0",'
    '"method":"PUT","host":"files.test","uri":"/up/1.bin",'
    '"headers":{"User-Agent":["uploader/5"],"Referer":["https://files.test/list","y"]}},'
    '"bytes_read":4096,"user_id":"","duration":0.0125,"size":64,"status":201}'
)
CADDY_OLD = (
    '{"level":"info","ts":1767225661.5,"msg":"handled request","request":{"remote_addr":'
    '"198.51.100.77:50123","proto":"HTTP/1.1","method":"DELETE","host":"d","uri":"/item/3"},'
    '"duration":0.25,"size":12,"status":204}'
)
CADDY_V6 = (
    '{"level":"info","ts":"2026-11-12T13:14:15Z","msg":"handled request","request":{"remote_addr":'
    '"[2001:db8:5::77]:8443","method":"HEAD","uri":"/v6"},"status":206,"size":9}'
)
HAPROXY = (
    'haproxy[807]: 198.51.100.33:40404 [05/Jul/2026:18:19:20.456] public~ shop-pool/node3 '
    '3/0/2/71/90 302 845 - - ---- 4/4/0/1/0 0/0 "POST /buy?id=6 HTTP/1.1"'
)
HAPROXY_V6 = (
    'haproxy[12]: 2001:db8:9::4:8080 [05/Jul/2026:18:19:21.250] edge pool/<NOSRV> 0/7/-1/-1/-1 -1 0 - - SC-- '
    '9/9/3/0/0 1/2 {shop.test|agent "2"} {} "GET /queue HTTP/1.1"'
)
ASA_DENY = (
    '%ASA-4-106023: Deny udp src dmz:198.51.100.71/5353 dst lan:192.0.2.9/53 '
    'by access-group "dmz_in" [0x8, 0x1]'
)
PANOS = (
    "1,2026/07/05 18:20:05,009900112233,TRAFFIC,drop,2817,2026/07/05 18:20:01,198.51.100.90,192.0.2.31,"
    "203.0.113.1,0.0.0.0,web-out,,,ssl,vsys2,guest,wan,ethernet1/5,ethernet1/6,"
    "to-syslog,2026/07/05 18:20:04,777,1,52100,8443,0,0,0x400053,tcp,allow,4242,1111,3131,20,"
    "2026/07/05 18:19:00,61,any,0,0,0,0,,edge02,from-policy"
)


def rows(df):
    return [r.asDict() for r in df.collect()]


def expect(row, **values):
    assert {k: row[k] for k in values} == values


def test_clf(envelope):
    a, b, c, d = rows(parse_clf(envelope(COMBINED, COMMON, DASHES, "nothing of this shape")))
    expect(
        a, parsed=True, remote_host="198.51.100.24", ident="-", auth_user="maria", method="GET",
        path="/shop/lamps.html", protocol="HTTP/1.1", status=200, bytes=5120,
        referer="https://shop.test/index",
        user_agent="TestBrowser/2.1 (X11; rv:7)", ts=datetime(2026, 3, 21, 0, 37, 8),
    )
    expect(b, remote_host="203.0.113.80", method="HEAD", path="/status/", status=204, bytes=88, referer="", user_agent="")
    expect(c, auth_user="-", method="PUT", status=403, bytes=None, referer="-")
    assert not d["parsed"]


def test_clf_with_every_separator(envelope):
    """A line that holds all separators of the one-pass match is matched all the same."""
    odd = "\u0001\u0002\ufdd0"
    row, other = rows(parse_clf(envelope(COMBINED.replace("lamps", odd), f"not {odd} a line")))
    expect(row, parsed=True, path=f"/shop/{odd}.html", status=200, referer="https://shop.test/index", bytes=5120)
    assert not other["parsed"]


def test_clf_edges(envelope):
    short, bad_time, huge, tail, marked, wide = rows(parse_clf(envelope(
        '192.0.2.4 - - [04/Apr/2026:04:05:06 +0000] "-" - 1',
        '192.0.2.4 - - [some day] "GET / HTTP/1.1" 200 1',
        '192.0.2.4 - - [04/Apr/2026:04:05:06 +0000] "GET / HTTP/1.1" 200 99999999999999999999',
        '  192.0.2.4 - - [04/Apr/2026:04:05:06 +0000] "GET /a b c" 200 1 "r" "u" extra ',
        '192.0.2.4 - ma\u0001ria [04/Apr/2026:04:05:06 +0000] "GET /\u0001x HTTP/1.1" 200 1',
        '192.0.2.4 a\u00a0b - [04/Apr/2026:04:05:06 +0000] "GET / HTTP/1.1" 200 1',
    )))
    expect(short, parsed=True, method="-", path="", protocol="", status=None)
    expect(bad_time, parsed=True, ts=None, status=200)
    expect(huge, parsed=True, bytes=None)
    expect(tail, parsed=True, remote_host="192.0.2.4", method="GET", path="/a", protocol="b c", referer="r", user_agent="u")
    expect(marked, parsed=True, auth_user="ma\u0001ria", path="/\u0001x", protocol="HTTP/1.1")
    assert not wide["parsed"]  # a no-break space is white space


def test_traefik(envelope):
    a, b = rows(parse_traefik(envelope(TRAEFIK, "no braces here")))
    expect(
        a, parsed=True, remote_host="198.51.100.61", method="PATCH", path="/cart/18", status=202,
        bytes=777, router="cart@file", service="cart-pool@file", duration_ms=2.5,
        user_agent="probe/3.3", host="", ts=datetime(2026, 5, 4, 3, 2, 1),
    )
    assert not b["parsed"]


@pytest.mark.parametrize(("line", "parsed"), [
    ('{"RequestPath":"/"}', True),
    ('{"RequestPath":"/","DownstreamStatus":null}', True),
    ('{"RequestPath":"/","DownstreamStatus":"200"}', False),
    ('{"RequestPath":"/","DownstreamStatus":200.0}', False),
    ('{"RequestPath":"/","DownstreamContentSize":99999999999999999999}', False),
    ('{"RequestPath":7}', False),
    ('{"ClientHost":"192.0.2.4"}', False),
    ('{"RequestPath":null}', False),
    ('{"RequestPath":"/"} x', False),
    ('{"RequestPath":"/"} {"a":1}', False),
    ('{"RequestPath":"/"},{"a":1}', False),
    ('{"RequestPath":"/"},null,{}', False),
    ('{"RequestPath":"/"}] x}', False),
    ('{"RequestPath":"/","l":[{"a":1}]}', True),
    ('  {"RequestPath":"/"}\n', True),
    ('["/"]', False),
    ('{"RequestPath":', False),
])
def test_json_is_strict(envelope, line, parsed):
    assert rows(parse_traefik(envelope(line)))[0]["parsed"] is parsed


def test_traefik_narrow_status_and_time(envelope):
    a, b, c = rows(parse_traefik(envelope(
        '{"RequestPath":"/","DownstreamStatus":4294967700,"StartUTC":"2026-08-09T07:30:00.654321987+05:30"}',
        '{"RequestPath":"/","StartUTC":"2026-08-09T07:30:00"}',
        '{"RequestPath":"/","Duration":1}',
    )))
    expect(a, status=404, ts=datetime(2026, 8, 9, 2, 0, 0, 654321))
    expect(b, parsed=True, ts=None, status=None)
    expect(c, duration_ms=1e-6, bytes=None)


def test_caddy(envelope):
    a, b, c = rows(parse_caddy(envelope(CADDY, CADDY_OLD, CADDY_V6)))
    expect(
        a, parsed=True, remote_host="198.51.100.9", path="/up/1.bin", status=201, bytes=64,
        bytes_read=4096, user_agent="uploader/5", referer="https://files.test/list", host="files.test",
        ts=datetime(2026, 1, 1, 0, 0, 0, 250000),
    )
    assert a["duration_ms"] == pytest.approx(12.5)
    expect(b, parsed=True, remote_host="198.51.100.77", duration_ms=250.0, user_agent="")
    expect(c, parsed=True, remote_host="2001:db8:5::77", ts=datetime(2026, 11, 12, 13, 14, 15), bytes=9)


@pytest.mark.parametrize(("line", "parsed"), [
    ('{"level":"warn","ts":1767225661.5,"msg":"certificate renewed"}', False),
    ('{"level":"error","msg":"upstream gone","request":{"method":"PUT"},"status":502}', False),
    ("plain text", False),
    (TRAEFIK, False),
    ('{"request":{"method":"GET"}}', True),
    ('{"request":{},"status":200}', True),
    ('{"request":{}}', False),
    ('{"request":null,"status":200}', False),
    ('{"request":{"method":"GET","headers":{"A":"x"}}}', False),
    ('{"request":{"method":"GET","headers":{"A":["x"],"B":[null]}}}', False),
    ('{"request":{"method":"GET","headers":{"A":["x"],"B":[]}}}', True),
    ('{"request":{"method":"GET","headers":{}}}', True),
    ('{"request":{"method":"GET","headers":null}}', True),
    ('{"request":{"method":"GET","headers":{"A":[1]}}}', False),
    ('{"request":{"method":"GET"},"duration":"1s"}', False),
    ('{"request":{"method":"GET"},"duration":1}', True),
    ('{"request":{"method":"GET"},"ts":{"a":1}}', True),
])
def test_caddy_records(envelope, line, parsed):
    assert rows(parse_caddy(envelope(line)))[0]["parsed"] is parsed


def test_caddy_bare_ipv6_loses_its_last_group(envelope):
    line = '{"request":{"method":"GET","remote_addr":"2001:db8:4::6"}}'
    assert rows(parse_caddy(envelope(line)))[0]["remote_host"] == "2001:db8:4:"


def test_haproxy(envelope):
    a, b, c = rows(parse_haproxy(envelope(HAPROXY, HAPROXY.removeprefix("haproxy[807]: "), HAPROXY_V6)))
    expect(
        a, parsed=True, remote_host="198.51.100.33", frontend="public~", backend="shop-pool",
        server="node3", status=302, bytes=845, duration_ms=90.0, termination="----", method="POST",
        path="/buy?id=6", protocol="HTTP/1.1", ts=datetime(2026, 7, 5, 18, 19, 20, 456000),
    )
    expect(b, parsed=True, backend="shop-pool", status=302)
    expect(
        c, parsed=True, remote_host="2001:db8:9::4", server="<NOSRV>", duration_ms=None, status=None,
        bytes=0, termination="SC--", path="/queue",
    )


FRONT = "198.51.100.33:40404 [05/Jul/2026:18:19:20] edge "


@pytest.mark.parametrize("line", [
    FRONT + "pool/node3 3/0/2 302 -- 4/4/0/1/0 0/0",  # the TCP format
    "haproxy[807]: Server shop-pool/node3 is DOWN.",
    COMBINED,
    FRONT + 'pool 3/0/2/71/90 302 845 - - ---- 4/4/0/1/0 0/0 "GET / HTTP/1.1"',
    FRONT + 'pool/n 3/0/2/71/90 302 845 - - --- 4/4/0/1/0 0/0 "GET / HTTP/1.1"',
    FRONT + 'pool/n 3/0/2/71/90 302 845 - - ---- 4/4/0/1/0 0/0 {open "GET / HTTP/1.1',
    FRONT + "pool/n 3/0/2/71/90 302 845 - - ---- 4/4/0/1/0 0/0",
    FRONT + 'pool/n 3/0/2/71/90 ok 845 - - ---- 4/4/0/1/0 0/0 "GET / HTTP/1.1"',
])
def test_haproxy_rejects(envelope, line):
    assert not rows(parse_haproxy(envelope(line)))[0]["parsed"]


def test_haproxy_keeps_braces_and_blanks_of_the_request(envelope):
    line = FRONT + 'pool/n/x 3/0/2/71/90 302 845 - - ---- 4/4/0/1/0 0/0 "GET /a {b} c" rest'
    expect(rows(parse_haproxy(envelope(line)))[0], parsed=True, server="n/x", path="/a", protocol="{b} c", method="GET")


def test_asa_deny(envelope):
    expect(
        rows(parse_asa(envelope(ASA_DENY)))[0], parsed=True, action="deny", protocol="udp",
        src_ip="198.51.100.71", src_port=5353, dst_ip="192.0.2.9", dst_port=53, src_zone="dmz",
        dst_zone="lan", rule="dmz_in", bytes=None, event_type="106023", ts=ARRIVED,
        raw=ASA_DENY, application="",
    )


def test_asa_sentences(envelope):
    permitted, denied, built, torn, udp, inbound, icmp, six = rows(parse_asa(envelope(
        "%ASA-6-106100: access-list edge permitted tcp wan/198.51.100.8(50505) -> lan/192.0.2.40(8443) hit-cnt 3 first hit",
        "%FTD-4-106100: access-list edge denied udp wan/198.51.100.8(777)->lan/192.0.2.40(514) hit-cnt 1",
        "%ASA-6-302013: Built inbound TCP connection 90210 for wan:198.51.100.8/50506 (198.51.100.8/50506) "
        "to lan:192.0.2.40/993 (192.0.2.40/993)",
        "%ASA-6-302014: Teardown TCP connection 90210 for wan:198.51.100.8/50506 to lan:192.0.2.40/993 "
        "duration 0:12:44 bytes 31415 TCP Reset-I",
        "%PIX-6-302015: Built outbound UDP connection 11 for wan:198.51.100.8/123 (198.51.100.8/123) to lan:192.0.2.40/1230",
        "Nov 30 2026 21:22:23: %ASA-2-106001: Inbound TCP connection denied from 203.0.113.55/6000 "
        "to 192.0.2.77/3389 flags RST on interface wan",
        "Nov  3 2026 01:02:03: %ASA-4-106023: Deny icmp src q:203.0.113.5 dst r:192.0.2.6 (type 3, code 1) by access-group list7",
        "%ASA-4-106023: Deny tcp src wan:2001:db8:1::2/4000 dst lan:2001:db8:2::3/25",
    )))
    expect(permitted, action="allow", rule="edge", protocol="tcp", src_zone="wan", src_port=50505, dst_zone="lan", dst_ip="192.0.2.40")
    expect(denied, action="deny", protocol="udp", dst_port=514)
    expect(built, action="allow", bytes=None, src_zone="wan", dst_ip="192.0.2.40", dst_port=993, event_type="302013")
    expect(torn, action="allow", bytes=31415, rule="")
    expect(udp, action="allow", protocol="udp", dst_port=1230)
    expect(
        inbound, action="deny", dst_port=3389, src_zone="wan", dst_zone="",
        ts=datetime(2026, 11, 30, 21, 22, 23), src_ip="203.0.113.55",
    )
    expect(icmp, action="deny", src_port=None, dst_port=None, dst_ip="192.0.2.6", rule="list7", ts=datetime(2026, 11, 3, 1, 2, 3))
    expect(six, parsed=True, src_zone="wan", src_ip="2001:db8:1::2", src_port=4000, dst_ip="2001:db8:2::3", rule="")


@pytest.mark.parametrize("line", [
    "%ASA-6-605005: Login permitted from 192.0.2.3/7 to lan:192.0.2.1/https for user \"op\"",
    "%ASA-5-111008: User 'op' executed the 'write' command.",
    "%ASA-6-302020: Built outbound ICMP connection for faddr 198.51.100.8/0",
    "%ASA-4-106023: Deny with no ends named",
    "%ASA-6-302013: Built inbound TCP connection 5 for wan:198.51.100.8 to lan:192.0.2.40/993",
    "%ASA-6-106100: access-list edge watched tcp wan/198.51.100.8(5) -> lan/192.0.2.40(6)",
    "words only",
])
def test_asa_ignores(envelope, line):
    assert not rows(parse_asa(envelope(line)))[0]["parsed"]


def test_asa_id_from_tag(envelope):
    body = ASA_DENY.split(": ", 1)[1]
    a, b, c = rows(parse_asa(envelope((body, "%ASA-4-106023"), (body, "%ASA-4-106023:"), (body, "sshd"))))
    expect(a, parsed=True, event_type="106023", raw=ASA_DENY)
    expect(b, parsed=True, raw=ASA_DENY)
    assert not c["parsed"]


def test_panos(envelope):
    expect(
        rows(parse_panos(envelope(PANOS)))[0], parsed=True, action="allow", protocol="tcp",
        src_ip="198.51.100.90", src_port=52100, dst_ip="192.0.2.31", dst_port=8443, src_zone="guest",
        dst_zone="wan", rule="web-out", application="ssl", bytes=4242,
        event_type="drop", ts=datetime(2026, 7, 5, 18, 20, 1), raw=PANOS,
    )


@pytest.mark.parametrize("verdict", ["deny", "drop", "reset-both", "reset-client", "block-url", ""])
def test_panos_denies(envelope, verdict):
    line = PANOS.replace(",tcp,allow,", f",tcp,{verdict},")
    expect(rows(parse_panos(envelope(line)))[0], parsed=True, action="deny")


@pytest.mark.parametrize(("quoted", "rule"), [
    ('"a, b, c"', "a, b, c"),
    ('"a ""b"", c"', 'a "b", c'),
    ('""', ""),
    ('""""', '"'),
    ('x"y,z"', "xy,z"),
    ('"a\u0001,b"', "a\u0001,b"),
    ('"a\u0001\u0002,\ufdd0b\u00011,0"', "a\u0001\u0002,\ufdd0b\u00011,0"),
    ('  "a,b" ', "a,b"),
])
def test_panos_quotes(envelope, quoted, rule):
    row = rows(parse_panos(envelope(PANOS.replace("web-out", quoted))))[0]
    expect(row, parsed=True, rule=rule, application="ssl", bytes=4242)


@pytest.mark.parametrize("line", [
    PANOS.replace("TRAFFIC", "THREAT"), PANOS.replace("TRAFFIC", "SYSTEM"), "1,2,3,TRAFFIC", "",
    PANOS.replace("198.51.100.90", ""), PANOS.replace("web-out", '"never closed'),
])
def test_panos_rejects(envelope, line):
    assert not rows(parse_panos(envelope(line)))[0]["parsed"]


def test_panos_rejoins_the_tag(envelope):
    tag, body = PANOS.split(" ", 1)
    expect(rows(parse_panos(envelope((body, tag))))[0], parsed=True, src_ip="198.51.100.90", raw=PANOS)


def test_no_python_in_any_parser(envelope, capsys):
    for parse in (parse_clf, parse_traefik, parse_caddy, parse_haproxy, parse_asa, parse_panos):
        plan = parse(envelope("x"))._jdf.queryExecution().toString()
        assert "Python" not in plan


def test_no_step_is_too_long_to_be_compiled(spark, tmp_path):
    """The JVM only interprets methods of more than 8,000 bytes of code."""
    from logharrow.operators.parsers.asa import parse_asa
    from workload import render

    path = str(tmp_path / "lines")
    spark.createDataFrame([], "source_ip string, hostname string, tag string, raw string, received_at timestamp_ntz").write.parquet(path)
    events = spark.read.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(path)
    for df in (parse_asa(spark.read.schema("source_ip string, hostname string, tag string, raw string, received_at timestamp_ntz").parquet(path)).where("parsed"), render.messages(events)):
        text = df._sc._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(df._jdf.queryExecution().executedPlan())
        sizes = [int(part.split(";")[0]) for part in text.split("maxMethodCodeSize:")[1:]]
        assert sizes and max(sizes) < 8000
