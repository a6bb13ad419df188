"""Log lines rendered from derived rows, to be parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharrow.operators.pin import pin
from workload import derive

BROKEN = "garbage"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Firewall columns beside request columns in one frame.
_FIREWALL = {f"fw_{name}": e for name, e in derive.FIREWALL.items() if name not in derive.ENVELOPE}
EVERYTHING = {
    **derive.CLF, **derive.PROXY, **_FIREWALL, "event_ts": "ts", "user_id": "user_id", "value": "value",
}


def _part(c: Column, start: int, length: int) -> Column:
    return F.substring(c.cast("string"), start, length)


def _clock(ts: Column) -> Column:
    return _part(ts, 12, 8)


def _month(ts: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), _part(ts, 6, 2).cast("int") - 1)


def _web_date(ts: Column) -> Column:
    return F.concat(_part(ts, 9, 2), F.lit("/"), _month(ts), F.lit("/"), _part(ts, 1, 4), F.lit(":"), _clock(ts))


def _millis(ts: Column) -> Column:
    return F.substring(F.rpad(_part(ts, 21, 6), 6, "0"), 1, 3)


def _or_dash(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def clf_line() -> Column:
    """Combined format; half the lines carry a local time two hours ahead."""
    ts = F.col("event_ts")
    ahead = F.col("event_id") % 2 == 0
    local = F.when(ahead, ts + F.expr("INTERVAL 2 HOUR")).otherwise(ts)
    return F.concat(
        F.col("remote_host"), F.lit(" - "), F.col("auth_user"), F.lit(" ["), _web_date(local),
        F.when(ahead, " +0200").otherwise(" +0000"), F.lit('] "'),
        F.concat_ws(" ", "method", "path", "protocol"), F.lit('" '),
        _or_dash(F.col("status")), F.lit(" "), _or_dash(F.col("bytes")),
        F.lit(' "'), F.col("referer"), F.lit('" "'), F.col("user_agent"), F.lit('"'),
    )


def traefik_line() -> Column:
    return F.to_json(F.struct(
        F.col("remote_host").alias("ClientHost"),
        F.col("method").alias("RequestMethod"),
        F.col("path").alias("RequestPath"),
        F.col("protocol").alias("RequestProtocol"),
        F.col("host").alias("RequestHost"),
        F.col("status").alias("DownstreamStatus"),
        F.col("bytes").alias("DownstreamContentSize"),
        F.col("router").alias("RouterName"),
        F.col("service").alias("ServiceName"),
        F.round(F.col("value") * 1_000_000).cast("bigint").alias("Duration"),
        F.concat(F.replace(F.col("event_ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z")).alias("StartUTC"),
        F.col("user_agent").alias("request_User-Agent"),
    ))


def caddy_line() -> Column:
    ts = F.col("event_ts")
    rfc3339 = F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00"))
    return F.to_json(F.struct(
        F.lit("info").alias("level"),
        rfc3339.alias("ts"),
        F.lit("handled request").alias("msg"),
        F.struct(
            F.concat(F.col("remote_host"), F.lit(":4711")).alias("remote_addr"),
            F.col("protocol").alias("proto"),
            "method",
            "host",
            F.col("path").alias("uri"),
            F.struct(
                F.array("user_agent").alias("User-Agent"),
                F.array("referer", F.lit("second")).alias("Referer"),
            ).alias("headers"),
        ).alias("request"),
        "bytes_read",
        F.col("value").alias("duration"),
        F.col("bytes").alias("size"),
        "status",
    ))


def haproxy_line() -> Column:
    ts = F.col("event_ts")
    request = F.concat_ws(" ", "method", "path", "protocol")
    total = F.when(F.col("event_id") % 13 == 0, -1).otherwise(F.floor("value")).cast("string")
    return F.concat(
        F.lit("haproxy["), F.col("user_id").cast("string"), F.lit("]: "), F.col("remote_host"),
        F.lit(":5001 ["), _web_date(ts), F.lit("."), _millis(ts), F.lit("] "), F.col("frontend"), F.lit(" "),
        F.col("backend"), F.lit("/"), F.col("server"), F.lit(" 0/0/1/2/"), total, F.lit(" "),
        F.coalesce(F.col("status"), F.lit(-1)).cast("string"), F.lit(" "),
        F.coalesce(F.col("bytes"), F.lit(-1)).cast("string"), F.lit(" - - "), F.col("termination"),
        F.lit(' 1/1/0/0/0 0/0 {h|a} "'), request, F.lit('"'),
    )


def asa_line() -> Column:
    """Denied and permitted flows in three sentence shapes, some with a time."""
    ts = F.col("event_ts")
    port = F.coalesce(F.col("fw_dst_port").cast("string"), F.lit("0"))
    deny = F.concat(
        F.lit("106023: Deny "), F.upper("fw_protocol"), F.lit(" src "), F.col("fw_src_zone"), F.lit(":"),
        F.col("fw_src_ip"), F.lit("/"), F.col("fw_src_port").cast("string"), F.lit(" dst "), F.col("fw_dst_zone"),
        F.lit(":"), F.col("fw_dst_ip"), F.lit("/"), port, F.lit(' by access-group "acl-'),
        F.col("fw_rule"), F.lit('" [0x0, 0x0]'),
    )
    permit = F.concat(
        F.lit("106100: access-list acl-"), F.col("fw_rule"), F.lit(" permitted "), F.col("fw_protocol"), F.lit(" "),
        F.col("fw_src_zone"), F.lit("/"), F.col("fw_src_ip"), F.lit("("), F.col("fw_src_port").cast("string"),
        F.lit(") -> "), F.col("fw_dst_zone"), F.lit("/"), F.col("fw_dst_ip"), F.lit("("), port, F.lit(") hit-cnt 1"),
    )
    torn = F.concat(
        F.lit("302014: Teardown "), F.upper("fw_protocol"), F.lit(" connection 77 for "), F.col("fw_src_zone"),
        F.lit(":"), F.col("fw_src_ip"), F.lit("/"), F.col("fw_src_port").cast("string"), F.lit(" to "),
        F.col("fw_dst_zone"), F.lit(":"), F.col("fw_dst_ip"), F.lit("/"), port, F.lit(" duration 0:00:30"),
        F.coalesce(F.concat(F.lit(" bytes "), F.col("bytes").cast("string")), F.lit("")),
    )
    sentence = (
        F.when(F.col("fw_action") == "deny", deny)
        .when(F.col("fw_event_type") == "view", torn)
        .otherwise(permit)
    )
    day = F.lpad(F.ltrim(_part(ts, 9, 2), F.lit("0")), 2, " ")
    own_time = F.concat(_month(ts), F.lit(" "), day, F.lit(" "), _part(ts, 1, 4), F.lit(" "), _clock(ts), F.lit(": "))
    return F.concat(
        F.when(F.col("event_id") % 2 == 0, own_time).otherwise(F.lit("")), F.lit("%ASA-4-"), sentence
    )


def panos_line() -> Column:
    ts = F.col("event_ts")
    when = F.concat(F.replace(_part(ts, 1, 10), F.lit("-"), F.lit("/")), F.lit(" "), _clock(ts))
    fields = [F.lit("x")] * 45
    for at, value in {
        0: F.lit("1"), 1: when, 3: F.lit("TRAFFIC"), 4: F.col("fw_event_type"), 6: when,
        7: F.col("fw_src_ip"), 8: F.col("fw_dst_ip"),
        11: F.concat(F.lit('"zone, ""a"", '), F.col("fw_rule"), F.lit('"')),
        14: F.coalesce(F.col("fw_application"), F.lit("")), 16: F.col("fw_src_zone"), 17: F.col("fw_dst_zone"),
        24: F.col("fw_src_port").cast("string"), 25: F.coalesce(F.col("fw_dst_port").cast("string"), F.lit("")),
        29: F.upper("fw_protocol"),
        30: F.when(F.col("fw_action") == "allow", "allow").otherwise("reset-both"),
        31: F.coalesce(F.col("bytes").cast("string"), F.lit("")),
    }.items():
        fields[at] = value
    return F.concat_ws(",", *fields)


LINES = {
    "apache": clf_line, "nginx": clf_line, "traefik": traefik_line, "caddy": caddy_line,
    "haproxy": haproxy_line, "cisco_asa": asa_line, "panos": panos_line,
}


def all_columns(events: DataFrame) -> DataFrame:
    return derive.derive(events, EVERYTHING)


def envelope_of(events: DataFrame, log_type: str) -> DataFrame:
    """Envelope rows of one type; a row with a value below 1 has a broken line."""
    df = all_columns(events)
    return df.select(
        "event_id", "source_ip", F.lit(None).cast("string").alias("hostname"),
        F.lit(None).cast("string").alias("tag"),
        F.when(F.col("value") < 1, BROKEN).otherwise(LINES[log_type]()).alias("raw"), "received_at",
    )


def _header() -> Column:
    """Header forms in turn: RFC 3164, RFC 5424, none."""
    ts = F.col("event_ts")
    host = F.concat(F.lit("host-"), (F.col("user_id") % 5).cast("string"))
    old = F.concat(F.lit("<134>"), _month(ts), F.lit(" "), _part(ts, 9, 2), F.lit(" "), _clock(ts), F.lit(" "), host, F.lit(" "))
    new = F.concat(
        F.lit("<165>1 "), F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z "), host,
        F.lit(' app 77 ID47 [x@1 k="a]\\"b" l="c"][y@2] '),
    )
    return F.when(F.col("user_id") % 3 == 0, old).when(F.col("user_id") % 3 == 1, new).otherwise(F.lit(""))


def plain_messages(events: DataFrame) -> DataFrame:
    """Messages with a simple body and, under RFC 3164, a program name."""
    df = all_columns(events)
    program = F.when(F.col("user_id") % 3 == 0, "prog[42]: ").otherwise("")
    return df.select(
        "event_id", F.col("source_ip").alias("peer_ip"),
        F.concat(_header(), program, F.lit("body of "), F.col("path"), F.lit(": done")).alias("payload"),
        "received_at",
    )


def messages(events: DataFrame) -> DataFrame:
    """Messages in the format their sender is configured for (SOURCES, by key)."""
    df = all_columns(events)
    # Each format in a step of its own: all in one would be a method too long for the JVM to compile.
    for i, name in enumerate(sorted(LINES)):
        df = pin(df, **{f"_{name}": F.when(F.col("user_id") % 7 == i, LINES[name]())})
    body = F.coalesce(*[f"_{name}" for name in LINES])
    broken = F.when(F.col("value") < 1, BROKEN).otherwise(body)
    return df.select(
        F.col("source_ip").alias("peer_ip"), F.concat(_header(), broken).alias("payload"), "received_at"
    )
