"""HAProxy HTTP log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharrow.functions.text import request_part, strip
from logharrow.functions.time import parse_naive_time
from logharrow.operators.pin import pin

TIME = "d/MMM/yyyy:H:m:s[.SSS]"
# The blank-separated fields between the accept date and the quoted request,
# and the shape of each by the HTTP log format.
FIELDS = {
    "frontend": r"\S+",
    "target": r"[^/]+/\S+",
    "timers": r"-?\d+(?:/-?\d+){4}",
    "status": r"-?\d+",
    "bytes": r"-?\d+",
    "request_cookie": r"\S+",
    "response_cookie": r"\S+",
    "termination": r"\S{4}",
    "connections": r"\d+(?:/\d+){4}",
    "queues": r"\d+/\d+",
}


def _before(text: Column, sign: str) -> Column:
    return F.substring_index(text, sign, 1)


def _behind(text: Column, sign: str) -> Column:
    """What follows the first ``sign``; empty where there is none."""
    return F.substring(text, F.length(_before(text, sign)) + 1 + len(sign), F.length(text))


def parse_haproxy(envelope: DataFrame) -> DataFrame:
    """The line is taken apart at its signs: ``[date]``, blanks, braces and quotes.

    Every field is then checked for itself, so no pattern runs over the whole line.
    """
    line = F.regexp_replace(strip(F.col("raw")), r"^\S+\[\d+\]:\s+", "")  # the program, if named
    df = pin(envelope, _line=line)
    head, tail = strip(_before(F.col("_line"), "[")), _behind(F.col("_line"), "]")
    df = pin(df, _head=head, _date=_before(_behind(F.col("_line"), "["), "]"), _tail=tail)
    # Captured headers stand in braces between the fields and the request.
    plain = _before(_before(F.col("_tail"), '"'), " {")
    rest = F.substring(F.col("_tail"), F.length(plain) + 1, F.length("_tail"))
    df = pin(df, _fields=F.split(strip(plain), r"\s+"), _rest=F.regexp_replace(rest, r"^(?:\s*\{[^}]*\})*+\s*", ""))

    def field(name: str) -> Column:
        return F.get("_fields", F.lit(list(FIELDS).index(name)))

    client = F.substring_index("_head", ":", -1)
    checks = [
        F.size("_fields") == len(FIELDS),
        F.rlike(F.col("_head"), F.lit(r"^\S+:\d+$")),
        F.col("_date") != "",
        F.rlike(F.col("_rest"), F.lit('^"[^"]*"')),
        *[F.rlike(field(name), F.lit(f"^(?:{shape})$")) for name, shape in FIELDS.items()],
    ]
    parsed = F.lit(True)
    for check in checks:
        parsed = parsed & F.coalesce(check, F.lit(False))
    df = pin(df, parsed=parsed)
    ok = lambda value: F.when(F.col("parsed"), value)
    request = _before(_behind(F.col("_rest"), '"'), '"')
    status, size = field("status").try_cast("int"), field("bytes").try_cast("bigint")
    total_ms = F.substring_index(field("timers"), "/", -1).try_cast("bigint")
    return df.withColumns({
        "remote_host": ok(F.substring("_head", F.lit(1), F.length("_head") - F.length(client) - 1)),
        "ts": ok(parse_naive_time(F.col("_date"), TIME)),
        "frontend": ok(field("frontend")),
        "backend": ok(_before(field("target"), "/")),
        "server": ok(_behind(field("target"), "/")),
        # -1 marks a session that never completed.
        "duration_ms": ok(F.when(total_ms >= 0, total_ms.cast("double"))),
        "status": ok(F.when(status > 0, status)),
        "bytes": ok(F.when(size >= 0, size)),
        "termination": ok(field("termination")),
        "method": ok(request_part(request, 0)),
        "path": ok(request_part(request, 1)),
        "protocol": ok(request_part(request, 2)),
    }).drop("_line", "_head", "_date", "_tail", "_fields", "_rest")
