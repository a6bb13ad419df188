"""Caddy JSON access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharrow.functions import json as J
from logharrow.functions.text import strip
from logharrow.functions.time import from_micros, parse_rfc3339
from logharrow.operators.pin import pin

# Field names of an entry and of its request.
ENTRY = ["msg", "ts", "request", "status", "size", "duration", "bytes_read"]
REQUEST = ["client_ip", "remote_ip", "remote_addr", "proto", "method", "host", "uri"]
HEADERS = "headers"
ACCESS = "handled request"


def _client(request) -> Column:
    """Best known client address; the oldest field carries a port to cut off."""
    addr = J.text(request("remote_addr"))
    port = F.substring_index(addr, ":", -1)
    bare = F.left(addr, F.length(addr) - F.length(port) - 1)
    host = F.regexp_replace(bare, r"^\[+|\]+\z", "")
    return F.coalesce(
        F.nullif(J.text(request("client_ip")), F.lit("")),
        F.nullif(J.text(request("remote_ip")), F.lit("")),
        F.when(F.contains(addr, F.lit(":")), host).otherwise(addr),
        F.lit(""),
    )


def _time(ts: Column) -> Column:
    """Epoch seconds, whole or fractional, or RFC 3339 text."""
    seconds = J.number(ts)
    whole = F.floor(seconds)
    micros = whole.cast("bigint") * 1_000_000 + F.floor(
        F.round((seconds - whole) * 1e9) / F.lit(1000.0)
    ).cast("bigint")
    # Beyond these bounds the instant does not fit a timestamp; it is then unknown.
    numeric = F.when(F.abs(seconds) < 9.0e12, from_micros(micros))
    return F.when(J.kind(ts) == "STRING", parse_rfc3339(J.text(ts))).when(J.is_number(ts), numeric)


def _headers_typed(headers: Column) -> Column:
    """True unless a header is anything but a list of strings."""
    # All lists of strings, as nearly always: only null elements are left to rule out.
    only_strings = ~F.rlike(F.schema_of_variant(headers), F.lit(r": (?!ARRAY<STRING>[,>])"))
    values = F.flatten(F.map_values(F.try_variant_get(headers, "$", "map<string,array<string>>")))
    no_nulls = ~F.exists(values, lambda x: x.isNull())
    # Otherwise, as with an empty list, look at every element.
    lists = F.map_values(F.try_variant_get(headers, "$", "map<string,array<variant>>"))
    each = F.forall(
        lists, lambda list_: list_.isNotNull() & F.forall(list_, lambda x: F.schema_of_variant(x) == "STRING")
    )
    return J.absent(headers) | F.coalesce(F.when(only_strings, no_nulls).otherwise(each), F.lit(False))


def parse_caddy(envelope: DataFrame) -> DataFrame:
    def entry(name: str) -> Column:
        return F.col("_f").getField(name)

    def request(name: str) -> Column:
        return F.col("_r").getField(name)

    df = pin(envelope, _line=strip(F.col("raw")))
    df = pin(df, _array=J.wrapped(F.col("_line")))
    df = pin(df, _f=J.only_object(F.col("_line"), F.col("_array"), ENTRY))
    df = pin(df, _r=F.try_variant_get(entry("request"), "$", J.fields_of([*REQUEST, HEADERS])))
    typed = J.all_true(
        [J.is_text(entry("msg")), J.is_number(entry("duration"))]
        + [J.is_integer(entry(name)) for name in ("status", "size", "bytes_read")]
        + [J.is_text(request(name)) for name in REQUEST]
        + [_headers_typed(request(HEADERS))]
    )
    outcome = ~J.absent(entry("status")) | ~J.absent(request("method"))
    access = J.absent(entry("msg")) | (J.text(entry("msg")) == ACCESS)
    usable = F.col("_r").isNotNull() & typed & outcome & access
    return (
        pin(df, parsed=F.coalesce(usable, F.lit(False)))
        .withColumns({
            "remote_host": _client(request),
            "ts": _time(entry("ts")),
            "method": J.text_or_empty(request("method")),
            "path": J.text_or_empty(request("uri")),
            "protocol": J.text_or_empty(request("proto")),
            "host": J.text_or_empty(request("host")),
            "status": J.low_int(J.integer(entry("status"))),
            "bytes": J.integer(entry("size")),
            "bytes_read": J.integer(entry("bytes_read")),
            "duration_ms": J.number(entry("duration")) * F.lit(1000.0),  # from seconds
            "user_agent": F.coalesce(
                F.try_variant_get(request(HEADERS), '$["User-Agent"][0]', "string"), F.lit("")
            ),
            "referer": F.coalesce(
                F.try_variant_get(request(HEADERS), "$.Referer[0]", "string"), F.lit("")
            ),
        })
        .drop("_line", "_array", "_f", "_r")
    )
