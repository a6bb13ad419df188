"""Traefik JSON access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharrow.functions import json as J
from logharrow.functions.text import strip
from logharrow.functions.time import parse_rfc3339
from logharrow.operators.pin import pin

# Field names of the format, by column.
TEXT_FIELDS = {
    "remote_host": "ClientHost",
    "method": "RequestMethod",
    "path": "RequestPath",
    "protocol": "RequestProtocol",
    "host": "RequestHost",
    "router": "RouterName",
    "service": "ServiceName",
    "user_agent": "request_User-Agent",
}
STATUS, SIZE, DURATION = "DownstreamStatus", "DownstreamContentSize", "Duration"
START = "StartUTC"


def parse_traefik(envelope: DataFrame) -> DataFrame:
    def field(name: str) -> Column:
        return F.col("_f").getField(name)

    texts, integers = [*TEXT_FIELDS.values(), START], [STATUS, SIZE, DURATION]
    df = pin(envelope, _line=strip(F.col("raw")))
    df = pin(df, _array=J.wrapped(F.col("_line")))
    df = pin(df, _f=J.only_object(F.col("_line"), F.col("_array"), texts + integers))
    typed = J.all_true([J.is_text(field(n)) for n in texts] + [J.is_integer(field(n)) for n in integers])
    something = [~J.absent(field(n)) for n in (TEXT_FIELDS["method"], TEXT_FIELDS["path"], STATUS)]
    usable = F.col("_f").isNotNull() & typed & (something[0] | something[1] | something[2])
    return (
        pin(df, parsed=F.coalesce(usable, F.lit(False)))
        .withColumns({
            **{name: J.text_or_empty(field(source)) for name, source in TEXT_FIELDS.items()},
            "ts": parse_rfc3339(J.text(field(START))),
            "status": J.low_int(J.integer(field(STATUS))),
            "bytes": J.integer(field(SIZE)),
            "duration_ms": J.integer(field(DURATION)) / F.lit(1_000_000.0),  # from nanoseconds
        })
        .drop("_line", "_array", "_f")
    )
