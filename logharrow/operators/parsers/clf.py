"""Common and Combined Log Format (Apache, nginx)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharrow.functions.text import group, match_groups, matched, request_part, strip
from logharrow.functions.time import parse_time
from logharrow.operators.pin import pin

# Fixed value: the accepted line shape. Anchored at the start only; text after the
# last field is ignored. The referer and agent pair is optional.
LINE = (
    r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}|-) (\d+|-)(?: "([^"]*)" "([^"]*)")?'
)
TIME = "d/MMM/yyyy:H:m:s Z"


def parse_clf(envelope: DataFrame) -> DataFrame:
    m = F.col("_m")
    return (
        pin(pin(envelope, _line=strip(F.col("raw"))), _m=match_groups(F.col("_line"), LINE, 9))
        .withColumns({
            "parsed": matched(m),
            "remote_host": group(m, 1),
            "ident": group(m, 2),
            "auth_user": group(m, 3),
            "ts": parse_time(group(m, 4), TIME),
            "method": request_part(group(m, 5), 0),
            "path": request_part(group(m, 5), 1),
            "protocol": request_part(group(m, 5), 2),
            "status": group(m, 6).try_cast("int"),
            "bytes": group(m, 7).try_cast("bigint"),
            "referer": group(m, 8),
            "user_agent": group(m, 9),
        })
        .drop("_line", "_m")
    )
