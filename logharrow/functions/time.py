"""Time helpers. Stored times are TIMESTAMP_NTZ in UTC.

Text with an offset is resolved to an instant and rebuilt from its microseconds,
so results do not depend on the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = {
    "1h": timedelta(hours=1),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
    "1y": timedelta(days=365),
}
DEFAULT_RANGE = "24h"

# Seconds per timeline bucket; None is a calendar month.
BUCKET_SECONDS = {"1h": 300, "24h": 3600, "7d": 86400, "30d": 86400, "1y": None}
BUCKET_COUNT = {"1h": 12, "24h": 24, "7d": 7, "30d": 30, "1y": 12}
GRANULARITY = {"1h": "time", "24h": "time", "7d": "day", "30d": "day", "1y": "month"}
RANGE_LABELS = {
    "1h": "last hour",
    "24h": "last 24 hours",
    "7d": "last 7 days",
    "30d": "last 30 days",
    "1y": "last year",
}


def range_key(value: str | None) -> str:
    return value if value in RANGES else DEFAULT_RANGE


def ntz(value: datetime) -> Column:
    """A naive datetime as a TIMESTAMP_NTZ literal."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ntz(datetime(1970, 1, 1)))


def micros_of(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, as BIGINT."""
    return F.timestamp_diff("MICROSECOND", ntz(datetime(1970, 1, 1)), ts)


def micros(moment: datetime) -> int:
    """The same of a naive datetime."""
    return (moment - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def parse_time(text: Column, layout: str) -> Column:
    """Text with an offset to UTC; NULL when it does not fit the layout."""
    return from_micros(F.unix_micros(F.try_to_timestamp(text, F.lit(layout))))


def parse_naive_time(text: Column, layout: str) -> Column:
    """Text without an offset, taken as UTC."""
    return parse_time(F.concat(text, F.lit(" +0000")), layout + " Z")


def parse_rfc3339(text: Column) -> Column:
    """RFC 3339 text to UTC. The offset is mandatory, unlike in a plain cast."""
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
    instant = F.upper(text).try_cast("timestamp")
    return F.when(F.rlike(text, F.lit(shape)), from_micros(F.unix_micros(instant)))


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP_NTZ, as BIGINT."""
    return F.unix_timestamp(ts)


def bucket(ts: Column, range_: str) -> Column:
    """Start of the timeline bucket a time falls in, as epoch seconds."""
    width = BUCKET_SECONDS[range_key(range_)]
    if width is None:
        return F.unix_date(F.trunc(F.to_date(ts), "month")).cast("bigint") * 86400
    seconds = epoch(ts)
    return seconds - F.pmod(seconds, F.lit(width).cast("bigint"))


def spine_bounds(range_: str, as_of: datetime) -> tuple[datetime, datetime]:
    """First and last bucket start of a timeline ending in the bucket of ``as_of``."""
    key = range_key(range_)
    count, width = BUCKET_COUNT[key], BUCKET_SECONDS[key]
    if width is None:
        last = as_of.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        months = last.year * 12 + last.month - 1 - (count - 1)
        return last.replace(year=months // 12, month=months % 12 + 1), last
    seconds = int((as_of - datetime(1970, 1, 1)).total_seconds())
    last = datetime(1970, 1, 1) + timedelta(seconds=seconds - seconds % width)
    return last - timedelta(seconds=width * (count - 1)), last


def spine_end(range_: str, as_of: datetime) -> datetime:
    """First moment after the last bucket."""
    key = range_key(range_)
    _, last = spine_bounds(key, as_of)
    width = BUCKET_SECONDS[key]
    if width is None:
        return (last + timedelta(days=32)).replace(day=1)
    return last + timedelta(seconds=width)


def cutoff(range_: str | None, as_of: datetime) -> datetime:
    """Oldest event time in a range, cut to whole seconds."""
    return (as_of - RANGES[range_key(range_)]).replace(microsecond=0)
