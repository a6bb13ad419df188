"""Derived columns used by reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def status_class(status: Column, mode: str = "rounded") -> Column:
    """HTTP status class of a code.

    ``rounded`` is parity with the engine we replace: true division, then rounding
    half to even, so 451 is 5. ``floor`` gives the class its label suggests.
    """
    if mode == "floor":
        return F.floor(status / F.lit(100)).cast("int")
    if mode == "rounded":
        return F.bround(status / F.lit(100)).cast("int")
    raise ValueError(f"unknown status class mode '{mode}'")


def class_label(klass: Column) -> Column:
    return F.concat(klass.cast("string"), F.lit("xx"))


def country_label(country: Column) -> Column:
    return F.coalesce(F.nullif(country, F.lit("")), F.lit("Unknown"))


def country_code(code: Column) -> Column:
    return F.coalesce(code, F.lit(""))


def port_text(port: Column) -> Column:
    return port.cast("string")


def ts_text(ts: Column) -> Column:
    """A stored time as text; independent of the session zone for TIMESTAMP_NTZ."""
    return ts.cast("string")


def ageing_time(ts: Column, received_at: Column) -> Column:
    return F.coalesce(ts, received_at)


def part_pct(part: Column, total: Column) -> Column:
    """``part`` as a percentage of ``total``; 0 when there is nothing."""
    return F.when(total > 0, part * F.lit(100.0) / total).otherwise(F.lit(0.0))


def bar_pct(count: Column, biggest: Column) -> Column:
    """Bar length 0-100: whole percent of the biggest bar."""
    scaled = F.least(F.lit(100), F.greatest(F.lit(0), F.call_function("div", count * 100, F.nullif(biggest, F.lit(0)))))
    return F.when(biggest > 0, scaled).otherwise(F.lit(0)).cast("bigint")


# Display: strings, made last.

# Units in steps of 1024.
UNITS = ("B", "KB", "MB", "GB", "TB")


def human_bytes(n: Column) -> Column:
    text = F.format_string("%d B", n.cast("bigint"))
    for power, unit in enumerate(UNITS[1:], start=1):
        scaled = F.bround(n / F.lit(1024.0**power), 1)
        text = F.when(n >= F.lit(1024**power), F.format_string(f"%.1f {unit}", scaled)).otherwise(text)
    return text


def fmt_ms(ms: Column) -> Column:
    shown = F.concat(F.bround(ms, 0).cast("bigint").cast("string"), F.lit(" ms"))
    return F.coalesce(shown, F.lit("—"))


def fmt_pct(pct: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(pct, 1))
