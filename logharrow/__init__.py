"""Log analytics on Spark: parse, route, enrich, store and report on log lines.

Everything takes DataFrames and returns DataFrames. ``as_of`` (the "now" of a
report) is always an explicit argument so that results can be repeated.
"""

from logharrow.filters import Filter
from logharrow.registry import REGISTRY, LogTypeSpec, ReportSpec, register

__all__ = ["Filter", "LogTypeSpec", "REGISTRY", "ReportSpec", "register"]
