"""The filter every report shares: a time range, drill-downs and a search."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharrow.functions.columns import country_label, status_class
from logharrow.functions.time import RANGES, cutoff, ntz, range_key
from logharrow.registry import ReportSpec

ACTIONS = ("allow", "deny")
PAGE = 200


@dataclass(frozen=True)
class Filter:
    """An immutable filter. ``None`` means "not filtered by this"."""

    range: str | None = None
    ip: str | None = None
    path: str | None = None
    status: int | None = None
    country: str | None = None
    router: str | None = None
    service: str | None = None
    backend: str | None = None
    server: str | None = None
    src: str | None = None
    dst: str | None = None
    port: int | None = None
    action: str | None = None
    protocol: str | None = None
    rule: str | None = None
    application: str | None = None
    q: str | None = None
    limit: int | None = None

    def normalised(self) -> Filter:
        """Trim text, drop empty values, unknown ranges and unknown actions."""

        def clean(value):
            return (value.strip() or None) if isinstance(value, str) else value

        cleaned = replace(self, **{name: clean(value) for name, value in vars(self).items()})
        return replace(
            cleaned,
            range=cleaned.range if cleaned.range in RANGES else None,
            action=cleaned.action if cleaned.action in ACTIONS else None,
        )

    @classmethod
    def from_params(cls, params: dict[str, str]) -> Filter:
        """A filter from text parameters; numbers that are none, and unknown names, are dropped."""
        known = {name: text for name, text in params.items() if name in cls.__dataclass_fields__}
        for name in ("status", "port", "limit"):
            if name in known:
                text = known[name].strip()
                known[name] = int(text) if text.isascii() and text.isdigit() and len(text) < 10 else None
        return cls(**known).normalised()

    def with_(self, **changes) -> Filter:
        return replace(self, **changes)

    def without(self, *names: str) -> Filter:
        return replace(self, **dict.fromkeys(names))

    @property
    def range_key(self) -> str:
        return range_key(self.range)

    @property
    def page_size(self) -> int:
        """Lines of a page: what was asked for, or the usual number."""
        return PAGE if self.limit is None else max(self.limit, 1)

    def conditions(
        self,
        spec: ReportSpec,
        as_of: datetime,
        partitioned: bool = False,
        status_mode: str = "rounded",
    ) -> list[Column]:
        """The conditions, all of which a row must meet."""
        found = [
            self._dimension(spec, key, column)
            for key, column in spec.dimensions.items()
            if getattr(self, key) is not None
        ]
        if self.status is not None and spec.family != "firewall":
            found.append(status_class(F.col("status"), status_mode) == F.lit(self.status))
        if self.q is not None:
            found.append(self._search(spec))
        oldest = cutoff(self.range_key, as_of)
        found.append(F.col("ts") >= ntz(oldest))
        if partitioned:
            # Not derivable from ts by the optimizer; safe because ts is not NULL
            # here and then event_date is its day.
            found.append(F.col("event_date") >= F.lit(oldest.date()))
        return found

    def _dimension(self, spec: ReportSpec, key: str, column: str) -> Column:
        value = F.lit(getattr(self, key))
        return (country_label(F.col(column)) if key == "country" else F.col(column)) == value

    def _search(self, spec: ReportSpec) -> Column:
        """Any search column contains the text, ignoring case; % and _ stay wildcards."""
        pattern = "%" + self.q.replace("\\", "\\\\") + "%"
        return reduce(or_, (F.col(c).cast("string").ilike(pattern) for c in spec.search))

    def apply(self, df: DataFrame, spec: ReportSpec, as_of: datetime, status_mode: str = "rounded") -> DataFrame:
        """Rows of ``df`` under this filter."""
        partitioned = "event_date" in df.columns
        tests = self.normalised().conditions(spec, as_of, partitioned, status_mode)
        return df.where(reduce(and_, tests))
