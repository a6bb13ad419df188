"""The log types: how each is parsed, stored and reported on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logharrow import schemas
from logharrow.operators import parsers

CATEGORIES = {"web": "Web", "firewall": "Firewall", "third-party": "Third-Party"}

# Columns of a drill-down, by report family; a key is the name users filter by.
DIMENSIONS = {
    "web": {"ip": "remote_host", "path": "path", "country": "country"},
    "proxy": {"ip": "remote_host", "path": "path", "country": "country"},
    "firewall": {
        "src": "src_ip", "dst": "dst_ip", "port": "dst_port", "action": "action",
        "protocol": "protocol", "country": "country", "rule": "rule",
    },
}

# The columns a search looks in.
WEB_SEARCH = ("remote_host", "path", "user_agent", "referer", "method", "country")
FIREWALL_SEARCH = (
    "src_ip", "dst_ip", "rule", "application", "protocol", "src_zone", "dst_zone",
    "country", "dst_port",
)


@dataclass(frozen=True)
class ReportSpec:
    """What a report on one log type shows and can be filtered by."""

    family: str
    search: tuple[str, ...]
    extra: tuple[str, ...] = ()

    @property
    def dimensions(self) -> dict[str, str]:
        return {**DIMENSIONS[self.family], **{name: name for name in self.extra}}


@dataclass(frozen=True)
class LogTypeSpec:
    """One log type. ``parse`` takes envelope rows and adds the typed columns."""

    name: str
    category: str
    label: str
    schema: T.StructType = field(repr=False)
    parse: Callable[[DataFrame], DataFrame] = field(repr=False)
    geo_column: str
    report: ReportSpec


REGISTRY: dict[str, LogTypeSpec] = {}


def register(spec: LogTypeSpec) -> LogTypeSpec:
    if spec.category not in CATEGORIES:
        raise ValueError(f"unknown category '{spec.category}'")
    REGISTRY[spec.name] = spec
    return spec


def get(name: str) -> LogTypeSpec:
    try:
        return REGISTRY[name]
    except KeyError:
        raise ValueError(f"unknown log type '{name}'") from None


def names() -> list[str]:
    return sorted(REGISTRY)


def by_category() -> dict[str, list[LogTypeSpec]]:
    """Categories that have types, each with its types sorted by label."""
    grouped = {
        category: sorted((s for s in REGISTRY.values() if s.category == category), key=lambda s: s.label)
        for category in CATEGORIES
    }
    return {category: specs for category, specs in grouped.items() if specs}


def _web(name: str, label: str) -> None:
    register(LogTypeSpec(
        name, "web", label, schemas.CLF, parsers.parse_clf, "remote_host",
        ReportSpec("web", WEB_SEARCH),
    ))


def _proxy(name, label, schema, parse, search, extra=()) -> None:
    register(LogTypeSpec(
        name, "web", label, schema, parse, "remote_host", ReportSpec("proxy", search, extra),
    ))


def _firewall(name, label, parse, extra) -> None:
    register(LogTypeSpec(
        name, "firewall", label, schemas.FIREWALL, parse, "src_ip",
        ReportSpec("firewall", FIREWALL_SEARCH, extra),
    ))


_web("apache", "Apache")
_web("nginx", "nginx")
_proxy(
    "traefik", "Traefik", schemas.TRAEFIK, parsers.parse_traefik,
    ("remote_host", "path", "user_agent", "host", "country", "router", "service"),
    ("router", "service"),
)
_proxy(
    "caddy", "Caddy", schemas.CADDY, parsers.parse_caddy,
    ("remote_host", "path", "user_agent", "referer", "host", "country"),
)
_proxy(
    "haproxy", "HAProxy", schemas.HAPROXY, parsers.parse_haproxy,
    ("remote_host", "path", "country", "frontend", "backend", "server"),
    ("backend", "server"),
)
_firewall("cisco_asa", "Cisco ASA", parsers.parse_asa, ("rule",))
_firewall("panos", "Palo Alto", parsers.parse_panos, ("application", "rule"))
