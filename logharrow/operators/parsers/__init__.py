"""Bulk parse jobs: envelope rows in, typed rows plus a ``parsed`` flag out.

Every parser is a set of column expressions; none uses a Python function per row.
"""

from logharrow.operators.parsers.asa import parse_asa
from logharrow.operators.parsers.caddy import parse_caddy
from logharrow.operators.parsers.clf import parse_clf
from logharrow.operators.parsers.haproxy import parse_haproxy
from logharrow.operators.parsers.panos import parse_panos
from logharrow.operators.parsers.traefik import parse_traefik

__all__ = [
    "parse_asa", "parse_caddy", "parse_clf", "parse_haproxy", "parse_panos", "parse_traefik",
]
