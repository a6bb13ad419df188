"""Run a query and its SQL side by side and report differences."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str, show: int = 3) -> list[str]:
    """Empty when both sides have the same columns and the same rows."""
    names = sorted(df.columns)
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    if sorted(theirs_names) != names:
        return [f"columns {names} but expected {sorted(theirs_names)}"]
    ours = Counter(tuple(row) for row in df.select(*names).collect())
    at = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(row[i] for i in at) for row in cursor.fetchall())
    found = []
    for label, extra in (("only ours", ours - theirs), ("only theirs", theirs - ours)):
        for row, n in list(extra.items())[:show]:
            found.append(f"{label} x{n}: {dict(zip(names, row))}")
    if found:
        found.insert(0, f"rows {sum(ours.values())} but expected {sum(theirs.values())}")
    kinds = dict(df.dtypes)
    for name, kind in con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall():
        pair = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}.get(kinds[name])
        if pair != kind:
            found.append(f"column {name} is {kinds[name]} but expected {kind}")
    return found
