"""Run a registered query and its SQL, and compare the rows whatever their order."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb

DATA = os.environ.get("LOGTEL_TEST_DATA", "/root/testdata")


def sql_engine(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.6f}"
    if hasattr(value, "quantize"):
        return f"{float(value):.6f}"
    return str(value)


def normal(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark, folder: str, name: str, queries: dict, oracles: dict) -> tuple[str | None, int, float]:
    """(what differs or None, row count, seconds)."""
    began = time.time()
    df = queries[name](spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if name not in oracles:
        return None, len(got[1]), took
    cur = sql_engine(folder).execute(oracles[name])
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), took
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}; first {got[1][:2]} / {want[1][:2]}", len(got[1]), took
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return (f"{len(bad)} rows differ, e.g. {bad[0]} (columns {got[0]})" if bad else None), len(got[1]), took
