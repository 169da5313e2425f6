"""Compares query results with DuckDB, as values in any order."""

from __future__ import annotations

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def _text(v) -> str:
    return "" if v is None else "~" + repr(round(v, 9) if isinstance(v, float) else v)


def comparable(columns: list[str], rows: list) -> list[tuple]:
    """Rows with their columns by name, in a fixed order."""
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(_text(row[k]) for k in at) for row in rows)
