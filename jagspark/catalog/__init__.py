"""The driver's queries over the TPC-H-like tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import arrays, elementwise, external, ladder, plans, ragged

MODULES = [elementwise, ragged, arrays, ladder, external, plans]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
