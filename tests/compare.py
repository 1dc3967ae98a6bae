"""Runs a query on Spark and its SQL on DuckDB, and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from catalog.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        v = float(v)
        return "nan" if math.isnan(v) else v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return repr(v)


def _kind(name: str) -> str:
    """Type family of a Spark or DuckDB type name."""
    families = {
        "integer": ("tinyint", "smallint", "int", "integer", "bigint", "number"), "float": ("float", "double"),
        "text": ("string", "varchar"), "flag": ("boolean", "bool"),
    }
    return next((f for f, names in families.items() if name.lower() in names), name.lower())


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(cells, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else "") for v in r))


def difference(df, con, sql: str) -> str | None:
    """None when both agree to the last digit, else the first difference."""
    have_names, have = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want_names, want = _rows([d[0] for d in found.description], found.fetchall())
    kinds, wanted = {c: _kind(t) for c, t in df.dtypes}, {d[0]: _kind(str(d[1])) for d in found.description}
    if kinds != wanted:
        return f"types {sorted(set(kinds.items()) ^ set(wanted.items()))}"
    if have_names != want_names:
        return f"columns {have_names} != {want_names}"
    if len(have) != len(want):
        return f"{len(have)} rows != {len(want)} rows; {[x for x in have if x not in want][:3]} / {[x for x in want if x not in have][:3]}"
    if not have:
        return "no rows"
    for a, b in zip(have, want):
        if a != b:
            return f"{a} != {b}"
    return None
