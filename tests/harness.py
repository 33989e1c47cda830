"""Runs a query and its DuckDB counterpart over the same folder and compares rows, columns in the order of their names."""

from __future__ import annotations

from collections import Counter
from pathlib import Path


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def difference(df, con, sql: str) -> str:
    """Empty if both give the same rows."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    if ours == theirs:
        return ""
    return f"rows {ours.total()} and {theirs.total()}; only ours {list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}"
