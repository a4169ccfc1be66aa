"""Compare a query with its SQL oracle the way the gate does: columns by name, rows as a bag."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, bool):
        return v
    return v


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple(str(x) for x in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise the first difference."""
    cur = con.execute(sql)
    want_cols, want = _bag([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = _bag(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    if not want:
        return "both sides are empty"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} != {w}"
        for a, b in zip(g, w):
            if type(a) is not type(b):
                return f"types {[type(x).__name__ for x in g]} != {[type(x).__name__ for x in w]}"
    return None
