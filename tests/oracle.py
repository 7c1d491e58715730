"""Run a registered query and its SQL twin side by side and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "item"):
        return _cell(v.item())
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float)) else (False, "n", x) for x in r))


def compare(df, sql: str, con) -> tuple[int, str | None]:
    """(row count, None if equal else a short description of the first difference)."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want_cols, want = rows(names, cur.fetchall())
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return len(got), f"columns {got_cols} vs {want_cols}"
    if len(want) != len(got):
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return len(got), f"rows {len(got)} vs {len(want)}; only here {extra}; only there {lack}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return len(got), f"{got_cols}: {a} vs {b}"
    return len(got), None
