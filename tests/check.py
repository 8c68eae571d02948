"""Compare registered queries with their SQL in DuckDB: python -m tests.check [sf_dir] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v)) + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def compare(spark, con, name, fn, sql, sf) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first {got[:2]} / {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} != {w} (columns {sorted(names)})"
    if not got:
        return "no rows on either side"
    return None


def main(sf: str, prefixes: list[str]) -> int:
    from tests.conftest import make_session

    import __spark_entry__ as entry

    spark, con, bad = make_session(), connect(sf), 0
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, name, fn, oracle.get(name), sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        print(f"{mark:4}{'' if name in oracle else '(rows only) '}{name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) else 0)
