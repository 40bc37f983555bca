"""Run queries on Spark and their SQL on DuckDB, and compare the results."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _kind(v) -> str:
    return "num" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def _table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple(str(x) for x in r))


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def oracle_result(con, text):
    rel = con.sql(text)
    return rel.columns, rel.fetchall()


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str:
    """Empty if equal."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"
    _, a = _table(spark_cols, spark_rows)
    names, b = _table(duck_cols, duck_rows)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, {names}, first {bad[0]}"
    for i, n in enumerate(names):
        kinds = [{_kind(r[i]) for r in t if r[i] is not None} for t in (a, b)]
        if kinds[0] != kinds[1]:
            return f"types of {n}: {kinds}"
    return ""


def run(spark, sf: str, names=None, out=sys.stdout) -> dict[str, str]:
    from marketloom.catalog import ORACLES, QUERIES

    con = connect(sf)
    failed = {}
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            rows = df.collect()
            took = time.time() - start
            if name in ORACLES:
                cols, expected = oracle_result(con, ORACLES[name])
                why = compare(rows, df.columns, expected, cols)
            else:
                why = "" if rows else "no rows"
        except Exception as e:  # noqa: BLE001
            took, why = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}"
        if why:
            failed[name] = why
        mark = "FAIL" if why else ("ok  " if name in ORACLES else "rows")
        print(f"{mark} {name} {took:.1f}s {len(rows) if not why else ''} {why}", file=out, flush=True)
    return failed


def main() -> None:
    from marketloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    picks = sys.argv[2:]
    from marketloom.catalog import QUERIES

    names = [n for n in QUERIES if not picks or any(n.startswith(p) for p in picks)]
    failed = run(local_session(8), str(Path(sf)), names)
    print(f"{len(names)} run, {len(failed)} failed")


if __name__ == "__main__":
    main()
