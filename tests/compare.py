"""Run registered queries and compare each with its checking SQL.

usage: python tests/compare.py [name-part ...]   (SF_DIR selects the data)
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        if hasattr(value, "asDict"):
            return canonical(value.asDict())
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), canonical(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return canonical(value.asDict())
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    start = time.time()
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = f"[run {time.time() - start:.1f}s] "
    if sql is None:
        return "rows-only", len(got[1]), spent
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return "match", len(got[1]), spent
    detail = f"columns {got[0]} vs {want[0]}; rows {len(got[1])} vs {len(want[1])}"
    if got[0] == want[0]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        detail += f"\n   spark only: {sorted(a - b)[:2]}\n   sql only:   {sorted(b - a)[:2]}"
    return "MISMATCH", len(got[1]), detail[:1800]


def main():
    import __spark_entry__ as entry
    from vitagrain.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if len(sys.argv) > 1 and not any(p in name for p in sys.argv[1:]):
            continue
        start = time.time()
        try:
            status, n, detail = compare(spark, con, folder, fn, oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            status, n, detail = "ERROR", 0, str(exc)[:1500]
        bad += status in ("MISMATCH", "ERROR")
        print(f"{status:9} {name:50} rows={n} {time.time() - start:.1f}s {detail}", flush=True)
    print("bad:", bad, "of", len(queries), "oracles", len(oracles))


if __name__ == "__main__":
    main()
