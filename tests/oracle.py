"""Compares a registered query with its SQL: column names, row count, values in any order."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([[plain(r[i]) for i in order] for r in rows], key=repr)


def close(a, b, tolerance):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark, con, fn, sql, sf_dir, tolerance=0.0):
    """(ok, message, seconds)"""
    start = time.time()
    df = fn(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got[1])}", took
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", took
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}: {got[1][:3]} / {want[1][:3]}", took
    bad = [(g, w) for g, w in zip(got[1], want[1]) if not all(close(a, b, tolerance) for a, b in zip(g, w))]
    if bad:
        return False, f"{len(bad)} of {len(got[1])} rows differ, first: {bad[0]}", took
    return True, f"rows {len(got[1])}", took


def main():
    import sys
    sys.path.insert(0, ".")
    from sightline.session import build_session
    from sightline_queries import ORACLE, QUERIES
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)] \
        if sys.argv[2:] else names
    spark, con = build_session("local[8]"), connect(sf_dir)
    failures = 0
    for name in names:
        try:
            ok, message, took = compare(spark, con, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report every query
            ok, message, took = False, f"{type(error).__name__}: {str(error)[:300]}", 0.0
        failures += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s {message[:420]}", flush=True)
    print("failures", failures, "of", len(names))


if __name__ == "__main__":
    main()
