"""Run registered queries next to their SQL on DuckDB and compare the rows.

    python tests/parity.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    import datetime as dt
    import decimal

    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    """(problem or None, spark seconds, duckdb seconds, rows)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    raw = [tuple(r) for r in df.collect()]
    got_cols, got = rows_of(df.columns, raw)
    t1 = time.time()
    if sql is None:
        return (None if got else "no rows"), t1 - t0, 0.0, len(got)
    rel = con.sql(sql)
    raw_sql = rel.fetchall()
    want_cols, want = rows_of(rel.columns, raw_sql)
    t2 = time.time()
    problem = None
    if got_cols != want_cols:
        problem = f"columns {got_cols} != {want_cols}"
    elif len(got) != len(want):
        problem = f"rows {len(got)} != {len(want)}"
    else:
        bad = [(a, b) for a, b in zip(got, want) if a != b
               or [type(x) for x in a] != [type(x) for x in b]]
        if bad:
            problem = f"{len(bad)} rows differ of {len(got)}; first {bad[0][0]} != {bad[0][1]}"
        elif not got:
            problem = "no rows"
    if problem is None:
        exact = _exact(got_cols, df.columns, raw) == _exact(want_cols, rel.columns, raw_sql)
        problem = None if exact else "equal to nine digits only"
    return problem, t1 - t0, t2 - t1, len(got)


def _exact(order, columns, rows):
    at = [columns.index(c) for c in order]
    return sorted((tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in at)
                   for r in rows))


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from brickyard.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("parity")
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    names = argv[1:] or list(qs)
    failed = 0
    for n in names:
        try:
            problem, s, d, rows = compare(spark, con, sf_dir, n, qs[n], sqls.get(n))
        except Exception as e:  # report and go on with the next query
            problem, s, d, rows = f"{type(e).__name__}: {str(e)[:1200]}", 0, 0, 0
        failed += bool(problem)
        mark = "FAIL" if problem else ("ok  " if n in sqls else "rows")
        print(f"{mark} {n:28s} rows={rows:<8d} spark={s:6.2f}s duckdb={d:6.2f}s"
              + (f"  {problem}" if problem else ""), flush=True)
    print(f"{len(names) - failed} of {len(names)} agree", flush=True)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
