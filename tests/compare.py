"""Compare registered queries with their SQL twins in DuckDB: python -m tests.compare <sf folder> [names...]"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else repr(round(f, 9) + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name, fn, sql):
    """(ok, message)"""
    t0 = time.time()
    df = fn(spark, sf)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, no SQL twin, spark {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, note
    sa, sb = set(a), set(b)
    return False, f"{note}; {len(a)} vs {len(b)} rows\n   only spark: {[x for x in a if x not in sb][:3]}\n   only sql:   {[x for x in b if x not in sa][:3]}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from leafstack.session import local_session
    folder, wanted = sys.argv[1], sys.argv[2:]
    session, con = local_session(8), duck(folder)
    sql = oracle_sql()
    bad = 0
    for key, fn in queries().items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, msg = compare(session, con, folder, key, fn, sql.get(key))
        except Exception as exc:
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + key + ": " + msg, flush=True)
    print("failures:", bad)
