"""Runs a registered query and its SQL side by side.

    python -m tests.oracle <folder> [name ...]
"""

import math
import os
import signal
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return f"{type(v).__name__}:{v}" if isinstance(v, int) else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    t0 = time.time()
    a_cols, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    compare.spark_s = time.time() - t0
    cur = con.execute(sql)
    b_cols, b = rows_of([c[0] for c in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} / {b_cols}", len(a)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}", len(a)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return (f"{len(diff)} rows differ, first {diff[0]}" if diff else None), len(a)


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from wireloom.plans.catalog import ORACLE, QUERIES
    from wireloom.session import local_session
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    limit = int(os.environ.get("QUERY_SECONDS", "60"))

    def late(*_):
        raise TimeoutError(f"over {limit} s")

    signal.signal(signal.SIGALRM, late)
    for name in names or list(QUERIES):
        t0 = time.time()
        signal.alarm(limit)
        try:
            if name in ORACLE:
                t1 = time.time()
                msg, n = compare(spark, con, sf_dir, QUERIES[name], ORACLE[name])
            else:
                n, msg = QUERIES[name](spark, sf_dir).count(), None
        except Exception as e:  # report and go on
            msg, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok'} {name} rows={n} {time.time() - t0:.1f}s {'' if name in ORACLE else '(no sql)'} {msg or ''}",
              flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
