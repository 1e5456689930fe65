"""Runs registered queries next to their checking SQL and compares values.

python tests/oracle_check.py [folder] [name-prefix ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def frame(pdf):
    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple(None if v is None or v != v else v for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(map(repr, rows)), {c: str(t) for c, t in pdf.dtypes.items()}


def compare(spark, con, name, fn, sql, folder):
    t0 = time.time()
    got = fn(spark, folder).toPandas()
    took = time.time() - t0
    if sql is None:
        return True, f"rows-only {len(got)}", took
    want = con.execute(sql).fetchdf()
    a, ta = frame(got)
    b, tb = frame(want)
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}", took
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"rows {len(a)} vs {len(b)}; types {ta} {tb}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}", took
    kinds = {c: (ta[c], tb[c]) for c in ta if ta[c] != tb[c] and "object" not in (ta[c], tb[c]) and "datetime" not in ta[c]}
    return True, f"{len(a)} rows" + (f" types differ {kinds}" if kinds else "") + ("  EMPTY" if not a else ""), took


def connect(folder):
    import duckdb

    from pageaudit.registry.views import BASE

    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pageaudit.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, note, took = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as e:  # report and go on
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.1f}s {note}", flush=True)
    print("failures", bad)
