"""Compare registered queries with their SQL: ``check_oracles.py <sf_dir> [key prefix ...]``."""
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from lineweave.session import local_session  # noqa: E402


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (int, decimal.Decimal)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
        return f"{float(v):.6f}"
    return str(v)


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(norm(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


def compare(spark, con, sf, key, fn, sql):
    t0 = time.time()
    s = fn(spark, sf).toPandas()
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(s)} rows", t1 - t0, 0
    d = con.sql(sql).df()
    t2 = time.time()
    if sorted(s.columns) != sorted(d.columns):
        return f"FAIL columns {sorted(s.columns)} != {sorted(d.columns)}", t1 - t0, t2 - t1
    a, b = rows_of(s), rows_of(d)
    if a == b:
        return f"ok {len(a)} rows", t1 - t0, t2 - t1
    sa, sb = set(a), set(b)
    return (f"FAIL rows {len(a)} vs {len(b)}; {len(sa - sb)}+{len(sb - sa)} spark-only {str(sorted(sa - sb)[:2])[:300]} sql-only {str(sorted(sb - sa)[:2])[:300]}",
            t1 - t0, t2 - t1)


if __name__ == "__main__":
    sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    bad = 0
    oracles = entry.oracle_sql()
    for key, fn in entry.queries().items():
        if prefixes and not key.startswith(prefixes):
            continue
        try:
            res, ts, td = compare(spark, con, sf, key, fn, oracles.get(key))
        except Exception as e:  # report and go on with the next query
            lines = [x for x in str(e).splitlines() if x.strip()]
            res, ts, td = "ERROR " + " ".join(lines[:4])[:600], 0, 0
        bad += res.startswith(("FAIL", "ERROR"))
        print(f"{key:34s} {ts:6.2f}s {td:6.2f}s {res}", flush=True)
    print("bad:", bad)
