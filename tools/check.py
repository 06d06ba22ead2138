"""Run registered queries and their SQL twins side by side: python tools/check.py [folder] [name ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from twinframe.catalog import load
from twinframe.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value).lower()
    return repr(value)


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    rows = df.collect()
    if sql is None:
        return f"rows {len(rows)}"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    a = sorted(tuple(canon(x[c]) for c in order) for x in rows)
    b = sorted(tuple(canon(x[names.index(c)]) for c in order) for x in theirs)
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}: {a[:2]} {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"ok {len(a)}" if not bad else f"VALUES {len(bad)} of {len(a)}: {bad[:2]}"


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    queries, sql = load()
    wanted = argv[1:] or list(queries)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            out = compare(spark, con, folder, name, queries[name], sql.get(name))
        except Exception as exc:
            out = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        failed += out.split()[0].isupper()
        print(f"{name:34s} {time.time() - start:6.1f}s  {out}", flush=True)
    print("failed", failed, "of", len(wanted))


if __name__ == "__main__":
    main(sys.argv[1:])
