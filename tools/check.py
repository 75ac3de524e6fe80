"""Run registered queries next to their SQL: python tools/check.py [sf_dir] [name …]."""

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from corpuslab.catalog import load
from corpuslab.session import get_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN", "float": "FLOAT"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = load()
    names = [n for n in queries if not args or n in args or any(a.endswith("*") and n.startswith(a[:-1]) for a in args)]
    spark = get_session("check", f"local[{os.environ.get('CHECK_CPUS', '8')}]", spark__sql__shuffle__partitions="8",
                        spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        try:
            t0 = time.time()
            df = queries[name](spark, sf)
            got = rows(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - t0
        except Exception as e:
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            if not isinstance(e, Exception) or "-v" in sys.argv:
                traceback.print_exc()
            continue
        if name not in oracles:
            print(f"rows  {name}: {len(got)} rows, {took:.2f}s", flush=True)
            continue
        try:
            t0 = time.time()
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want = rows(cols, cur.fetchall())
            ot = time.time() - t0
        except Exception as e:
            bad += 1
            print(f"SQL   {name}: {str(e)[:1500]}", flush=True)
            continue
        clash = {c: (t, types.get(c)) for c, t in df.dtypes if TYPES.get(t, t) != types.get(c)
                 and not (t.startswith("array") or t.startswith("struct"))}
        if sorted(df.columns) != sorted(cols) or clash:
            bad += 1
            print(f"TYPE  {name}: {df.columns} / {cols} {clash}", flush=True)
        if got != want:
            bad += 1
            extra = [r for r in got if r not in set(want)][:3]
            missing = [r for r in want if r not in set(got)][:3]
            print(f"DIFF  {name}: {len(got)} rows against {len(want)}\n   ours {str(extra)[:700]}\n   sql  {str(missing)[:700]}", flush=True)
        elif not clash:
            print(f"ok    {name}: {len(got)} rows, {took:.2f}s (sql {ot:.2f}s)", flush=True)
    print(f"{len(names)} queries, {bad} problems")


main()
