"""Run registered queries on a data folder and compare them with their SQL.

    python tools/compare.py [--dir DIR] [--like PREFIX ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (1, "")
    if isinstance(v, float):
        return (0, "nan") if math.isnan(v) else (0, repr(v))
    return (0, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, entry, folder):
    start = time.time()
    df = entry.run(spark, folder)
    got = df.collect()
    spent = time.time() - start
    sql = entry.statement()
    if sql is None:
        return "rows", len(got), spent, ""
    start = time.time()
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = res.fetchall()
    sql_time = time.time() - start
    a, b = rows_of(df.columns, got), rows_of(names, want)
    note = f"duckdb {sql_time:.1f}s"
    if sorted(df.columns) != sorted(names):
        return "COLUMNS", len(got), spent, f"{df.columns} {names}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        sample = "\n      ".join(f"{x}\n      {y}" for x, y in diff[:2])
        return "DIFF", len(got), spent, f"{len(got)} vs {len(want)}, {len(diff)} rows differ\n      {sample}"
    return "ok", len(got), spent, note


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--dir", default="/root/testdata/sf0.01")
    p.add_argument("--like", nargs="*", default=[""])
    p.add_argument("--cpus", default=8, type=int)
    args = p.parse_args()
    from freshet.catalog import ENTRIES
    from freshet.session import local_session

    spark = local_session(args.cpus)
    con = connect(args.dir)
    bad = 0
    for name, entry in ENTRIES.items():
        if not any(name.startswith(x) for x in args.like):
            continue
        try:
            status, n, spent, note = compare(spark, con, entry, args.dir)
        except Exception as e:  # report and go on with the next query
            status, n, spent, note = "ERROR", 0, 0.0, str(e)[:1500]
        bad += status not in ("ok", "rows")
        flag = "" if n else "  EMPTY"
        print(f"{status:8}{name:34}{n:8d} rows {spent:6.2f}s  {note}{flag}", flush=True)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
