"""Run registered queries next to their SQL and compare rows.

usage: python tests/oracle_check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


TIMES: dict[str, float] = {}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads to 4")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.6f}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, con, folder, query):
    df = query.run(spark, folder)
    begin = time.time()
    got = [tuple(r) for r in df.collect()]
    TIMES["spark"] = time.time() - begin
    begin = time.time()
    sql = query.oracle()
    if sql is None:
        return len(got), None, "rows only"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    TIMES["sql"] = time.time() - begin
    if sorted(names) != sorted(df.columns):
        return len(got), False, f"columns {df.columns} vs {names}"
    left, right = rows_of(df.columns, got), rows_of(names, want)
    if left == right:
        return len(got), True, ""
    a, b = list((left - right).items()), list((right - left).items())
    a.sort(key=str)
    b.sort(key=str)
    return (
        len(got),
        False,
        f"{len(got)} vs {len(want)} rows; {len(a)} only spark {a[:2]}; {len(b)} only sql {b[:2]}",
    )


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        del argv[at : at + 2]
    from quantframe.catalog import load_all
    from quantframe.session import build_session

    folder = f"/root/testdata/sf{sf}"
    spark = build_session("oracle-check")
    con = connect(folder)
    bad = 0
    for name, q in load_all().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        begin = time.time()
        try:
            n, ok, note = compare(spark, con, folder, q)
        except Exception as exc:  # noqa: BLE001
            n, ok, note = -1, False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += ok is False
        empty = " EMPTY" if n == 0 else ""
        label = {True: "ok  ", False: "FAIL", None: "rows"}[ok]
        print(f"{label} {name} rows={n}{empty} {time.time() - begin:.1f}s (spark {TIMES.get('spark', 0):.1f} sql {TIMES.get('sql', 0):.1f}) {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
