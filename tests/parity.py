"""Compare registered Spark queries with their check SQL on DuckDB.

Usage: python tests/parity.py <folder> [name-substring ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def open_views(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def key(row):
    return tuple((v is None, isinstance(v, str), v if v is not None else 0) for v in row)


def same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        if math.isnan(a) or math.isnan(b):
            return False
        return abs(a - b) <= 2e-6 * max(1.0, abs(a))
    return a == b


def compare(spark_rows, names, sql_rows, sql_names):
    """Return (problem or None, whether values are bit-equal)."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    other = sorted(range(len(sql_names)), key=lambda i: sql_names[i])
    if [names[i] for i in order] != [sql_names[i] for i in other]:
        return f"columns {names} / {sql_names}", False
    left = sorted((tuple(r[i] for i in order) for r in spark_rows), key=key)
    right = sorted((tuple(r[i] for i in other) for r in sql_rows), key=key)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}: {left[:2]} / {right[:2]}", False
    exact = left == right
    for a, b in zip(left, right):
        if not all(same(x, y) for x, y in zip(a, b)):
            return f"{a} / {b}", False
    return None, exact


def main(folder: str, parts: list[str]) -> int:
    from moundwork.plans import catalog
    from moundwork.session import build_session

    spark = build_session("parity", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = open_views(folder)
    bad = 0
    for name, item in catalog.load().items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            frame = item.run(spark, folder)
            rows = [tuple(r) for r in frame.collect()]
            spent = time.time() - begin
            sql = item.oracle()
            if sql is None:
                print(f"rows-only {name} {len(rows)} {spent:.1f}s {rows[:1]}"[:300], flush=True)
                continue
            cur = con.execute(sql)
            sql_names = [d[0] for d in cur.description]
            problem, exact = compare(rows, frame.columns, cur.fetchall(), sql_names)
        except Exception as error:
            problem, exact, spent, rows = f"{type(error).__name__} {str(error)[:1500]}", False, 0, []
        bad += problem is not None
        state = "ok" if problem is None and exact else "near" if problem is None else "BAD"
        if problem is None and not rows:
            state = "EMPTY"
        print(f"{state} {name} {len(rows)} {spent:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
