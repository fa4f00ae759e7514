"""Compare every catalog query with its SQL check in DuckDB.

Usage: python tests/check_oracles.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if value is not None and type(value).__name__ == "Decimal":
        return repr(float(value))
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    left_rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"{len(left_rows)} rows, no SQL"
    cur = con.execute(sql)
    right_cols = [c[0] for c in cur.description]
    right_rows = cur.fetchall()
    if sorted(df.columns) != sorted(right_cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(right_cols)}"
    left, right = canonical(df.columns, left_rows), canonical(right_cols, right_rows)
    if left == right:
        return True, f"{len(left)} rows"
    in_left, in_right = set(left), set(right)
    only_left = [r for r in left if r not in in_right][:3]
    only_right = [r for r in right if r not in in_left][:3]
    return False, f"rows {len(left)} vs {len(right)}\n   spark {only_left}\n   sql   {only_right}"


def main() -> int:
    import __spark_entry__ as contract

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = duck(sf_dir), contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, query, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            ok, note = False, str(error)[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
