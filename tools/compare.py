"""Run the registered queries and their SQL side by side and report differences.

    python tools/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from storyloom.queries import all_queries, all_sql  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


def compare(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = all_queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    sql = all_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    start = time.time()
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    sql_spent = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}"
    left, right = _rows(df.columns, got), _rows(columns, want)
    if left == right:
        return True, f"{len(got)} rows, {spent:.1f}s against {sql_spent:.1f}s"
    missing = [r for r in right if r not in set(left)][:3]
    extra = [r for r in left if r not in set(right)][:3]
    return False, f"{len(left)} against {len(right)} rows\n  only Spark: {extra}\n  only SQL: {missing}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in args.names or all_queries():
        try:
            fine, text = compare(spark, f"/root/testdata/sf{args.sf}", name)
        except Exception as error:  # noqa: BLE001
            fine, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not fine
        print(("ok   " if fine else "FAIL ") + name + ": " + text, flush=True)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
