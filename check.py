"""Compare queries with their SQL counterparts in DuckDB: python check.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, datetime):
        return value.date() if (value.hour, value.minute, value.second, value.microsecond) == (0, 0, 0, 0) else value
    if isinstance(value, date):
        return value
    if isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return round(number, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES.split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def compare(spark: SparkSession, db, folder: str, query) -> tuple[str, str]:
    df = query.run(spark, folder)
    columns, rows = normal(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return ("rows" if rows else "EMPTY"), f"{len(rows)} rows"
    result = db.execute(query.sql)
    names = [d[0] for d in result.description]
    want_columns, want = normal(names, result.fetchall())
    if columns != want_columns:
        return "DIFF", f"columns {columns} <> {want_columns}"
    if rows == want:
        return "ok" if rows else "EMPTY", f"{len(rows)} rows"
    only, other = [r for r in rows if r not in set(want)][:2], [r for r in want if r not in set(rows)][:2]
    return "DIFF", f"{len(rows)} <> {len(want)} rows; spark {only}; sql {other}"


def local_session(cpus: str = "8") -> SparkSession:
    from voxtide.session import build_session

    spark = build_session(
        "check", **{
            "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from voxtide.plans.catalog import QUERIES

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark, db = local_session(), database(folder)
    bad = 0
    for name, query in QUERIES.items():
        if args and not any(a in name for a in args):
            continue
        began = time.time()
        try:
            state, note = compare(spark, db, folder, query)
        except Exception as error:  # report and go on
            state, note = "FAIL", f"{type(error).__name__}: {str(error)[:600]}"
        bad += state in ("DIFF", "FAIL", "EMPTY")
        print(f"{state:6} {time.time() - began:7.2f}s {name}: {note}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
