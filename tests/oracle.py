"""Run queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    return repr(round(value, 9)) if isinstance(value, float) and math.isfinite(value) else repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, query, sql) -> str | None:
    """None when both sides agree, else what differs."""
    frame = query(spark, sf_dir)
    columns, mine = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    result = con.execute(sql)
    wanted_columns, wanted = _rows([column[0] for column in result.description], result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}"
    if not mine:
        return "no rows"
    if mine != wanted:
        extra, missing = set(mine) - set(wanted), set(wanted) - set(mine)
        return f"{len(mine)} rows, want {len(wanted)}; extra {list(extra)[:1]}; missing {list(missing)[:1]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.sql.shuffle.partitions", "8"
    ).config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if name not in sql or sys.argv[2:] and not any(name.startswith(prefix) for prefix in sys.argv[2:]):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, query, sql[name])
        except Exception as error:  # shown, and the other queries go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {(problem or '')[:1800]}", flush=True)
