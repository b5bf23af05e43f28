"""Run registered queries in Spark and their SQL in DuckDB and compare the rows exactly.

    python tests/compare.py [--sf 0.01] [--shuffle] [key ...]

``--shuffle`` forbids broadcasts chosen by size, so that the joins for large tables are taken.
"""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata"
NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/sf{sf}/{name}.parquet')")
    return con


def cell(value) -> str:
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return f"{type(value).__name__}:{value}"


def shape(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def spark_rows(frame):
    return shape(frame.columns, [tuple(r) for r in frame.collect()])


def sql_rows(con, sql: str):
    result = con.execute(sql)
    return shape([d[0] for d in result.description], result.fetchall())


def difference(frame, con, sql: str) -> str | None:
    columns, rows = spark_rows(frame)
    want_columns, want = sql_rows(con, sql)
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}; first {rows[:2]} vs {want[:2]}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"{len(bad)} of {len(rows)} rows differ: {bad[:2]}" if bad else None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from larkspur.session import local_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = local_session(8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    if argv[:1] == ["--shuffle"]:
        argv = argv[1:]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    con = connect(sf)
    known, sqls, failed = queries(), oracle_sql(), []
    for key in argv or known:
        start = time.time()
        try:
            frame = known[key](spark, f"{DATA}/sf{sf}")
            problem = difference(frame, con, sqls[key]) if key in sqls else (None if frame.count() else "no rows")
            rows = "" if key in sqls else " (rows only)"
        except Exception as error:  # report every key, then fail at the end
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        print(f"{'FAIL' if problem else 'ok  '} {key:26s} {time.time() - start:6.2f}s{rows} {problem or ''}", flush=True)
        if problem:
            failed.append(key)
    print(f"{len(failed)} failed: {' '.join(failed)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
