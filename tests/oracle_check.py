"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py DIR [query ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
import pyarrow as pa

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(dtype: pa.DataType) -> str:
    if pa.types.is_timestamp(dtype):
        return "timestamp"
    return "string" if pa.types.is_large_string(dtype) or pa.types.is_string(dtype) else str(dtype)


def _rows(table: pa.Table, columns: list[str]) -> pd.Series:
    frame = table.select(columns).to_pandas()
    text = frame.apply(lambda c: c.map(lambda v: "NULL" if pd.isna(v) else repr(v)))
    return text.agg("|".join, axis=1).sort_values(ignore_index=True) if len(text) else pd.Series(dtype=object)


def compare(spark_table: pa.Table, duck_table: pa.Table) -> str:
    """Empty when equal, otherwise what differs."""
    columns = sorted(spark_table.column_names)
    if columns != sorted(duck_table.column_names):
        return f"columns {set(columns) ^ set(duck_table.column_names)}"
    kinds = {
        c: (_kind(spark_table.schema.field(c).type), _kind(duck_table.schema.field(c).type)) for c in columns
    }
    wrong = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if wrong:
        return f"types {wrong}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows {spark_table.num_rows} vs {duck_table.num_rows}"
    left, right = _rows(spark_table, columns), _rows(duck_table, columns)
    bad = left.ne(right)
    return f"{bad.sum()} rows differ, e.g.\n  {left[bad].iloc[0]}\n  {right[bad].iloc[0]}\n  {columns}" if bad.any() else ""


def twin(con: duckdb.DuckDBPyConnection, name: str) -> pa.Table:
    return con.sql(entry.oracle_sql()[name]).to_arrow_table()


def check(spark, con, sf_dir: str, name: str) -> str:
    return compare(entry.queries()[name](spark, sf_dir).toArrow(), twin(con, name))


def main() -> None:
    from lyceum.session import build_session

    spark = build_session(
        "oracle-check", os.environ.get("ORACLE_MASTER", "local[8]"), spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    con = connect(sf_dir)
    names = chosen or list(entry.queries())
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem = check(spark, con, sf_dir, name) if name in entry.oracle_sql() else "no SQL twin"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        failed += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {name:36s} {time.time() - started:6.2f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")


if __name__ == "__main__":
    main()
