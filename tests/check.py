"""Run catalogue queries and their SQL side by side: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows by value, numbers and dates as comparable text."""
    df = df[sorted(df.columns)].copy()
    for column in df.columns:
        values = df[column]
        if pd.api.types.is_datetime64_any_dtype(values):
            values = values.dt.strftime("%Y-%m-%d")
        df[column] = [
            "NULL" if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
            for v in values.astype(object)
        ]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    wrong = (a != b).any(axis=1)
    if not wrong.any():
        return ""
    return f"{int(wrong.sum())} of {len(a)} rows differ\n{a[wrong].head(4)}\n{b[wrong].head(4)}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from conftest import make_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(queries())
    spark, con, sql = make_session(), connect(sf_dir), oracle_sql()
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = queries()[name](spark, sf_dir).toPandas()
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in sql:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s\n{got.head(5)}", flush=True)
            continue
        start = time.time()
        try:
            want = con.execute(sql[name]).df()
        except Exception as error:
            print(f"SQL  {name}: {str(error)[:800]}", flush=True)
            bad += 1
            continue
        problem = differences(got, want)
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name}: {len(got)} rows, {took:.1f}s, sql {time.time() - start:.1f}s {problem}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
