"""Run registered queries against their DuckDB counterparts and report differences.

    python tests/compare.py <folder> [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(columns=sorted(df.columns))
    # Whole numbers with nulls have a type of their own in one library and are floats in the other.
    df = df.astype({c: "float64" for c, kind in df.dtypes.items() if isinstance(kind, pd.Int64Dtype)})
    df = df.sort_values(list(df.columns), kind="stable", na_position="last")
    return df.reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} values of {c}, first {x[i]!r} != {y[i]!r}"
    kinds = [(c, a[c].dtype, b[c].dtype) for c in a.columns if a[c].dtype.kind != b[c].dtype.kind]
    return f"types {kinds[:3]}" if kinds and len(a) else None


def compare(spark, folder: str, names: list[str] | None = None) -> dict[str, str | None]:
    import __spark_entry__ as entry

    con, oracle, out = connect(folder), entry.oracle_sql(), {}
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = query(spark, folder).toPandas()
            spent = time.time() - start
            if name in oracle:
                out[name] = difference(got, con.execute(oracle[name]).df())
            else:
                out[name] = None if len(got) else "no rows"
        except Exception as error:  # report and go on
            spent = time.time() - start
            out[name] = f"{type(error).__name__}: {str(error)[:600]}"
        rest = time.time() - start - spent
        print(f"{name:24s} {spent:6.1f}s {rest:5.1f}s  {out[name] or 'ok'}", flush=True)
    return out


if __name__ == "__main__":
    from tillcast.session import get_session

    session = get_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    result = compare(session, sys.argv[1], sys.argv[2:])
    bad = [n for n, d in result.items() if d]
    print(f"{len(result) - len(bad)} of {len(result)} ok; failed: {bad}")
