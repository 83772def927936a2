"""Run a registered query and its SQL side by side and compare all values."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else (
            str(v)[:10] if isinstance(v, pd.Timestamp) and v == v.normalize() else
            str([str(x) for x in v]) if hasattr(v, "tolist") and not isinstance(v, (str, bytes)) and hasattr(v, "__len__") else
            repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    if not len(spark_df):
        return None
    a, b = canonical(spark_df), canonical(sql_df)
    if a.equals(b):
        return None
    bad = (a != b).any(axis=1)
    i = bad.idxmax()
    return f"{int(bad.sum())} rows differ, first:\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"


def check(spark, con, name: str, sf_dir: str, queries, oracle) -> str:
    t = time.time()
    got = queries[name](spark, sf_dir).toPandas()
    t_spark = time.time() - t
    if name not in oracle:
        return f"ok (rows only, {len(got)}) {t_spark:.1f}s"
    t = time.time()
    want = con.execute(oracle[name]).df()
    diff = differences(got, want)
    nulls = got.isna().mean().max() if len(got) else 1
    return (f"ok {len(got)} rows" if diff is None else f"FAIL {diff}") + f" spark {t_spark:.1f}s sql {time.time() - t:.1f}s nulls<= {nulls:.2f}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tidemark.session import get_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = get_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    session.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    con = connect(sf)
    failed = 0
    for n in names:
        try:
            out = check(session, con, n, sf, queries, oracle)
        except Exception as e:  # noqa: BLE001
            out = f"FAIL {type(e).__name__}: {str(e)[:600]}"
        failed += out.startswith("FAIL")
        print(n, out, flush=True)
    print("failed", failed, "of", len(names))
