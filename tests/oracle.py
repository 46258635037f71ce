"""Compares a registered query with its SQL on DuckDB."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def tables(con):
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].astype(float).round(6) + 0.0
    return sorted(map(repr, (tuple("-" if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in df.astype(object).itertuples(index=False))))


def compare(spark, query, sql):
    got, want = query(spark, DATA).toPandas(), tables(duckdb.connect()).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    return len(got)
