"""Runs a query and its SQL on the same tables and compares the rows, whatever their order."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir=DATA):
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        at = f"{sf_dir}/{f}"
        c.sql(f"create view {f.split('.')[0]} as from '{at if os.path.isfile(at) else at + '/*.parquet'}'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for x in df.columns:
        kind = df[x].dtype.kind
        if kind == "f":
            df[x] = df[x].astype(float).round(6) + 0.0
        elif kind in "iu":
            df[x] = df[x].astype("int64")
        elif kind == "M":
            df[x] = df[x].astype("datetime64[us]")
        elif kind == "O":
            df[x] = df[x].map(lambda v: None if v is None or v != v else v)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


def differences(spark_df, sql_df):
    a, b = normal(spark_df), normal(sql_df)
    if list(a.columns) != list(b.columns) or len(a) != len(b):
        return [f"{list(a.columns)} x {len(a)} against {list(b.columns)} x {len(b)}"]
    return [c for c in a.columns if not (a[c] == b[c]).all()]
