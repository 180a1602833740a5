"""Row-by-row comparison of a query with its DuckDB text."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(folder=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "NULL"
        return "%.9g" % (v + 0.0) if isinstance(v, (float, np.floating)) else str(v)

    out = pd.DataFrame({c: df[c].map(text) for c in sorted(df.columns)})
    # Whole numbers read alike whatever their type.
    out = out.map(lambda v: v[:-2] if v.endswith(".0") else v)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def agree(spark, con, query, sql, folder=SMALL):
    got, want = canonical(query(spark, folder).toPandas()), canonical(con.sql(sql).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert (got.to_numpy() == want.to_numpy()).all(), (got[(got != want).any(axis=1)].head(), want[(got != want).any(axis=1)].head())
