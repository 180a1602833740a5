"""Correlations of two pairs whose sides hardly move beside their level: both engines have to round alike."""

import duckdb
import numpy as np
import pandas as pd

from quantloom.functions.dialect import DUCKDB, SPARK
from quantloom.functions.series import Series


def test_last_correlations_of_nearly_flat_sides_equal_the_sql(spark):
    rng = np.random.default_rng(5)
    k = 4000
    level, step = rng.uniform(1e4, 1e6, (k, 2)), rng.uniform(-0.05, 0.05, (k, 2))
    x, y = np.stack([level, level + step], 1).reshape(2 * k, 2).T
    df = pd.DataFrame({"dt": pd.Timestamp("2020-01-01"), "code": np.repeat([f"S{i}" for i in range(k)], 2), "seq": np.tile([1, 2], k), "n": 2, "x": x, "y": y})

    def sql(d):
        s = Series(d)
        c = s.corr_last(s.col("x"), s.col("y"), 2)
        return s.query("SELECT * FROM nearly_flat", {"c": c, "r": s.cs_rank(c), "v": s.cov_last(s.col("x"), s.col("y"), 2)})

    spark.createDataFrame(df).createOrReplaceTempView("nearly_flat")
    got = spark.sql(sql(SPARK)).toPandas().sort_values("code").reset_index(drop=True)
    con = duckdb.connect()
    con.register("nearly_flat", df)
    want = con.sql(sql(DUCKDB)).df().sort_values("code").reset_index(drop=True)
    assert len(got) == len(want) == k
    for name in ("c", "r", "v"):
        assert (got[name] == want[name]).all(), name
