"""Series layers in numpy blocks give what the window queries give, to the last bit, on odd panels too."""

import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quantloom.functions import blocks
from quantloom.functions.dialect import SPARK
from quantloom.plans import factors
from tests.oracle import SMALL

NAMES = factors.alpha_groups()["factors_alpha_6"]
VALUES = ["last", "open", "high", "low", "volume", "amount", "bid_price1", "ask_price1"]


def odd_panel(strange: bool) -> pa.Table:
    """Groups of 1 to 70 rows and one of 700, with ties, flat prices, gaps and, if strange, NaN, infinities and huge values."""
    rng = np.random.default_rng(7)
    parts = []
    for g, n in enumerate([*range(1, 71), 700, 1, 2, 25, 25]):
        last = 100 + (np.round(rng.normal(0, 1, n), 1) if g % 3 else np.zeros(n)).cumsum()
        df = pd.DataFrame({"last": last, "open": last + rng.integers(-2, 3, n) * 0.1, "high": last + rng.integers(0, 3, n), "low": last - rng.integers(0, 3, n)})
        df["volume"] = rng.integers(0, 5, n).astype(float)
        df["amount"] = df["volume"] * last * (1 if g % 4 else 0)
        df["bid_price1"], df["ask_price1"] = last - 0.1 * rng.integers(0, 3, n), last + 0.1 * rng.integers(0, 3, n)
        if g % 2:
            df = df.mask(rng.random(df.shape) < 0.15)
        if g % 10 == 9:
            df[["bid_price1", "open"]] = np.nan
        ok = df.notna().to_numpy()
        x = df.to_numpy(copy=True)
        if strange and g % 5 == 1:
            spots = rng.random(x.shape) < 0.08
            x[spots] = rng.choice([np.nan, np.inf, -np.inf, 1e300, -1e-300, -0.0, -5.0], spots.sum())
            ok |= spots
        cols = {"dt": pa.array([datetime.date(2020, 1, 1 + g % 2)] * n), "code": pa.array([f"S{g:03d}"] * n), "seq": pa.array(np.arange(1, n + 1, dtype=np.int32)), "n": pa.array(np.full(n, n))}
        parts.append(pa.table(cols | {c: pa.array(x[:, i], mask=~ok[:, i]) for i, c in enumerate(VALUES)}))
    return pa.concat_tables(parts)


def sorted_rows(df):
    return df.toPandas().sort_values(["dt", "code"]).reset_index(drop=True)


@pytest.mark.parametrize("strange", [False, True])
def test_blocks_equal_the_window_query(spark, strange):
    panel = spark.createDataFrame(odd_panel(strange)).repartition(3, "dt", "code")
    panel.createOrReplaceTempView("odd_panel")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sorted_rows(factors.alpha_blocks(NAMES)(spark, panel))
        want = sorted_rows(spark.sql(factors.alpha_sql(SPARK, NAMES, "SELECT * FROM odd_panel")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) == 75
    pd.testing.assert_frame_equal(got, want, check_exact=True)
    assert (got[NAMES].nunique() > 1).sum() >= 10


def test_blocks_and_batches_of_any_size_give_the_same(monkeypatch):
    table = odd_panel(False)
    ends = blocks.Ends(*_plan())
    whole = pa.Table.from_batches(list(ends(iter(table.combine_chunks().to_batches()))))
    monkeypatch.setattr(blocks, "ROWS", 40)
    monkeypatch.setattr(blocks, "CELLS", 100)
    parts = list(ends(iter(table.combine_chunks().to_batches(max_chunksize=7))))
    assert len(parts) > 10
    assert pa.Table.from_batches(parts).combine_chunks().equals(whole.combine_chunks())


def _plan():
    s = factors.Series(SPARK)
    c = factors.Columns(s)
    return s.plan({n: factors.ALPHAS[n](s, c) for n in NAMES})


@pytest.mark.parametrize("rows", [[0, 2, 1], [1, 2], [0, 2], [0, 0, 2]])
def test_blocks_refuse_groups_that_are_not_whole(rows):
    table = odd_panel(False).slice(3, 3).take(rows)
    with pytest.raises(ValueError, match="missing or out of order"):
        list(blocks.Ends(*_plan())(iter(table.combine_chunks().to_batches())))


def test_an_empty_panel_gives_no_rows(spark):
    panel = spark.createDataFrame(odd_panel(False)).where("seq < 0")
    assert factors.alpha_blocks(NAMES)(spark, panel).count() == 0


def test_alpha_6_sorts_its_rows_once_and_not_for_every_rank(spark):
    df = factors.queries()["factors_alpha_6"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The panel's sort, the cross-sections' and those that order rows for blocks; the window query had 28 windows and 16 sorts.
    assert plan.count("Window [") <= 8
    assert plan.count("Sort [") <= 8
    assert "MapInArrow" in plan
