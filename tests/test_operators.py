"""Operators on small frames, edge cases, sources and sinks, registry and streaming."""

import datetime as dt
import sqlite3

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.functions.dialect import SPARK
from quantloom.functions.series import Series
from quantloom.operators import expressions as E
from quantloom.operators import frames, models
from quantloom.plans import registry, special
from quantloom.sources import tables
from quantloom.sources.panel import from_ticks, panel
from quantloom.streaming import events as stream
from tests.oracle import SMALL

DAY = dt.date(2026, 1, 5)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_residuals_are_uncorrelated_with_the_exposure(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=40)
    df = spark.createDataFrame(pd.DataFrame({"trade_date": [DAY] * 40, "code": [f"c{i}" for i in range(40)], "f": 3 * x + rng.normal(size=40), "x": x}))
    out = frames.neutralise(df, ["f"], ["x"]).toPandas()
    assert abs(np.corrcoef(out["f"], out["x"])[0, 1]) < 1e-6 and abs(out["f"].mean()) < 1e-9


def test_neutralise_refuses_unknown_columns_and_leaves_short_days_empty(spark):
    df = spark.createDataFrame([(DAY, "a", 1.0, 2.0), (DAY, "b", 2.0, None)], "trade_date date, code string, f double, x double")
    with pytest.raises(ValueError):
        frames.neutralise(df, ["f"], ["nope"])
    with pytest.raises(ValueError):
        frames.neutralise(df, ["f"], [])
    assert frames.neutralise(df, ["f"], ["x"]).where("f is not null and not isnan(f)").count() == 0


def test_turnover_keeps_the_best_of_the_day_before(spark):
    s = [(1, "a", 9.0), (1, "b", 8.0), (1, "c", 1.0), (1, "d", 0.5), (2, "c", 9.0), (2, "d", 8.0), (2, "b", 3.0), (2, "a", 2.0)]
    df = spark.createDataFrame(s, "day int, code string, score double")
    half = rows(frames.select_turnover(df, 2, 0.5, by="day"), "day", "rank")
    assert [(r[0], r[1]) for r in half] == [(1, "a"), (1, "b"), (2, "c"), (2, "b")]
    full = rows(frames.select_turnover(df, 2, 1.0, by="day"), "day", "rank")
    assert [(r[0], r[1]) for r in full] == [(1, "a"), (1, "b"), (2, "c"), (2, "d")]
    assert all(abs(r[2] - 0.5) < 1e-12 for r in half + full)


def test_asof_join_strict_and_inclusive(spark):
    l = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    r = spark.createDataFrame([("a", 1, 10.0), ("a", 4, 40.0)], "k string, t int, v double")
    assert rows(frames.asof_join(l, r, ["k"], "t", ["v"]), "k", "t") == [("a", 1, 10.0), ("a", 5, 40.0), ("b", 5, None)]
    assert rows(frames.asof_join(l, r, ["k"], "t", ["v"], strict=True), "k", "t") == [("a", 1, None), ("a", 5, 40.0), ("b", 5, None)]


def test_merge_factors(spark):
    old = spark.createDataFrame([(1, 1.0, 2.0)], "k int, a double, b double")
    new = spark.createDataFrame([(1, 9.0, 5.0), (2, 8.0, 6.0)], "k int, b double, c double")
    assert rows(frames.merge_factors(old, new, ["k"]), "k") == [(1, 1.0, 2.0, 5.0), (2, None, None, 6.0)]
    assert rows(frames.merge_factors(old, new, ["k"], overwrite=True), "k") == [(1, 1.0, 9.0, 5.0), (2, None, 8.0, 6.0)]
    assert frames.merge_factors(old, new, ["k"], refresh=True).columns == ["k", "b", "c"]


def test_linear_score_recovers_weights(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": 2 * x[:, 0] - x[:, 1]}))
    w = frames.ridge_weights(df, ["a", "b"], "y", 1e-9)
    assert np.allclose(w, [2, -1], atol=1e-6)
    out = frames.linear_score(df, ["a", "b"], w).toPandas()
    assert np.allclose(out["score"], (2 * out["a"] - out["b"]) / 3)


def test_pca_query_uses_all_coordinates(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas().set_index("vec_id")["embedding"]
    x = np.stack(e.to_numpy()).astype(float)
    x -= x.mean(axis=0)
    load = np.linalg.svd(x, full_matrices=False)[2][:2]
    load *= np.sign(load[np.arange(2), np.abs(load).argmax(axis=1)])[:, None]
    got = special.queries()["operator_pca"](spark, SMALL).toPandas().set_index("vec_id").loc[e.index]
    assert x.shape[1] > 8 and np.allclose(got.to_numpy(), x @ load.T, atol=1e-4)


def test_pca_signs_and_order(spark):
    rng = np.random.default_rng(2)
    t = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"a": 3 * t, "b": 3 * t + 0.01 * rng.normal(size=200)}))
    out = frames.pca(df, ["a", "b"], 1).toPandas()
    assert np.corrcoef(out["pc_1"], t)[0, 1] > 0.99 or np.corrcoef(out["pc_1"], out["a"])[0, 1] > 0.99


def test_carried_basket_skips_failed_days(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "day_idx int, valid boolean")
    assert rows(frames.carried_basket(df).select("day_idx", "carried"), "day_idx") == [(1, None), (2, 1), (3, 1), (4, 3)]


def test_mark_nav():
    p = pd.DataFrame({"dt": [1, 2, 3], "code": ["a"] * 3, "price": [1.0, 2.0, 3.0]})
    assert frames.mark_nav(pd.DataFrame({"dt": [1], "code": ["a"], "weight": [0.5]}), p)["nav"].tolist() == [1.0, 1.5, 2.0]


def test_greedy_dedupe():
    c = {("a", "b"): 0.95, ("a", "c"): 0.1, ("b", "c"): 0.2}
    corr = lambda x, y: c.get((x, y), c.get((y, x)))
    assert frames.greedy_dedupe(["a", "b", "c"], corr, 0.9) == ["a", "c"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=12))
def test_pct_rank_equals_pandas(spark, values):
    df = spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(values)], "g int, i int, x double")
    got = df.selectExpr("i", f"{E.pct_rank('x', 'g')} AS r").orderBy("i").toPandas()["r"].to_numpy(float)
    want = pd.Series([np.nan if v is None else float(v) for v in values]).rank(pct=True, method="average").to_numpy()
    assert np.allclose(got, want, equal_nan=True)


def test_codes_and_prices(spark):
    one = spark.range(1)
    got = one.selectExpr(E.stock_code("'600001'"), E.stock_code("'000002'"), E.stock_code("'430001'"), E.stock_code("'x.SH'"), E.exchange_code("'110001.0'", "'xshg'")).first()
    assert tuple(got) == ("600001.SH", "000002.SZ", "430001.BJ", "x.SH", "110001.SH")
    assert E.bps_rate(-5) == 0
    v = one.selectExpr(E.with_cost("100D", 10, "buy"), E.with_cost("100D", 10, "sell"), E.compound("1D", "0D")).first()
    assert abs(v[0] - 100.1) < 1e-9 and abs(v[1] - 99.9) < 1e-9 and v[2] is None


def _series(spark, groups, build):
    data = [(1, c, i + 1, float(x), len(xs)) for c, xs in groups.items() for i, x in enumerate(xs)]
    spark.createDataFrame(data, "dt int, code string, seq int, x double, n int").createOrReplaceTempView("small_panel")
    s = Series(SPARK)
    return {r["code"]: r["v"] for r in spark.sql(s.query("SELECT * FROM small_panel", {"v": build(s, s.col("x"))}, None)).collect()}


def test_series_functions_on_short_flat_and_tied_groups(spark):
    g = {"one": [5], "flat": [2, 2, 2], "up": [1, 2, 4, 8]}
    assert _series(spark, g, lambda s, x: s.delta(x, 2)) == {"one": 0.0, "flat": 0.0, "up": 6.0}
    assert _series(spark, g, lambda s, x: s.delay(x, 9)) == {"one": 5.0, "flat": 2.0, "up": 1.0}
    assert _series(spark, g, lambda s, x: s.ts_rank_last(x, 3)) == {"one": 1.0, "flat": pytest.approx(2 / 3, abs=1e-6), "up": 1.0}
    assert _series(spark, g, lambda s, x: s.corr_last(x, x, 4)) == {"one": 0.0, "flat": 0.0, "up": 1.0}
    assert _series(spark, g, lambda s, x: s.argmax(x, 3)) == {"one": 1.0, "flat": 1.0, "up": 3.0}
    assert _series(spark, g, lambda s, x: s.std(x, 2)) == {"one": None, "flat": 0.0, "up": pytest.approx(2.828427, abs=1e-5)}
    assert _series(spark, g, lambda s, x: s.decay(x, 2))["up"] == pytest.approx((4 + 16) / 3, abs=1e-5)


def test_registry_covers_all_factors(spark):
    assert len(registry.factor_names()) == 195
    r = registry.Registry()
    r.register("a")(1)
    with pytest.raises(ValueError):
        r.register("a")(2)
    with pytest.raises(KeyError):
        r.get("b")
    specs = [registry.FactorSpec("x", "alpha003_corr_open_volume_v1", {"corr_window": 5}), registry.FactorSpec("y", "vwap", {"window_minutes": 0})]
    out = registry.compute(spark, specs, panel(spark, SMALL))
    assert out.columns == ["dt", "code", "x", "y"] and out.count() > 0
    assert registry.requirements([registry.FactorSpec("z", "daily_sharpe_mean_v1")]) == {"daily": 7}
    assert registry.trials({"a": [1, 2], "b": [3, 4]}, limit=3) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}]


def test_candidate_review():
    good = dict(factor_key="k", factor_name="n", formula="a / b", rationale="r", python_code="import numpy as np\nx = np.log(1)", config_spec={"a": 1}, used_panel_fields=["last"], time_visibility="14:30")
    assert registry.review_candidate(good, ["last"]) == []
    bad = good | {"python_code": "import os\neval('1')", "used_panel_fields": ["nope"]}
    why = registry.review_candidate(bad, ["last"], ["A/B"])
    assert len(why) == 4


def test_day_partitions(spark, tmp_path):
    root = str(tmp_path)
    d1, d2, d3 = (dt.date(2026, 1, i) for i in (5, 6, 7))
    a = spark.createDataFrame([(d1, "a", 1.0), (d2, "a", 2.0)], "trade_date date, code string, v double")
    tables.write_by_date(a, root, "t")
    tables.write_by_date(spark.createDataFrame([(d2, "a", 9.0), (d3, "a", 3.0)], a.schema), root, "t")
    assert sorted(r["v"] for r in tables.read_all(spark, root, "t").collect()) == [1.0, 2.0, 3.0]
    tables.write_by_date(spark.createDataFrame([(d2, "a", 9.0)], a.schema), root, "t", overwrite=True)
    assert [r["v"] for r in tables.read_range(spark, root, "t", "2026-01-06", "2026-01-06").collect()] == [9.0]
    tables.upsert_by_date(spark.createDataFrame([(d2, "b", 7.0), (d3, "a", 4.0)], a.schema), root, "t", ["code"])
    t = tables.read_all(spark, root, "t")
    assert sorted(r["v"] for r in t.collect()) == [1.0, 4.0, 7.0, 9.0]
    assert tables.latest_date(t) == d3 and tables.has_data(t)
    assert {r["trade_date"] for r in tables.lookback(t, "2026-01-06", 2).collect()} == {d1, d2}
    assert {r["trade_date"] for r in tables.latest_on_or_before(t, "2026-01-30").collect()} == {d3}


def test_scores_and_database_sink(spark, tmp_path):
    s = spark.createDataFrame([(DAY, "110001.SH", 0.5), (DAY, "110002.SZ", 0.1)], "trade_date date, code string, score double")
    tables.write_scores(s, f"{tmp_path}/scores")
    assert tables.read_scores(spark, f"{tmp_path}/scores/*").count() == 2
    db = f"{tmp_path}/x.db"
    con = sqlite3.connect(db)
    con.execute("create table trades (trade_date text, score real, instrument_code text, exchange_code text)")
    con.commit()
    for _ in range(2):
        tables.replace_date(s, lambda: sqlite3.connect(db), "trades", str(DAY))
    assert con.execute("select count(*), min(instrument_code), max(exchange_code) from trades").fetchone() == (2, "110001", "SZ")


def test_snapshots(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 9)], "code string, ts int")
    assert rows(tables.latest_per_symbol(df, 2), "code", "ts") == [("a", 2), ("a", 3), ("b", 9)]
    assert tables.score_range(df, 2, 3).count() == 2
    with pytest.raises(ValueError):
        tables.cached_or_direct(spark, "other", "", lambda: df)


def test_stream_equals_batch(spark, tmp_path):
    src = f"{tmp_path}/events"
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(4).write.parquet(src)
    live = stream.windowed(stream.read(spark, src), "1 hour", late="400 days")
    q = live.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = stream.windowed(spark.read.parquet(src), "1 hour")
    key = lambda df: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("live")) == key(batch)


def test_available_now_remembers(spark, tmp_path):
    src, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    e.limit(50).write.parquet(src)
    for _ in range(2):
        stream.run_available(stream.read(spark, src).select("event_id"), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 50
    e.limit(7).write.mode("append").parquet(src)
    stream.run_available(stream.read(spark, src).select("event_id"), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 57




def test_models_and_strategies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame(pd.DataFrame({"day_idx": np.repeat(np.arange(10), 20), "a": x[:, 0], "b": x[:, 1], "y": x[:, 0]}))
    for name, params in (("gbt", {"maxIter": 3}), ("linear", {}), ("elastic", {})):
        out = models.rolling_fit(df, name, ["a", "b"], "y", 4, 3, **params).toPandas()
        assert sorted(out["day_idx"].unique()) == [4, 5, 6, 7, 8, 9] and np.corrcoef(out["score"], out["y"])[0, 1] > 0.8
    s = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "day int, code string, score double")
    assert models.select_signals("topk_turnover", s, k=1, by="day").count() == 1
    assert models.select_signals("topk_turnover", None) is None
    assert E.price_bound(" None ") == 0 and E.price_bound("2.5") == 2.5 and E.first_present(["x", "y"], ["z", "y"]) == "y"
    with pytest.raises(ValueError):
        E.first_present(["x"], ["z"])


def test_panel_from_ticks(spark):
    at = lambda h, m: dt.datetime(2026, 1, 5, h, m)
    data = [(DAY, "a", at(9, 30), 1, 10.0, 9.0, 5.0), (DAY, "a", at(9, 30), 2, 11.0, 9.0, 6.0), (DAY, "a", at(10, 5), 1, float("nan"), 9.0, 7.0), (DAY, "b", at(9, 31), 1, 3.0, None, 1.0)]
    p = from_ticks(spark.createDataFrame(data, "dt date, code string, trade_time timestamp, id int, last double, pre_close double, volume double"), order="id")
    got = rows(p.select("code", "seq", "last", "prev_bar_close", "n", "end_sec"), "code", "seq")
    assert got == [("a", 1, 11.0, 9.0, 2, 36300), ("a", 2, None, 11.0, 2, 36300), ("b", 1, 3.0, None, 1, 34260)]
    out = registry.compute(spark, [registry.FactorSpec("v", "volume_sum", {"window_minutes": 30}), registry.FactorSpec("r", "price_position")], p)
    assert {r["code"]: (r["v"], r["r"]) for r in out.collect()} == {"a": (7.0, 0.0), "b": (1.0, 0.0)}
