"""Factors, neutralising and joins against values written out by hand, on small frames with gaps, ties and short groups."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantloom.functions.dialect import DUCKDB
from quantloom.operators import frames, neutral
from quantloom.plans.factors import grouped_sql

DAY = dt.date(2026, 1, 5)


def panel():
    """Groups of 1, 2, 3, 40 and 70 ticks a minute apart, with ties, zero and missing volumes, crossed, empty and missing books."""
    rng = np.random.default_rng(5)
    rows = []
    for code, n in (("A", 1), ("B", 2), ("C", 3), ("D", 40), ("E", 40), ("F", 70), ("G", 70), ("H", 12)):
        for seq in range(1, n + 1):
            last = round(float(rng.uniform(90, 110)), 1)
            r = {"dt": DAY, "code": code, "seq": seq, "sec": seq * 60, "last": last, "pre_close": 100.0, "open": 99.0, "high": last + 1, "low": last - 2, "volume": float(rng.integers(0, 4)) if code != "E" else 2.0, "num_trades": 1.0}
            r["amount"] = r["volume"] * last
            for k in range(1, 6):
                r |= {f"bid_price{k}": last - k / 10, f"ask_price{k}": last + k / 5, f"bid_volume{k}": float(k + seq % 3), f"ask_volume{k}": float(2 * k)}
            if code == "D" and seq % 4 == 0:
                r["ask_price1"] = None
            if code == "E" and seq == n:
                r["bid_volume1"] = None
            if code == "F" and seq == n:
                r |= {"bid_price1": last + 2, "ask_volume1": 0.0}
            if code == "G" and seq == 65:
                r |= {"bid_volume3": None, "volume": None}
            if code == "H" and seq == n:
                r |= {"ask_volume1": 0.0, "bid_volume2": None}
            rows.append(r)
    df = pd.DataFrame(rows)
    g = df.groupby("code")
    return df.assign(prev_bar_close=g["last"].shift().fillna(df["pre_close"]), n=g["seq"].transform("count"), end_sec=g["sec"].transform("max"), start_sec=g["sec"].transform("min"))


def classic_by_hand(g: pd.DataFrame) -> dict[str, float]:
    """The classic factors of one group from their definitions; 0 and missing are told apart by none of the checks."""
    z, w = g.iloc[-1], g[g["sec"] >= g["sec"].max() - 1800]
    e, nan = 1e-8, float("nan")
    p, f, l = w["last"], w["last"].iloc[0], z["last"]
    bv, av, bp, ap = z.bid_volume1, z.ask_volume1, z.bid_price1, z.ask_price1
    mid, tot = (ap + bp) / 2, bv + av
    op = z.open if pd.isna(mid) else mid
    micro = (bp * av + ap * bv) / tot if tot else nan
    lv = lambda side, n: [z[f"{side}{k}"] for k in range(1, n + 1)]
    bid3, ask3 = np.nansum(lv("bid_volume", 3)), np.nansum(lv("ask_volume", 3))
    bidw, askw = (np.dot(lv(f"{s}_volume", 5), [5, 4, 3, 2, 1]) for s in ("bid", "ask"))

    def slope(side):
        v, x = np.array(lv(f"{side}_volume", 5), float), np.array(lv(f"{side}_price", 5), float)
        m = (v[1:] + v[:-1]) / 2
        return 0.0 if m.sum() <= 0 else (np.abs(np.diff(x)) * m).sum() / m.sum()

    many = lambda side: np.nansum(w[[f"{side}_volume{k}" for k in (1, 2, 3)]].to_numpy(float))
    logs, mids = np.log(p).diff().dropna(), (w.ask_price1 + w.bid_price1) / 2
    vol, amt, rng = w.volume.sum(), w.amount.sum(), (z.high - z.low) / (z.prev_bar_close + e)
    full = g.dropna(subset=["last", "volume", "amount"])
    mean = full.amount.sum() / full.volume.sum() if full.volume.sum() > 0 else nan
    depth = g[[f"{s}_volume{k}" for s in ("bid", "ask") for k in range(1, 6)]].sum(axis=1, min_count=10)
    t = w["sec"] - w["sec"].iloc[0]
    quiet = g[(g.volume >= 0) & (g.pre_close > 0) & (g["last"] > 0)]
    return {
        "amihud_illiq": abs((l - f) / f) / amt if amt > 0 else 0,
        "amount_sum": amt,
        "bid_ask_spread_v1": (ap - bp) / (mid + e),
        "depth_imbalance": (bid3 - ask3) / (bid3 + ask3) if bid3 + ask3 > 0 else 0,
        "depth_slope": (slope("ask") - slope("bid")) / mid,
        "depth_weighted_imbalance_v1": (bidw - askw) / (bidw + askw + e),
        "intraday_momentum_v1": (l - op) / (op + e),
        "microprice_bias": (micro - mid) / mid,
        "microprice_dev_liquidity_v1": l - micro,
        "microprice_deviation_liq_cond_v1": (l - micro) / (tot + e),
        "microprice_deviation_liq_v1": (l - micro) / l * (tot / z.volume) if z.volume > 0 else nan,
        "microprice_deviation_v1": (l - micro) / micro,
        "midprice_move": mids.iloc[-1] / mids.iloc[0] - 1,
        "mom_slope": np.polyfit(t, p, 1)[0] if len(w) > 1 else 0,
        "ob_pressure_spread_persistence_v1": (ap - bp) / l * (bv - av) / tot if ap >= bp and tot else nan,
        "ob_pressure_spread_recovery_v1": (ap - bp) / l * (bv - av) / (tot + e),
        "ob_pressure_spread_v1": (bv - av) / (tot + e) / ((ap - bp) / mid + e) if ap >= bp else nan,
        "order_flow_imbalance_v1": (bv - av) / (tot + e),
        "price_level_position_v1": (l - z.low) / (z.high - z.low + e),
        "price_position": (l - p.min()) / np.ptp(p) if np.ptp(p) else 0,
        "range_ratio": np.ptp(p) / l,
        "ret_window": l / f - 1,
        "ret_open_to_time": (lambda t: t.iloc[-1] / t.iloc[0] - 1)(g[g["sec"] <= 5400]["last"]),
        "return_skew": logs.skew() if len(logs) > 2 else 0,
        "spread": (ap - bp) / mid,
        "spread_depth_pressure_v1": -(ap - bp) / l * tot / z.volume if z.volume > 0 else nan,
        "tail_volume_absorption_v1": (quiet.volume / ((quiet["last"] - quiet.pre_close).abs() / (quiet.pre_close + e) + e)).mean(),
        "trade_intensity_v1": z.amount / (z.num_trades + e) / (z.prev_bar_close + e),
        "turnover_rate": vol / z.num_trades,
        "volatility": logs.std() if len(logs) > 1 else 0,
        "volatility_scaled_return_v1": (l - op) / (op + e) / (rng + e) if rng > 0 else 0,
        "volen": depth.iloc[-60:].mean() / depth.iloc[-10:].mean() if len(g) >= 60 and depth.iloc[-60:].notna().all() else 0,
        "volume_imbalance": (many("bid") - many("ask")) / (many("bid") + many("ask")),
        "volume_price_trend_v1": (l - z.prev_bar_close) / (z.prev_bar_close + e) * z.amount,
        "volume_sum": vol,
        "vwap": amt / vol if vol > 0 else 0,
        "vwap_deviation_liquidity_cond_v1": (full["last"].iloc[-1] - mean) / mean * np.log(full.amount.iloc[-1] + 1) if len(full) else nan,
        "vwap_gap": l / (amt / vol) - 1 if vol > 0 else 0,
    }


def by_hand(g: pd.DataFrame) -> dict[str, float]:
    """The factors of one group from their definitions."""
    z, w = g.iloc[-1], g[g["sec"] >= g["sec"].max() - 1800]
    v = w["volume"].to_numpy(float)
    pos = v[v > 0]
    nan = float("nan")
    bv, av, bp, ap = z.bid_volume1, z.ask_volume1, z.bid_price1, z.ask_price1
    mid, tot = (ap + bp) / 2, bv + av
    micro = (ap * bv + bp * av) / tot
    share = pos / pos.sum() if len(pos) else pos
    ask, bid = sum(g[f"ask_price{k}"] for k in (1, 2, 3)) / 3, sum(g[f"bid_price{k}"] for k in (1, 2, 3)) / 3
    lean = lambda t: (sum(t[f"bid_volume{k}"] - t[f"ask_volume{k}"] for k in (1, 2, 3)) / sum(t[f"bid_volume{k}"] + t[f"ask_volume{k}"] for k in (1, 2, 3)))
    total, half = w.amount.sum(), w.amount.iloc[: len(w) // 2].sum()
    l, lo, hi, wv, wa = z["last"], g.low.min(), g.high.max(), g.volume.sum(), g.amount.sum()
    ok = w[(w.ask_price1 > 0) & (w.bid_price1 > 0) & (w["last"] > 0) & (w.ask_price1 >= w.bid_price1)]
    gaps, mids = (ok.ask_price1 - ok.bid_price1) / ok["last"], (g.ask_price1 + g.bid_price1) / 2
    first = (w.iloc[0].ask_price1 + w.iloc[0].bid_price1) / 2
    avg = wa / wv if wv > 0 else l
    whole, some = not np.isnan(v).any(), lambda x: 1e-8 if x == 0 else x
    run = np.cumsum(v)
    steep = np.polyfit(np.arange(len(v)), run, 1)[0] if whole and len(v) > 1 else nan
    dv, k, ages = v - v.mean(), np.arange(1, len(v) + 1), (w["sec"] - w["sec"].min()).to_numpy(float)
    paid, wsum = w.amount.sum(), w.volume.sum()
    return classic_by_hand(g) | {
        "t1430_close_range_position_v1": (l - lo) / (hi - lo + 1e-8),
        "t1430_microprice_last_gap_v1": micro / l - 1 if av > 0 and bv > 0 else nan,
        "t1430_microprice_liquidity_v1": (micro - mid) / (ap - bp) / ((ap - bp) * z.volume) if av > 0 and bv > 0 and z.volume > 0 else nan,
        "t1430_microprice_mid_deviation_v1": (l - micro) / micro,
        "t1430_microprice_midpoint_dev_v1": (l - micro) / micro,
        "t1430_mid_price_return_v1": ((mids - g.pre_close) / g.pre_close).mean(),
        "t1430_mid_return_30m_v1": mid / first - 1,
        "t1430_ob_imbalance_flow_v1": (bv - av) / tot * z.volume / tot if z.volume != 0 else nan,
        "t1430_order_imbalance_v1": (bv - av) / tot,
        "t1430_orderflow_imbalance_v1": (av - bv) / tot,
        "t1430_price_range_30m_v1": np.ptp(w["last"]) / l,
        "t1430_pv_interaction_v1": (l - z.low) / some(z.high - z.low) * z.amount / some(z.volume * l),
        "t1430_pv_ratio_v1": (l - lo) / some(hi - lo) * wv / avg,
        "t1430_range_norm_volume_v1": wv / ((hi - lo) / l + 1e-8),
        "t1430_range_volume_norm_v1": (z.high - z.low) / l * np.log1p(z.volume),
        "t1430_range_volume_v1": (z.high - z.low) / l * z.volume,
        "t1430_relative_strength_vwap_v1": (l - wa / wv) / (wa / wv) if z.volume > 0 else nan,
        "t1430_volume_weighted_price_deviation_v1": (l - wa / wv) / (wa / wv) if wv > 0 and z.volume >= 0 else nan,
        "t1430_spread_change_30m_v1": gaps.iloc[-1] - gaps.iloc[0] if len(gaps) > 1 else nan,
        "t1430_spread_mean_guarded_30m_v1": gaps.mean(),
        "t1430_spread_width_norm_v1": ((g.ask_price1 - g.bid_price1) / mids).mean(),
        "t1430_tail_pressure_v1": (l - z.low) / some(z.high - z.low) * z.volume / some(z.amount / l),
        "t1430_vol_turnover_ratio_v1": wv / (wa / l) if wa > 0 else nan,
        "t1430_volatility_turnover_v1": (hi - lo) / l * wa / (wv * l + 1e-8),
        "t1430_volume_acceleration_v1": steep / v.sum() if whole and (v > 0).all() else nan,
        "t1430_volume_cumsum_slope_v1": steep if len(v) > 2 else nan,
        "t1430_volume_autocorrelation_v1": (dv[1:] * dv[:-1]).mean() / (dv * dv).mean() if whole and len(v) > 2 and dv.any() else nan,
        "t1430_volume_concentration_gini_v1": np.abs(pos[:, None] - pos[None]).mean() / (2 * pos.mean()) if len(pos) > 1 else nan,
        "t1430_volume_gini_coefficient_v1": 2 * (k * np.sort(v)).sum() / (len(v) * v.sum()) - (len(v) + 1) / len(v) if whole and len(v) > 1 and v.sum() else nan,
        "t1430_volume_concentration_hhi_v1": (share**2).sum() if len(pos) else nan,
        "t1430_volume_hhi_v1": (share**2).sum() if whole and len(v) > 1 and (v > 0).all() else nan,
        "t1430_volume_count_v2": len(pos) or nan,
        "t1430_volume_count_v3": len(pos) or nan,
        "t1430_volume_cumsum_v1": wsum or nan,
        "t1430_volume_entropy_v2": -(share * np.log(share)).sum() if len(pos) else nan,
        "t1430_volume_max_v1": w.volume.max() or nan,
        "t1430_volume_max_v2": pos.max() if len(pos) else nan,
        "t1430_volume_mean_v1": w.volume.mean() or nan,
        "t1430_volume_min_v1": pos.min() if len(pos) else nan,
        "t1430_volume_moment_v1": pos.mean() if len(pos) else nan,
        "t1430_volume_momentum_v1": wsum or nan,
        "t1430_volume_recent_share_v1": w[w["sec"] > w["sec"].max() - 60].volume.sum() / wsum if wsum else nan,
        "t1430_volume_weighted_mid_v1": (bp * np.nan_to_num(av) + ap * np.nan_to_num(bv)) / (np.nan_to_num(av) + np.nan_to_num(bv)),
        "t1430_volume_weighted_time_center_v1": (nan if not (whole and wsum) else 0.5 if not ages.any() else (v * ages).sum() / (v.sum() * ages.max())),
        "t1430_vwap_deviation_v1": (l - z.amount / some(z.volume)) / some(z.amount / some(z.volume)),
        "t1430_window_vwap_last_gap_v1": paid / wsum / l - 1 if wsum else nan,
        "t1430_amount_accel_30m_v1": (total - 2 * half) / total if len(w) > 1 and total > 0 else nan,
        "t1430_amount_intensity_v1": z.amount / (z["last"] * z.volume) if z.volume > 0 else nan,
        "t1430_cumulative_volume_ratio_v1": g[g["sec"] >= g["sec"].max() - 300].volume.sum() / w.volume.sum() if w.volume.sum() > 0 else nan,
        "t1430_depth_concentration_v1": tot / sum(z[f"{s}_volume{k}"] for s in ("bid", "ask") for k in range(1, 6)),
        "t1430_depth_imbalance_change_v1": lean(z) - lean(w.iloc[0]) if len(w) > 1 else nan,
        "aacb": ((ask - bid) / ((g.ask_price1 + g.bid_price1) / 2)).fillna(0).mean(),
        "t1430_amount_vol_ratio_v1": g.amount.sum() / (g.volume.sum() + 1e-8),
        "t1430_bid_ask_imbalance_v1": (bv - av) / tot,
        "t1430_bid_ask_spread_v1": (ap - bp) / mid,
        "t1430_close_position_v1": (z["last"] - z.low) / (z.high - z.low),
        "t1430_depth_pressure_return_v1": (z["last"] - 100) / 100 / tot,
        "t1430_depth_weighted_mid_v1": z["last"] - (bp * av + ap * bv) / tot,
        "t1430_liq_adj_spread_v1": (ap - bp) / (z["last"] * np.sqrt((0 if np.isnan(tot) else tot) + 1)),
        "t1430_micro_price_deviation_v1": (z["last"] - micro) / micro,
        "t1430_microprice_imbalance_v1": (micro - z["last"]) / z["last"],
        "t1430_microprice_mid_spread_v1": (micro - mid) / mid,
        "t1430_order_flow_imbalance_v1": (av - bv) / tot,
        "t1430_order_flow_toxicity_v1": abs(bv - av) / tot,
        "t1430_price_range_depth_ratio_v1": (z.high - z.low) / tot,
        "t1430_range_vol_norm_v1": (z.high - z.low) / z["last"] * np.log1p(z.volume),
        "t1430_relative_bid_ask_strength_v1": np.log(bp * bv) - np.log(ap * av),
        "t1430_relative_strength_v1": (z["last"] - 100) / 100,
        "t1430_spread_liquidity_ratio_v1": (ap - bp) / (tot * z["last"]),
        "t1430_spread_volatility_ratio_v1": (ap - bp) / (z.high - z.low),
        "t1430_last_return_30m_v1": z["last"] / w["last"].iloc[0] - 1 if len(w) > 1 else nan,
        "t1430_volume_count_v1": len(pos) or nan,
        "t1430_volume_cv_v1": pos.std(ddof=1) / pos.mean() if len(pos) > 1 else nan,
        "t1430_volume_entropy_v1": -(share * np.log(share)).sum() if len(pos) else nan,
        "t1430_volume_hhi_v2": (share**2).sum() if len(pos) else nan,
        "t1430_volume_gini_simple_v1": np.abs(pos[:, None] - pos[None]).mean() / (2 * pos.mean()) if len(pos) else nan,
        "t1430_volume_kurtosis_v1": pd.Series(v).kurt() if len(v) > 3 else nan,
        "t1430_volume_skewness_v1": pd.Series(v).skew() if len(v) > 2 else nan,
        "t1430_volume_max_tick_v1": pos.max() if len(pos) else nan,
        "t1430_volume_mean_v2": pos.mean() if len(pos) else nan,
        "t1430_volume_min_v2": pos.min() if len(pos) else nan,
        "t1430_volume_range_v1": np.ptp(pos) if len(pos) > 1 else nan,
        "t1430_volume_std_dev_v1": w["volume"].std(),
        "t1430_volume_std_dev_v2": pos.std(ddof=1) if len(pos) > 1 else nan,
        "t1430_volume_sum_v1": pos.sum() if len(pos) else nan,
        "t1430_volume_weighted_avg_size_v1": (v * v).sum() / v.sum() if v.sum() else nan,
    }


@pytest.fixture(scope="module")
def computed():
    p = panel()
    names = list(by_hand(p[p.code == "E"]))
    con = duckdb.connect()
    con.register("ticks", p)
    got = con.sql(grouped_sql(DUCKDB, names, "SELECT * FROM ticks")).df().set_index("code")
    return got, {c: by_hand(g) for c, g in p.groupby("code")}


@pytest.mark.parametrize("name", sorted(by_hand(panel()[lambda x: x.code == "E"])))
def test_factor_equals_its_definition(computed, name):
    got, want = computed
    for code, w in want.items():
        a, b = got.loc[code, name], w[name]
        missing = lambda x: x is None or pd.isna(x)
        assert (missing(a) or a == 0) if missing(b) or not np.isfinite(b) else a == pytest.approx(b, rel=1e-4, abs=2e-6), (code, a, b)


# --- neutralising


def cross_section(spark, values, codes):
    at = dt.datetime(2026, 1, 6, 14, 30)
    return spark.createDataFrame([(at, c, float(v)) for c, v in zip(codes, values)], "dt timestamp, code string, factor_x double")


CODES = [f"11000{i}.SH" for i in range(1, 6)]


def prices(spark):
    days = [(dt.date(2026, 1, 5), [100.0, 110.0, 120.0, 130.0, 140.0]), (dt.date(2026, 1, 6), [300.0, 280.0, 260.0, 240.0, 220.0])]
    rows = [(d, 110001.0 + i, "XSHG", p) for d, ps in days for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "trade_date date, instrument_code double, exchange_code string, cb_close_price double")
    return df.withColumn("code", neutral.standard_code())


def test_residuals_are_uncorrelated_with_the_price_of_the_day_before(spark):
    df = cross_section(spark, [200.1, 219.8, 240.05, 260.3, 279.75], CODES)
    src = prices(spark)
    assert sorted({r["code"] for r in src.collect()}) == CODES
    n = neutral.Neutraliser([neutral.Exposure("p", "daily", "cb_close_price", lag=1)], "ols", min_count=3)
    wide, found = n.with_exposures(df, {"daily": src}, src.select("trade_date").distinct())
    (name,) = found
    assert [r[name] for r in wide.orderBy("code").collect()] == [100.0, 110.0, 120.0, 130.0, 140.0]
    out = n.apply(df, ["factor_x"], {"daily": src}, src.select("trade_date").distinct()).orderBy("code").toPandas()
    assert abs(np.corrcoef(out.factor_x, [100, 110, 120, 130, 140])[0, 1]) < 1e-9 and abs(out.factor_x.mean()) < 1e-9


def test_absent_sources_short_days_and_partial_settings(spark):
    df = cross_section(spark, [1, 2, 3], CODES[:3])
    gone = neutral.Neutraliser([neutral.Exposure("p", "daily", "cb_close_price")], min_count=3)
    assert gone.apply(df, ["factor_x"]).toPandas().equals(df.toPandas())
    src = prices(spark)
    for missing, want in (("keep_original", [1.0, 2.0, 3.0]), ("nan", [None] * 3)):
        out = neutral.Neutraliser([neutral.Exposure("p", "daily", "cb_close_price")], missing=missing).apply(df, ["factor_x"], {"daily": src}).orderBy("code").toPandas()
        assert [None if pd.isna(x) else x for x in out.factor_x] == want
    for partial in ({"factors": ["factor_x"]}, {"exclude_factors": ["amount"]}):
        with pytest.raises(ValueError, match="partial neutralization is not supported"):
            neutral.Neutraliser([], **partial)


def test_panel_exposure_is_the_last_at_or_before_the_time(spark):
    at = dt.datetime(2026, 5, 20, 14, 30)
    t = lambda h, m, d=20: dt.datetime(2026, 5, d, h, m)
    rows = [("a", 0, t(14, 25), 100.0), ("a", 1, t(14, 29), 101.0), ("a", 2, t(14, 31), 999.0), ("b", 0, t(14, 20), 200.0), ("b", 1, t(14, 30), 201.0), ("b", 2, t(14, 31), 999.0), ("c", 0, t(15, 0, 19), 300.0)]
    df = spark.createDataFrame([(at, *r) for r in rows], "dt timestamp, code string, seq int, trade_time timestamp, last double")
    assert {r["code"]: r["value"] for r in neutral.last_before(df, "last").collect()} == {"a": 101.0, "b": 201.0, "c": 300.0}


def test_onehot_exposure_removes_group_means(spark):
    df = cross_section(spark, [1, 3, 10, 14, 18], CODES).withColumn("kind", neutral.F.substring("code", 6, 1).cast("int").cast("string"))
    df = df.withColumn("kind", neutral.F.when(neutral.F.col("kind").isin("1", "2"), "x").otherwise("y"))
    out = neutral.Neutraliser([neutral.Exposure("k", "factor", "kind", encoding="onehot")], "ols", min_count=3).apply(df, ["factor_x"]).orderBy("code").toPandas()
    assert np.allclose(out.factor_x, [-1, 1, -4, 0, 4])


# --- as-of join in buckets


def test_asof_join_in_buckets_equals_the_plain_one(spark):
    rng = np.random.default_rng(1)
    when = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(hours=int(i))
    left = spark.createDataFrame([(int(rng.integers(3)), when(rng.integers(3000)), i) for i in range(200)], "k int, t timestamp, id int")
    right = spark.createDataFrame([(int(rng.integers(3)), when(rng.integers(3000)), float(i), i) for i in range(60)], "k int, t timestamp, v double, o int")
    for strict in (False, True):
        a, b = (sorted(map(tuple, frames.asof_join(left, right, ["k"], "t", ["v"], strict=strict, right_order="o", bucket=x).collect())) for x in (None, "month"))
        assert list(map(str, a)) == list(map(str, b))
