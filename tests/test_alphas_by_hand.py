"""Every alpha factor against its definition in pandas, on short and long groups with ties, flat prices and gaps."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantloom.functions.alphas import ALPHAS
from quantloom.functions.dialect import DUCKDB, SPARK
from quantloom.plans.factors import alpha_sql

E = 1e-8
NAN = float("nan")
SIZES = {"A": 1, "B": 2, "C": 3, "D": 8, "E": 12, "F": 40, "G": 70, "H": 70, "I": 33}


def panel():
    """Groups of 1 to 70 ticks of two days: D has no book, F and H books with gaps, I one price, G and H missing volumes."""
    rng = np.random.default_rng(11)
    rows = []
    for day in (dt.date(2026, 1, 5), dt.date(2026, 1, 6)):
        for code, n in SIZES.items():
            price = 100.0
            for seq in range(1, n + 1):
                price = 100.0 if code == "I" else round(price + float(rng.normal(0, 1.5)), 1)
                vol = float(rng.integers(1, 9))
                r = {"dt": day, "code": code, "seq": seq, "last": price, "pre_close": 99.5, "open": round(price - float(rng.uniform(-1, 1)), 2)}
                r |= {"high": round(price + float(rng.uniform(0, 2)), 2), "low": round(price - float(rng.uniform(0, 2)), 2), "volume": vol, "amount": round(vol * (price + float(rng.uniform(-1, 1))), 3)}
                gap = code == "D" or (code in "FH" and seq % 7 == 0)
                r |= {"ask_price1": None if gap else price + 0.2, "bid_price1": None if gap else round(price - float(rng.uniform(0.1, 0.6)), 2)}
                if code in "GH" and seq == (n if code == "G" else 30):
                    r["volume"] = None
                rows.append(r)
    df = pd.DataFrame(rows)
    g = df.groupby(["dt", "code"])
    return df.assign(prev_bar_close=g["last"].shift().fillna(df["pre_close"]), n=g["seq"].transform("count"))


def pr(x):
    return x.rank(pct=True)


def roll(x, w, least=1):
    return x.rolling(max(least, w), min_periods=least)


def std(x, w):
    return roll(x, w, 2).std().fillna(0)


def corr(x, y, w):
    """Rolling correlation of pairs to nine decimals; none where a side is flat."""
    out = []
    for i in range(len(x)):
        p = pd.DataFrame({"x": x, "y": y}).iloc[max(0, i + 1 - w) : i + 1].dropna()
        flat = len(p) < 2 or p.x.std(ddof=0) <= 1e-9 or p.y.std(ddof=0) <= 1e-9
        out.append(NAN if flat else round(np.corrcoef(p.x, p.y)[0, 1], 9))
    return pd.Series(out, index=x.index, dtype=float)


def pair(x, y, w, what="corr"):
    p = pd.DataFrame({"x": x, "y": y}).dropna().iloc[-w:]
    if len(p) < 2:
        return 0.0
    if what == "cov":
        return round(np.cov(p.x, p.y)[0, 1], 9)
    return 0.0 if min(p.x.std(ddof=0), p.y.std(ddof=0)) <= E else round(np.corrcoef(p.x, p.y)[0, 1], 9)


def tsr(x, w):
    """Rank of each value among the w that end with it."""
    return x.rolling(w, min_periods=1).apply(lambda v: pd.Series(v).rank(pct=True).iloc[-1], raw=True).where(x.notna())


def tsr_end(x, w):
    known = x.iloc[-w:].dropna()
    return pr(known).iloc[-1] if len(known) else 0.0


def decay(x, w, eps=E):
    def one(v):
        k = np.arange(1, len(v) + 1)
        return np.nansum(v * k) / (k.sum() + eps)

    return x.rolling(w, min_periods=1).apply(one, raw=True)


def back(x, k):
    """Value k rows before the last, else the first."""
    return x.iloc[-1 - k] if len(x) > k else x.iloc[0]


def step(x, k=1):
    return x.iloc[-1] - x.iloc[-1 - k] if len(x) > k else 0.0


def known(x):
    return 0.0 if pd.isna(x) else x


def below(a, b, yes):
    return yes if a.iloc[-1] < b.iloc[-1] else 0.0


def place(x, w):
    return x.rolling(w, min_periods=1).apply(lambda v: np.argmax(v) + 1, raw=True)


def scale(x):
    return x / x.abs().sum() if x.abs().sum() > E else x * 0


def scalars(g):
    """By factor: a value of the group, or several that its cross-section is made from."""
    last, high, low, vol, amt, op = (g[c].astype(float) for c in ("last", "high", "low", "volume", "amount", "open"))
    book = (g.ask_price1 + g.bid_price1) / 2
    o, m1 = book.fillna(op), book if book.notna().any() else op
    r, vw, mid = (last - g.prev_bar_close) / (g.prev_bar_close + E), amt / (vol + E), (high + low) / 2
    adv = lambda w: roll(amt, w).mean()
    d = last.diff()
    gap = last - o

    def change(w):
        lo, hi = roll(d, w).min().iloc[-1], roll(d, w).max().iloc[-1]
        return known(d.iloc[-1]) if lo > 0 or hi < 0 else -known(d.iloc[-1])

    base = pd.Series(np.where(r < 0, std(r, 20), last), g.index)
    prod = roll(o, 5).sum() * roll((last - o) / (o + E), 5).sum()
    level = roll(last, 20).mean()
    rate = known((level.diff(20) / (level.shift(20) + E)).iloc[-1])
    trend = known((((last.shift(10) - last.shift(5)) - (last.shift(5) - last)) / 10).iloc[-1])
    logs = np.log(pr(-d).rolling(2, min_periods=1).min().abs() + E)
    scaled = (logs - logs.mean()) / (logs.abs().sum() + E)
    long, dev, short = roll(last, 5).mean().iloc[-1], std(last, 5).iloc[-1], roll(last, 2).mean().iloc[-1]
    lows = roll(low, 5).min()
    place_in = (last - roll(low, 12).min()) / (roll(high, 12).max() - roll(low, 12).min() + E)
    blend73, total = m1 * 0.147 + low * (1 - 0.147), lambda a, w: roll(adv(a), w).sum()
    sign = lambda a, b: known(np.sign(last.shift(a).iloc[-1] - last.shift(b).iloc[-1]))
    return {
        1: roll(np.sign(base) * base.abs() ** 2, 5).max().iloc[-1],
        2: -pair(pr(np.log(vol.clip(lower=0) + E).diff(2)), pr(gap / (o + E)), 6),
        3: -pair(pr(o), pr(vol), 10),
        4: -tsr_end(pr(low), 9),
        5: (o.iloc[-1] - roll(vw, 10).mean().iloc[-1], (last - vw).iloc[-1]),
        6: -pair(o, vol, 10),
        7: -1.0 if adv(20).iloc[-1] >= vol.iloc[-1] else -tsr_end(last.diff(7).abs(), 60) * np.sign(step(last, 7)),
        8: prod.iloc[-1] - back(prod, 10),
        9: change(5),
        10: change(4),
        11: (roll(vw - last, 3).max().iloc[-1], roll(vw - last, 3).min().iloc[-1], step(vol, 3)),
        12: np.sign(step(vol)) * -step(last),
        13: pair(pr(last), pr(vol), 5, "cov"),
        14: (step(r, 3), pair(o, vol, 10)),
        15: -pr(corr(pr(high), pr(vol), 3).fillna(0)).iloc[-3:].sum(),
        16: pair(pr(high), pr(vol), 5, "cov"),
        17: (tsr_end(last, 10), known(d.diff().iloc[-1]), tsr_end(vol / (adv(20) + E), 5)),
        18: std(gap.abs(), 5).iloc[-1] + gap.iloc[-1] + pair(last, o, 10),
        19: (np.sign(last.iloc[-1] - back(last, 7) + step(last, 7)), 1 + roll(r, 250).sum().iloc[-1]),
        20: tuple(o.iloc[-1] - back(x, 1) for x in (high, last, low)),
        21: -1.0 if long + dev < short else 1.0 if short < long - dev or vol.iloc[-1] / (adv(10).iloc[-1] + E) >= 1 else -1.0,
        22: (known(corr(high, vol, 5).diff(5).iloc[-1]), std(last, 10).iloc[-1]),
        23: -step(high, 2) if roll(high, 10).mean().iloc[-1] < high.iloc[-1] else 0.0,
        24: -(last.iloc[-1] - roll(last, 20).min().iloc[-1]) if rate <= 0.05 else -step(last, 3),
        25: (-r * adv(10) * vw * (high - last)).iloc[-1],
        26: -roll(corr(tsr(vol, 5), tsr(high, 5), 5), 3).max().iloc[-1],
        27: known(roll(corr(pr(vol), pr(vw), 6), 2).mean().iloc[-1]),
        28: pair(adv(10), low, 5) + mid.iloc[-1] - last.iloc[-1],
        29: roll(pr(scaled.round(12)), 5).min().iloc[-1] + tsr_end((-r).shift(3), 5),
        30: (sign(0, 1) + sign(1, 2) + sign(2, 3), roll(vol, 5).sum().iloc[-1] / (roll(vol, 10).sum().iloc[-1] + E)),
        31: (known(decay(-pr(last.diff(10)), 10, 0).iloc[-1]), -step(last, 3), pair(adv(10), low, 12)),
        32: roll(last, 7).mean().iloc[-1] - last.iloc[-1] + 20 * pair(vw, last.shift(5), 60),
        33: -(1 - o.iloc[-1] / (last.iloc[-1] + E)),
        34: (std(r, 2).iloc[-1] / (std(r, 5).iloc[-1] + E), step(last)),
        35: tsr_end(vol, 20) * (1 - tsr_end(last + high - low, 16)) * (1 - tsr_end(r, 20)),
        36: (pair(gap, vol.shift(), 15), -gap.iloc[-1], tsr_end((-r).shift(6), 5), abs(pair(vw, adv(10), 6)), (roll(last, 60).mean() - o).iloc[-1] * gap.iloc[-1]),
        37: (pair((-gap).shift(), last, 30), -gap.iloc[-1]),
        38: (tsr_end(last, 10), last.iloc[-1] / (o.iloc[-1] + E)),
        39: (step(last, 7) * (1 - tsr_end(vol / (adv(10) + E), 9)), 1 + roll(r, 60).sum().iloc[-1]),
        40: (std(high, 10).iloc[-1], pair(high, vol, 10)),
        41: (np.sqrt(high.clip(lower=0) * low.clip(lower=0)) - vw).iloc[-1],
        42: ((vw - last).iloc[-1], (vw + last).iloc[-1]),
        43: tsr_end(vol / (adv(10) + E), 10) * tsr_end(-last.diff(5), 5),
        44: -pair(high, pr(vol), 5),
        45: (roll(last.shift(5), 20).mean().iloc[-1], pair(last, vol, 2), pair(roll(last, 5).sum(), roll(last, 20).sum(), 2) + E),
        46: -1.0 if trend > 0.25 else 1.0 if trend < 0 else -step(last),
        47: (pr(1 / (last + E)) * vol / (adv(10) + E) * high * pr(high - last) / (roll(high, 5).mean() + E) - pr(vw - vw.shift(5))).iloc[-1],
        49: 1.0 if trend < -0.1 else -step(last),
        50: -roll(pr(corr(pr(vol), pr(vw), 5)), 5).max().iloc[-1],
        51: 1.0 if trend < -0.05 else -step(last),
        52: ((lows.shift(5) - lows) * pr(((roll(r, 60).sum() - roll(r, 20).sum()) / 40).round(12)) * tsr_end(vol, 5)).iloc[-1],
        53: -known((((last - low) - (high - last)) / (last - low + E)).diff(9).iloc[-1]),
        54: (-(low - last) * o**5 / ((low - high) * last**5 + E)).iloc[-1],
        55: -pair(pr(place_in), pr(vol), 6),
        57: -((last - vw) / (decay(pr(place(last, 10)), 2, 0) + E)).iloc[-1],
        60: ((((last - low) - (high - last)) / (high - low + E) * vol).iloc[-1], place(last, 10).iloc[-1]),
        62: below(pr(corr(vw, total(20, 22), 10)), pr((pr(m1) * 2 < pr(mid) + pr(high)).astype(float)), -1.0),
        65: below(pr(corr(m1 * 0.008 + vw * (1 - 0.008), total(30, 9), 6)), pr(m1 - roll(m1, 14).min()), -1.0),
        66: -(known(pr(decay(vw.diff(4), 7).round(12)).iloc[-1]) + tsr_end(decay((low * 0.966 + low * (1 - 0.966) - vw) / (m1 - mid + E), 11).round(12), 7)),
        68: below(pr(tsr(corr(pr(high), pr(adv(15)), 9).round(9), 14)), pr((last * 0.518 + low * (1 - 0.518)).diff()), -1.0),
        72: known(pr(decay(corr(mid, adv(20), 9).round(9), 10).round(12)).iloc[-1]) / (known(pr(decay(corr(tsr(vw, 4), tsr(vol, 19), 7).round(9), 3).round(12)).iloc[-1]) + E),
        73: -max(known(pr(decay(vw.diff(5), 3).round(12)).iloc[-1]), tsr_end(decay(-blend73.diff(2) / (blend73 + E), 3).round(12), 17)),
        74: below(pr(corr(last, total(20, 37), 15).round(9)), pr(corr(pr(high * 0.026 + vw * (1 - 0.026)), pr(vol), 11).round(9)), -1.0),
        75: below(pr(corr(vw, vol, 4).round(9)), pr(corr(pr(low), pr(adv(30)), 12).round(9)), 1.0),
        77: min(known(pr(decay(mid - vw, 10).round(12)).iloc[-1]), known(pr(decay(corr(mid, adv(20), 3).round(9), 6).round(12)).iloc[-1])),
        78: known(pr(corr(roll(low * 0.352 + vw * (1 - 0.352), 20).sum(), total(20, 20), 7).round(9)).iloc[-1]) ** known(pr(corr(pr(vw), pr(vol), 6).round(9)).iloc[-1]),
    }


#: By factor: what the cross-section of one time does with the values, ranked (q) or not (v).
ACROSS = {
    1: lambda q, v: q[0] - 0.5,
    5: lambda q, v: -q[0] * q[1],
    8: lambda q, v: -q[0],
    10: lambda q, v: q[0],
    11: lambda q, v: (q[0] + q[1]) * q[2],
    13: lambda q, v: -q[0],
    14: lambda q, v: -q[0] * v[1],
    16: lambda q, v: -q[0],
    17: lambda q, v: -q[0] * q[1] * q[2],
    18: lambda q, v: -q[0],
    19: lambda q, v: -v[0] * (1 + q[1]),
    20: lambda q, v: -q[0] * q[1] * q[2],
    22: lambda q, v: -v[0] * q[1],
    25: lambda q, v: q[0],
    27: lambda q, v: pd.Series(np.where(q[0] > 0.5, -1.0, 1.0), q[0].index),
    28: lambda q, v: q[0],
    30: lambda q, v: (1 - q[0]) * v[1],
    31: lambda q, v: q[0] + q[1] + np.sign(q[2] - 0.5),
    32: lambda q, v: q[0],
    33: lambda q, v: q[0],
    34: lambda q, v: 2 - q[0] - q[1],
    36: lambda q, v: 2.21 * q[0] + 0.7 * q[1] + 0.73 * q[2] + q[3] + 0.6 * q[4],
    37: lambda q, v: q[0] + q[1],
    38: lambda q, v: -q[0] * q[1],
    39: lambda q, v: -q[0] * (1 + q[1]),
    40: lambda q, v: -q[0] * v[1],
    42: lambda q, v: q[0] / (q[1] + E),
    45: lambda q, v: -q[0] * v[1] * q[2],
    60: lambda q, v: -(2 * pr(scale(q[0]).round(12)) - scale(q[1])),
}


def by_hand(p):
    rows = {key: scalars(g.reset_index(drop=True)) for key, g in p.groupby(["dt", "code"])}
    out = {}
    for k in next(iter(rows.values())):
        values = pd.DataFrame({key: np.atleast_1d(v[k]) for key, v in rows.items()}).T.astype(float)
        ranked = values.groupby(level=0).rank(pct=True)
        one = lambda i: ACROSS[k](ranked.loc[i], values.loc[i]) if k in ACROSS else values.loc[i][0]  # noqa: B023, E731
        out[k] = pd.concat({i: one(i) for i in values.index.levels[0]})
    return pd.DataFrame(out).replace([np.inf, -np.inf], np.nan).fillna(0.0)


NAMES = sorted(ALPHAS)


@pytest.fixture(scope="module")
def tables(spark):
    p = panel()
    con = duckdb.connect()
    con.register("ticks", p)
    duck = con.sql(alpha_sql(DUCKDB, NAMES, "SELECT * FROM ticks")).df()
    spark.createDataFrame(p.astype(object).where(p.notna(), None), "dt date, code string, seq long, last double, pre_close double, open double, high double, low double, volume double, amount double, ask_price1 double, bid_price1 double, prev_bar_close double, n long").createOrReplaceTempView("ticks_by_hand")
    got = [pd.concat([spark.sql(alpha_sql(SPARK, NAMES[i : i + 11], "SELECT * FROM ticks_by_hand")).toPandas().set_index(["dt", "code"]) for i in range(0, len(NAMES), 11)], axis=1), duck.set_index(["dt", "code"])]
    want = by_hand(p)
    want.index = pd.MultiIndex.from_tuples([(str(d), c) for d, c in want.index])
    return got, want


@pytest.mark.parametrize("name", NAMES)
def test_alpha_equals_its_definition(tables, name):
    for got in tables[0]:
        want = tables[1][int(name[5:8])]
        np.testing.assert_allclose(got[name].reindex(want.index).to_numpy(float), want.to_numpy(), rtol=2e-4, atol=3e-6)
