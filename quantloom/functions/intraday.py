"""Microstructure and window factors as group expressions: classic, T1430 and the parameterised composite.

Every function takes (g, c) and its parameters with their defaults. Classic factors mostly turn missing
results into 0 (those registered with zero=True); the others leave them missing.
"""

from __future__ import annotations

from collections.abc import Callable

from quantloom.functions.grouped import Grouped
from quantloom.functions.series import EPS, X, absolute, fill, join, log, root, sign, where

CLASSIC: dict[str, Callable[..., X]] = {}
T1430: dict[str, Callable[..., X]] = {}
#: Factors with 0 for missing results.
ZERO: set[str] = set()


def classic(f=None, *, zero=True):
    """Registers a classic factor."""
    if f is None:
        return lambda g: classic(g, zero=zero)
    CLASSIC[f.__name__] = f
    if zero:
        ZERO.add(f.__name__)
    return f


def t1430(f):
    """Registers a T1430 factor; missing results stay missing."""
    T1430[f.__name__] = f
    return f


class Book:
    """Base columns, window conditions and quantities that many factors share."""

    def __init__(self, g: Grouped) -> None:
        self.g = g
        c = g.s.col
        self.c = c
        self.last, self.high, self.low, self.pre, self.prev = c("last"), c("high"), c("low"), c("pre_close"), c("prev_bar_close")
        self.vol, self.amt, self.trades, self.sec = c("volume"), c("amount"), c("num_trades"), c("sec")
        self.ap, self.bp, self.av, self.bv = c("ask_price1"), c("bid_price1"), c("ask_volume1"), c("bid_volume1")
        self.mid = (self.ap + self.bp) / 2
        self.open = join("coalesce({0}, {1})", self.mid, c("open"))
        self.micro = (self.bp * self.av + self.ap * self.bv) / (self.bv + self.av)

    def within(self, minutes: int) -> X:
        """Rows of the last minutes, both ends included; all rows for 0 or less."""
        return X(f"(sec >= end_sec - {int(minutes) * 60})") if minutes and minutes > 0 else X("(sec >= start_sec)")

    def levels(self, side: str, n: int, missing: float | None = None) -> X:
        """Sum of the first n levels; without a value for missing levels, missing where one is."""
        every = [self.c(f"{side}{k}") if missing is None else fill(self.c(f"{side}{k}"), missing) for k in range(1, n + 1)]
        out = every[0]
        for x in every[1:]:
            out = out + x
        return out


def given(cond: X, x: X) -> X:
    """x where the condition holds, else missing."""
    return join("(case when {0} then {1} end)", cond, x)


def both(*conds: X) -> X:
    return join("(" + " and ".join(f"{{{i}}}" for i in range(len(conds))) + ")", *conds)


# --- classic


@classic
def aacb(g, b, levels=3):
    ask, bid = b.levels("ask_price", levels) / levels, b.levels("bid_price", levels) / levels
    return g.mean(fill(where(absolute(b.mid) <= EPS, 0, (ask - bid) / b.mid)))


@classic
def amihud_illiq(g, b, window_minutes=30):
    w = b.within(window_minutes)
    f, l, a = g.first(b.last, w), g.last(b.last, w), g.sum(b.amt, w)
    return given(both(f > 0, a > 0), absolute((l - f) / f) / a)


@classic
def amount_sum(g, b, window_minutes=30):
    return g.sum(b.amt, b.within(window_minutes))


@classic
def bid_ask_spread_v1(g, b):
    return g.last((b.ap - b.bp) / (b.mid + 1e-8))


@classic
def depth_imbalance(g, b, levels=3):
    bid, ask = b.levels("bid_volume", levels, 0.0), b.levels("ask_volume", levels, 0.0)
    return g.last(given(bid + ask > 0, (bid - ask) / (bid + ask)))


def _book_slope(b, side, levels):
    up, weight = None, None
    for k in range(1, levels):
        mean = (b.c(f"{side}_volume{k}") + b.c(f"{side}_volume{k + 1}")) / 2
        term = absolute(b.c(f"{side}_price{k + 1}") - b.c(f"{side}_price{k}")) * mean
        up, weight = (term, mean) if up is None else (up + term, weight + mean)
    return where(weight <= 0, 0, up / weight)


@classic
def depth_slope(g, b, levels=5):
    return g.last(given(b.mid > 0, (_book_slope(b, "ask", levels) - _book_slope(b, "bid", levels)) / b.mid))


@classic
def depth_weighted_imbalance_v1(g, b, weights=(5, 4, 3, 2, 1)):
    bid = ask = None
    for k, w in enumerate(weights, 1):
        x, y = b.c(f"bid_volume{k}") * w, b.c(f"ask_volume{k}") * w
        bid, ask = (x, y) if bid is None else (bid + x, ask + y)
    return g.last((bid - ask) / (bid + ask + 1e-8))


@classic
def intraday_momentum_v1(g, b):
    return g.last((b.last - b.open) / (b.open + 1e-8))


@classic
def microprice_bias(g, b):
    ok = both(b.ap > 0, b.bp > 0, b.bv + b.av > 0)
    return g.last(given(ok, (b.micro - b.mid) / b.mid))


@classic(zero=False)
def microprice_dev_liquidity_v1(g, b):
    return g.last(given(both(b.ap > 0, b.bp > 0), where(b.bv + b.av <= 0, 0, b.last - b.micro)))


@classic
def microprice_deviation_liq_cond_v1(g, b):
    depth = b.bv + b.av
    return g.last(where(depth <= 0, 0, (b.last - b.micro) / (depth + 1e-8)))


@classic(zero=False)
def microprice_deviation_liq_v1(g, b):
    depth = b.bv + b.av
    return g.last(given(both(b.last > 0, b.vol > 0, depth > 0), (b.last - b.micro) / b.last * (depth / b.vol)))


@classic(zero=False)
def microprice_deviation_v1(g, b):
    return g.last(given(both(b.ap > 0, b.bp > 0, b.bv + b.av > 0), (b.last - b.micro) / b.micro))


@classic
def midprice_move(g, b, window_minutes=30):
    w = b.within(window_minutes)
    f, l = g.first(b.mid, w), g.last(b.mid, w)
    return (l - f) / f


@classic
def mom_slope(g, b, window_minutes=30):
    return g.slope(b.last, b.sec, b.within(window_minutes))


@classic(zero=False)
def ob_pressure_spread_persistence_v1(g, b):
    ok = both(b.last > 0, b.ap - b.bp >= 0, b.av + b.bv > 0)
    return g.last(given(ok, (b.ap - b.bp) / b.last * -((b.av - b.bv) / (b.av + b.bv))))


@classic(zero=False)
def ob_pressure_spread_recovery_v1(g, b):
    ok = both(b.last > 0, b.ap > 0, b.bp > 0, b.av >= 0, b.bv >= 0)
    return g.last(given(ok, (b.ap - b.bp) / b.last * ((b.bv - b.av) / (b.bv + b.av + 1e-8))))


@classic(zero=False)
def ob_pressure_spread_v1(g, b):
    ok = both(b.ap > 0, b.bp > 0, b.av >= 0, b.bv >= 0, b.ap - b.bp >= 0)
    return g.last(given(ok, (b.bv - b.av) / (b.bv + b.av + 1e-8) / ((b.ap - b.bp) / b.mid + 1e-8)))


@classic
def order_flow_imbalance_v1(g, b):
    return g.last((b.bv - b.av) / (b.bv + b.av + 1e-8))


@classic
def price_level_position_v1(g, b):
    return g.last(given(b.high > b.low, (b.last - b.low) / (b.high - b.low + 1e-8)))


@classic
def price_position(g, b, window_minutes=30):
    w = b.within(window_minutes)
    lo, hi = g.min(b.last, w), g.max(b.last, w)
    return given(hi > lo, (g.last(b.last, w) - lo) / (hi - lo))


@classic
def range_ratio(g, b, window_minutes=30):
    w = b.within(window_minutes)
    return (g.max(b.last, w) - g.min(b.last, w)) / g.last(b.last, w)


@classic
def ret_open_to_time(g, b, start_sec=0, end_sec=5400):
    """start_sec and end_sec: seconds of the panel's clock, both included."""
    w = X(f"(sec between {int(start_sec)} and {int(end_sec)})")
    f, l = g.first(b.last, w), g.last(b.last, w)
    return (l - f) / f


@classic
def ret_window(g, b, window_minutes=30):
    w = b.within(window_minutes)
    f, l = g.first(b.last, w), g.last(b.last, w)
    return (l - f) / f


def _returns(g, b, window_minutes, use_log_return):
    """Row returns within the window: the first row of the window has none."""
    p = given(b.within(window_minutes), b.last)
    before = g.s.lag(p, 1)
    return log(p / before) if use_log_return else p / before - 1


@classic
def return_skew(g, b, window_minutes=30, use_log_return=True):
    return _skew(g, _returns(g, b, window_minutes, use_log_return))


def _moments(g, x):
    d = x - g.s.whole("avg", x)
    return g.count(x), g.sum(d * d), g.sum(d * d * d), g.sum(d * d * d * d)


def _skew(g, x):
    """Bias-corrected skewness; missing below three values, 0 where flat."""
    n, s2, s3, _ = _moments(g, x)
    m2 = s2 / n
    return given(n >= 3, where(m2 > 1e-14, root(n * (n - 1)) / (n - 2) * (s3 / n) / (m2 * root(m2)), 0))


def _kurtosis(g, x):
    """Bias-corrected excess kurtosis; missing below four values, 0 where flat."""
    n, s2, _, s4 = _moments(g, x)
    adj = 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    top = n * (n + 1) * (n - 1) * s4
    return given(n >= 4, where(s2 > 1e-14, top / ((n - 2) * (n - 3) * s2 * s2) - adj, 0))


@classic
def spread(g, b):
    return g.last((b.ap - b.bp) / b.mid)


@classic(zero=False)
def spread_depth_pressure_v1(g, b):
    return g.last(given(both(b.last > 0, b.vol > 0), -((b.ap - b.bp) / b.last) * ((b.av + b.bv) / b.vol)))


@classic(zero=False)
def tail_volume_absorption_v1(g, b):
    ok = both(b.pre > 0, b.last > 0, b.vol >= 0)
    return g.mean(b.vol / (absolute(b.last - b.pre) / (b.pre + 1e-8) + 1e-8), ok)


@classic
def trade_intensity_v1(g, b):
    return g.last(b.amt / (b.trades + 1e-8) / (b.prev + 1e-8))


@classic
def turnover_rate(g, b, window_minutes=30):
    w = b.within(window_minutes)
    shares = g.last(b.trades, w)
    return given(shares > 0, g.sum(b.vol, w) / shares)


@classic
def volatility(g, b, window_minutes=30, use_log_return=True):
    return g.std(_returns(g, b, window_minutes, use_log_return))


@classic
def volatility_scaled_return_v1(g, b):
    rng = (b.high - b.low) / (b.prev + 1e-8)
    return g.last(given(rng > 0, (b.last - b.open) / (b.open + 1e-8) / (rng + 1e-8)))


@classic
def volen(g, b, levels=5, fast=60, slow=10):
    depth = b.levels("bid_volume", levels) + b.levels("ask_volume", levels)
    tail = lambda k: X(f"(seq > n - {int(k)})")
    base = g.mean(depth, tail(slow))
    return given(both(g.count(depth, tail(fast)) >= fast, g.count(depth, tail(slow)) >= slow, absolute(base) > EPS), g.mean(depth, tail(fast)) / base)


@classic
def volume_imbalance(g, b, window_minutes=30, levels=3):
    w = b.within(window_minutes)
    bid, ask = g.sum(b.levels("bid_volume", levels, 0.0), w), g.sum(b.levels("ask_volume", levels, 0.0), w)
    return given(bid + ask > 0, (bid - ask) / (bid + ask))


@classic
def volume_price_trend_v1(g, b):
    return g.last((b.last - b.prev) / (b.prev + 1e-8) * b.amt)


@classic
def volume_sum(g, b, window_minutes=30):
    return g.sum(b.vol, b.within(window_minutes))


@classic
def vwap(g, b, window_minutes=30):
    w = b.within(window_minutes)
    v = g.sum(b.vol, w)
    return given(v > 0, g.sum(b.amt, w) / v)


@classic(zero=False)
def vwap_deviation_liquidity_cond_v1(g, b):
    whole = join("({0} is not null and {1} is not null and {2} is not null)", b.last, b.vol, b.amt)
    v = g.sum(b.vol, whole)
    p = given(v > 0, g.sum(b.amt, whole) / v)
    return given(p > 0, (g.last(b.last, whole) - p) / p * log(g.last(b.amt, whole) + 1))


@classic
def vwap_gap(g, b, window_minutes=30):
    w = b.within(window_minutes)
    v = g.sum(b.vol, w)
    p = given(v > 0, g.sum(b.amt, w) / v)
    return given(p > 0, (g.last(b.last, w) - p) / p)


# --- T1430


@t1430
def t1430_amount_accel_30m_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    m = g.s.whole("sum", where(w, 1, 0))
    head = join("({0} and seq <= n - {1} + floor({1} / 2))", w, m)
    one, all_ = g.sum(b.amt, head), g.sum(b.amt, w)
    return given(both(g.count(X("seq"), w) >= 2, all_ > 0), (all_ - fill(one) - fill(one)) / all_)


@t1430
def t1430_amount_intensity_v1(g, b):
    return g.last(given(b.last * b.vol > 0, b.amt / (b.last * b.vol)))


@t1430
def t1430_amount_vol_ratio_v1(g, b):
    return g.sum(b.amt) / (g.sum(b.vol) + 1e-8)


def _imbalance(b):
    return (b.bv - b.av) / (b.bv + b.av)


@t1430
def t1430_bid_ask_imbalance_v1(g, b):
    return g.last(_imbalance(b))


@t1430
def t1430_bid_ask_spread_v1(g, b):
    return g.last((b.ap - b.bp) / b.mid)


@t1430
def t1430_close_position_v1(g, b):
    return g.last((b.last - b.low) / (b.high - b.low))


@t1430
def t1430_close_range_position_v1(g, b):
    return (g.last(b.last) - g.min(b.low)) / (g.max(b.high) - g.min(b.low) + EPS)


@t1430
def t1430_cumulative_volume_ratio_v1(g, b, window_minutes=30, tail_minutes=5):
    v = g.sum(b.vol, b.within(window_minutes))
    return given(v > 0, fill(g.sum(b.vol, b.within(tail_minutes))) / v)


@t1430
def t1430_depth_concentration_v1(g, b):
    depth = b.levels("bid_volume", 5) + b.levels("ask_volume", 5)
    return g.last(given(depth > 0, (b.bv + b.av) / depth))


@t1430
def t1430_depth_imbalance_change_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    bid, ask = b.levels("bid_volume", 3), b.levels("ask_volume", 3)
    x = given(bid + ask > 0, (bid - ask) / (bid + ask))
    return given(g.count(X("seq"), w) >= 2, g.last(x, w) - g.first(x, w))


@t1430
def t1430_depth_pressure_return_v1(g, b):
    return g.last((b.last - b.pre) / b.pre / (b.bv + b.av))


@t1430
def t1430_depth_weighted_mid_v1(g, b):
    return g.last(b.last - b.micro)


@t1430
def t1430_last_return_30m_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    return given(g.count(b.last, w) >= 2, g.last(b.last, w) / g.first(b.last, w) - 1)


@t1430
def t1430_liq_adj_spread_v1(g, b):
    return g.last(given(b.last > 0, (b.ap - b.bp) / (b.last * root(fill(b.bv + b.av) + 1))))


@t1430
def t1430_micro_price_deviation_v1(g, b):
    return g.last((b.last - b.micro) / b.micro)


@t1430
def t1430_microprice_imbalance_v1(g, b):
    return g.last((b.micro - b.last) / b.last)


@t1430
def t1430_microprice_last_gap_v1(g, b):
    return g.last(given(both(b.av > 0, b.bv > 0, b.last > 0), b.micro / b.last - 1))


@t1430
def t1430_microprice_liquidity_v1(g, b):
    gap = b.ap - b.bp
    return g.last(given(both(b.av > 0, b.bv > 0), (b.micro - b.mid) / gap / (gap * b.vol)))


@t1430
def t1430_microprice_mid_deviation_v1(g, b):
    m = b.bp + (b.ap - b.bp) * b.bv / (b.bv + b.av)
    return g.last((b.last - m) / m)


@t1430
def t1430_microprice_mid_spread_v1(g, b):
    return g.last((b.micro - b.mid) / b.mid)


@t1430
def t1430_microprice_midpoint_dev_v1(g, b):
    return g.last((b.last - b.micro) / b.micro)


@t1430
def t1430_mid_price_return_v1(g, b):
    return g.mean((b.mid - b.pre) / b.pre)


@t1430
def t1430_mid_return_30m_v1(g, b, window_minutes=30):
    w, mid = b.within(window_minutes), given(both(b.ap > 0, b.bp > 0), b.mid)
    return g.last(mid, w) / g.first(mid, w) - 1


@t1430
def t1430_ob_imbalance_flow_v1(g, b):
    return g.last(_imbalance(b) * (join("nullif({0}, 0)", b.vol) / (b.bv + b.av)))


@t1430
def t1430_order_flow_imbalance_v1(g, b):
    return g.last(-_imbalance(b))


@t1430
def t1430_order_flow_toxicity_v1(g, b):
    return g.last(absolute(b.bv - b.av) / (b.bv + b.av))


@t1430
def t1430_order_imbalance_v1(g, b):
    return g.last(_imbalance(b))


@t1430
def t1430_orderflow_imbalance_v1(g, b):
    return g.last(given(b.av + b.bv > 0, -_imbalance(b)))


@t1430
def t1430_price_range_30m_v1(g, b, window_minutes=30):
    w = both(b.within(window_minutes), b.last > 0)
    return (g.max(b.last, w) - g.min(b.last, w)) / g.last(b.last, w)


@t1430
def t1430_price_range_depth_ratio_v1(g, b):
    return g.last((b.high - b.low) / (b.bv + b.av))


def _some(x):
    """1e-8 in place of 0."""
    return where(join("({0} = 0)", x), 1e-8, x)


@t1430
def t1430_pv_interaction_v1(g, b):
    return g.last((b.last - b.low) / _some(b.high - b.low) * (b.amt / _some(b.vol * b.last)))


@t1430
def t1430_pv_ratio_v1(g, b):
    lo, hi, v = g.min(b.low), g.max(b.high), g.sum(b.vol)
    price = where(v > 0, g.sum(b.amt) / v, g.last(b.last))
    return (g.last(b.last) - lo) / where(hi - lo <= 0, 1e-8, hi - lo) * (fill(v) / where(price <= 0, 1e-8, price))


@t1430
def t1430_range_norm_volume_v1(g, b):
    return g.sum(b.vol) / ((g.max(b.high) - g.min(b.low)) / g.last(b.last) + EPS)


@t1430
def t1430_range_vol_norm_v1(g, b):
    return g.last((b.high - b.low) / b.last * log(b.vol + 1))


@t1430
def t1430_range_volume_norm_v1(g, b):
    return g.last(given(both(b.last > 0, b.high >= b.low), (b.high - b.low) / b.last * log(b.vol + 1)))


@t1430
def t1430_range_volume_v1(g, b):
    return g.last(given(both(b.last > 0, b.high >= b.low), (b.high - b.low) / b.last * b.vol))


@t1430
def t1430_relative_bid_ask_strength_v1(g, b):
    return g.last(log(b.bp * b.bv) - log(b.ap * b.av))


@t1430
def t1430_relative_strength_v1(g, b):
    return g.last((b.last - b.pre) / b.pre)


def _whole_gap(g, b):
    p = g.sum(b.amt) / g.sum(b.vol)
    return (g.last(b.last) - p) / p


@t1430
def t1430_relative_strength_vwap_v1(g, b):
    return given(both(absolute(g.last(b.vol)) > 0, g.last(b.amt) >= 0), _whole_gap(g, b))


@t1430
def t1430_spread_change_30m_v1(g, b, window_minutes=30):
    w = both(b.within(window_minutes), b.ap > 0, b.bp > 0, b.last > 0, b.ap >= b.bp)
    x = (b.ap - b.bp) / b.last
    return given(g.count(x, w) >= 2, g.last(x, w) - g.first(x, w))


@t1430
def t1430_spread_liquidity_ratio_v1(g, b):
    return g.last((b.ap - b.bp) / ((b.bv + b.av) * b.last))


@t1430
def t1430_spread_mean_guarded_30m_v1(g, b, window_minutes=30):
    return g.mean((b.ap - b.bp) / b.last, both(b.within(window_minutes), b.ap > 0, b.bp > 0, b.last > 0, b.ap >= b.bp))


@t1430
def t1430_spread_volatility_ratio_v1(g, b):
    return g.last((b.ap - b.bp) / (b.high - b.low))


@t1430
def t1430_spread_width_norm_v1(g, b):
    return g.mean((b.ap - b.bp) / b.mid)


@t1430
def t1430_tail_pressure_v1(g, b):
    return g.last((b.last - b.low) / _some(b.high - b.low) * (b.vol / _some(b.amt / b.last)))


@t1430
def t1430_vol_turnover_ratio_v1(g, b):
    return g.sum(b.vol) / (g.sum(b.amt) / g.last(b.last))


@t1430
def t1430_volatility_turnover_v1(g, b):
    return (g.max(b.high) - g.min(b.low)) / g.last(b.last) * (g.sum(b.amt) / (g.sum(b.vol) * g.last(b.last) + EPS))


def _total(g, b, w):
    """Volume of the window and its least value."""
    return g.sum(b.vol, w), g.min(b.vol, w)


def _whole_volumes(g, b, w, least: int) -> X:
    """Whether the window has so many rows, and a volume in each."""
    return both(g.count(X("seq"), w) >= least, g.count(b.vol, w) >= g.count(X("seq"), w))


def _cumulative_slope(g, b, w):
    v = given(w, b.vol)
    total = g.s._over(f"sum({v.text})", v, " ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    return g.slope(total, X("seq"), w)


@t1430
def t1430_volume_acceleration_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    v, lo = _total(g, b, w)
    return given(both(_whole_volumes(g, b, w, 2), lo > 0), _cumulative_slope(g, b, w) / v)


@t1430
def t1430_volume_autocorrelation_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    x = given(w, b.vol)
    d = x - g.s.whole("avg", x)
    n, s2 = g.count(x), g.sum(d * d)
    return given(both(_whole_volumes(g, b, w, 3), g.min(x) >= 0), g.sum(d * g.s.lag(d, 1)) / (n - 1) / (s2 / n))


def _gini(g, b, cond):
    x = given(cond, b.vol)
    place = g.s._window(f"row_number() OVER (PARTITION BY dt, code ORDER BY {x.text} NULLS LAST, seq)", 0, x.depth)
    n, v = g.count(x), g.sum(x)
    return n, v, (2 * g.sum(x * place) - (n + 1) * v) / (n * v)


@t1430
def t1430_volume_concentration_gini_v1(g, b, window_minutes=30):
    n, v, x = _gini(g, b, both(b.within(window_minutes), b.vol > 0))
    return given(n >= 2, x)


@t1430
def t1430_volume_concentration_hhi_v1(g, b, window_minutes=30):
    return _hhi(g, b, both(b.within(window_minutes), b.vol > 0))


def _hhi(g, b, cond):
    v = g.sum(b.vol, cond)
    return given(v > 0, g.sum(b.vol * b.vol, cond) / (v * v))


def _positive(g, b, window_minutes):
    return both(b.within(window_minutes), b.vol > 0)


def _count(g, b, window_minutes=30):
    n = g.count(b.vol, _positive(g, b, window_minutes))
    return given(n > 0, n)


@t1430
def t1430_volume_count_v1(g, b, window_minutes=30):
    return _count(g, b, window_minutes)


@t1430
def t1430_volume_count_v2(g, b, window_minutes=30):
    return _count(g, b, window_minutes)


@t1430
def t1430_volume_count_v3(g, b, window_minutes=30):
    return _count(g, b, window_minutes)


@t1430
def t1430_volume_cumsum_slope_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    return given(_whole_volumes(g, b, w, 3), _cumulative_slope(g, b, w))


@t1430
def t1430_volume_cumsum_v1(g, b, window_minutes=30):
    v, lo = _total(g, b, b.within(window_minutes))
    return given(both(lo >= 0, v > 0), v)


@t1430
def t1430_volume_cv_v1(g, b, window_minutes=30):
    w = _positive(g, b, window_minutes)
    return given(g.count(b.vol, w) >= 2, g.std(b.vol, w) / g.mean(b.vol, w))


def _entropy(g, b, window_minutes):
    w = _positive(g, b, window_minutes)
    v = g.sum(b.vol, w)
    return given(v > 0, log(v) - g.sum(b.vol * log(b.vol), w) / v)


@t1430
def t1430_volume_entropy_v1(g, b, window_minutes=30):
    return _entropy(g, b, window_minutes)


@t1430
def t1430_volume_entropy_v2(g, b, window_minutes=30):
    return _entropy(g, b, window_minutes)


@t1430
def t1430_volume_gini_coefficient_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    _, v, x = _gini(g, b, w)
    return given(both(_whole_volumes(g, b, w, 2), g.min(b.vol, w) >= 0, v > 0), x)


@t1430
def t1430_volume_gini_simple_v1(g, b, window_minutes=30):
    n, v, x = _gini(g, b, both(b.within(window_minutes), b.vol > 0))
    return given(both(n >= 2, v > 0), x)


@t1430
def t1430_volume_hhi_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    return given(both(_whole_volumes(g, b, w, 2), g.min(b.vol, w) > 0), _hhi(g, b, w))


@t1430
def t1430_volume_hhi_v2(g, b, window_minutes=30):
    return _hhi(g, b, _positive(g, b, window_minutes))


@t1430
def t1430_volume_kurtosis_v1(g, b, window_minutes=30):
    return _kurtosis(g, given(b.within(window_minutes), b.vol))


@t1430
def t1430_volume_max_tick_v1(g, b, window_minutes=30):
    return g.max(b.vol, _positive(g, b, window_minutes))


@t1430
def t1430_volume_max_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    m = g.max(b.vol, w)
    return given(both(g.min(b.vol, w) >= 0, m > 0), m)


@t1430
def t1430_volume_max_v2(g, b, window_minutes=30):
    return g.max(b.vol, _positive(g, b, window_minutes))


@t1430
def t1430_volume_mean_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    m = g.mean(b.vol, w)
    return given(both(g.min(b.vol, w) >= 0, m > 0), m)


@t1430
def t1430_volume_mean_v2(g, b, window_minutes=30):
    return g.mean(b.vol, _positive(g, b, window_minutes))


@t1430
def t1430_volume_min_v1(g, b, window_minutes=30):
    return g.min(b.vol, _positive(g, b, window_minutes))


@t1430
def t1430_volume_min_v2(g, b, window_minutes=30):
    return g.min(b.vol, _positive(g, b, window_minutes))


@t1430
def t1430_volume_moment_v1(g, b, window_minutes=30):
    return g.mean(b.vol, _positive(g, b, window_minutes))


@t1430
def t1430_volume_momentum_v1(g, b, window_minutes=30):
    v = g.sum(b.vol, b.within(window_minutes))
    return given(v > 0, v)


@t1430
def t1430_volume_range_v1(g, b, window_minutes=30):
    w = _positive(g, b, window_minutes)
    return given(g.count(b.vol, w) >= 2, g.max(b.vol, w) - g.min(b.vol, w))


@t1430
def t1430_volume_recent_share_v1(g, b, window_minutes=30, tail_minutes=1):
    v = g.sum(b.vol, b.within(window_minutes))
    return given(v > 0, fill(g.sum(b.vol, X(f"(sec > end_sec - {int(tail_minutes) * 60})"))) / v)


@t1430
def t1430_volume_skewness_v1(g, b, window_minutes=30):
    return _skew(g, given(b.within(window_minutes), b.vol))


@t1430
def t1430_volume_std_dev_v1(g, b, window_minutes=30):
    return g.std(b.vol, b.within(window_minutes))


@t1430
def t1430_volume_std_dev_v2(g, b, window_minutes=30):
    return g.std(b.vol, _positive(g, b, window_minutes))


@t1430
def t1430_volume_sum_v1(g, b, window_minutes=30):
    return g.sum(b.vol, _positive(g, b, window_minutes))


@t1430
def t1430_volume_weighted_avg_size_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    v = g.sum(b.vol, w)
    return given(both(_whole_volumes(g, b, w, 1), v > 0), g.sum(b.vol * b.vol, w) / v)


@t1430
def t1430_volume_weighted_mid_v1(g, b):
    a, v = fill(b.av), fill(b.bv)
    return g.last((b.bp * a + b.ap * v) / (a + v))


@t1430
def t1430_volume_weighted_price_deviation_v1(g, b):
    return given(both(g.last(b.vol) >= 0, g.last(b.amt) >= 0), _whole_gap(g, b))


@t1430
def t1430_volume_weighted_time_center_v1(g, b, window_minutes=30):
    w = b.within(window_minutes)
    v, s, lo, hi = g.sum(b.vol, w), g.sum(b.vol * b.sec, w), g.min(b.sec, w), g.max(b.sec, w)
    return given(both(_whole_volumes(g, b, w, 1), v > 0), where(hi <= lo, 0.5, (s - v * lo) / (v * (hi - lo))))


@t1430
def t1430_vwap_deviation_v1(g, b):
    p = b.amt / _some(b.vol)
    return g.last((b.last - p) / _some(p))


@t1430
def t1430_window_vwap_last_gap_v1(g, b):
    w = b.within(30)
    v, l = g.sum(b.vol, w), g.last(b.last, w)
    return given(both(v > 0, l > 0), g.sum(b.amt, w) / v / l - 1)


# --- the parameterised composite


def _composite_metrics(g: Grouped, b: Book, window: int, recent: int, level: int) -> dict[str, X]:
    w, late = b.within(window), b.within(min(window, recent) if window > 0 else recent)
    early = join("({0} and not {1})", w, late)
    ret = lambda x, cond: given(g.count(x, both(cond, x > 0)) >= 2, g.last(x, both(cond, x > 0)) / g.first(x, both(cond, x > 0)) - 1)
    bid, ask = b.levels("bid_volume", level), b.levels("ask_volume", level)
    depth = (bid - ask) / (bid + ask + EPS)
    gap = given(both(b.ap > 0, b.bp > 0), (b.ap - b.bp) / (b.mid + EPS))
    micro = given(both(b.ap > 0, b.bp > 0, b.av > 0, b.bv > 0), ((b.bp * b.av + b.ap * b.bv) / (b.bv + b.av + EPS) - b.mid) / (b.mid + EPS))
    vw = b.amt / (b.vol + EPS)
    vw_gap = given(both(b.last > 0, vw > 0), (b.last - vw) / (vw + EPS))
    present = lambda x: join("({0} and {1} is not null)", w, x)
    ok = both(w, b.last > 0)
    px, lo, hi = g.last(b.last, ok), g.min(b.last, ok), g.max(b.last, ok)
    amt, trades, vol = g.sum(b.amt, w), g.sum(b.trades, w), g.sum(b.vol, w)
    amt_r, trades_r, vol_r = g.sum(b.amt, late), g.sum(b.trades, late), g.sum(b.vol, late)
    return {
        "ret_w": ret(b.last, w), "range_w": given(px > 0, (hi - lo) / px), "liquidity": log(1 + where(amt > 0, amt, 0)),
        "trade_size": amt / (trades + EPS), "recent_share": vol_r / (vol + EPS), "amount_recent_share": amt_r / (amt + EPS),
        "volume_accel": vol_r / (g.sum(b.vol, early) + EPS), "amount_accel": amt_r / (g.sum(b.amt, early) + EPS), "trade_accel": trades_r / (trades - trades_r + EPS),
        "vol_per_trade_recent": amt_r / (trades_r + EPS), "vol_per_trade_all": amt / (trades + EPS), "ret_recent": ret(b.last, late), "ret_early": ret(b.last, early),
        "depth_recent": g.mean(depth, late), "depth_early": g.mean(depth, early), "spread_recent": g.mean(gap, late), "spread_early": g.mean(gap, early),
        "micro_gap_last": g.last(micro, present(micro)), "vwap_gap_last": g.last(vw_gap, present(vw_gap)), "mid_ret": ret(b.mid, w),
        "last_std_ratio": given(g.count(b.last, ok) >= 2, g.std_pop(b.last, ok) / (px + EPS)), "last_pos": (px - lo) / (hi - lo + EPS),
    }


_MODES: dict[str, Callable[[dict[str, X]], X]] = {
    "ret_depth_liq": lambda m: m["ret_w"] * m["depth_recent"] * m["liquidity"],
    "ret_spread_inverse": lambda m: m["ret_w"] / (m["spread_recent"] + EPS),
    "vwap_gap_depth": lambda m: m["vwap_gap_last"] * m["depth_recent"],
    "micro_gap_liq": lambda m: m["micro_gap_last"] * m["liquidity"],
    "range_amount_pressure": lambda m: m["range_w"] * m["amount_recent_share"] * sign(m["ret_recent"]),
    "depth_shift_return": lambda m: (m["depth_recent"] - m["depth_early"]) * m["ret_recent"],
    "spread_shift_reversal": lambda m: (m["spread_recent"] - m["spread_early"]) * -m["ret_recent"],
    "tail_volume_reversal": lambda m: m["recent_share"] * (m["ret_recent"] - m["ret_early"]),
    "trade_size_momentum": lambda m: (m["vol_per_trade_recent"] / (m["vol_per_trade_all"] + EPS) - 1) * m["ret_recent"],
    "mid_vwap_contrast": lambda m: (m["mid_ret"] - m["ret_w"]) * m["vwap_gap_last"],
    "depth_spread_absorption": lambda m: m["depth_recent"] / (m["spread_recent"] + EPS) * sign(m["ret_recent"]),
    "liquidity_volatility_balance": lambda m: m["liquidity"] / (m["last_std_ratio"] + EPS) * sign(m["ret_w"]),
    "amount_accel_depth": lambda m: m["amount_accel"] * m["depth_recent"],
    "volume_accel_spread": lambda m: m["volume_accel"] / (m["spread_recent"] + EPS),
    "trade_accel_micro": lambda m: m["trade_accel"] * m["micro_gap_last"],
    "price_position_depth": lambda m: (m["last_pos"] - 0.5) * m["depth_recent"],
}
MODES = sorted(_MODES)


def ai_factory_wave80_intraday_v1(g, b, mode="", level=1, window_minutes=30, recent_minutes=None, power=1.0, scale=1.0, sign_=1.0):
    """Signed logarithm of one of 16 combinations (mode) of 22 window metrics."""
    if mode not in _MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    m = _composite_metrics(g, b, window_minutes, recent_minutes or max(5, window_minutes // 3), level)
    v = _MODES[mode](m)
    if power != 1.0:
        v = sign(v) * join(f"power({{0}}, cast({power!r} as double))", absolute(v))
    v = v * scale
    return sign(v) * log(absolute(v) + 1) * sign_
