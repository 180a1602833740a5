"""Alpha101-style factors as series expressions: one function by factor, parameters with their defaults.

Missing results are 0. o is the open-like price (middle of the first book level, else open), mid1 the middle
alone, unless its group has none, r the return since the last bar's close, vw the row's average price, adv(w)
the mean amount of w rows.
"""

from __future__ import annotations

from collections.abc import Callable

from quantloom.functions.series import EPS, Series, X, absolute, either, fill, greatest, join, least, log, power, root, sign, where


class Columns:
    """Base and derived columns of a panel."""

    def __init__(self, s: Series) -> None:
        self.s = s
        c = s.col
        self.last, self.high, self.low, self.vol, self.amt = c("last"), c("high"), c("low"), c("volume"), c("amount")
        book = join("(({0} + {1}) / 2)", c("ask_price1"), c("bid_price1"))
        self.o = join("coalesce({0}, {1})", book, c("open"))
        self._book = book
        self.vw = self.amt / (self.vol + EPS)
        self.r = (self.last - c("prev_bar_close")) / (c("prev_bar_close") + EPS)
        self.mid = (self.high + self.low) / 2

    @property
    def mid1(self) -> X:
        return join("(case when {0} > 0 then {1} else {2} end)", self.s.whole("count", self._book), self._book, self.o)

    def adv(self, w: int) -> X:
        return self.s.mean(self.amt, w)


ALPHAS: dict[str, Callable[..., X]] = {}


def alpha(f: Callable[..., X]) -> Callable[..., X]:
    """Registers a factor under its function's name."""
    if f.__name__ in ALPHAS:
        raise ValueError(f"{f.__name__} is registered already")
    ALPHAS[f.__name__] = f
    return f


@alpha
def alpha001_signed_power_v1(s, c, stddev_window=20, ts_max_window=5):
    base = where(c.r < 0, fill(s.std(c.r, stddev_window)), c.last)
    return s.cs_rank(s.max(sign(base) * power(absolute(base), 2), ts_max_window)) - 0.5


@alpha
def alpha002_corr_volume_return_v1(s, c, corr_window=6):
    return -s.corr_last(s.rank(s.diff(log(where(c.vol < 0, 0, c.vol) + EPS), 2)), s.rank((c.last - c.o) / (c.o + EPS)), corr_window)


@alpha
def alpha003_corr_open_volume_v1(s, c, corr_window=10):
    return -s.corr_last(s.rank(c.o), s.rank(c.vol), corr_window)


@alpha
def alpha004_ts_rank_low_v1(s, c, ts_rank_window=9):
    return -s.ts_rank_last(s.rank(c.low), ts_rank_window)


@alpha
def alpha005_vwap_gap_v1(s, c, vwap_window=10):
    return s.cs_rank(c.o - s.mean(c.vw, vwap_window)) * -absolute(s.cs_rank(c.last - c.vw))


@alpha
def alpha006_corr_open_volume_neg_v1(s, c, corr_window=10):
    return -s.corr_last(c.o, c.vol, corr_window)


@alpha
def alpha007_volume_breakout_v1(s, c, adv_window=20, delta_window=7, ts_rank_window=60):
    d = s.diff(c.last, delta_window)
    return where(c.adv(adv_window) >= c.vol, -1, -s.ts_rank_last(absolute(d), ts_rank_window) * sign(s.delta(c.last, delta_window)))


@alpha
def alpha008_open_return_momentum_v1(s, c, sum_window=5, delay_window=10):
    prod = s.sum(c.o, sum_window) * s.sum((c.last - c.o) / (c.o + EPS), sum_window)
    return -s.cs_rank(prod - s.delay(prod, delay_window))


def _filtered_change(s, c, w):
    d = s.diff(c.last)
    return where(either(s.min(d, w) > 0, s.max(d, w) < 0), d, -d)


@alpha
def alpha009_close_change_filter_v1(s, c, ts_window=5):
    return _filtered_change(s, c, ts_window)


@alpha
def alpha010_close_change_rank_v1(s, c, ts_window=4):
    return s.cs_rank(fill(_filtered_change(s, c, ts_window)))


@alpha
def alpha011_vwap_close_volume_v1(s, c, ts_window=3):
    gap = c.vw - c.last
    return (s.cs_rank(s.max(gap, ts_window)) + s.cs_rank(s.min(gap, ts_window))) * s.cs_rank(s.delta(c.vol, ts_window))


@alpha
def alpha012_volume_close_reversal_v1(s, c):
    return sign(s.delta(c.vol)) * -s.delta(c.last)


@alpha
def alpha013_cov_close_volume_v1(s, c, cov_window=5):
    return -s.cs_rank(s.cov_last(s.rank(c.last), s.rank(c.vol), cov_window))


@alpha
def alpha014_return_open_volume_v1(s, c, delta_window=3, corr_window=10):
    return -s.cs_rank(s.delta(c.r, delta_window)) * s.corr_last(c.o, c.vol, corr_window)


@alpha
def alpha015_high_volume_corr_v1(s, c, corr_window=3, sum_window=3):
    return -s.sum(s.rank(fill(s.corr(s.rank(c.high), s.rank(c.vol), corr_window))), sum_window)


@alpha
def alpha016_cov_high_volume_v1(s, c, cov_window=5):
    return -s.cs_rank(s.cov_last(s.rank(c.high), s.rank(c.vol), cov_window))


@alpha
def alpha017_close_rank_volume_v1(s, c, adv_window=20, ts_rank_close_window=10, ts_rank_vol_window=5):
    change = fill(s.diff(s.diff(c.last)))
    return -s.cs_rank(s.ts_rank_last(c.last, ts_rank_close_window)) * s.cs_rank(change) * s.cs_rank(s.ts_rank_last(c.vol / (c.adv(adv_window) + EPS), ts_rank_vol_window))


@alpha
def alpha018_close_open_vol_v1(s, c, stddev_window=5, corr_window=10):
    d = c.last - c.o
    return -s.cs_rank(fill(s.std(absolute(d), stddev_window)) + d + s.corr_last(c.last, c.o, corr_window))


@alpha
def alpha019_close_momentum_sign_v1(s, c, delta_window=7, sum_window=250):
    move = (c.last - s.delay(c.last, delta_window)) + s.delta(c.last, delta_window)
    return -sign(move) * (1 + s.cs_rank(1 + s.sum(c.r, sum_window)))


@alpha
def alpha020_open_delay_range_v1(s, c, delay_window=1):
    gap = lambda x: s.cs_rank(c.o - s.delay(x, delay_window))
    return -gap(c.high) * gap(c.last) * gap(c.low)


@alpha
def alpha021_close_volatility_breakout_v1(s, c, sum_window_long=5, sum_window_short=2, adv_window=10):
    m, d, short = s.mean(c.last, sum_window_long), fill(s.std(c.last, sum_window_long)), s.mean(c.last, sum_window_short)
    return where(m + d < short, -1, where(short < m - d, 1, where(c.vol / (c.adv(adv_window) + EPS) >= 1, 1, -1)))


@alpha
def alpha022_high_volume_corr_change_v1(s, c, corr_window=5, delta_window=5, stddev_window=10):
    return -(fill(s.diff(s.corr(c.high, c.vol, corr_window), delta_window)) * s.cs_rank(fill(s.std(c.last, stddev_window))))


@alpha
def alpha023_high_momentum_v1(s, c, sum_window=10, delta_window=2):
    return where(s.mean(c.high, sum_window) < c.high, -s.delta(c.high, delta_window), 0)


@alpha
def alpha024_close_trend_filter_v1(s, c, sum_window=20, delta_window=20, ts_min_window=20, short_delta_window=3, trend_threshold=0.05):
    level = s.mean(c.last, sum_window)
    rate = fill(s.diff(level, delta_window) / (s.lag(level, delta_window) + EPS))
    return where(rate <= trend_threshold, -(c.last - s.min(c.last, ts_min_window)), -s.delta(c.last, short_delta_window))


@alpha
def alpha025_return_volume_vwap_range_v1(s, c, adv_window=10):
    return s.cs_rank(-c.r * c.adv(adv_window) * c.vw * (c.high - c.last))


@alpha
def alpha026_volume_high_rank_corr_v1(s, c, ts_rank_window=5, corr_window=5, ts_max_window=3):
    return -s.max(s.corr(s.ts_rank(c.vol, ts_rank_window), s.ts_rank(c.high, ts_rank_window), corr_window), ts_max_window)


@alpha
def alpha027_volume_vwap_corr_signal_v1(s, c, corr_window=6, sum_window=2):
    return where(s.cs_rank(fill(s.mean(s.corr(s.rank(c.vol), s.rank(c.vw), corr_window), sum_window))) > 0.5, -1, 1)


@alpha
def alpha028_adv_low_close_signal_v1(s, c, adv_window=10, corr_window=5):
    return s.cs_rank(s.corr_last(c.adv(adv_window), c.low, corr_window) + c.mid - c.last)


@alpha
def alpha029_complex_rank_signal_v1(s, c, ts_min_window=2, ts_rank_window=5, delay_window=3, min_window=5):
    x = join("round({0}, 12)", log(absolute(s.min(s.rank(-s.diff(c.last)), ts_min_window)) + EPS))
    scaled = join("round({0}, 12)", (x - s.whole("avg", x)) / (s.whole("sum", absolute(x)) + EPS))
    return s.min(s.rank(scaled), min_window) + s.ts_rank_last(s.lag(-c.r, delay_window), ts_rank_window)


@alpha
def alpha030_close_sign_volume_v1(s, c, delay1=1, delay2=2, delay3=3, sum_window_short=5, sum_window_long=10):
    a, b, d = s.lag(c.last, delay1), s.lag(c.last, delay2), s.lag(c.last, delay3)
    return (1 - s.cs_rank(fill(sign(c.last - a)) + fill(sign(a - b)) + fill(sign(b - d)))) * (s.sum(c.vol, sum_window_short) / (s.sum(c.vol, sum_window_long) + EPS))


@alpha
def alpha031_close_decay_momentum_v1(s, c, delta_window=10, decay_window=10, delta_short_window=3, corr_window=12, adv_window=10):
    slow = fill(s.decay(-s.rank(s.diff(c.last, delta_window)), decay_window, 0.0))
    tied = s.corr_last(c.adv(adv_window), c.low, corr_window)
    return s.cs_rank(slow) + s.cs_rank(-s.delta(c.last, delta_short_window)) + sign(s.cs_rank(tied) - 0.5)


@alpha
def alpha032_vwap_close_mean_reversion_v1(s, c, sum_window=7, corr_window=60, delay_window=5, corr_scale=20.0):
    return s.cs_rank((s.mean(c.last, sum_window) - c.last) + corr_scale * s.corr_last(c.vw, s.lag(c.last, delay_window), corr_window))


@alpha
def alpha033_open_close_ratio_v1(s, c):
    return s.cs_rank(-(1 - c.o / (c.last + EPS)))


@alpha
def alpha034_return_volatility_rank_v1(s, c, stddev_window_short=2, stddev_window_long=5, delta_window=1):
    ratio = fill(s.std(c.r, stddev_window_short)) / (fill(s.std(c.r, stddev_window_long)) + EPS)
    return (1 - s.cs_rank(ratio)) + (1 - s.cs_rank(s.delta(c.last, delta_window)))


@alpha
def alpha035_volume_price_momentum_v1(s, c, ts_rank_window_long=20, ts_rank_window_short=16):
    return s.ts_rank_last(c.vol, ts_rank_window_long) * (1 - s.ts_rank_last(c.last + c.high - c.low, ts_rank_window_short)) * (1 - s.ts_rank_last(c.r, ts_rank_window_long))


@alpha
def alpha036_complex_correlation_signal_v1(s, c, corr_window_1=15, corr_window_2=6, sum_window=60, ts_rank_window=5, delay_window=6, adv_window=10):
    t1 = s.corr_last(c.last - c.o, s.lag(c.vol, 1), corr_window_1)
    t3 = s.ts_rank_last(s.lag(-c.r, delay_window), ts_rank_window)
    t4 = absolute(s.corr_last(c.vw, c.adv(adv_window), corr_window_2))
    t5 = (s.mean(c.last, sum_window) - c.o) * (c.last - c.o)
    return 2.21 * s.cs_rank(t1) + 0.7 * s.cs_rank(c.o - c.last) + 0.73 * s.cs_rank(t3) + s.cs_rank(t4) + 0.6 * s.cs_rank(t5)


@alpha
def alpha037_open_close_correlation_v1(s, c, corr_window=30, delay_window=1):
    gap = c.o - c.last
    return s.cs_rank(s.corr_last(s.lag(gap, delay_window), c.last, corr_window)) + s.cs_rank(gap)


@alpha
def alpha038_close_rank_ratio_v1(s, c, ts_rank_window=10):
    return -s.cs_rank(s.ts_rank_last(c.last, ts_rank_window)) * s.cs_rank(c.last / (c.o + EPS))


@alpha
def alpha039_volume_decay_momentum_v1(s, c, adv_window=10, decay_window=9, delta_window=7, sum_window=60):
    x = s.delta(c.last, delta_window) * (1 - s.ts_rank_last(c.vol / (c.adv(adv_window) + EPS), decay_window))
    return -s.cs_rank(x) * (1 + s.cs_rank(1 + s.sum(c.r, sum_window)))


@alpha
def alpha040_high_volatility_corr_v1(s, c, stddev_window=10, corr_window=10):
    return -s.cs_rank(fill(s.std(c.high, stddev_window))) * s.corr_last(c.high, c.vol, corr_window)


@alpha
def alpha041_geometric_mean_vwap_v1(s, c):
    return root(greatest(c.high, X("cast(0 as double)")) * greatest(c.low, X("cast(0 as double)"))) - c.vw


@alpha
def alpha042_vwap_close_rank_ratio_v1(s, c):
    return s.cs_rank(c.vw - c.last) / (s.cs_rank(c.vw + c.last) + EPS)


@alpha
def alpha043_volume_delay_momentum_v1(s, c, adv_window=10, ts_rank_window_1=10, delta_window=5, ts_rank_window_2=5):
    return s.ts_rank_last(c.vol / (c.adv(adv_window) + EPS), ts_rank_window_1) * s.ts_rank_last(-s.diff(c.last, delta_window), ts_rank_window_2)


@alpha
def alpha044_high_volume_rank_corr_v1(s, c, corr_window=5):
    return -s.corr_last(c.high, s.rank(c.vol), corr_window)


@alpha
def alpha045_close_sum_corr_v1(s, c, delay_window=5, sum_window_long=20, corr_window_1=2, sum_window_short=5, corr_window_2=2):
    late = s.mean(s.lag(c.last, delay_window), sum_window_long)
    return -(s.cs_rank(late) * s.corr_last(c.last, c.vol, corr_window_1) * s.cs_rank(s.corr_last(s.sum(c.last, sum_window_short), s.sum(c.last, sum_window_long), corr_window_2) + EPS))


def _trend(s, c, long, short, scale):
    """Change of slope; 0 where the group is too short."""
    a, b = s.lag(c.last, long), s.lag(c.last, short)
    return fill(((a - b) - (b - c.last)) / scale)


@alpha
def alpha046_close_delay_trend_v1(s, c, delay_window_long=10, delay_window_short=5, trend_scale=10.0, threshold_up=0.25, threshold_down=0.0):
    t = _trend(s, c, delay_window_long, delay_window_short, trend_scale)
    return where(t > threshold_up, -1, where(t < threshold_down, 1, -s.delta(c.last)))


@alpha
def alpha047_inverse_close_volume_v1(s, c, adv_window=10, sum_window=5, delay_window=5, power=5):
    level = s.rank_last(1 / (c.last + EPS)) * c.vol / (c.adv(adv_window) + EPS)
    reach = c.high * s.rank_last(c.high - c.last) / (s.mean(c.high, sum_window) + EPS)
    return level * reach - s.rank_last(c.vw - s.lag(c.vw, delay_window))


@alpha
def alpha049_close_delay_threshold_v1(s, c, delay_window_long=10, delay_window_short=5, trend_scale=10.0, threshold=-0.1):
    return where(_trend(s, c, delay_window_long, delay_window_short, trend_scale) < threshold, 1, -s.delta(c.last))


@alpha
def alpha050_volume_vwap_corr_max_v1(s, c, corr_window=5, ts_max_window=5):
    return -s.max(s.rank(s.corr(s.rank(c.vol), s.rank(c.vw), corr_window)), ts_max_window)


@alpha
def alpha051_close_delay_threshold_v2_v1(s, c, delay_window_long=10, delay_window_short=5, trend_scale=10.0, threshold=-0.05):
    return where(_trend(s, c, delay_window_long, delay_window_short, trend_scale) < threshold, 1, -s.delta(c.last))


@alpha
def alpha052_low_momentum_volume_v1(s, c, ts_min_window=5, delay_window=5, sum_window_long=60, sum_window_short=20, ts_rank_window=5):
    m = s.min(c.low, ts_min_window)
    gain = join("round({0}, 12)", (s.sum(c.r, sum_window_long) - s.sum(c.r, sum_window_short)) / max(1, sum_window_long - sum_window_short))
    return (s.lag(m, delay_window) - m) * s.rank_last(gain) * s.ts_rank_last(c.vol, ts_rank_window)


@alpha
def alpha053_price_position_delta_v1(s, c, delta_window=9):
    return -s.delta(((c.last - c.low) - (c.high - c.last)) / ((c.last - c.low) + EPS), delta_window)


@alpha
def alpha054_price_power_ratio_v1(s, c, power=5):
    p = lambda x: join(f"power({{0}}, cast({power} as double))", x)
    return (-(c.low - c.last) * p(c.o)) / ((c.low - c.high) * p(c.last) + EPS)


@alpha
def alpha055_close_range_volume_corr_v1(s, c, ts_window=12, corr_window=6):
    low, high = s.min(c.low, ts_window), s.max(c.high, ts_window)
    return -s.corr_last(s.rank((c.last - low) / (high - low + EPS)), s.rank(c.vol), corr_window)


@alpha
def alpha057_close_vwap_decay_v1(s, c, ts_argmax_window=10, decay_window=2):
    return -((c.last - c.vw) / (s.decay(s.rank(s.argmax(c.last, ts_argmax_window)), decay_window, 0.0) + EPS))


@alpha
def alpha060_price_range_volume_scale_v1(s, c, ts_argmax_window=10):
    place = ((c.last - c.low) - (c.high - c.last)) / (c.high - c.low + EPS) * c.vol
    tidy = lambda x: join("round({0}, 12)", x)
    return -(2 * s.cs_rank(tidy(s.cs_scale(s.cs_rank(place)))) - s.cs_scale(s.cs_rank(s.argmax(c.last, ts_argmax_window))))


def _below(a: X, b: X, yes: float) -> X:
    """yes where a < b, else 0; 0 where either is missing."""
    return where(a < b, yes, 0)


@alpha
def alpha062_vwap_open_rank_compare_v1(s, c, adv_window=20, sum_window=22, corr_window=10):
    tied = s.rank_last(s.corr(c.vw, s.sum(c.adv(adv_window), sum_window), corr_window))
    compare = where(s.rank(c.mid1) * 2 < s.rank(c.mid) + s.rank(c.high), 1, 0)
    return _below(tied, s.rank_last(compare), -1)


@alpha
def alpha065_open_vwap_min_signal_v1(s, c, weight=0.008, adv_window=30, sum_window=9, corr_window=6, ts_min_window=14):
    tied = s.rank_last(s.corr(c.mid1 * weight + c.vw * (1 - weight), s.sum(c.adv(adv_window), sum_window), corr_window))
    return _below(tied, s.rank_last(c.mid1 - s.min(c.mid1, ts_min_window)), -1)


@alpha
def alpha066_vwap_low_decay_v1(s, c, delta_window=4, decay_window_1=7, weight=0.966, decay_window_2=11, ts_rank_window=7):
    a = s.rank_last(s.decay(s.diff(c.vw, delta_window), decay_window_1))
    b = s.decay((c.low * weight + c.low * (1 - weight) - c.vw) / (c.mid1 - c.mid + EPS), decay_window_2)
    return -(fill(a) + s.ts_rank_last(b, ts_rank_window))


@alpha
def alpha068_high_adv_rank_signal_v1(s, c, adv_window=15, corr_window=9, ts_rank_window=14, weight=0.518, delta_window=1):
    tied = s.corr(s.rank(c.high), s.rank(c.adv(adv_window)), corr_window)
    return _below(s.rank_last(s.ts_rank(tied, ts_rank_window)), s.rank_last(s.diff(c.last * weight + c.low * (1 - weight), delta_window)), -1)


@alpha
def alpha072_vwap_volume_decay_ratio_v1(s, c, adv_window=20, corr_window_1=9, decay_window_1=10, ts_rank_window_1=4, ts_rank_window_2=19, corr_window_2=7, decay_window_2=3):
    a = s.rank_last(s.decay(s.corr(c.mid, c.adv(adv_window), corr_window_1), decay_window_1))
    b = s.rank_last(s.decay(s.corr(s.ts_rank(c.vw, ts_rank_window_1), s.ts_rank(c.vol, ts_rank_window_2), corr_window_2), decay_window_2))
    return fill(a) / (fill(b) + EPS)


@alpha
def alpha073_vwap_open_decay_max_v1(s, c, delta_window_1=5, decay_window_1=3, weight=0.147, delta_window_2=2, decay_window_2=3, ts_rank_window=17):
    blend = c.mid1 * weight + c.low * (1 - weight)
    a = s.rank_last(s.decay(s.diff(c.vw, delta_window_1), decay_window_1))
    b = s.decay(-(s.diff(blend, delta_window_2) / (blend + EPS)), decay_window_2)
    return -greatest(fill(a), s.ts_rank_last(b, ts_rank_window))


@alpha
def alpha074_close_adv_rank_corr_v1(s, c, adv_window=20, sum_window=37, corr_window_1=15, weight=0.026, corr_window_2=11):
    a = s.rank_last(s.corr(c.last, s.sum(c.adv(adv_window), sum_window), corr_window_1))
    return _below(a, s.rank_last(s.corr(s.rank(c.high * weight + c.vw * (1 - weight)), s.rank(c.vol), corr_window_2)), -1)


@alpha
def alpha075_vwap_volume_low_adv_corr_v1(s, c, corr_window_1=4, adv_window=30, corr_window_2=12):
    return _below(s.rank_last(s.corr(c.vw, c.vol, corr_window_1)), s.rank_last(s.corr(s.rank(c.low), s.rank(c.adv(adv_window)), corr_window_2)), 1)


@alpha
def alpha077_mid_price_adv_decay_min_v1(s, c, decay_window_1=10, adv_window=20, corr_window=3, decay_window_2=6):
    a = s.rank_last(s.decay(c.mid - c.vw, decay_window_1))
    b = s.rank_last(s.decay(s.corr(c.mid, c.adv(adv_window), corr_window), decay_window_2))
    return least(fill(a), fill(b))


@alpha
def alpha078_low_vwap_adv_corr_v1(s, c, weight=0.352, sum_window_1=20, adv_window=20, sum_window_2=20, corr_window_1=7, corr_window_2=6):
    blend = s.sum(c.low * weight + c.vw * (1 - weight), sum_window_1)
    a = s.rank_last(s.corr(blend, s.sum(c.adv(adv_window), sum_window_2), corr_window_1))
    b = s.rank_last(s.corr(s.rank(c.vw), s.rank(c.vol), corr_window_2))
    return power(fill(a), fill(b))
