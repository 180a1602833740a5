"""Market queries: scans, filters, joins, aggregations and series over daily and event tables.

One text serves Spark and the oracle; the dialect fills in what they spell differently. ``daily`` is one row
by month and instrument from ``orders``, whose averages are rounded once so that ranks and ties downstream
don't depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.functions.dialect import DUCKDB, SPARK, Dialect, num, rounded
from quantloom.operators import expressions as E
from quantloom.plans.factors import register

_Q: dict[str, tuple[tuple[str, ...], Callable[[Dialect], str]]] = {}


def query(*tables: str):
    def keep(f: Callable[[Dialect], str]):
        _Q[f.__name__] = (tables, f)
        return f

    return keep


def _r4(x: str) -> str:
    return f"round({x} + {num(1.234e-7)}, 4)"


def _text(d: Dialect, x: str) -> str:
    return f"cast({x} as {d.string})"


def daily(d: Dialect) -> str:
    """CTE items daily and calendar."""
    return f"""daily AS (
  SELECT trade_date, code, {_r4("avg(px)")} AS close, {_r4("avg(case when k % 2 = 0 then px end)")} AS buy_twap, {_r4("avg(case when k % 3 > 0 then px end)")} AS sell_twap,
    {_r4("sum(px)")} AS amount, cast(count(*) as double) AS volume, {_r4("avg(case when k % 5 > 0 then px / (1 + k % 7) end)")} AS f1, {_r4("avg(px * (k % 11))")} AS f2, {_r4("min(px)")} AS f3
  FROM (SELECT cast(date_trunc('month', o_orderdate) as date) AS trade_date, concat('C', {_text(d, "o_custkey % 50")}) AS code, o_totalprice AS px, o_orderkey AS k FROM orders) t
  GROUP BY trade_date, code),
calendar AS (SELECT trade_date, cast(row_number() OVER (ORDER BY trade_date) as bigint) AS day_idx FROM (SELECT DISTINCT trade_date FROM daily) t),
market AS (
  SELECT d.*, c.day_idx, lag(close) OVER (PARTITION BY code ORDER BY d.trade_date) AS prev_close
  FROM daily d JOIN calendar c ON d.trade_date = c.trade_date),
labelled AS (
  SELECT m.trade_date, m.day_idx, m.code, m.f1, m.f2, m.f3, m.close, m.volume, m.amount, m.buy_twap, m.sell_twap, m.prev_close, {_r4("n.close / m.close - 1")} AS y
  FROM market m JOIN market n ON n.code = m.code AND n.day_idx = m.day_idx + 1)"""


def with_daily(d: Dialect, rest: str) -> str:
    return f"WITH {daily(d)}{rest}"


def _ticks(d: Dialect) -> str:
    """CTE item ticks: events with their day, second of the day, and a code."""
    return f"""ticks AS (
  SELECT event_id, ts, cast(ts as date) AS day, cast({d.seconds.format(a="ts")} as bigint) AS sec, concat('U', {_text(d, "user_id % 20")}) AS code, value AS price, event_type FROM events)"""


# --- scans


@query("orders")
def scan_table_range(d):
    """Day-range scan of a partitioned table."""
    return with_daily(d, f" SELECT {_text(d, 'trade_date')} AS trade_date, code, close, buy_twap FROM daily WHERE trade_date BETWEEN date '1996-01-01' AND date '1996-12-31'")


@query("orders")
def scan_metadata(d):
    """Latest and first day of a table, its number of days, and whether it has data."""
    return with_daily(d, f" SELECT {_text(d, 'max(trade_date)')} AS latest, {_text(d, 'min(trade_date)')} AS first, count(DISTINCT trade_date) AS days, count(*) > 0 AS has_data FROM daily")


@query("events")
def scan_snapshot_dedup(d):
    """One row by (code, minute): the last one."""
    return f"WITH {_ticks(d)} SELECT event_id, code, {_text(d, 'day')} AS day, minute, price FROM (SELECT *, cast(floor(sec / 60) as bigint) AS minute, row_number() OVER (PARTITION BY code, day, cast(floor(sec / 60) as bigint) ORDER BY ts DESC, event_id DESC) AS rn FROM ticks) t WHERE rn = 1"


@query("events")
def scan_snapshot_up_to(d):
    """Rows of a day up to a cutoff, and the last of each code."""
    return f"WITH {_ticks(d)} SELECT {_text(d, 'day')} AS day, code, count(*) AS n, max_by(price, event_id) AS last_price FROM ticks WHERE sec <= 52200 GROUP BY day, code"


@query("orders")
def scan_lookback_days(d):
    """Rows of the last five trading days on or before a day."""
    return with_daily(d, f" SELECT {_text(d, 'trade_date')} AS trade_date, code, close FROM daily WHERE trade_date IN (SELECT trade_date FROM (SELECT DISTINCT trade_date FROM daily WHERE trade_date <= date '1998-06-15') t ORDER BY trade_date DESC LIMIT 5)")


@query("orders")
def scan_latest_on_or_before(d):
    """The newest partition of a sparser table on or before each day."""
    return with_daily(d, f", sparse AS (SELECT DISTINCT trade_date AS map_day FROM daily WHERE extract(month from trade_date) IN (2, 7, 11)) SELECT {_text(d, 'c.trade_date')} AS trade_date, {_text(d, 'max(s.map_day)')} AS map_day FROM calendar c LEFT JOIN sparse s ON s.map_day <= c.trade_date GROUP BY c.trade_date")


@query("orders")
def scan_column_statistics(d):
    """Rows, missing values, least and greatest value by column."""
    one = lambda c: f"SELECT '{c}' AS column_name, count(*) AS rows_n, count(*) - count({c}) AS nulls, min({c}) AS least, max({c}) AS greatest FROM daily"
    return with_daily(d, " " + " UNION ALL ".join(map(one, ("close", "buy_twap", "sell_twap", "amount"))))


# --- filters and projections


@query("orders")
def filter_universe(d):
    """Tradable rows: a buy price, and optional bounds (0 is off)."""
    return with_daily(d, f" SELECT {_text(d, 'trade_date')} AS trade_date, code, buy_twap, sell_twap, amount, volume FROM daily WHERE buy_twap IS NOT NULL AND buy_twap > 0 AND sell_twap > 0 AND amount >= 200000 AND volume >= 3 AND buy_twap BETWEEN 1000 AND 400000")


@query("orders")
def filter_allowlist(d):
    """Codes of the pool of the trading day before: a positive field over a threshold."""
    return with_daily(d, f" SELECT {_text(d, 'm.trade_date')} AS trade_date, m.code, m.close FROM market m LEFT SEMI JOIN (SELECT day_idx + 1 AS next_idx, code FROM market WHERE coalesce(f1, f2) > 40000) p ON p.next_idx = m.day_idx AND p.code = m.code" if d is SPARK else f" SELECT {_text(d, 'm.trade_date')} AS trade_date, m.code, m.close FROM market m WHERE EXISTS (SELECT 1 FROM market p WHERE p.day_idx + 1 = m.day_idx AND p.code = m.code AND coalesce(p.f1, p.f2) > 40000)")


@query("orders")
def filter_banlist(d):
    """Codes that aren't in a list."""
    return with_daily(d, f" SELECT {_text(d, 'trade_date')} AS trade_date, code FROM daily m WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('C1'), ('C7'), ('C49')) AS b(banned) WHERE b.banned = m.code)")


@query("events")
def filter_lunch(d):
    """Rows outside the lunch break, with continuous trading minutes."""
    m = "cast(floor(sec / 60) as bigint)"
    return f"WITH {_ticks(d)} SELECT event_id, {E.trading_minute('minute')} AS trading_minute FROM (SELECT event_id, {m} AS minute FROM ticks) t WHERE {E.outside_lunch('minute')}"


@query("supplier")
def project_codes(d):
    """Normalised codes: trailing .0, exchange aliases, exchange by first digit."""
    raw = f"concat(' ', {_text(d, 's_suppkey + 100000 * (s_suppkey % 10)')}, '.0 ')"
    ex = "case s_suppkey % 4 when 0 then 'xshg' when 1 then ' SZSE' when 2 then 'SSE' else 'bse' end"
    return f"SELECT s_suppkey, {E.normal_code('raw')} AS plain, {E.exchange_code('raw', 'ex')} AS code, {E.stock_code('plain')} AS stock FROM (SELECT *, {E.normal_code('raw')} AS plain FROM (SELECT s_suppkey, {raw} AS raw, {ex} AS ex FROM supplier) a) b"


@query("events")
def project_numbers(d):
    """Text to finite numbers; anything else is missing."""
    text = f"case event_id % 5 when 0 then 'n/a' when 1 then 'NaN' when 2 then 'Infinity' else {_text(d, 'value')} end"
    return f"SELECT event_id, {E.number('raw', d)} AS parsed, {E.number(d.json.format(x='props', k='k'), d)} AS k FROM (SELECT event_id, props, {text} AS raw FROM events) t"


@query("orders")
def project_transforms(d):
    """Logarithms, roots, absolute values, signed logarithm and percentile rank."""
    x = "(f1 - 30000)"
    items = [f"{rounded(E.transform(x, k))} AS {k}_f1" for k in ("none", "log", "log1p", "sqrt", "abs")]
    return with_daily(d, f" SELECT {_text(d, 'trade_date')} AS trade_date, code, {', '.join(items)}, {rounded(E.signed_log(x))} AS signed_log_f1, {rounded(E.pct_rank('f1', 'trade_date'))} AS rank_f1 FROM daily")


@query("orders")
def project_missing_counts(d):
    """Valid and missing columns by row."""
    valid = " + ".join(f"(case when {c} is not null then 1 else 0 end)" for c in ("f1", "buy_twap", "sell_twap", "close"))
    return with_daily(d, f" SELECT {_text(d, 'trade_date')} AS trade_date, code, {valid} AS valid_count, 4 - ({valid}) AS missing_count FROM daily")


@query("customer")
def project_one_hot(d):
    """One column by level but the first, and one for missing values."""
    levels = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    seg = "nullif(c_mktsegment, 'AUTOMOBILE')"
    return f"SELECT c_custkey, {', '.join(f'(case when {seg} = {chr(39)}{x}{chr(39)} then 1 else 0 end) AS seg_{x.lower()}' for x in levels)}, (case when {seg} is null then 1 else 0 end) AS seg_missing FROM customer"


@query("events")
def filter_label_time(d):
    """Rows at a label time, moved to the factor time of their day."""
    return f"WITH {_ticks(d)} SELECT event_id, {_text(d, d.when.format(a='day', s=52200))} AS dt, price FROM ticks WHERE sec BETWEEN 53100 AND 53999"


# --- joins


@query("orders")
def join_factor_label(d):
    return with_daily(d, f" SELECT {_text(d, 'trade_date')} AS trade_date, code, f1, f2, y FROM labelled WHERE y IS NOT NULL")


@query("orders")
def join_price_twap_full(d):
    """Closing prices and window prices side by side, either may be absent."""
    return with_daily(d, f", a AS (SELECT trade_date, code, close FROM daily WHERE volume > 4), b AS (SELECT trade_date, code, buy_twap FROM daily WHERE buy_twap IS NOT NULL) SELECT {_text(d, 'coalesce(a.trade_date, b.trade_date)')} AS trade_date, coalesce(a.code, b.code) AS code, close, buy_twap FROM a FULL OUTER JOIN b ON a.trade_date = b.trade_date AND a.code = b.code")


@query("orders")
def join_held_to_sell(d):
    """Yesterday's holdings meet today's selling price, else the close before it."""
    return with_daily(d, f", held AS (SELECT day_idx, code, close FROM market WHERE f1 > 50000) SELECT {_text(d, 'm.trade_date')} AS trade_date, h.code, coalesce(m.sell_twap, m.prev_close) AS sell_price, m.sell_twap IS NULL AS fallback FROM held h JOIN market m ON m.code = h.code AND m.day_idx = h.day_idx + 1")


@query("orders")
def join_buy_sell_sides(d):
    """Today's buys and yesterday's holdings, full outer."""
    return with_daily(d, f", buys AS (SELECT day_idx, code, buy_twap FROM market WHERE f1 > 45000), sells AS (SELECT day_idx + 1 AS day_idx, code, close FROM market WHERE f1 > 45000) SELECT coalesce(b.day_idx, s.day_idx) AS day_idx, coalesce(b.code, s.code) AS code, b.buy_twap, s.close AS held_at, b.code IS NOT NULL AS bought, s.code IS NOT NULL AS held FROM buys b FULL OUTER JOIN sells s ON b.day_idx = s.day_idx AND b.code = s.code")


@query("orders")
def join_calendar_offsets(d):
    """The trading days after and before each day."""
    return with_daily(d, f" SELECT {_text(d, 'c.trade_date')} AS trade_date, {_text(d, 'n.trade_date')} AS next_day, {_text(d, 'p.trade_date')} AS third_before FROM calendar c LEFT JOIN calendar n ON n.day_idx = c.day_idx + 1 LEFT JOIN calendar p ON p.day_idx = c.day_idx - 3")


@query("orders", "events")
def join_asof(d):
    """The last quote on or before each order of a code: one union and one ordered window, no range join."""
    return f"""WITH q AS (SELECT concat('U', {_text(d, "user_id % 20")}) AS code, ts, value, event_id FROM events),
o AS (SELECT concat('U', {_text(d, "o_custkey % 20")}) AS code, o_orderkey, o_orderdate AS ts FROM orders),
u AS (SELECT code, ts, 0 AS side, value, event_id, cast(null as bigint) AS o_orderkey FROM q UNION ALL SELECT code, ts, 1, cast(null as double), cast(null as bigint), o_orderkey FROM o),
f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY code ORDER BY ts, side, event_id, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS quote FROM u)
SELECT o_orderkey, code, quote FROM f WHERE side = 1""" if d is DUCKDB else f"""WITH q AS (SELECT concat('U', {_text(d, "user_id % 20")}) AS code, ts, value, event_id FROM events),
o AS (SELECT concat('U', {_text(d, "o_custkey % 20")}) AS code, o_orderkey, o_orderdate AS ts FROM orders),
u AS (SELECT code, ts, 0 AS side, value, event_id, cast(null as bigint) AS o_orderkey FROM q UNION ALL SELECT code, ts, 1, cast(null as double), cast(null as bigint), o_orderkey FROM o),
f AS (SELECT *, last_value(value, true) OVER (PARTITION BY code ORDER BY ts, side, event_id, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS quote FROM u)
SELECT o_orderkey, code, quote FROM f WHERE side = 1"""


@query("events")
def join_last_before(d):
    """The last value of each code at or before a time of every day."""
    return f"WITH {_ticks(d)} SELECT {_text(d, 'day')} AS day, code, max_by(price, sec * 100000000 + event_id) AS last_price FROM ticks WHERE sec <= 43200 GROUP BY day, code"


@query("orders")
def join_factor_merge(d):
    """New factor columns: old values where the new frame has none, new rows added."""
    return with_daily(d, f", old AS (SELECT trade_date, code, f1, f2 FROM daily WHERE volume > 2), new AS (SELECT trade_date, code, f2 * 2 AS f2, f3 FROM daily WHERE f1 IS NOT NULL) SELECT {_text(d, 'coalesce(o.trade_date, n.trade_date)')} AS trade_date, coalesce(o.code, n.code) AS code, o.f1, n.f2, n.f3 FROM old o FULL OUTER JOIN new n ON o.trade_date = n.trade_date AND o.code = n.code")


@query("lineitem", "supplier")
def factors_bond_stock(d):
    """premium_momentum_proxy_v1 and stock_bond_momentum_gap_v1: last rows of a bond and of its mapped stock."""
    from quantloom.sources.panel import panel_sql

    # The stock of a group is one of its rows, so a window finds its values: the panel is computed once, without a join of it with itself.
    stock = lambda c: f"max(case when code = stock then {c} end) OVER (PARTITION BY dt, stock)"
    mid = "coalesce((ask_price1 + bid_price1) / 2, open)"
    return f"""WITH panel AS ({panel_sql(d)}), ends AS (SELECT dt, code, (last - prev_bar_close) / (prev_bar_close + {num(1e-8)}) AS r, (last - {mid}) / ({mid} + {num(1e-8)}) AS m FROM panel WHERE seq = n),
map AS (SELECT concat('S', {_text(d, "s_suppkey")}) AS code, concat('S', {_text(d, "min(s_suppkey) OVER (PARTITION BY s_nationkey)")}) AS stock FROM supplier),
matched AS (SELECT dt, code, r, m, {stock("r")} AS sr, {stock("m")} AS sm FROM (SELECT e.*, map.stock FROM ends e LEFT JOIN map ON map.code = e.code) t)
SELECT {_text(d, "dt")} AS dt, code, {rounded(f"coalesce(r - sr, {num(0.0)})")} AS premium_momentum_proxy_v1, {rounded(f"coalesce(m - sm, {num(0.0)})")} AS stock_bond_momentum_gap_v1 FROM matched"""


@query("orders")
def factors_daily_overnight(d):
    """daily_overnight_return_mean_v1 and daily_sharpe_mean_v1 over five days: today's sell price on the buy price before."""
    w = "PARTITION BY code ORDER BY trade_date"
    ret = f"(case when sell_twap > 0 and lag(buy_twap) OVER ({w}) > 0 then sell_twap / lag(buy_twap) OVER ({w}) - 1 end)"
    mean, sd = E.rolling("avg", "r", w, 5, 5), E.rolling("stddev_samp", "r", w, 5, 5)
    return with_daily(d, f", rets AS (SELECT trade_date, code, {ret} AS r FROM daily), ok AS (SELECT * FROM rets WHERE r IS NOT NULL), m AS (SELECT trade_date, code, {mean} AS m, {sd} AS s FROM ok), l AS (SELECT *, lag(m) OVER ({w}) AS before FROM m) SELECT {_text(d, 'k.trade_date')} AS trade_date, k.code, {rounded('l.before')} AS daily_overnight_return_mean_v1, {rounded('l.m / nullif(l.s, 0)')} AS daily_sharpe_mean_v1 FROM daily k LEFT JOIN l ON l.trade_date = k.trade_date AND l.code = k.code")


# --- aggregations


@query("events")
def agg_window_twap(d):
    """Mean prices of several windows, left-open and right-closed, in one pass."""
    at = lambda a, b: f"avg(case when sec > {a} and sec <= {b} then price end)"
    return f"WITH {_ticks(d)} SELECT {_text(d, 'day')} AS day, code, {rounded(at(34200, 41400))} AS am, {rounded(at(46800, 52200))} AS pm, {rounded(at(52200, 54000))} AS close_window FROM ticks GROUP BY day, code"


@query("events")
def agg_time_weighted_price(d):
    """Prices weighted by the seconds until the next tick; the last one until the window ends."""
    nxt = "coalesce(lead(sec) OVER (PARTITION BY day, code ORDER BY ts, event_id), 86400)"
    return f"WITH {_ticks(d)} SELECT {_text(d, 'day')} AS day, code, {rounded('sum(price * w) / nullif(sum(w), 0)')} AS twap, max_by(price, event_id) - min_by(price, event_id) AS change FROM (SELECT *, greatest({nxt} - sec, 0) AS w FROM ticks) t GROUP BY day, code"


@query("lineitem")
def agg_bar_rebuild(d):
    """Bars of four ticks: open, high, low, close, flow from cumulative volume with resets, and the close before."""
    from quantloom.sources.panel import panel_sql

    return f"""WITH panel AS ({panel_sql(d)}), flow AS (SELECT *, volume - lag(volume) OVER (PARTITION BY dt, code ORDER BY seq) AS dv FROM panel),
bars AS (SELECT dt, code, cast(floor((seq - 1) / 4) as bigint) AS bar, min_by(last, seq) AS open, max(last) AS high, min(last) AS low, max_by(last, seq) AS close, sum(case when dv >= 0 then dv else volume end) AS volume, min_by(pre_close, seq) AS pre FROM flow GROUP BY dt, code, cast(floor((seq - 1) / 4) as bigint))
SELECT {_text(d, "dt")} AS dt, code, bar, open, high, low, close, volume, coalesce(lag(close) OVER (PARTITION BY dt, code ORDER BY bar), first_value(pre) OVER (PARTITION BY dt, code ORDER BY bar)) AS prev_bar_close FROM bars"""


@query("orders")
def agg_information_coefficient(d):
    """Pearson and Spearman correlation of a factor with the label by day."""
    c = lambda a, b: f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
    return with_daily(d, f", p AS (SELECT trade_date, f1, y FROM labelled WHERE f1 IS NOT NULL AND y IS NOT NULL), r AS (SELECT *, {E.pct_rank('f1', 'trade_date')} AS rf, {E.pct_rank('y', 'trade_date')} AS ry FROM p) SELECT {_text(d, 'trade_date')} AS trade_date, count(*) AS n, {rounded(c('f1', 'y'))} AS ic, {rounded(c('rf', 'ry'))} AS rank_ic FROM r GROUP BY trade_date")


def _ics(d):
    c = "covar_pop(f1, y) / nullif(stddev_pop(f1) * stddev_pop(y), 0)"
    return f", ics AS (SELECT trade_date, day_idx, {_r4(c)} AS ic FROM labelled WHERE f1 IS NOT NULL AND y IS NOT NULL GROUP BY trade_date, day_idx)"


@query("orders")
def agg_ic_summary(d):
    """Mean, deviation, annualised ratio, t value, positive share and median of the daily correlations."""
    m, s = "avg(ic)", "stddev_samp(ic)"
    return with_daily(d, f"{_ics(d)} SELECT count(*) AS n, {rounded(m)} AS mean, {rounded(s)} AS sd, {rounded(f'{m} / nullif({s}, 0) * sqrt({num(252.0)})')} AS ir, {rounded(f'{m} / nullif({s}, 0) * sqrt(cast(count(*) as double))')} AS t, {rounded('avg(case when ic > 0 then cast(1 as double) else cast(0 as double) end)')} AS positive, {rounded(d.quantile.format(x='ic', q=0.5))} AS median FROM ics")


@query("orders")
def agg_newey_west(d):
    """t value of the mean with Bartlett weights: lags by a join on the day index."""
    return with_daily(d, f"""{_ics(d)}, e AS (SELECT row_number() OVER (ORDER BY day_idx) AS i, ic - (SELECT avg(ic) FROM ics) AS u FROM ics), k AS (SELECT count(*) AS n, cast(round(4 * power(count(*) / {num(100.0)}, {num(2 / 9)})) as int) AS lag FROM e),
g AS (SELECT b.i - a.i AS h, sum(a.u * b.u) AS s FROM (SELECT e.*, k.lag FROM e CROSS JOIN k) a JOIN e b ON b.i >= a.i AND b.i <= a.i + a.lag GROUP BY b.i - a.i)
SELECT max(k.n) AS n, max(k.lag) AS lag, {rounded("(SELECT avg(ic) FROM ics) / sqrt(sum(case when h = 0 then s when h <= k.lag then 2 * (1 - h / cast(k.lag + 1 as double)) * s else 0 end) / max(k.n) / max(k.n))")} AS t FROM g CROSS JOIN k""")


def _binned(d, bins=5):
    return f", binned AS (SELECT trade_date, day_idx, code, f1, y, {E.qcut('f2', 'trade_date', bins)} AS bin FROM labelled WHERE y IS NOT NULL)"


@query("orders")
def agg_quantile_bins(d):
    """Mean label, rows and share of right direction by day and factor bin."""
    return with_daily(d, f"{_binned(d)} SELECT {_text(d, 'trade_date')} AS trade_date, bin, count(*) AS n, {rounded('avg(y)')} AS mean_y, {rounded('avg(case when (y > 0) = (bin >= 2) then cast(1 as double) else cast(0 as double) end)')} AS direction FROM binned GROUP BY trade_date, bin")


@query("orders")
def agg_bin_pivot(d):
    """Bin means by day, one column by bin."""
    cols = ", ".join(f"{rounded(f'avg(case when bin = {i} then y end)')} AS bin_{i}" for i in range(5))
    return with_daily(d, f"{_binned(d)} SELECT {_text(d, 'trade_date')} AS trade_date, {cols} FROM binned GROUP BY trade_date")


@query("orders")
def agg_prediction_metrics(d):
    """Mean squared error, R squared and direction of a prediction, by day."""
    return with_daily(d, f", p AS (SELECT *, (f2 / {num(1e6)} - {num(0.5)}) AS p FROM labelled WHERE y IS NOT NULL AND f2 IS NOT NULL), m AS (SELECT *, avg(y) OVER (PARTITION BY trade_date) AS my FROM p) SELECT {_text(d, 'trade_date')} AS trade_date, {rounded('avg((y - p) * (y - p))')} AS mse, {rounded('1 - sum((y - p) * (y - p)) / nullif(sum((y - my) * (y - my)), 0)')} AS r2, {rounded('avg(case when sign(y) = sign(p) then cast(1 as double) else cast(0 as double) end)')} AS direction FROM m GROUP BY trade_date")


@query("orders")
def agg_correlation_matrix(d):
    """Pairs of factors: daily correlation over enough rows, averaged over the days that have it."""
    names = ["f1", "f2", "f3", "close", "volume", "amount"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    day = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, trade_date, count(*) AS n, covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS r FROM daily WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY trade_date" for a, b in pairs)
    return with_daily(d, f", by_day AS ({day}) SELECT a, b, count(*) AS days, {rounded('avg(r)')} AS mean_corr, cast(sum(n) as bigint) AS pairs FROM by_day WHERE n >= 20 AND r IS NOT NULL GROUP BY a, b")


@query("orders")
def agg_coverage(d):
    """Days present, days with values, share of values, and whether a column is constant."""
    one = lambda c: f"SELECT '{c}' AS factor, count(DISTINCT trade_date) AS days, count(DISTINCT case when {c} is not null then trade_date end) AS value_days, {rounded(f'count({c}) / cast(count(*) as double)')} AS non_null, min({c}) = max({c}) AS constant FROM daily"
    return with_daily(d, " " + " UNION ALL ".join(map(one, ("f1", "f2", "f3", "sell_twap"))))


@query("orders")
def agg_score_guard(d):
    """Range, deviation, sign shares, distinct values and equality of scores by day."""
    s = "f1 - 30000"
    share = lambda c: rounded(f"avg(case when {c} then cast(1 as double) else cast(0 as double) end)")
    return with_daily(d, f", s AS (SELECT trade_date, {s} AS s FROM daily WHERE f1 IS NOT NULL) SELECT {_text(d, 'trade_date')} AS trade_date, count(*) AS n, min(s) AS least, max(s) AS greatest, {rounded('stddev_pop(s)')} AS sd, count(DISTINCT s) AS distinct_n, {share('s > 0')} AS positive, {share('s < 0')} AS negative, max(s) - min(s) <= 1e-12 AS all_equal FROM s GROUP BY trade_date")


# --- portfolios


def _positions(d):
    """CTE items: the ten best codes of each day at equal weights, with their legs."""
    buy, sell = E.with_cost("m.buy_twap", 5, "buy"), E.with_cost("coalesce(n.sell_twap, n.prev_close)", 7, "sell")
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY f1 DESC, code) AS rank FROM market WHERE f1 IS NOT NULL AND buy_twap > 0),
picked AS (SELECT *, {E.normal_weight("1", "trade_date")} AS weight FROM ranked WHERE rank <= 10),
positions AS (SELECT m.trade_date, m.day_idx, m.code, m.rank, m.weight, {E.compound("m.close", buy)} AS buy_leg, {E.compound(sell, "m.close")} AS sell_leg, {E.compound(sell, buy)} AS full_ret
  FROM picked m JOIN market n ON n.code = m.code AND n.day_idx = m.day_idx + 1)"""


def _returns(d):
    return f"{_positions(d)}, returns AS (SELECT trade_date, day_idx, count(*) AS n, {_r4('sum(weight * full_ret)')} / 100 AS r FROM positions WHERE full_ret IS NOT NULL GROUP BY trade_date, day_idx)"


@query("orders")
def portfolio_positions(d):
    """Top-k selection with costs, legs bridged at the close, and the full cycle."""
    return with_daily(d, f"{_positions(d)} SELECT {_text(d, 'trade_date')} AS trade_date, code, cast(rank as bigint) AS rank, {rounded('weight')} AS weight, {rounded('buy_leg')} AS buy_leg, {rounded('sell_leg')} AS sell_leg, {rounded('full_ret')} AS full_ret FROM positions")


@query("orders")
def portfolio_strict_market_day(d):
    """Buying leg to the close, selling leg from the close before; gross and net; selling price falls back."""
    sell = "(case when sell_twap > 0 then sell_twap else prev_close end)"
    return with_daily(d, f" SELECT {_text(d, 'trade_date')} AS trade_date, code, {rounded(E.compound('close', 'buy_twap'))} AS buy_leg_gross, {rounded(E.compound('close', 'buy_twap') + f' - {num(E.bps_rate(5))}')} AS buy_leg_net, {rounded(E.compound(sell, 'prev_close'))} AS sell_leg_gross, {rounded(E.compound(sell, 'prev_close') + f' - {num(E.bps_rate(5))}')} AS sell_leg_net, {rounded(E.cycle_after_cost(E.compound(sell, 'buy_twap'), 5, 7))} AS cycle_net FROM market")


@query("orders")
def portfolio_labels(d):
    """Label: today's buying leg and the next trading day's selling leg."""
    sell = "(case when n.sell_twap > 0 then n.sell_twap else n.prev_close end)"
    return with_daily(d, f" SELECT {_text(d, 'm.trade_date')} AS trade_date, m.code, {rounded(E.compound('m.close', 'm.buy_twap') + ' + ' + E.compound(sell, 'm.close'))} AS y FROM market m JOIN market n ON n.code = m.code AND n.day_idx = m.day_idx + 1")


@query("orders")
def portfolio_benchmark(d):
    """Weighted legs of the whole pool by day, with counts and weight of fallbacks."""
    w = E.normal_weight("volume", "trade_date")
    return with_daily(d, f", p AS (SELECT *, {w} AS w FROM market WHERE buy_twap > 0) SELECT {_text(d, 'p.trade_date')} AS trade_date, count(*) AS n, count(DISTINCT p.code) AS codes, {rounded('sum(p.w * ' + E.compound('p.close', 'p.buy_twap') + ')')} AS buy_leg, {rounded('sum(p.w * ' + E.compound('coalesce(n.sell_twap, n.prev_close)', 'p.close') + ')')} AS sell_leg, cast(sum(case when n.sell_twap is null then 1 else 0 end) as bigint) AS fallbacks, {rounded('sum(case when n.sell_twap is null then p.w else 0 end)')} AS fallback_weight FROM p JOIN market n ON n.code = p.code AND n.day_idx = p.day_idx + 1 GROUP BY p.trade_date")


@query("orders")
def portfolio_nav(d):
    """Net asset value, drawdown and rolling statistics of the daily returns."""
    o = "ORDER BY day_idx"
    ratio = f"{E.rolling('avg', 'r', o, 12, 6)} / nullif({E.rolling('stddev_samp', 'r', o, 12, 6)}, 0) * sqrt({num(252.0)})"
    return with_daily(d, f"{_returns(d)}, v AS (SELECT *, {E.growth('r', o)} AS nav, {ratio} AS sharpe, {E.rolling('avg', 'r', o, 12, 3)} AS mean12, {E.rolling('avg', '(case when r > 0 then cast(1 as double) else cast(0 as double) end)', o, 12, 3)} AS hit12 FROM returns) SELECT {_text(d, 'trade_date')} AS trade_date, {rounded('nav')} AS nav, {rounded('nav / max(nav) OVER (ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1')} AS drawdown, {rounded('sharpe')} AS rolling_sharpe, {rounded('mean12')} AS rolling_mean, {rounded('hit12')} AS rolling_hit FROM v")


@query("orders")
def portfolio_statistics(d):
    """Sharpe, volatility, t value, win rate (sample and population deviations) and the greatest drawdown."""
    o = "ORDER BY day_idx"
    m, s, p, n = "avg(r)", "stddev_samp(r)", "stddev_pop(r)", "cast(count(*) as double)"
    return with_daily(d, f"{_returns(d)}, v AS (SELECT *, {E.growth('r', o)} AS nav FROM returns), w AS (SELECT *, nav / max(nav) OVER (ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM v) SELECT count(*) AS n, {rounded(f'{m} / nullif({s}, 0) * sqrt({num(252.0)})')} AS sharpe, {rounded(f'{m} / nullif({p}, 0) * sqrt({num(252.0)})')} AS sharpe_population, {rounded(f'{s} * sqrt({num(252.0)})')} AS volatility, {rounded(f'{m} / nullif({s}, 0) * sqrt({n})')} AS t, {rounded('avg(case when r > 0 then cast(1 as double) else cast(0 as double) end)')} AS win_rate, {rounded('min(dd)')} AS max_drawdown FROM w")


@query("orders")
def portfolio_period_returns(d):
    """Compounded returns by month and by year."""
    one = lambda k: f"SELECT '{k}' AS period, {_text(d, f'cast(date_trunc({chr(39)}{k}{chr(39)}, trade_date) as date)')} AS start_day, {rounded('exp(sum(ln(1 + r))) - 1')} AS ret FROM returns GROUP BY cast(date_trunc('{k}', trade_date) as date)"
    return with_daily(d, f"{_returns(d)} {one('month')} UNION ALL {one('year')}")


@query("orders")
def portfolio_contribution(d):
    """Weighted return and days held by code."""
    return with_daily(d, f"{_positions(d)} SELECT code, {rounded('sum(weight * full_ret)')} AS contribution, count(*) AS hold_days FROM positions WHERE full_ret IS NOT NULL GROUP BY code")


@query("orders")
def portfolio_turnover(d):
    """Half the sum of weight changes between consecutive days, absent codes at 0; the first day half its weights."""
    return with_daily(d, f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY f1 DESC, code) AS rank FROM market WHERE f1 IS NOT NULL AND buy_twap > 0),
w AS (SELECT day_idx, code, {E.normal_weight("1", "trade_date")} AS w FROM ranked WHERE rank <= 10), days AS (SELECT DISTINCT day_idx FROM w),
moves AS (SELECT coalesce(a.day_idx, b.day_idx + 1) AS day_idx, abs(coalesce(a.w, {num(0.0)}) - coalesce(b.w, {num(0.0)})) AS move FROM w a FULL OUTER JOIN w b ON a.code = b.code AND a.day_idx = b.day_idx + 1)
SELECT m.day_idx, {rounded(f"sum(move) * {num(0.5)}")} AS turnover FROM moves m JOIN days ON days.day_idx = m.day_idx GROUP BY m.day_idx""")


# --- series operators


@query("orders")
def series_standardise(d):
    """Winsorised, z-scored, robust, squashed and centred-rank forms of a factor, by day."""
    by = "trade_date"
    med = E.quantile("f1", 0.5, by, d)
    return with_daily(d, f", a AS (SELECT trade_date, code, f1, {E.winsor('f1', by, 0.05, 0.95, d)} AS w, {E.zscore('f1', by)} AS z, {E.centred_rank('f1', by)} AS c, {med} AS med, stddev_pop(f1) OVER (PARTITION BY {by}) AS sd FROM daily), b AS (SELECT *, {E.quantile('abs(f1 - med)', 0.5, by, d)} AS mad FROM a) SELECT {_text(d, 'trade_date')} AS trade_date, code, {rounded('w')} AS winsor, {rounded('z')} AS z, {rounded(E.robust_z('f1', 'med', 'mad', 'sd'))} AS robust, {rounded(E.tanh_scaled('z', 2.0))} AS squashed, {rounded('c')} AS centred FROM b")


@query("orders")
def series_tail_features(d):
    """Rank, upper and lower flags and strength of both tails, where a day has enough values."""
    return with_daily(d, f", a AS (SELECT trade_date, code, case when count(f1) OVER (PARTITION BY trade_date) >= 20 then {E.pct_rank('f1', 'trade_date')} end AS r FROM daily) SELECT {_text(d, 'trade_date')} AS trade_date, code, {rounded('r')} AS rank_pct, case when r >= {num(0.8)} then 1 when r is not null then 0 end AS upper_tail, case when r <= {num(0.2)} then 1 when r is not null then 0 end AS lower_tail, {rounded(f'case when r is not null then {E.tail_strength(chr(114), 0.2, 0.8)} end')} AS strength FROM a")


@query("orders")
def series_qcut(d):
    """Equal-frequency bins by value, and ranking labels."""
    return with_daily(d, f" SELECT {_text(d, 'trade_date')} AS trade_date, code, {E.qcut('f2', 'trade_date', 5)} AS bin5, {E.relevance('f2', 'trade_date', 4)} AS relevance, count(*) OVER (PARTITION BY trade_date) AS group_size FROM daily")


@query("orders")
def series_sample_weights(d):
    """Weights of training rows: label and liquidity multipliers, decay by age, normalised by day."""
    return with_daily(d, f""", a AS (SELECT trade_date, day_idx, code, (case when {E.pct_rank("y", "trade_date")} >= {num(0.8)} then {num(2.0)} else {num(1.0)} end) * (case when y > 0 then {num(1.5)} else {num(1.0)} end) * (case when {E.pct_rank("amount", "trade_date")} <= {num(0.2)} then {num(0.5)} else {num(1.0)} end) AS w, (SELECT max(day_idx) FROM labelled WHERE y IS NOT NULL) - day_idx AS age FROM labelled WHERE y IS NOT NULL),
b AS (SELECT *, least(greatest(w, {num(0.25)}), {num(2.5)}) AS clipped, power({num(0.5)}, age / {num(24.0)}) AS decay FROM a)
SELECT {_text(d, "trade_date")} AS trade_date, code, {rounded("clipped / avg(clipped) OVER (PARTITION BY trade_date)")} AS day_weight, {rounded("decay / mean_decay")} AS age_weight FROM b CROSS JOIN (SELECT avg(decay) AS mean_decay FROM b) t""")


@query("orders")
def series_day_split(d):
    """Days in order: training, validation and test parts, and the days of each rolling window."""
    return with_daily(d, f", n AS (SELECT count(*) AS n FROM calendar) SELECT {_text(d, 'trade_date')} AS trade_date, day_idx, case when day_idx <= floor(n * {num(0.7)}) then 'train' when day_idx <= floor(n * {num(0.7)}) + floor(n * {num(0.15)}) then 'val' else 'test' end AS part, greatest(day_idx - 23, 1) AS window_start FROM calendar CROSS JOIN n")


@query("orders")
def series_walk_forward_bins(d):
    """The two bins of best compounded return over the twelve days before each day, once six are there."""
    return with_daily(d, f"""{_binned(d)}, b AS (SELECT day_idx, bin, {_r4("avg(y)")} / 10 AS r FROM binned WHERE bin IS NOT NULL GROUP BY day_idx, bin),
days AS (SELECT DISTINCT day_idx FROM b),
past AS (SELECT t.day_idx, b.bin, {_r4("exp(sum(ln(1 + b.r))) - 1")} AS gain, count(*) AS n FROM days t JOIN b ON b.day_idx >= t.day_idx - 12 AND b.day_idx < t.day_idx GROUP BY t.day_idx, b.bin),
best AS (SELECT *, row_number() OVER (PARTITION BY day_idx ORDER BY gain DESC, bin) AS rk FROM past WHERE n >= 6)
SELECT p.day_idx, p.bin, p.gain, cast(p.rk as bigint) AS rk, {rounded("b.r")} AS realised FROM best p LEFT JOIN b ON b.day_idx = p.day_idx AND b.bin = p.bin WHERE p.rk <= 2""")


@query("orders")
def series_runs_and_flips(d):
    """Longest run of gains, and changes of sign that skip zeros."""
    return with_daily(d, f"""{_ics(d)}, s AS (SELECT day_idx, ic > 0 AS up, sum(case when ic > 0 then 0 else 1 end) OVER (ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ics),
runs AS (SELECT island, sum(case when up then 1 else 0 end) AS n FROM s GROUP BY island),
f AS (SELECT sign(ic) AS g, lag(sign(ic)) OVER (ORDER BY day_idx) AS before FROM ics WHERE ic <> 0)
SELECT cast((SELECT max(n) FROM runs) as bigint) AS longest_run, cast((SELECT sum(case when g <> before then 1 else 0 end) FROM f) as bigint) AS flips""")


@query("orders")
def series_monotonicity(d):
    """Mean over days of the rank correlation between bin and mean return."""
    return with_daily(d, f"""{_binned(d)}, m AS (SELECT trade_date, bin, {_r4("avg(y)")} AS y FROM binned WHERE bin IS NOT NULL GROUP BY trade_date, bin),
r AS (SELECT trade_date, {E.pct_rank("bin", "trade_date")} AS a, {E.pct_rank("y", "trade_date")} AS b FROM m),
c AS (SELECT trade_date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS s FROM r GROUP BY trade_date HAVING count(*) >= 3)
SELECT count(*) AS days, {rounded("avg(s)")} AS monotonicity FROM c""")


# --- sorts, limits, sets


@query("orders")
def limit_top_k(d):
    """The ten best codes by day."""
    return with_daily(d, f" SELECT {_text(d, 'trade_date')} AS trade_date, code, cast(rk as bigint) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY f1 DESC, code) AS rk FROM daily WHERE f1 IS NOT NULL) t WHERE rk <= 10")


@query("lineitem")
def limit_last_points(d):
    """The last ten ticks of groups that have so many, numbered from 0."""
    from quantloom.sources.panel import panel_sql

    return f"WITH panel AS ({panel_sql(d)}) SELECT {_text(d, 'dt')} AS dt, code, cast(seq - n + 9 as bigint) AS point, last, volume FROM panel WHERE n >= 10 AND seq > n - 10"


@query("orders")
def set_dedup_last(d):
    """One row by key, the later source first."""
    return with_daily(d, f", u AS (SELECT trade_date, code, close AS score, 1 AS source FROM daily WHERE volume > 3 UNION ALL SELECT trade_date, code, f2 AS score, 2 AS source FROM daily WHERE volume < 6) SELECT {_text(d, 'trade_date')} AS trade_date, code, score, source FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, code ORDER BY source DESC) AS rn FROM u) t WHERE rn = 1")


@query("orders")
def set_missing_days(d):
    """Days between the first and the last of every code that it lacks, and those it has."""
    span = f"SELECT code, {d.explode_range.format(a='first_idx', b='last_idx', as_='day_idx')} FROM (SELECT code, min(day_idx) AS first_idx, max(day_idx) AS last_idx FROM market GROUP BY code) s"
    have = "SELECT code, day_idx FROM market"
    return with_daily(d, f", span AS ({span}) SELECT kind, x.code, {_text(d, 'c.trade_date')} AS trade_date FROM (SELECT 'missing' AS kind, code, day_idx FROM (SELECT code, day_idx FROM span EXCEPT {have}) m UNION ALL SELECT 'common', code, day_idx FROM (SELECT code, day_idx FROM span INTERSECT {have}) n) x JOIN calendar c ON c.day_idx = x.day_idx")


@query("region")
def schedule_nodes(d):
    """Execution nodes every 15 minutes from 9:30 to 15:00, without the lunch break, and their windows."""
    return f"SELECT minute, minute - 15 AS window_start, minute + 10 AS window_end FROM (SELECT {d.explode_range.format(a=38, b=60, as_='q')} FROM region WHERE r_regionkey = 0) t CROSS JOIN LATERAL (SELECT cast(q * 15 as bigint) AS minute) m WHERE {E.outside_lunch('minute')}"


# --- screening


@query("orders")
def screen_factor(d):
    """Thresholds on correlation, ratio and Sharpe, and the verdict."""
    m, s = "avg(ic)", "stddev_samp(ic)"
    return with_daily(d, f"{_ics(d)}, a AS (SELECT {_r4(f'abs({m})')} AS abs_ic, {_r4(f'abs({m} / nullif({s}, 0))')} AS abs_ir, count(*) AS days FROM ics) SELECT abs_ic, abs_ir, days, abs_ic >= 0.02 AS ic_ok, abs_ir >= 0.1 AS ir_ok, case when abs_ic >= 0.02 and abs_ir >= 0.1 then 'active' when abs_ic >= 0.02 then 'watch_emerging' else 'reject' end AS verdict FROM a")


@query("orders")
def screen_bins(d):
    """Days with fewer bins than asked, and missing-value ratios, by the bad-factor rule."""
    return with_daily(d, f"{_binned(d)}, b AS (SELECT trade_date, count(DISTINCT bin) AS bins, count(*) AS n, count(f1) AS valid FROM binned GROUP BY trade_date) SELECT count(*) AS days, cast(sum(case when bins < 5 then 1 else 0 end) as bigint) AS short_days, {rounded('1 - sum(valid) / cast(sum(n) as double)')} AS missing_ratio, sum(case when bins < 5 then 1 else 0 end) > count(*) * 0.2 OR 1 - sum(valid) / cast(sum(n) as double) > 0.3 AS bad FROM b")


@query("orders")
def screen_stable_bins(d):
    """Twelve checks on every bin's return above the mean of all: whole history, rolling windows and the recent ones; and the verdict."""
    window, least, recent = 12, 6, 6
    o = "PARTITION BY bin ORDER BY day_idx"
    w = f"{o} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW"
    share = lambda cond, on="true": f"avg(case when {on} then case when {cond} then {num(1.0)} else {num(0.0)} end end)"
    late = f"back <= {recent}"
    checks = {
        "coverage": "coverage >= 0.8", "avg_count": "avg_count >= 3", "alpha_mean": "alpha_mean > 0", "alpha_t": "alpha_t >= 0.5", "rolling_mean": "mean_pos >= 0.5", "rolling_t": "t_pos >= 0.5", "rolling_t_sig": "t_sig >= 0.05",
        "rolling_hit": "hit_share >= 0.4", "recent_mean": "recent_mean_pos >= 0.5", "recent_t": "recent_t_pos >= 0.5", "recent_hit": "recent_hit_share >= 0.4", "max_bad": "max_bad <= 24",
    }
    ok = lambda names: " AND ".join(f"{n}_ok" for n in names)
    names = list(checks)
    return with_daily(d, f"""{_binned(d)}, m AS (SELECT bin, day_idx, {_r4("avg(y)")} AS r, count(*) AS n FROM binned WHERE bin IS NOT NULL GROUP BY bin, day_idx),
bench AS (SELECT day_idx, {_r4("avg(y)")} AS b FROM binned GROUP BY day_idx),
grid AS (SELECT k.bin, bench.day_idx, bench.b FROM (SELECT DISTINCT bin FROM m) k CROSS JOIN bench),
alpha AS (SELECT g.bin, g.day_idx, {_r4("m.r - g.b")} AS alpha, m.n FROM grid g LEFT JOIN m ON m.bin = g.bin AND m.day_idx = g.day_idx),
roll AS (SELECT *, count(alpha) OVER ({w}) AS c, {_r4(f"avg(alpha) OVER ({w})")} AS rm, stddev_samp(alpha) OVER ({w}) AS rs, avg(case when alpha > 0 then {num(1.0)} else {num(0.0)} end) OVER ({w}) AS hit FROM alpha),
valid AS (SELECT *, {_r4("rm / nullif(rs, 0) * sqrt(cast(c as double))")} AS rt, row_number() OVER (PARTITION BY bin ORDER BY day_idx DESC) AS back, row_number() OVER ({o}) - row_number() OVER (PARTITION BY bin, case when rm <= 0 then 1 else 0 end ORDER BY day_idx) AS island FROM roll WHERE c >= {least}),
bad AS (SELECT bin, max(len) AS max_bad FROM (SELECT bin, island, count(*) AS len FROM valid WHERE rm <= 0 GROUP BY bin, island) t GROUP BY bin),
rolled AS (SELECT bin, {_r4(share("rm > 0"))} AS mean_pos, {_r4(share("rt > 0"))} AS t_pos, {_r4(share("rt >= 1"))} AS t_sig, {_r4(share("hit >= 0.5"))} AS hit_share, {_r4(share("rm > 0", late))} AS recent_mean_pos, {_r4(share("rt > 0", late))} AS recent_t_pos, {_r4(share("hit >= 0.5", late))} AS recent_hit_share FROM valid GROUP BY bin),
whole AS (SELECT bin, {_r4("count(alpha) / cast(count(*) as double)")} AS coverage, {_r4("avg(cast(n as double))")} AS avg_count, {_r4("avg(alpha)")} AS alpha_mean, {_r4("avg(alpha) / nullif(stddev_samp(alpha), 0) * sqrt(cast(count(alpha) as double))")} AS alpha_t, {_r4(f"avg(case when alpha > 0 then {num(1.0)} when alpha IS NOT NULL then {num(0.0)} end)")} AS alpha_hit FROM alpha GROUP BY bin),
every AS (SELECT w.*, coalesce(mean_pos, 0) AS mean_pos, coalesce(t_pos, 0) AS t_pos, coalesce(t_sig, 0) AS t_sig, coalesce(hit_share, 0) AS hit_share, coalesce(recent_mean_pos, 0) AS recent_mean_pos, coalesce(recent_t_pos, 0) AS recent_t_pos, coalesce(recent_hit_share, 0) AS recent_hit_share, coalesce(max_bad, 0) AS max_bad FROM whole w LEFT JOIN rolled ON rolled.bin = w.bin LEFT JOIN bad ON bad.bin = w.bin),
checked AS (SELECT *, {", ".join(f"coalesce({c}, false) AS {n}_ok" for n, c in checks.items())} FROM every)
SELECT bin, coverage, avg_count, alpha_mean, alpha_t, alpha_hit, mean_pos, t_pos, t_sig, hit_share, recent_mean_pos, recent_t_pos, recent_hit_share, cast(max_bad as bigint) AS max_bad, {_r4("mean_pos + t_pos + t_sig + hit_share + recent_mean_pos + recent_t_pos + recent_hit_share - 0.05 * cast(max_bad as double)")} AS rolling_score, {", ".join(f"{n}_ok" for n in names)},
  case when {ok(names)} then 'active' when {ok(names[:8])} AND max_bad_ok then 'watch_recent_decay' when {ok(names[8:11])} then 'watch_emerging' else 'reject' end AS verdict FROM checked""")


@query("orders")
def live_coverage_calendar(d):
    """Status of every calendar day: off, ok, partial or missing."""
    return with_daily(d, f", c AS (SELECT trade_date, count(f1) AS have, count(*) AS want FROM daily GROUP BY trade_date) SELECT {_text(d, 'k.trade_date')} AS trade_date, case when extract(month from k.trade_date) = 12 then 'off' when c.want is null then 'missing' when c.have = c.want then 'ok' else 'partial' end AS status FROM calendar k LEFT JOIN c ON c.trade_date = k.trade_date AND c.want > 40")


@query("orders")
def live_backfill_days(d):
    """Days between the first and the last of every code whose panel, factor or label row is missing, and the span to rebuild."""
    span = f"SELECT code, {d.explode_range.format(a='first_idx', b='last_idx', as_='day_idx')} FROM (SELECT code, min(day_idx) AS first_idx, max(day_idx) AS last_idx FROM market GROUP BY code) s"
    part = lambda name, cond: f"SELECT '{name}' AS kind, code, day_idx FROM (SELECT code, day_idx FROM span EXCEPT SELECT code, day_idx FROM market WHERE {cond}) {name}_gap"
    return with_daily(d, f", span AS ({span}), gaps AS ({part('panel', '1 = 1')} UNION ALL {part('factor', 'f1 IS NOT NULL')} UNION ALL {part('label', 'sell_twap IS NOT NULL')}) SELECT kind, code, count(*) AS n, {_text(d, 'min(c.trade_date)')} AS first, {_text(d, 'max(c.trade_date)')} AS last FROM gaps g JOIN calendar c ON c.day_idx = g.day_idx GROUP BY kind, code")


# --- arrays


@query("orders")
def array_factor_sequence(d):
    """The last six days of a factor by code, with slope and coverage, from a frame of rows."""
    f = "PARTITION BY code ORDER BY day_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW"
    return with_daily(d, f", s AS (SELECT trade_date, code, f2, {d.collect}(f2) OVER ({f}) AS seq, covar_pop(cast(f2 as double), cast(day_idx as double)) OVER ({f}) AS cv, var_pop(cast(day_idx as double)) OVER ({f}) AS vr, f2 - lag(f2) OVER (PARTITION BY code ORDER BY day_idx) AS diff1 FROM market WHERE f2 IS NOT NULL) SELECT {_text(d, 'trade_date')} AS trade_date, code, cast({d.size}(seq) as bigint) AS length, seq[{0 if d is SPARK else 1}] AS oldest, {rounded('cv / nullif(vr, 0)')} AS slope, {rounded('diff1')} AS diff1 FROM s WHERE {d.size}(seq) = 6")


@query("lineitem")
def array_book_tensor(d):
    """The last eight ticks as rows of levels: asks from the highest, then bids; prices and volumes."""
    from quantloom.sources.panel import panel_sql

    px = ", ".join([f"ask_price{k}" for k in range(5, 0, -1)] + [f"bid_price{k}" for k in range(1, 6)])
    vol = ", ".join([f"ask_volume{k}" for k in range(5, 0, -1)] + [f"bid_volume{k}" for k in range(1, 6)])
    if d is SPARK:
        pack = f"sort_array(collect_list(struct(seq, array({px}) AS p, array({vol}) AS v)))"
        at = "size(t)", "t[7].p[4]", "t[0].v[9]", "aggregate(t, cast(0 as double), (a, x) -> a + x.p[0] * x.v[0])"
    else:
        pack = f"list({{'seq': seq, 'p': [{px}], 'v': [{vol}]}} ORDER BY seq)"
        at = "len(t)", "t[8].p[5]", "t[1].v[10]", "list_sum(list_transform(t, lambda x : x.p[1] * x.v[1]))"
    return f"WITH panel AS ({panel_sql(d)}), tensors AS (SELECT dt, code, {pack} AS t FROM panel WHERE n >= 8 AND seq > n - 8 GROUP BY dt, code) SELECT {_text(d, 'dt')} AS dt, code, cast({at[0]} as bigint) AS steps, {at[1]} AS last_best_ask, {at[2]} AS first_deep_bid_volume, {rounded(at[3])} AS top_ask_notional FROM tensors"


@query("lineitem")
def factors_on_bars(d):
    """Factors of rebuilt bars of three ticks instead of raw ticks."""
    from quantloom.plans.factors import alpha_sql
    from quantloom.sources.panel import bars_sql, panel_sql

    return alpha_sql(d, ["alpha001_signed_power_v1", "alpha006_corr_open_volume_neg_v1", "alpha012_volume_close_reversal_v1", "alpha023_high_momentum_v1", "alpha041_geometric_mean_vwap_v1"], bars_sql(d, panel_sql(d), 3))


@query("events")
def agg_signal_window_post(d):
    """Signal price before a window, price and flow within it, and the price after: one conditional aggregate."""
    at = lambda cond: f"max_by(price, case when {cond} then event_id end)"
    return f"WITH {_ticks(d)} SELECT {_text(d, 'day')} AS day, code, {at('sec < 52200')} AS signal_price, {rounded('avg(case when sec > 52200 and sec <= 61200 then price end)')} AS window_price, cast(sum(case when sec > 52200 and sec <= 61200 then 1 else 0 end) as bigint) AS window_ticks, {at('sec <= 61200')} AS post_price FROM ticks GROUP BY day, code HAVING sum(case when sec < 52200 then 1 else 0 end) > 0"


@query("orders")
def portfolio_cost_label(d):
    """Change from one day's cost to the next: missing unless the first is positive."""
    return with_daily(d, f" SELECT {_text(d, 'm.trade_date')} AS trade_date, m.code, {rounded('case when m.close > 0 then (n.close - m.close) / m.close end')} AS y FROM market m JOIN market n ON n.code = m.code AND n.day_idx = m.day_idx + 1")


@query("orders")
def portfolio_live_summary(d):
    """Last twenty days against the pool: values, means, and volatility with population deviation."""
    return with_daily(d, f"""{_returns(d)}, pool AS (SELECT m.day_idx, {_r4("avg(n.close / m.close - 1)")} AS b FROM market m JOIN market n ON n.code = m.code AND n.day_idx = m.day_idx + 1 GROUP BY m.day_idx),
j AS (SELECT r.day_idx, r.r, p.b, row_number() OVER (ORDER BY r.day_idx DESC) AS back FROM returns r JOIN pool p ON p.day_idx = r.day_idx)
SELECT count(*) AS days, {rounded("exp(sum(ln(1 + r))) - 1")} AS strategy, {rounded("exp(sum(ln(1 + b))) - 1")} AS benchmark, {rounded("avg(r - b)")} AS mean_excess, {rounded(f"stddev_pop(r) * sqrt({num(252.0)})")} AS volatility FROM j WHERE back <= 20""")


@query("orders")
def portfolio_bin_backtest(d):
    """Compounded return, share of winning days and rows of every factor bin."""
    return with_daily(d, f"{_binned(d)}, m AS (SELECT bin, day_idx, {_r4('avg(y)')} / 10 AS r, count(*) AS n FROM binned WHERE bin IS NOT NULL GROUP BY bin, day_idx) SELECT bin, count(*) AS days, cast(sum(n) as bigint) AS rows_n, {rounded('exp(sum(ln(1 + r))) - 1')} AS total, {rounded('avg(case when r > 0 then cast(1 as double) else cast(0 as double) end)')} AS win_rate FROM m GROUP BY bin")


@query("orders")
def screen_walk_forward(d):
    """Seven checks on the returns of a selection and those above the mean of all: active, watched or rejected, and the bins."""
    o = "ORDER BY day_idx"
    checks = {"full_bin_count": "short_days <= 0.2 * days", "ret_total": "ret_total >= 0", "alpha_ret_total": "alpha_ret_total >= 0", "sharpe": "sharpe >= 0.5", "alpha_sharpe": "alpha_sharpe >= 0.5", "win_rate": "win_rate >= 0.5", "maxdd": "maxdd >= -0.3"}
    ok = lambda names: " AND ".join(f"{n}_ok" for n in names)
    sharpe = lambda x: f"avg({x}) / nullif(stddev_samp({x}), 0) * sqrt({num(252.0)})"
    return with_daily(d, f"""{_returns(d)}{_binned(d)}, bins AS (SELECT trade_date, count(DISTINCT bin) AS bins FROM binned GROUP BY trade_date),
bench AS (SELECT day_idx, {_r4("avg(y)")} / 100 AS b FROM labelled WHERE y IS NOT NULL GROUP BY day_idx),
v AS (SELECT r.day_idx, r.r, r.r - coalesce(bench.b, 0) AS a, {E.growth("r.r", "ORDER BY r.day_idx")} AS nav FROM returns r LEFT JOIN bench ON bench.day_idx = r.day_idx),
w AS (SELECT *, nav / max(nav) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM v),
s AS (SELECT count(*) AS days, {_r4("exp(sum(ln(1 + r))) - 1")} AS ret_total, {_r4("exp(sum(ln(1 + a))) - 1")} AS alpha_ret_total, {_r4(sharpe("r"))} AS sharpe, {_r4(sharpe("a"))} AS alpha_sharpe, {_r4("avg(case when r > 0 then cast(1 as double) else cast(0 as double) end)")} AS win_rate, {_r4("min(dd)")} AS maxdd FROM w),
f AS (SELECT cast(sum(case when bins < 5 then 1 else 0 end) as bigint) AS short_days FROM bins),
checked AS (SELECT s.*, f.short_days, {", ".join(f"coalesce({c}, false) AS {n}_ok" for n, c in checks.items())} FROM s CROSS JOIN f)
SELECT *, case when {ok(checks)} then 'active' when {ok(["alpha_ret_total", "sharpe", "maxdd"])} then 'watch_low_abs_ret' else 'reject' end AS verdict FROM checked""")


@query("orders")
def agg_importance_mean(d):
    """Mean importance of features over fitted states, best first."""
    one = lambda c: f"SELECT '{c}' AS factor, day_idx, abs(covar_pop({c}, y)) / nullif(stddev_pop({c}) * stddev_pop(y), 0) AS importance FROM labelled WHERE {c} IS NOT NULL AND y IS NOT NULL GROUP BY day_idx"
    return with_daily(d, f", states AS ({one('f1')} UNION ALL {one('f2')} UNION ALL {one('f3')}), m AS (SELECT factor, count(*) AS states, {_r4('avg(importance)')} AS importance FROM states GROUP BY factor) SELECT factor, states, importance, cast(row_number() OVER (ORDER BY importance DESC, factor) as bigint) AS place FROM m")


def _run(tables: tuple[str, ...], sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *tables)
        return spark.sql(sql)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _run(t, f(SPARK)) for k, (t, f) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f(DUCKDB) for k, (_, f) in _Q.items()}
