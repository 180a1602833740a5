"""Column expressions of the panel engine, as SQL text for ``F.expr``, ``selectExpr`` or ``spark.sql``.

Each function takes expression texts and names of grouping columns and returns an expression. They are
declarative window or scalar expressions only, so Catalyst shares sorts between those of equal partitioning.
"""

from __future__ import annotations

from quantloom.functions.dialect import SPARK, Dialect, num

# --- ranks, scaling, bins


def pct_rank(x: str, by: str) -> str:
    """Average-tie percentile rank within the groups; missing values apart."""
    w = f"PARTITION BY {by} ORDER BY {x} NULLS LAST"
    return f"(case when {x} is not null then (rank() OVER ({w}) + (count(*) OVER ({w} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) * {num(0.5)}) / nullif(count({x}) OVER (PARTITION BY {by}), 0) end)"


def centred_rank(x: str, by: str) -> str:
    """2 * rank - 1."""
    return f"(2 * {pct_rank(x, by)} - 1)"


def zscore(x: str, by: str) -> str:
    """Deviations of the mean in population standard deviations; 0 where flat."""
    sd = f"stddev_pop({x}) OVER (PARTITION BY {by})"
    return f"(case when {x} is null then null when {sd} > {num(1e-12)} then ({x} - avg({x}) OVER (PARTITION BY {by})) / {sd} else {num(0.0)} end)"


def tanh_scaled(z: str, scale: float) -> str:
    return f"tanh({z} / {num(scale)})"


def quantile(x: str, q: float, by: str, d: Dialect = SPARK) -> str:
    """Exact quantile of the group, linear between values."""
    return f"{d.quantile.format(x=x, q=q)} OVER (PARTITION BY {by})"


def winsor(x: str, by: str, lower: float, upper: float, d: Dialect = SPARK) -> str:
    """Clipped to the group's quantiles."""
    return f"(case when {x} is not null then least(greatest({x}, {quantile(x, lower, by, d)}), {quantile(x, upper, by, d)}) end)"


def robust_z(x: str, median: str, mad: str, sd: str) -> str:
    """(x - median) / (1.4826 mad); population deviation where the mad is flat; 0 where both are."""
    return f"(case when {x} is null then null when {mad} > {num(1e-12)} then ({x} - {median}) / ({mad} * {num(1.4826)}) when {sd} > {num(1e-12)} then ({x} - {median}) / {sd} else {num(0.0)} end)"


def qcut(x: str, by: str, bins: int) -> str:
    """Equal-frequency bin from 0 by rank: right-closed quantile edges in integers; untied values."""
    return f"(case when {x} is not null then cast(greatest(ceil((rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) - 1) * {bins} / nullif(cast(count({x}) OVER (PARTITION BY {by}) - 1 as double), 0)) - 1, 0) as int) end)"


def relevance(x: str, by: str, bins: int) -> str:
    """Ranking label: the percentile rank's step among bins."""
    return f"cast(least(greatest(floor({pct_rank(x, by)} * {bins}), 0), {bins - 1}) as int)"


def tail_strength(r: str, lower: float, upper: float) -> str:
    """How far a percentile rank lies in either tail, from 0 to 1."""
    return f"least(greatest(({r} - {num(upper)}) / {num(1 - upper)}, ({num(lower)} - {r}) / {num(lower)}, {num(0.0)}), {num(1.0)})"


# --- scalar transforms


def transform(x: str, kind: str) -> str:
    """none, log, log1p, sqrt or abs; missing outside the domain."""
    return {
        "none": x, "log": f"(case when {x} > 0 then ln({x}) end)", "log1p": f"(case when {x} > -1 then ln(1 + {x}) end)",
        "sqrt": f"(case when {x} >= 0 then sqrt({x}) end)", "abs": f"abs({x})",
    }[kind]


def signed_log(x: str) -> str:
    return f"(cast(sign({x}) as double) * ln(1 + abs({x})))"


def number(x: str, d: Dialect = SPARK) -> str:
    """Text or number to a finite double; anything else is missing."""
    v = d.to_number.format(x=x)
    return f"(case when {v} is not null and not isnan({v}) and abs({v}) < cast('Infinity' as double) then {v} end)"


def normal_code(code: str) -> str:
    """Trimmed, without a trailing .0."""
    return f"regexp_replace(trim({code}), '[.]0$', '')"


def exchange_code(instrument: str, exchange: str) -> str:
    """instrument.EXCHANGE with exchange aliases resolved."""
    e = f"upper(trim({exchange}))"
    return f"concat({normal_code(instrument)}, '.', case when {e} in ('XSHG', 'SSE', 'SHSE', 'SH') then 'SH' when {e} in ('XSHE', 'SZSE', 'SZ') then 'SZ' else {e} end)"


def stock_code(code: str) -> str:
    """Six digits get their exchange from the first one; other codes stay."""
    return f"(case when length({code}) <> 6 or {code} like '%.%' then {code} when substr({code}, 1, 1) in ('5', '6', '9') then concat({code}, '.SH') when substr({code}, 1, 1) in ('4', '8') then concat({code}, '.BJ') else concat({code}, '.SZ') end)"


def outside_lunch(minute: str) -> str:
    """Condition: the minute of the day isn't in [11:30, 13:00)."""
    return f"({minute} < 690 or {minute} >= 780)"


def trading_minute(minute: str) -> str:
    """Minutes of the day with the lunch break taken out."""
    return f"(case when {minute} >= 780 then {minute} - 90 when {minute} > 690 then 690 else {minute} end)"


# --- execution prices and returns


def bps_rate(bps: float) -> float:
    return max(0.0, bps) / 10000


def with_cost(price: str, bps: float, side: str) -> str:
    """Price after cost: dearer when buying, cheaper when selling."""
    r = bps_rate(bps)
    return f"({price} * {num(1 + r if side == 'buy' else 1 - r)})"


def compound(sell: str, buy: str) -> str:
    return f"(case when {buy} > 0 then {sell} / {buy} - 1 end)"


def bridge_legs(buy: str, sell: str, bridge: str) -> tuple[str, str, str]:
    """Return of the buying leg up to the bridge price, of the selling leg from it, and of both."""
    return compound(bridge, buy), compound(sell, bridge), compound(sell, buy)


def cycle_after_cost(gross: str, buy_bps: float, sell_bps: float) -> str:
    """(1 + r)(1 - s) / (1 + b) - 1."""
    return f"((1 + {gross}) * {num(1 - bps_rate(sell_bps))} / {num(1 + bps_rate(buy_bps))} - 1)"


def normal_weight(w: str, by: str) -> str:
    """Weights clipped at 0 and divided by their sum; equal where that isn't positive."""
    v = f"greatest(coalesce({w}, {num(0.0)}), {num(0.0)})"
    total = f"sum({v}) OVER (PARTITION BY {by})"
    return f"(case when {total} > 0 then {v} / {total} else {num(1.0)} / count(*) OVER (PARTITION BY {by}) end)"


def price_bound(value: object) -> float:
    """A bound from configuration: empty and null texts are 0, which is off."""
    return 0.0 if value is None or str(value).strip().lower() in ("", "none", "null") else float(str(value))


def first_present(columns: list[str], candidates: list[str]) -> str:
    """The first candidate that is a column."""
    for c in candidates:
        if c in columns:
            return c
    raise ValueError(f"none of {', '.join(candidates)} is there")


# --- series of daily returns, ordered by day


def growth(r: str, over: str) -> str:
    """Running product of 1 + r; r must be over -1."""
    return f"exp(sum(ln(1 + {r})) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


def rolling(fn: str, x: str, over: str, window: int, least: int) -> str:
    """Aggregate of the last window rows, missing below a number of values."""
    f = f"{over} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW"
    return f"(case when count({x}) OVER ({f}) >= {least} then {fn}({x}) OVER ({f}) end)"
