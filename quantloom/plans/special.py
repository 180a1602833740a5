"""Queries that SQL alone can't express, or whose rows come from Python, MLlib or streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.dialect import DUCKDB, SPARK, num
from quantloom.operators import frames, neutral
from quantloom.plans import market
from quantloom.plans.factors import register
from quantloom.sources.panel import panel
from quantloom.streaming import events as stream


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "orders")
    return spark.sql(market.with_daily(SPARK, " SELECT trade_date, day_idx, code, f1, f2, f3, close, volume, y FROM labelled"))


def operator_neutralise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of two factors on two exposures, by day."""
    out = frames.neutralise(_labelled(spark, sf_dir), ["f1", "f2"], ["close", "volume"])
    return out.select(F.col("trade_date").cast("string").alias("trade_date"), "code", *[F.round(F.nanvl(f, F.lit(None).cast("double")) + 1.234e-3, 1).alias(f) for f in ("f1", "f2")])


def _neutralised() -> str:
    """Two exposures in closed form: residuals of the ridge on standardised columns, by day."""
    d, x, z = DUCKDB, "close", "volume"
    parts, joins = [], []
    for f in ("f1", "f2"):
        parts.append(f"""m_{f} AS (SELECT trade_date, count(*) AS n, avg({f}) AS mf, avg({x}) AS mx, avg({z}) AS mz, greatest(stddev_pop({x}), 1e-12) AS sx, greatest(stddev_pop({z}), 1e-12) AS sz, var_pop({x}) AS vx, var_pop({z}) AS vz,
  covar_pop({x}, {z}) AS cxz, covar_pop({x}, {f}) AS cx, covar_pop({z}, {f}) AS cz FROM labelled WHERE {f} IS NOT NULL AND {x} IS NOT NULL AND {z} IS NOT NULL GROUP BY trade_date),
n_{f} AS (SELECT *, n * vx / sx / sx + 1e-8 AS a, n * vz / sz / sz + 1e-8 AS c, n * cxz / sx / sz AS b, n * cx / sx AS p, n * cz / sz AS q FROM m_{f}),
w_{f} AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS wx, (q * a - p * b) / (a * c - b * b) AS wz FROM n_{f})""")
        joins.append(f"LEFT JOIN w_{f} ON w_{f}.trade_date = l.trade_date")
    res = lambda f: f"round(case when w_{f}.n >= 5 then (l.{f} - w_{f}.mf) - w_{f}.wx * (l.{x} - w_{f}.mx) / w_{f}.sx - w_{f}.wz * (l.{z} - w_{f}.mz) / w_{f}.sz end + 1.234e-3, 1) AS {f}"
    return market.with_daily(d, f", {', '.join(parts)} SELECT cast(l.trade_date as varchar) AS trade_date, l.code, {res('f1')}, {res('f2')} FROM labelled l {' '.join(joins)}")


def operator_neutralise_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of two factors on the price of the trading day before; rows without it, and short days, keep their values."""
    df = _labelled(spark, sf_dir)
    prices = spark.sql(market.with_daily(SPARK, " SELECT trade_date, code, close FROM daily"))
    n = neutral.Neutraliser([neutral.Exposure("price", "daily", "close", lag=1), neutral.Exposure("gone", "absent", "close")], "ols", min_count=30)
    out = n.apply(df.select(F.col("trade_date").cast("timestamp").alias("dt"), "code", "f1", "f2"), ["f1", "f2"], {"daily": prices}, prices.select("trade_date").distinct())
    return out.select(F.to_date("dt").cast("string").alias("trade_date"), "code", *[F.round(F.nanvl(f, F.lit(None).cast("double")) + 1.234e-3, 1).alias(f) for f in ("f1", "f2")])


def _neutralised_lagged() -> str:
    res = lambda f: f"round(case when n_{f} >= 30 and x is not null and {f} is not null then {f} - m_{f} - c_{f} / v_{f} * (x - x_{f}) else {f} end + 1.234e-3, 1) AS {f}"
    one = lambda f: ", ".join(f"{a} FILTER ({f} IS NOT NULL AND x IS NOT NULL) OVER (PARTITION BY trade_date) AS {b}_{f}" for a, b in ((f"count(*)", "n"), (f"avg({f})", "m"), ("avg(x)", "x"), ("var_pop(x)", "v"), (f"covar_pop(x, {f})", "c")))
    return market.with_daily(DUCKDB, f", e AS (SELECT l.trade_date, l.code, l.f1, l.f2, p.close AS x FROM labelled l LEFT JOIN market p ON p.code = l.code AND p.day_idx = l.day_idx - 1), s AS (SELECT *, {one('f1')}, {one('f2')} FROM e) SELECT cast(trade_date as varchar) AS trade_date, code, {res('f1')}, {res('f2')} FROM s")


def operator_turnover_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten with turnover of at most 0.3."""
    scores = _labelled(spark, sf_dir).select("trade_date", "code", F.col("f1").alias("score"))
    return frames.select_turnover(scores, 10, 0.3).withColumn("trade_date", F.col("trade_date").cast("string"))


def operator_rolling_linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by ridge weights of the 24 days before, refitted every third day."""
    df = _labelled(spark, sf_dir).withColumns({f: (F.col(f) / 1e5) for f in ("f1", "f2", "f3")})
    return frames.rolling_linear_score(df, ["f1", "f2", "f3"], "y", 24, 3).select(F.col("trade_date").cast("string").alias("trade_date"), "code", F.round("score", 6).alias("score"))


def operator_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components of the embeddings, over all coordinates."""
    src = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    size = src.agg(F.max(F.size("embedding"))).first()[0] or 0
    e = src.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(size)])
    return frames.pca(e, [f"e{i}" for i in range(size)], 2).select("vec_id", F.round("pc_1", 5).alias("pc_1"), F.round("pc_2", 5).alias("pc_2"))


def operator_greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors in order of variance, without those that follow a kept one."""
    p = panel(spark, sf_dir)
    cols = ["last", "amount", "volume", "high", "low", "num_trades", "bid_price1", "ask_volume1"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = p.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs], *[(F.stddev(c) / F.avg(c)).alias(f"{c}|") for c in cols]).first()
    corr = lambda a, b: row[f"{a}|{b}"] if f"{a}|{b}" in row else row[f"{b}|{a}"]
    kept = frames.greedy_dedupe(sorted(cols, key=lambda c: -row[f"{c}|"]), corr, 0.9)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(kept)], "rank long, factor string")


def operator_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DataFrame form of the as-of join."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 20).alias("k"), "ts", F.col("value").alias("quote"), "event_id")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 20).alias("k"), F.col("o_orderdate").alias("ts"), "o_orderkey")
    return frames.asof_join(o, e, ["k"], "ts", ["quote"], right_order="event_id", bucket="month").select("o_orderkey", "k", "quote")


_ASOF = """WITH e AS (SELECT user_id % 20 AS k, ts, value AS quote, event_id FROM events), o AS (SELECT o_custkey % 20 AS k, o_orderdate AS ts, o_orderkey FROM orders)
SELECT o.o_orderkey, o.k, e.quote FROM o ASOF LEFT JOIN e ON o.k = e.k AND o.ts >= e.ts"""


def stream_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums by event type: the batch form of the streaming aggregate."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = stream.windowed(e, "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round(F.col("total") + 1.234e-5, 2).alias("total"))


_WINDOWED = f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value) + {num(1.234e-5)}, 2) AS total FROM events GROUP BY 1, 2"


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps of under half an hour."""
    out = stream.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "30 minutes")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, sid"""

_QUERIES = [operator_neutralise, operator_neutralise_lagged, operator_turnover_selection, operator_rolling_linear_score, operator_pca, operator_greedy_dedupe, operator_asof_join, stream_windowed, stream_sessions]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"operator_neutralise": _neutralised(), "operator_neutralise_lagged": _neutralised_lagged(), "operator_asof_join": _ASOF, "stream_windowed": _WINDOWED, "stream_sessions": _SESSIONS}
