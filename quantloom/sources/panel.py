"""The tick panel: ordered rows by (dt, code), built from the tape in ``lineitem``.

dt is a quarter and code a supplier; last, volume, amount and num_trades come from the line, the book levels
are fixed offsets of it. Ticks are ordered by every column of the line, since its keys repeat. sec is the
time within dt (a minute for every day), from which minute windows are cut.

A panel may come from any other source that has these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.dialect import SPARK, Dialect

LEVELS = 5
ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


def panel_sql(d: Dialect, source: str = "lineitem") -> str:
    """SELECT of the panel from a table like lineitem."""
    books = []
    for k in range(1, LEVELS + 1):
        off = f"{(k - 1) * 0.001:.3f}"
        books += [
            f"last * (1 - l_discount / 10 - cast({off} as double)) AS bid_price{k}",
            f"last * (1 + l_tax / 10 + cast({off} as double)) AS ask_price{k}",
            f"volume + cast({k} as double) * (num_trades % 3) AS bid_volume{k}",
            f"volume + cast({k} as double) * (num_trades % 4) + cast(1 as double) AS ask_volume{k}",
        ]
    return f"""
SELECT *, coalesce(lag(last) OVER (PARTITION BY dt, code ORDER BY seq), pre_close) AS prev_bar_close,
  count(*) OVER (PARTITION BY dt, code) AS n, max(sec) OVER (PARTITION BY dt, code) AS end_sec, min(sec) OVER (PARTITION BY dt, code) AS start_sec
FROM (
  SELECT dt, code, row_number() OVER (PARTITION BY dt, code ORDER BY {ORDER}) AS seq, sec, last, pre_close, open,
    greatest(last, open) * (1 + l_discount / 20) AS high, least(last, open) * (1 - l_tax / 20) AS low,
    volume, amount, num_trades, {", ".join(books)}
  FROM (
    SELECT *, cast(date_trunc('quarter', l_shipdate) as date) AS dt, concat('S', cast(l_suppkey as {d.string})) AS code,
      60 * {d.days.format(a="date_trunc('quarter', l_shipdate)", b="l_shipdate")} AS sec,
      l_extendedprice / l_quantity AS last, l_extendedprice / l_quantity * (cast(1.03 as double) - l_discount) AS pre_close,
      l_extendedprice / l_quantity * (cast(0.98 as double) + l_tax / 2) AS open, l_quantity AS volume, l_extendedprice AS amount, cast(l_linenumber as double) AS num_trades
    FROM {source} WHERE l_quantity > 0
  ) priced
) booked"""


#: Columns whose panel values are cumulative and become flows of a bar.
FLOWS = ("volume", "amount", "num_trades")


def bars_sql(d: Dialect, panel: str, points: int) -> str:
    """A panel of bars of so many ticks: prices rebuilt, flows from cumulative differences with resets, other columns last."""
    w = "PARTITION BY dt, code ORDER BY seq"
    bar = f"cast(floor((seq - 1) / {int(points)}) as bigint)"
    step = ", ".join(f"{c} - lag({c}) OVER ({w}) AS d_{c}" for c in FLOWS)
    flow = ", ".join(f"sum(case when d_{c} >= 0 then d_{c} else {c} end) AS {c}" for c in FLOWS)
    carried = [f"{side}_{kind}{k}" for k in range(1, LEVELS + 1) for side in ("bid", "ask") for kind in ("price", "volume")]
    carry = ", ".join(f"max_by({c}, seq) AS {c}" for c in ("sec", *carried))
    return f"""
SELECT dt, code, bar + 1 AS seq, open, high, low, last, volume, amount, num_trades, sec, {", ".join(carried)},
  coalesce(lag(last) OVER (PARTITION BY dt, code ORDER BY bar), first_value(pre) OVER (PARTITION BY dt, code ORDER BY bar)) AS prev_bar_close,
  coalesce(lag(last) OVER (PARTITION BY dt, code ORDER BY bar), first_value(pre) OVER (PARTITION BY dt, code ORDER BY bar)) AS pre_close,
  count(*) OVER (PARTITION BY dt, code) AS n, max(sec) OVER (PARTITION BY dt, code) AS end_sec, min(sec) OVER (PARTITION BY dt, code) AS start_sec
FROM (
  SELECT dt, code, bar, min_by(last, seq) AS open, max(last) AS high, min(last) AS low, max_by(last, seq) AS last, min_by(pre_close, seq) AS pre, {flow}, {carry}
  FROM (SELECT *, {bar} AS bar, {step} FROM ({panel}) ticks) stepped GROUP BY dt, code, bar
) bars"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a DataFrame."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("quantloom_tape")
    return spark.sql(panel_sql(SPARK, "quantloom_tape"))


def canonical(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns as missing values."""
    kinds = dict(df.dtypes)
    value = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    return df.select(*[value(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def from_ticks(ticks: DataFrame, dt: str = "dt", code: str = "code", time: str = "trade_time", order: str | None = None) -> DataFrame:
    """A panel from any tick table: last row by (dt, code, time), numbered in order of time, with the columns factors rely on.

    ticks has last, pre_close, open, high, low, volume, amount, num_trades and book levels as far as the factors
    that will be computed need them. order breaks ties of time (the greatest stays), and beyond it the greatest values, column by column. One exchange, one sort.
    """
    df = canonical(ticks).withColumnsRenamed({dt: "dt", code: "code"})
    newest = Window.partitionBy("dt", "code", time).orderBy(*[F.desc(c) for c in ([order] if order else [])], *[F.desc(c) for c in df.columns])
    df = df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")
    by, every = Window.partitionBy("dt", "code").orderBy(time), Window.partitionBy("dt", "code")
    df = df.withColumn("sec", (F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)).cast("long")).withColumn("seq", F.row_number().over(by))
    before = F.coalesce(F.lag("last").over(by), F.col("pre_close")) if "pre_close" in df.columns else F.lag("last").over(by)
    return df.withColumns({"prev_bar_close": before, "n": F.count("*").over(every), "end_sec": F.max("sec").over(every), "start_sec": F.min("sec").over(every)})
