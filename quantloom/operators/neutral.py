"""Neutralising as users configure it: exposures from raw tables, panels or factors, lags, encodings and missing rows."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Exposure:
    """One column that factors are freed of.

    source: ``factor`` (a column of the frame), ``panel`` (the last value at or before the frame's time) or the name
    of a table with a row by day and instrument. lag: trading days before the frame's day. encoding: ``numeric`` or
    ``onehot``, one column for each value of the day, without the first if drop_first.
    """

    name: str
    source: str
    column: str
    lag: int = 0
    encoding: str = "numeric"
    drop_first: bool = True
    date_col: str = "trade_date"


def standard_code(code: str = "instrument_code", exchange: str | None = "exchange_code"):
    """Instrument numbers or texts, and an exchange under any of its names, as CODE.EX."""
    plain = F.upper(F.regexp_replace(F.col(code).cast("string"), r"\.0$", ""))
    if exchange is None:
        return plain
    e = F.upper(F.col(exchange))
    short = F.when(e.isin("XSHG", "SSE", "SHSE"), "SH").when(e.isin("XSHE", "SZSE"), "SZ").otherwise(e)
    return F.when(F.instr(plain, ".") > 0, plain).otherwise(F.concat_ws(".", plain, short))


def shifted(source: DataFrame, calendar: DataFrame, lag: int, date_col: str = "trade_date") -> DataFrame:
    """The rows of a table under the trading day that comes lag days after theirs. calendar: one row by trading day (trade_date)."""
    if not lag:
        return source
    days = calendar.select(F.col("trade_date").cast("date").alias("_to")).distinct()
    before = days.withColumn("_from", F.lag("_to", lag).over(Window.orderBy("_to")))  # one row by day
    return source.join(before.where("_from is not null"), F.col(date_col).cast("date") == F.col("_from")).drop(date_col, "_from").withColumnRenamed("_to", date_col)


def last_before(panel: DataFrame, column: str) -> DataFrame:
    """(dt, code, value): the last value of each instrument at or before the panel's time."""
    at = panel.where((F.col("trade_time") <= F.col("dt")) & F.col(column).isNotNull())
    return at.groupBy("dt", "code").agg(F.max_by(column, F.struct("trade_time", "seq")).alias("value"))


class Neutraliser:
    """Residuals of all factor columns on exposures, time by time.

    method: ``ridge`` (penalty alpha on standardised exposures, intercept free) or ``ols``. Times with fewer complete
    rows than min_count, and rows that lack an exposure, keep their factor values (missing ``keep_original``) or lose
    them (``nan``). An exposure whose source is absent is left out; without any exposure the frame stays as it is.
    """

    def __init__(self, exposures: Sequence[Exposure], method: str = "ridge", alpha: float = 1e-6, min_count: int = 30, standardise: bool = True, missing: str = "keep_original", factors: Sequence[str] | None = None, exclude_factors: Sequence[str] | None = None) -> None:
        if factors or exclude_factors:
            raise ValueError("partial neutralization is not supported: all factors are neutralised together")
        if method not in ("ridge", "ols") or missing not in ("keep_original", "nan"):
            raise ValueError(f"unknown method or policy: {method}, {missing}")
        self.exposures, self.method, self.alpha, self.min_count, self.standardise, self.missing = list(exposures), method, alpha, min_count, standardise, missing

    def with_exposures(self, df: DataFrame, sources: Mapping[str, DataFrame], calendar: DataFrame | None = None) -> tuple[DataFrame, dict[str, Exposure]]:
        """The frame with a column for every exposure that has a source, and these columns.

        sources: by name, tables of (trade_date, code, ...), ``panel`` of (dt, code, seq, trade_time, ...). One join by source and lag.
        """
        out, found = df.withColumn("_day", F.to_date("dt")), {}
        for i, e in enumerate(self.exposures):
            name = f"_x{i}"
            if e.source == "factor":
                if e.column not in df.columns:
                    continue
                out = out.withColumn(name, F.col(f"`{e.column}`"))
            elif e.source not in sources or e.column not in sources[e.source].columns:
                continue
            else:
                src = sources[e.source]
                if e.source == "panel":
                    src = last_before(src, e.column).select(F.to_date("dt").alias("trade_date"), "code", F.col("value").alias(e.column))
                    day = "trade_date"
                else:
                    day = e.date_col
                if e.lag:
                    if calendar is None:
                        raise ValueError(f"{e.name} is {e.lag} days late and needs a calendar")
                    src = shifted(src, calendar, e.lag, day)
                slim = src.groupBy(F.col(day).cast("date").alias("_day"), F.upper("code").alias("_code")).agg(F.max_by(F.col(e.column), F.col(day)).alias(name))
                out = out.withColumn("_code", F.upper("code")).join(slim, ["_day", "_code"], "left").drop("_code")
            found[name] = e
        return out.drop("_day"), found

    def apply(self, df: DataFrame, factors: Sequence[str], sources: Mapping[str, DataFrame] | None = None, calendar: DataFrame | None = None) -> DataFrame:
        """The frame (dt, code, factors and any other columns) with residuals in place of the factors.

        A time is a cross-section of instruments, which fits one task.
        """
        wide, found = self.with_exposures(df, sources or {}, calendar)
        if not found:
            return df
        schema = df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in factors else F.col(f"`{c}`") for c in df.columns]).schema
        names, method, alpha, least, scale, missing = df.columns, self.method, self.alpha, self.min_count, self.standardise, self.missing

        def day(g: pd.DataFrame) -> pd.DataFrame:
            parts = []
            for name, e in found.items():
                if e.encoding == "onehot":
                    dummies = pd.get_dummies(g[name].astype("string"), dtype=float)
                    dummies = dummies.iloc[:, 1:] if e.drop_first and dummies.shape[1] > 1 else dummies
                    parts.append(dummies.to_numpy())
                else:
                    parts.append(pd.to_numeric(g[name], errors="coerce").to_numpy(float)[:, None])
            x = np.hstack(parts)
            x = np.where(np.isfinite(x), x, np.nan)
            x = x[:, ~np.isnan(x).all(axis=0)]
            if scale and x.size:
                sd = np.nanstd(x, axis=0)
                x = (x - np.nanmean(x, axis=0)) / np.where(sd > 0, sd, 1)
            out = g[names].copy()
            for f in factors:
                y = pd.to_numeric(out[f], errors="coerce").to_numpy(float)
                ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
                res = y.copy() if missing == "keep_original" else np.full(len(y), np.nan)
                if x.shape[1] and ok.sum() >= max(least, x.shape[1] + 2):
                    a = np.column_stack([np.ones(ok.sum()), x[ok]])
                    if method == "ridge":
                        beta = np.linalg.solve(a.T @ a + np.diag([0.0, *[alpha] * x.shape[1]]), a.T @ y[ok])
                    else:
                        beta = np.linalg.lstsq(a, y[ok], rcond=None)[0]
                    res[ok] = y[ok] - a @ beta
                out[f] = res
            return out

        return wide.groupBy("dt").applyInPandas(day, schema)
