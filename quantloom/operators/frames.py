"""Operators on DataFrames that need more than an expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_last(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """One row by key: that of the greatest order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if isinstance(order, str) else order.desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], strict: bool = False, right_order: str | None = None, bucket: str | None = None) -> DataFrame:
    """The last right values on or before (strictly before: strict) each left row's time.

    Both sides are put in one ordered window by key, so the cost is one shuffle and one sort, never a range join.
    bucket (a unit of date_trunc) cuts long keys: windows are by key and bucket, and what stood last before a
    bucket is carried into it from a table of one row by key and bucket.
    """
    if bucket:
        return _asof_in_buckets(left, right, by, on, values, strict, right_order, bucket)
    l = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_row", F.struct(*left.columns))
    r = right.select(*by, on, F.struct(*values).alias("_value"), (F.col(right_order) if right_order else F.lit(0)).alias("_order")).withColumn("_side", F.lit(1 if strict else 0))
    both = l.select(*by, on, "_side", "_row").unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_found", F.last("_value", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    return out.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def _asof_in_buckets(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], strict: bool, right_order: str | None, bucket: str) -> DataFrame:
    l = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_row", F.struct(*left.columns))
    r = right.select(*by, on, F.struct(*values).alias("_value"), (F.col(right_order) if right_order else F.lit(0)).alias("_order")).withColumn("_side", F.lit(1 if strict else 0))
    both = l.select(*by, on, "_side", "_row").unionByName(r, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, F.col(on)))
    w = Window.partitionBy(*by, "_bucket").orderBy(on, "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_found", F.last("_value", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    ends = both.groupBy(*by, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(on, "_order"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_bucket"])], "_carried")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_bucket"])]
    out = inside.join(carried, same, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return out.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def merge_factors(old: DataFrame | None, new: DataFrame, keys: list[str], refresh: bool = False, overwrite: bool = False) -> DataFrame:
    """refresh: the new frame alone; overwrite: new columns in place of equal ones; else only columns that are new."""
    if old is None or refresh:
        return new
    same = [c for c in new.columns if c in old.columns and c not in keys]
    if overwrite:
        return old.drop(*same).join(new, keys, "full")
    return old.join(new.drop(*same), keys, "full")


def neutralise(df: DataFrame, factors: list[str], exposures: list[str], by: str = "trade_date", alpha: float = 1e-8, min_count: int = 5) -> DataFrame:
    """Residuals of ALL factor columns on the exposures, day by day (ridge on centred exposures, intercept free).

    Days with fewer complete rows than min_count, or rows without an exposure, get missing residuals. A day is a
    cross-section of instruments, which fits one task. All columns that are to be scored must be neutralised together.
    """
    if not exposures:
        raise ValueError("no exposures")
    if missing := [c for c in [*factors, *exposures] if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")

    def day(g: pd.DataFrame) -> pd.DataFrame:
        out = g.copy()
        x = g[exposures].to_numpy(float)
        for f in factors:
            y = g[f].to_numpy(float)
            ok = np.isfinite(x).all(axis=1) & np.isfinite(y)
            res = np.full(len(g), np.nan)
            if ok.sum() >= max(min_count, len(exposures) + 2):
                a = x[ok] - x[ok].mean(axis=0)
                scale = np.maximum(a.std(axis=0), 1e-12)
                a = a / scale
                b = y[ok] - y[ok].mean()
                res[ok] = b - a @ np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ b)
            out[f] = res
        return out

    schema = df.schema
    return df.groupBy(by).applyInPandas(day, schema)


def select_turnover(scores: DataFrame, k: int, turnover: float = 1.0, max_weight: float = 1.0, by: str = "trade_date") -> DataFrame:
    """Top-k by score with limited turnover: (by, code, weight, rank).

    With turnover 1 days are independent, and one window picks them. Below, each day keeps the best
    round(k (1 - turnover)) of the day before and fills up. Days then depend on each other, so the ranked rows
    (three narrow columns) stream through one task in the order of the days, which holds one day at a time.
    """
    ranked = scores.where("score is not null").withColumn("_rk", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "code")))
    weight = lambda n: F.least(F.lit(1.0) / n, F.lit(float(max_weight)))
    if turnover >= 1:
        top = ranked.where(F.col("_rk") <= k)
        return top.select(by, "code", weight(F.count("*").over(Window.partitionBy(by))).alias("weight"), F.col("_rk").cast("long").alias("rank"))
    keep = int(round(k * (1 - turnover)))
    slim = ranked.select(by, "code", "score", "_rk")
    kind = scores.schema[by].dataType.simpleString()

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: set[str] = set()
        rest = pd.DataFrame()

        def pick(day: pd.DataFrame) -> pd.DataFrame:
            nonlocal held
            day = day.sort_values("_rk")
            stay = day[day["code"].isin(held)].head(keep)
            fill = day[~day["code"].isin(stay["code"])].head(max(0, k - len(stay)))
            out = pd.concat([stay, fill]).sort_values("_rk")
            held = set(out["code"])
            n = len(out)
            return pd.DataFrame({by: out[by], "code": out["code"], "weight": min(1.0 / n, max_weight) if n else 0.0, "rank": np.arange(1, n + 1)})

        for b in batches:
            rest = pd.concat([rest, b]) if len(rest) else b
            days = rest[by].unique()
            for d in days[:-1]:
                yield pick(rest[rest[by] == d])
            rest = rest[rest[by] == days[-1]] if len(days) else rest
        if len(rest):
            yield pick(rest)

    return slim.repartition(1).sortWithinPartitions(by, "_rk").mapInPandas(chain, f"{by} {kind}, code string, weight double, rank long")


def carried_basket(days: DataFrame, order: str = "day_idx") -> DataFrame:
    """Days that failed (valid is false) are skipped, the last valid basket before each day is carried to it."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("carried", F.last(F.when(F.col("valid"), F.col(order)), ignorenulls=True).over(w))


def ridge_weights(df: DataFrame, factors: list[str], label: str, alpha: float = 1.0) -> np.ndarray:
    """Ridge weights from normal equations, whose sums are made on the executors: one row reaches the driver."""
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in factors]
    sums = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]] + [F.sum(a * F.col(label)) for a in cols]
    row = list(df.where(F.col(label).isNotNull()).agg(*sums).first())
    n = len(factors)
    m = np.zeros((n, n))
    m[np.triu_indices(n)] = [v or 0.0 for v in row[: n * (n + 1) // 2]]
    m = m + np.triu(m, 1).T
    return np.linalg.solve(m + alpha * np.eye(n), np.array([v or 0.0 for v in row[n * (n + 1) // 2 :]]))


def linear_score(df: DataFrame, factors: list[str], weights: np.ndarray, clip: float | None = None) -> DataFrame:
    """Weighted mean by absolute weight; weights clipped and scaled to unit absolute sum."""
    w = np.clip(weights, -clip, clip) if clip else np.asarray(weights, float)
    total = np.abs(w).sum()
    w = w / total if total > 0 else np.full(len(w), 0.0)
    parts = [F.coalesce(F.col(f), F.lit(0.0)) * float(x) for f, x in zip(factors, w)]
    return df.withColumn("score", sum(parts[1:], parts[0]))


def rolling_linear_score(df: DataFrame, factors: list[str], label: str, window: int, refit_days: int = 1, alpha: float = 1.0, day: str = "day_idx") -> DataFrame:
    """Scores of each day by weights of the window days before it, fitted anew every refit_days.

    One aggregate gives the normal sums of every day (bounded by days and factors squared); the driver solves
    and sends the weights back as a small table.
    """
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in factors]
    n = len(factors)
    sums = [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)] + [F.sum(a * F.col(label)).alias(f"y{i}") for i, a in enumerate(cols)]
    per = df.where(F.col(label).isNotNull()).groupBy(day).agg(*sums).orderBy(day).toPandas().set_index(day)
    days = sorted(r[0] for r in df.select(day).distinct().collect())
    rows, w = [], None
    for i, t in enumerate(days):
        if i % refit_days == 0:
            past = per[(per.index >= t - window) & (per.index < t)].sum().to_numpy(float)
            w = np.linalg.solve(past[: n * n].reshape(n, n) + alpha * np.eye(n), past[n * n :]) if len(past) and np.abs(past).sum() else None
        if w is not None:
            u = w / max(np.abs(w).sum(), 1e-12)
            rows.append((int(t), [float(x) for x in u]))
    table = df.sparkSession.createDataFrame(rows, f"{day} long, _w array<double>")
    parts = [F.coalesce(F.col(f), F.lit(0.0)) * F.col("_w")[i] for i, f in enumerate(factors)]
    return df.join(F.broadcast(table), day, "left").withColumn("score", sum(parts[1:], parts[0])).drop("_w")


def greedy_dedupe(order: Iterable[str], corr: Callable[[str, str], float], threshold: float) -> list[str]:
    """Names in order of importance, without those whose correlation with a kept one reaches the threshold."""
    kept: list[str] = []
    for name in order:
        if all(abs(corr(name, k)) < threshold for k in kept):
            kept.append(name)
    return kept


def pca(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """First k components of centred features, the greatest loading of each positive, as columns pc_1.."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    centred = df.select("*", *[(F.coalesce(F.col(f), F.lit(means[f])) - F.lit(means[f])).alias(f"_c_{f}") for f in features])
    vec = VectorAssembler(inputCols=[f"_c_{f}" for f in features], outputCol="_v").transform(centred)
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    load = model.pc.toArray()
    signs = [1.0 if load[np.abs(load[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(vec).withColumn("_a", vector_to_array("_p"))
    return out.select(*df.columns, *[(F.col("_a")[j] * signs[j]).alias(f"pc_{j + 1}") for j in range(k)])


def mark_nav(targets: pd.DataFrame, prices: pd.DataFrame, start: float = 1.0) -> pd.DataFrame:
    """Net asset value of share positions and cash, rebalanced to target weights at each time: path-dependent, small."""
    px = prices.pivot(index="dt", columns="code", values="price").sort_index()
    cash, shares, rows = start, {}, []
    for dt, row in px.iterrows():
        nav = cash + sum(n * row[c] for c, n in shares.items() if not np.isnan(row.get(c, np.nan)))
        t = targets[targets["dt"] == dt]
        if len(t):
            shares = {c: nav * w / row[c] for c, w in zip(t["code"], t["weight"]) if row.get(c, 0) > 0}
            cash = nav - sum(n * row[c] for c, n in shares.items())
        rows.append((dt, nav))
    return pd.DataFrame(rows, columns=["dt", "nav"])
