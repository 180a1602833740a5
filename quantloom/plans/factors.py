"""Factor queries: sets of factors computed together over one panel scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from quantloom.functions import blocks
from quantloom.functions.alphas import ALPHAS, Columns
from quantloom.functions.dialect import DUCKDB, SPARK, Dialect
from quantloom.functions.grouped import Grouped
from quantloom.functions.intraday import CLASSIC, MODES, T1430, ZERO, Book, ai_factory_wave80_intraday_v1
from quantloom.functions.series import Series
from quantloom.sources.panel import panel_sql


def alpha_sql(d: Dialect, names: Iterable[str], panel: str, params: dict[str, dict] | None = None) -> str:
    """One query for several alpha factors; equal intermediate columns are computed once."""
    s = Series(d)
    c = Columns(s)
    return s.query(panel, {n: ALPHAS[n](s, c, **(params or {}).get(n, {})) for n in names})


def grouped_sql(d: Dialect, names: Iterable[str], panel: str, params: dict[str, dict] | None = None) -> str:
    """One query for several group factors: a single GROUP BY over the panel."""
    g = Grouped(d)
    b = Book(g)
    every = CLASSIC | T1430
    return g.query(panel, {n: every[n](g, b, **(params or {}).get(n, {})) for n in names}, ZERO)


def composite_sql(d: Dialect, panel: str, **params) -> str:
    """All modes of the parameterised composite in one query."""
    g = Grouped(d)
    b = Book(g)
    return g.query(panel, {f"wave80_{m}": ai_factory_wave80_intraday_v1(g, b, mode=m, **params) for m in MODES}, set())


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """Temporary views of parquet tables, by their names."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def alpha_groups(size: int = 11) -> dict[str, list[str]]:
    """Alpha factors in sets of a few, in the order of their names."""
    names = sorted(ALPHAS)
    return {f"factors_alpha_{i // size + 1}": names[i : i + size] for i in range(0, len(names), size)}


#: Bytecode size up to which the JVM compiles a method; larger ones stay interpreted for good.
COMPILED = 8000


#: Alpha queries whose factors need most of their windows and ranks at every row.
BLOCKS = ("factors_alpha_6",)
# Workers get the code with the task, as for plain expressions, wherever the package lies.
cloudpickle.register_pickle_by_value(blocks)


def _run(sql: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Wide stages of many factors would become one huge method each; above this size Spark makes smaller ones by operator.
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED))
        register(spark, sf_dir, *tables)
        return spark.sql(sql)

    return query


def alpha_blocks(names: Iterable[str], params: dict[str, dict] | None = None) -> Callable[[SparkSession, DataFrame], DataFrame]:
    """alpha_sql() of factors as a function of a panel, its series layers in numpy blocks and its cross-sections in SQL.

    The rows of one (dt, code) have to lie in one partition, as after any window over them; all else raises an error.
    """
    s = Series(SPARK)
    c = Columns(s)
    outputs = {n: ALPHAS[n](s, c, **(params or {}).get(n, {})) for n in names}
    ends = blocks.Ends(*s.plan(outputs))
    kinds = "".join(f", {n} {'array<double>' if n in ends.lists() else 'double'}" for n in ends.names)

    def run(spark: SparkSession, panel: DataFrame) -> DataFrame:
        rows = panel.select("dt", "code", "seq", *ends.base).sortWithinPartitions("dt", "code", "seq")
        return spark.sql(s.across("{ends}", outputs), ends=rows.mapInArrow(ends, f"dt date, code string{kinds}"))

    return run


def _run_blocks(names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    run = alpha_blocks(names)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED))
        register(spark, sf_dir, "lineitem")
        return run(spark, spark.sql(panel_sql(SPARK)))

    return query


def grouped_groups() -> dict[str, list[str]]:
    """Group factors in the sets that are queried together."""
    a, b = list(CLASSIC), list(T1430)
    return {"factors_classic_1": a[:20], "factors_classic_2": a[20:], "factors_t1430_1": b[:30], "factors_t1430_2": b[30:58], "factors_t1430_3": b[58:]}


def _sql(d: Dialect) -> dict[str, str]:
    panel = panel_sql(d)
    out = {k: alpha_sql(d, v, panel) for k, v in alpha_groups().items()}
    out |= {k: grouped_sql(d, v, panel) for k, v in grouped_groups().items()}
    return out | {"factors_composite": composite_sql(d, panel), "factors_composite_scaled": composite_sql(d, panel, level=3, window_minutes=60, power=0.5, scale=10.0, sign_=-1.0)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _run(v, "lineitem") for k, v in _sql(SPARK).items()} | {k: _run_blocks(alpha_groups()[k]) for k in BLOCKS}


def oracle_sql() -> dict[str, str]:
    return _sql(DUCKDB)
