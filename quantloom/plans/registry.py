"""Factor specifications, the registry, requirement inference and parameter trials."""

from __future__ import annotations

import ast
import dataclasses
import itertools
import random
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quantloom.functions.alphas import ALPHAS
from quantloom.functions.dialect import SPARK, Dialect
from quantloom.functions.intraday import CLASSIC, T1430
from quantloom.plans import factors as plans


class Registry:
    """Names to functions; a name may stand once."""

    def __init__(self) -> None:
        self._items: dict[str, Any] = {}

    def register(self, name: str) -> Callable[[Any], Any]:
        def keep(item: Any) -> Any:
            if name in self._items:
                raise ValueError(f"{name} is registered already")
            self._items[name] = item
            return item

        return keep

    def get(self, name: str) -> Any:
        if name not in self._items:
            raise KeyError(f"unknown name: {name}; known: {', '.join(sorted(self._items))}")
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)


@dataclasses.dataclass(frozen=True)
class FactorSpec:
    """One output column: a factor with parameters."""

    name: str
    factor: str
    params: dict = dataclasses.field(default_factory=dict)


#: Factors that need other tables than the panel.
CONTEXT = {
    "daily_overnight_return_mean_v1": {"daily": 7}, "daily_sharpe_mean_v1": {"daily": 7},
    "premium_momentum_proxy_v1": {"stock": 1, "map": 1}, "stock_bond_momentum_gap_v1": {"stock": 1, "map": 1},
}


def factor_names() -> list[str]:
    return sorted([*ALPHAS, *CLASSIC, *T1430, *CONTEXT, "ai_factory_wave80_intraday_v1"])


def requirements(specs: Iterable[FactorSpec]) -> dict[str, int]:
    """Other tables that the specifications need, with the greatest lookback in days."""
    out: dict[str, int] = {}
    for s in specs:
        for table, days in CONTEXT.get(s.factor, {}).items():
            out[table] = max(out.get(table, 0), s.params.get("context_lookback_days", days))
    return out


def compute_sql(d: Dialect, specs: list[FactorSpec], panel: str) -> str:
    """One query for panel factors of all kinds, joined on (dt, code) where kinds mix."""
    if len({s.name for s in specs}) < len(specs):
        raise ValueError("output names repeat")
    kinds: dict[str, list[FactorSpec]] = {"alpha": [], "grouped": []}
    for s in specs:
        if s.factor in ALPHAS:
            kinds["alpha"].append(s)
        elif s.factor in CLASSIC or s.factor in T1430 or s.factor == "ai_factory_wave80_intraday_v1":
            kinds["grouped"].append(s)
        else:
            raise KeyError(f"not a panel factor: {s.factor}")
    parts = []
    if kinds["alpha"]:
        series = plans.Series(d)
        c = plans.Columns(series)
        parts.append(series.query(panel, {s.name: ALPHAS[s.factor](series, c, **s.params) for s in kinds["alpha"]}))
    if kinds["grouped"]:
        g = plans.Grouped(d)
        b = plans.Book(g)
        every = CLASSIC | T1430 | {"ai_factory_wave80_intraday_v1": plans.ai_factory_wave80_intraday_v1}
        zero = {s.name for s in kinds["grouped"] if s.factor in plans.ZERO}
        parts.append(g.query(panel, {s.name: every[s.factor](g, b, **s.params) for s in kinds["grouped"]}, zero))
    return parts[0] if len(parts) == 1 else f"SELECT * FROM ({parts[0]}) a JOIN ({parts[1]}) b USING (dt, code)"


def compute(spark: SparkSession, specs: list[FactorSpec], panel: DataFrame) -> DataFrame:
    """Factor frame (dt, code, one column by specification) of a panel."""
    panel.createOrReplaceTempView("quantloom_panel")
    return spark.sql(compute_sql(SPARK, specs, "SELECT * FROM quantloom_panel"))


def trials(space: dict[str, list], kind: str = "grid", limit: int | None = None, seed: int = 0) -> list[dict]:
    """Parameter sets: the grid in order, or a seeded sample of it."""
    grid = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    if kind == "grid":
        return grid[:limit]
    if kind == "random":
        return random.Random(seed).sample(grid, min(limit or len(grid), len(grid)))
    raise ValueError(f"unknown kind: {kind}")


_FORBIDDEN = {"eval", "exec", "open", "compile", "__import__", "input", "globals", "locals", "getattr", "setattr"}


def review_candidate(candidate: dict, columns: Iterable[str], known_formulas: Iterable[str] = ()) -> list[str]:
    """Reasons against a candidate factor: keys, imports, calls, columns, formulas that are there already."""
    need = ("factor_key", "factor_name", "formula", "rationale", "python_code", "config_spec", "used_panel_fields", "time_visibility")
    why = [f"missing key: {k}" for k in need if not candidate.get(k)]
    if unknown := sorted(set(candidate.get("used_panel_fields") or ()) - set(columns)):
        why.append(f"unknown columns: {', '.join(unknown)}")
    plain = lambda f: "".join(str(f).lower().split())
    if plain(candidate.get("formula", "")) in {plain(f) for f in known_formulas}:
        why.append("the formula is there already")
    try:
        tree = ast.parse(candidate.get("python_code") or "")
    except SyntaxError as e:
        return [*why, f"code doesn't parse: {e.msg}"]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""]
            why += [f"import of {n}" for n in names if n.split(".")[0] not in ("numpy", "pandas", "math", "__future__")]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FORBIDDEN:
            why.append(f"call of {node.func.id}")
    return why
