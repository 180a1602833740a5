"""Group expressions: aggregates of one (dt, code), all of a query in a single GROUP BY."""

from __future__ import annotations

from quantloom.functions.dialect import Dialect, num, rounded
from quantloom.functions.series import Series, X, join


class Grouped:
    """Collects the aggregates of a set of expressions and renders the query.

    Row-level windows that an aggregate needs are layers below it (see Series).
    """

    def __init__(self, dialect: Dialect) -> None:
        self.s = Series(dialect)
        self.d = dialect
        self.aggs: dict[str, str] = {}

    def _agg(self, text: str) -> X:
        return X(self.aggs.setdefault(text, f"a{len(self.aggs)}"))

    @staticmethod
    def _if(x: X, cond: X | None) -> str:
        return x.text if cond is None else f"case when {cond.text} then {x.text} end"

    def sum(self, x: X, cond: X | None = None) -> X:
        return self._agg(f"sum({self._if(x, cond)})")

    def mean(self, x: X, cond: X | None = None) -> X:
        return self._agg(f"avg({self._if(x, cond)})")

    def min(self, x: X, cond: X | None = None) -> X:
        return self._agg(f"min({self._if(x, cond)})")

    def max(self, x: X, cond: X | None = None) -> X:
        return self._agg(f"max({self._if(x, cond)})")

    def std(self, x: X, cond: X | None = None) -> X:
        return self._agg(f"stddev_samp({self._if(x, cond)})")

    def std_pop(self, x: X, cond: X | None = None) -> X:
        return self._agg(f"stddev_pop({self._if(x, cond)})")

    def count(self, x: X, cond: X | None = None) -> X:
        return join("cast({0} as double)", self._agg(f"count({self._if(x, cond)})"))

    def last(self, x: X, cond: X | None = None) -> X:
        return self._agg(f"{self.d.last_of}({x.text}, {self._if(X('seq'), cond)})")

    def first(self, x: X, cond: X | None = None) -> X:
        return self._agg(f"{self.d.first_of}({x.text}, {self._if(X('seq'), cond)})")

    def slope(self, y: X, x: X, cond: X | None = None) -> X:
        """Least-squares slope of y on x; missing where x doesn't vary."""
        a, b = self._if(y, cond), self._if(x, cond)
        return self._agg(f"covar_pop(cast({a} as double), cast({b} as double))") / self._agg(f"var_pop(cast({b} as double))")

    def query(self, panel: str, outputs: dict[str, X], zero: set[str]) -> str:
        """SELECT of the outputs by (dt, code); those in zero have 0 for missing."""
        parts, now = [f"panel AS ({panel})"], "panel"
        for (_, k), cols in sorted(self.s.layers.items()):
            parts.append(f"layer{k} AS (SELECT *, {', '.join(f'{t} AS {c}' for t, c in cols.items())} FROM {now})")
            now = f"layer{k}"
        parts.append(f"grouped AS (SELECT dt, code, {', '.join(f'{t} AS {c}' for t, c in self.aggs.items())} FROM {now} GROUP BY dt, code)")
        value = lambda n, x: rounded(f"coalesce({x.text}, {num(0.0)})" if n in zero else x.text)
        return f"WITH {', '.join(parts)} SELECT cast(dt as {self.d.string}) AS dt, code, {', '.join(f'{value(n, x)} AS {n}' for n, x in outputs.items())} FROM grouped"
