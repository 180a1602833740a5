"""Ordered-series expressions, compiled to layered window queries.

An expression is text over the columns of a layer. A window function over it becomes a column of the next
layer; equal functions become one column, and so does what several of them are taken over. Series functions see the rows of one (dt, code) in the order of
seq; the last row of each group then enters the cross-section, whose functions see all codes of one dt. All
functions of a layer share a few window specifications, so Spark sorts once for each of them. A rolling
function that only the last row needs is taken once over the end of its group instead of at every row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from quantloom.functions.blocks import Plan
from quantloom.functions.dialect import Dialect, num, rounded

EPS = 1e-8
#: Standard deviations up to this count as flat in rolling correlations, which are kept to nine decimals.
FLAT = 1e-9
_NAME = re.compile(r"\w+")
#: Columns of a panel that expressions may name.
COLUMNS = {"seq", "n", "sec", "last", "pre_close", "prev_bar_close", "open", "high", "low", "volume", "amount", "num_trades"}
COLUMNS |= {f"{side}_{kind}{k}" for side in ("bid", "ask") for kind in ("price", "volume") for k in range(1, 6)}
_TAIL = "OVER (PARTITION BY dt, code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


class X:
    """Expression text, its phase (0: series, 1: cross-section) and the layer from which it can be read."""

    def __init__(self, text: str, phase: int = 0, depth: int = 0) -> None:
        self.text, self.phase, self.depth = text, phase, depth

    def _op(self, op: str, other: X | float, swap: bool = False) -> X:
        o = other if isinstance(other, X) else X(num(float(other)))
        a, b = (o, self) if swap else (self, o)
        return join(f"({{0}} {op} {{1}})", a, b)

    def __add__(self, o):
        return self._op("+", o)

    def __radd__(self, o):
        return self._op("+", o, True)

    def __sub__(self, o):
        return self._op("-", o)

    def __rsub__(self, o):
        return self._op("-", o, True)

    def __mul__(self, o):
        return self._op("*", o)

    def __rmul__(self, o):
        return self._op("*", o, True)

    def __truediv__(self, o):
        o = o if isinstance(o, X) else X(num(float(o)))
        return join("({0} / nullif({1}, 0))", self, o)

    def __rtruediv__(self, o):
        return X(num(float(o))) / self

    def __neg__(self):
        return join("(-{0})", self)

    def __lt__(self, o):
        return self._op("<", o)

    def __le__(self, o):
        return self._op("<=", o)

    def __gt__(self, o):
        return self._op(">", o)

    def __ge__(self, o):
        return self._op(">=", o)


def join(form: str, *xs: X) -> X:
    """A scalar expression of others."""
    phase = max(x.phase for x in xs)
    return X(form.format(*(x.text for x in xs)), phase, max((x.depth for x in xs if x.phase == phase), default=0))


def where(cond: X, yes: X | float, no: X | float) -> X:
    y, n = (v if isinstance(v, X) else X(num(float(v))) for v in (yes, no))
    return join("(case when {0} then {1} else {2} end)", cond, y, n)


def either(a: X, b: X) -> X:
    return join("({0} or {1})", a, b)


def absolute(x: X) -> X:
    return join("abs({0})", x)


def sign(x: X) -> X:
    return join("cast(sign({0}) as double)", x)


def fill(x: X, v: float = 0.0) -> X:
    return join(f"coalesce({{0}}, {num(v)})", x)


def log(x: X) -> X:
    return join("(case when {0} > 0 then ln({0}) end)", x)


def root(x: X) -> X:
    return join("(case when {0} >= 0 then sqrt({0}) end)", x)


def power(x: X, p: float | X) -> X:
    return join("power({0}, {1})", x, p if isinstance(p, X) else X(num(float(p))))


def least(a: X, b: X) -> X:
    return join("least({0}, {1})", a, b)


def greatest(a: X, b: X) -> X:
    return join("greatest({0}, {1})", a, b)


class Series:
    """Collects the window columns of a set of expressions and renders the query."""

    def __init__(self, dialect: Dialect) -> None:
        self.d = dialect
        #: (phase, layer) -> expression -> column.
        self.layers: dict[tuple[int, int], dict[str, str]] = {}
        #: The same for expressions that the windows of a layer are taken over.
        self.lets: dict[tuple[int, int], dict[str, str]] = {}
        #: Rolling function -> the same at a group's last row.
        self.tails: dict[str, str] = {}

    def let(self, x: X) -> X:
        """x as a column, evaluated once a row before the windows of its layer."""
        if _NAME.fullmatch(x.text):
            return x
        at = self.lets.setdefault((x.phase, x.depth), {})
        return X(at.setdefault(x.text, f"v{x.phase}_{x.depth}_{len(at)}"), x.phase, x.depth)

    def _window(self, text: str, phase: int, depth: int) -> X:
        at = self.layers.setdefault((phase, depth), {})
        name = at.setdefault(text, f"w{phase}_{depth}_{len(at)}")
        return X(name, phase, depth + 1)

    def _over(self, call: str, x: X, frame: str) -> X:
        return self._window(f"{call} OVER (PARTITION BY dt, code{frame})", 0, x.depth)

    def _rolling(self, fn: str, w: int, *xs: X) -> X:
        """An aggregate, which skips missing values, of the last w rows."""
        w = max(1, int(w))
        text = f"{fn}({', '.join(x.text for x in xs)}) OVER (PARTITION BY dt, code ORDER BY seq ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        self.tails[text] = f"{fn}({', '.join(f'case when seq > n - {w} then {x.text} end' for x in xs)}) {_TAIL}"
        return self._window(text, 0, max(x.depth for x in xs))

    def col(self, name: str) -> X:
        return X(name)

    # Series functions.
    def lag(self, x: X, k: int) -> X:
        return self._over(f"lag({x.text}, {max(1, int(k))})", x, " ORDER BY seq")

    def diff(self, x: X, k: int = 1) -> X:
        return x - self.lag(x, k)

    def first(self, x: X) -> X:
        return self._over(f"first_value({x.text})", x, " ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")

    def delta(self, x: X, k: int = 1) -> X:
        """Difference to k rows before; 0 where the group is too short, missing where either value is."""
        return join(f"(case when seq > {max(1, int(k))} then {{0}} else {num(0.0)} end)", self.diff(x, k))

    def delay(self, x: X, k: int) -> X:
        """Value k rows before; the first one where the group is too short."""
        return join(f"(case when seq > {max(1, int(k))} then {{0}} else {{1}} end)", self.lag(x, k), self.first(x))

    def mean(self, x: X, w: int) -> X:
        return self._rolling("avg", w, self.let(x))

    def sum(self, x: X, w: int) -> X:
        return self._rolling("sum", w, self.let(x))

    def min(self, x: X, w: int) -> X:
        return self._rolling("min", w, self.let(x))

    def max(self, x: X, w: int) -> X:
        return self._rolling("max", w, self.let(x))

    def std(self, x: X, w: int) -> X:
        """Sample deviation of at least two rows."""
        return self._rolling("stddev_samp", max(2, w), self.let(x))

    def whole(self, fn: str, x: X) -> X:
        """An aggregate of the whole group."""
        return self._over(f"{fn}({x.text})", x, "")

    def rank(self, x: X) -> X:
        """Percentile rank within the group, ties averaged, missing values apart."""
        x = self.let(x)
        by = f"PARTITION BY dt, code ORDER BY {x.text} NULLS LAST"
        r = self._window(f"rank() OVER ({by})", 0, x.depth)
        same = self._window(f"count(*) OVER ({by} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)", 0, x.depth)
        n = self._over(f"count({x.text})", x, "")
        return join(f"(case when {{0}} is not null then ({{1}} + ({{2}} - 1) * {num(0.5)}) / nullif({{3}}, 0) end)", x, r, same, n)

    def rank_last(self, x: X) -> X:
        """rank() of a group's last row alone: counts below and equal to it, without a sort by x."""
        x = self.let(x)
        end = self._over(f"last_value({x.text})", x, " ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
        count = lambda op: self._over(f"sum(case when {x.text} {op} {end.text} then 1 else 0 end)", X("", 0, max(x.depth, end.depth)), "")
        return join(f"(case when {{0}} is not null then ({{1}} + ({{2}} + 1) * {num(0.5)}) / nullif({{3}}, 0) end)", end, count("<"), count("="), self._over(f"count({x.text})", x, ""))

    def ts_rank(self, x: X, w: int) -> X:
        """Percentile rank of the current value among the last w."""
        x = self.let(x)
        items, n = self._rolling(self.d.collect, w, x), self._rolling("count", w, x)
        pick = lambda op: f"{self.d.size}({self.d.keep.format(list='{0}', var='v', cond=f'v {op} {{2}}')})"
        return join(f"(case when {{2}} is not null then ({pick('<')} + ({pick('=')} + 1) * {num(0.5)}) / nullif({{1}}, 0) end)", items, n, x)

    def ts_rank_last(self, x: X, w: int) -> X:
        """Percentile rank of the latest known value among the last w; 0 where none is known."""
        x = self.let(x)
        items = self._rolling(self.d.collect, w, x)
        end = self._rolling(self.d.last_of, w, x, self.let(join("(case when {0} is not null then seq end)", x)))
        pick = lambda op: f"{self.d.size}({self.d.keep.format(list='{0}', var='v', cond=f'v {op} {{2}}')})"
        return fill(join(f"(({pick('<')} + ({pick('=')} + 1) * {num(0.5)}) / nullif({{1}}, 0))", items, self._rolling("count", w, x), end))

    def _pairs(self, x: X, y: X, w: int) -> tuple[X, X, X, X]:
        x, y, w = self.let(x), self.let(y), max(2, w)
        a, b = (self.let(join("(case when {0} is not null then {1} end)", p, q)) for p, q in ((y, x), (x, y)))
        return self._moments(lambda fn, *v: self._rolling(fn, w, *v), a, b)

    def _moments(self, call: Callable[..., X], a: X, b: X) -> tuple[X, X, X, X]:
        """Count, covariance and deviations of pairs by an aggregate call.

        DuckDB adds (b - mean of b before) * (a - mean of a after) to covar_pop(a, b), and the same of a alone to
        stddev_pop(a). Spark does so for covar_pop(b, a) only; its stddev_pop rounds apart. Where a side hardly moves
        beside its level, correlations of two pairs differ from 1 by more than nine decimals hide, and later ranks with them.
        """
        if not self.d.swap_pairs:
            return call("count", a), call("covar_pop", a, b), call("stddev_pop", a), call("stddev_pop", b)
        return call("count", a), call("covar_pop", b, a), root(call("covar_pop", a, a)), root(call("covar_pop", b, b))

    def _last_pairs(self, x: X, y: X, w: int) -> tuple[X, X, X, X]:
        """_pairs() of the last w complete pairs of a group, however many gaps lie between them."""
        x, y, w = self.let(x), self.let(y), max(2, int(w))
        a, b = (self.let(join("(case when {0} is not null then {1} end)", p, q)) for p, q in ((y, x), (x, y)))
        later = self.whole("count", a) - self._over(f"count({a.text})", a, " ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        a, b = (self.let(join(f"(case when {{0}} < {w} then {{1}} end)", later, v)) for v in (a, b))
        call = lambda fn, *v: self._window(f"{fn}({', '.join(z.text for z in v)}) {_TAIL}", 0, a.depth)
        return self._moments(call, a, b)

    def corr(self, x: X, y: X, w: int) -> X:
        """Rolling correlation; missing where there are no two pairs or a side is flat."""
        return join(f"(case when {{0}} >= 2 and {{2}} > {num(FLAT)} and {{3}} > {num(FLAT)} then round({{1}} / ({{2}} * {{3}}), 9) end)", *self._pairs(x, y, w))

    def corr_last(self, x: X, y: X, w: int) -> X:
        """Correlation of the last w pairs; 0 where there are no two or a side is flat."""
        return join(f"(case when {{0}} >= 2 and {{2}} > {num(EPS)} and {{3}} > {num(EPS)} then round({{1}} / ({{2}} * {{3}}), 9) else {num(0.0)} end)", *self._last_pairs(x, y, w))

    def cov_last(self, x: X, y: X, w: int) -> X:
        """Sample covariance of the last w pairs; 0 where there are no two."""
        n, c, _, _ = self._last_pairs(x, y, w)
        return join(f"(case when {{0}} >= 2 then round({{1}} * {{0}} / nullif({{0}} - 1, 0), 9) else {num(0.0)} end)", n, c)

    def decay(self, x: X, w: int, eps: float = EPS) -> X:
        """Linearly weighted mean of the last w rows, missing values as 0, the latest row weighing most."""
        x = self.let(x)
        v = self.let(fill(x))
        s, t, n = self._rolling("sum", w, v), self._rolling("sum", w, self.let(join("({0} * seq)", v))), self._rolling("count", w, x)
        m = join(f"cast(least(seq, {int(w)}) as double)", x)
        return join(f"(case when {{3}} > 0 then round(({{1}} - (seq - {{2}}) * {{0}}) / ({{2}} * ({{2}} + 1) / 2 + {num(eps)}), 12) end)", s, t, m, n)

    def argmax(self, x: X, w: int) -> X:
        """Place, from 1, of the first greatest of the last w rows."""
        items = self._rolling(self.d.collect, w, self.let(x))
        known = self.d.keep.format(list="{0}", var="v", cond="v is not null")
        return join(f"cast({self.d.position}({known}, {self.d.greatest_of}({{0}})) as double)", items)

    # Cross-section functions.
    def _across(self, call: str, x: X, order: str = "") -> X:
        return self._window(f"{call} OVER (PARTITION BY dt{order})", 1, x.depth if x.phase == 1 else 0)

    def cs_rank(self, x: X) -> X:
        """Percentile rank among the codes of a dt, ties averaged, missing values apart."""
        x = self.let(X(x.text, 1, x.depth if x.phase == 1 else 0))
        by = f" ORDER BY {x.text} NULLS LAST"
        r, same, n = self._across("rank()", x, by), self._across("count(*)", x, by + " RANGE BETWEEN CURRENT ROW AND CURRENT ROW"), self._across(f"count({x.text})", x)
        return join(f"(case when {{0}} is not null then ({{1}} + ({{2}} - 1) * {num(0.5)}) / nullif({{3}}, 0) end)", x, r, same, n)

    def cs_scale(self, x: X) -> X:
        """Share of the sum of absolute values of a dt; 0 where that is flat."""
        total = self._across(f"sum(abs({x.text}))", x)
        return join(f"(case when {{1}} <= {num(EPS)} then {num(0.0)} else {{0}} / {{1}} end)", X(x.text, 1, x.depth if x.phase == 1 else 0), total)

    def _needed(self) -> set[str]:
        """Names in series columns: what other series columns are made from is needed at every row, the rest at the last."""
        return {w for at in (self.layers, self.lets) for (p, _), cols in at.items() if p == 0 for t in cols for w in _NAME.findall(t)}

    def query(self, panel: str, outputs: dict[str, X], missing: float | None = 0.0) -> str:
        """SELECT of the outputs by (dt, code), at the last row of each group."""
        parts = [f"panel AS ({panel})"]
        now = self._layered(0, "panel", parts)
        parts.append(f"ends AS (SELECT * FROM {now} WHERE seq = n)")
        return self._select(outputs, missing, parts)

    def plan(self, outputs: dict[str, X]) -> tuple[Plan, list[str]]:
        """The series columns as a plan for blocks, and the columns that across() needs of every group's last row."""
        made = {c: t for at in (self.layers, self.lets) for (p, _), cols in at.items() if p == 0 for t, c in cols.items()}
        every = self._needed()
        plan = Plan(made, {c for c, t in made.items() if t in self.tails and c not in every})
        texts = [x.text for x in outputs.values()] + [t for at in (self.layers, self.lets) for (p, _), cols in at.items() if p == 1 for t in cols]
        names = {w for t in texts for w in _NAME.findall(t)}
        return plan, sorted(c for c in names if c in made or c in COLUMNS)

    def across(self, ends: str, outputs: dict[str, X], missing: float | None = 0.0) -> str:
        """query() from the last rows of all groups on."""
        return self._select(outputs, missing, [f"ends AS (SELECT * FROM {ends})"])

    def _select(self, outputs: dict[str, X], missing: float | None, parts: list[str]) -> str:
        now = self._layered(1, "ends", parts)
        value = lambda x: rounded(f"coalesce({x.text}, {num(missing)})" if missing is not None else x.text)
        return f"WITH {', '.join(parts)} SELECT cast(dt as {self.d.string}) AS dt, code, {', '.join(f'{value(x)} AS {name}' for name, x in outputs.items())} FROM {now}"

    def _layered(self, phase: int, now: str, parts: list[str]) -> str:
        """Appends the layers of a phase over a table; returns the last one's name."""
        every = self._needed()
        for k in range(max((k for p, k in [*self.layers, *self.lets] if p == phase), default=-1) + 1):
            given, cols = self.lets.get((phase, k), {}), self.layers.get((phase, k), {})
            cols = {t if phase or c in every else self.tails.get(t, t): c for t, c in cols.items()}
            for name, made in ((f"given{phase}_{k}", given), (f"layer{phase}_{k}", cols)):
                if made:
                    parts.append(f"{name} AS (SELECT *, {', '.join(f'{t} AS {c}' for t, c in made.items())} FROM {now})")
                    now = name
        return now
