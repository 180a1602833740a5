"""Series layers evaluated in numpy over blocks of whole groups, from the same expression text as the window queries.

Every window at every row costs Spark a copy of a wide row, and every rank a sort. Here the rows of one (dt, code)
are a column of a block of groups of like length, places down and groups across, so that a lag or one step of a
rolling function is one operation on a whole block. Rolling functions are summed anew at every row, from the
oldest row to the newest and with the updates of Spark's aggregates, so results are Spark's to the last bit.

Edge cases: missing values have a mask of their own, so that NaN and infinities stay values; NaN equals itself and is
the greatest, as in SQL. A group has to fit a Python worker, at about a hundred columns of doubles. Rows that don't come as
whole groups in order of seq raise an error. Text that isn't known here raises Unsupported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that are gathered before whole groups are evaluated, and cells of a block.
ROWS = 1 << 17
CELLS = 1 << 16


class Unsupported(ValueError):
    """Text that blocks can't evaluate."""


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:e[+-]?\d+)?)|(->|<=|>=|[-+*/(),<>=])|(\w+))", re.I)
_WINDOW = re.compile(r"(\w+)\((.*)\) OVER \(PARTITION BY dt, code(?: ORDER BY (.*?))?(?: (ROWS|RANGE) BETWEEN (.*) AND (.*))?\)")
_SCALAR = {"nullif": 2, "coalesce": 2, "abs": 1, "sign": 1, "sqrt": 1, "least": 2, "greatest": 2, "round": 2}


class Plan:
    """Expression texts as one graph, in which equal parts are one node.

    A node is (operation, *operands); operands are node numbers or constants.
    """

    def __init__(self, texts: dict[str, str], last: set[str]) -> None:
        """texts: column -> text, where other names are columns of the panel; last: columns that only the last row needs."""
        self.texts, self.last = texts, last
        self.nodes: list[tuple] = []
        self._known: dict[tuple, int] = {}
        self._names: dict[str, int] = {}

    def add(self, *node) -> int:
        if node not in self._known:
            self._known[node] = len(self.nodes)
            self.nodes.append(node)
        return self._known[node]

    def name(self, name: str) -> int:
        if name not in self._names:
            text = self.texts.get(name)
            self._names[name] = self.add("col", name) if text is None else self._window(text, name in self.last) if " OVER (" in text else self.scalar(text)
        return self._names[name]

    def base(self) -> list[str]:
        """Columns of the panel."""
        return sorted(n[1] for n in self.nodes if n[0] == "col")

    def _window(self, text: str, last: bool) -> int:
        m = _WINDOW.fullmatch(text)
        if not m:
            raise Unsupported(text)
        fn, args, order, kind, start, end = m.groups()
        if order and order != "seq":
            by = self.scalar(order.removesuffix(" NULLS LAST"))
            if (text.startswith("rank() ") and not kind) or (fn, args, kind) == ("count", "*", "RANGE"):
                return self.add("pick", self.add("places", by), int(fn == "count"))
            raise Unsupported(text)
        xs = self.scalar(args, many=True)
        if fn == "lag" and order and not kind and self.nodes[xs[1]][0] == "num":
            return self.add("lag", xs[0], int(self.nodes[xs[1]][1]))
        if fn == "last_value" and (start, end) == ("UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING"):
            return self.add("last", xs[0])
        if not order and fn in ("count", "sum"):
            return self.add(f"all_{fn}", xs[0])
        w = re.fullmatch(r"(\d+) PRECEDING", start or "")
        if not w or kind != "ROWS" or end != "CURRENT ROW":
            raise Unsupported(text)
        w = int(w[1]) + 1
        if fn == "covar_pop":
            # Of two series, or of one beside another that has the same gaps: all moments come from one pass.
            return self.add("covar", w, last, *xs)
        if fn == "collect_list":
            return self.add("list", xs[0], w, last)
        if fn in ("sum", "avg", "count", "min", "max", "max_by"):
            return self.add(f"roll_{fn}", w, last, *xs)
        raise Unsupported(text)

    def scalar(self, text: str, many: bool = False):
        """Node of a scalar expression, or nodes of several between commas."""
        tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise Unsupported(text)
            tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        tokens.append("")
        pos = 0

        def take(*wanted: str) -> str | None:
            nonlocal pos
            if wanted and tokens[pos].lower() not in wanted:
                return None
            pos += 1
            return tokens[pos - 1].lower() if wanted else tokens[pos - 1]

        def need(token: str) -> None:
            if not take(token):
                raise Unsupported(f"{token!r} wanted, {tokens[pos]!r} found in {text}")

        def tree(operand, *ops: str):
            def parse() -> int:
                a = operand()
                while op := take(*ops):
                    a = self.add(op, a, operand())
                return a

            return parse

        def unary() -> int:
            return self.add("neg", unary()) if take("-") else atom()

        def compared() -> int:
            a = added()
            if op := take("<", "<=", ">", ">=", "="):
                # A greater than b is b less than a.
                b = added()
                return self.add("<" if op in "<>" else op.replace(">", "<"), *((b, a) if ">" in op else (a, b)))
            if take("is"):
                no = take("not")
                need("null")
                return self.add("known" if no else "missing", a)
            return a

        def filtered() -> tuple[int, str, int | None]:
            """(list, operator, node) of filter(list, v -> v operator node)."""
            need("filter"), need("(")
            items = self.name(take())
            need(","), need("v"), need("->"), need("v")
            if take("is"):
                need("not"), need("null"), need(")")
                return items, "known", None
            op = take("<", "=")
            x = added()
            need(")")
            return items, op, x

        def atom() -> int:
            if take("("):
                x = expr()
                need(")")
                return x
            t = take()
            if t[:1].isdigit():
                return self.add("num", float(t))
            low = t.lower()
            if low == "case":
                need("when")
                cond = expr()
                need("then")
                yes = expr()
                no = expr() if take("else") else None
                need("end")
                return self.add("case", cond, yes, no)
            if not take("("):
                if not t or low in ("when", "then", "else", "end", "null"):
                    raise Unsupported(text)
                return self.name(t)
            if low == "cast":
                x = expr()
                need("as"), need("double"), need(")")
                return x
            if low == "size":
                items, op, x = filtered()
                need(")")
                if x is None:
                    raise Unsupported(text)
                return self.add("places_in", items, op, x)
            if low == "array_position":
                items, op, _ = filtered()
                need(","), need("array_max"), need("(")
                if op != "known" or self.name(take()) != items:
                    raise Unsupported(text)
                need(")"), need(")")
                return self.add("first_greatest", items)
            args = [expr()]
            while take(","):
                args.append(expr())
            need(")")
            if _SCALAR.get(low) != len(args):
                raise Unsupported(f"{low} in {text}")
            return self.add(low, *args)

        added = tree(tree(unary, "*", "/"), "+", "-")
        expr = tree(tree(compared, "and"), "or")
        out = [expr()]
        while many and take(","):
            out.append(expr())
        if tokens[pos]:
            raise Unsupported(f"{tokens[pos]!r} left over in {text}")
        return out if many else out[0]


def operands(node: tuple) -> tuple[int, ...]:
    """Node numbers among a node's operands."""
    op, *rest = node
    if op in ("col", "num"):
        return ()
    if op in ("pick", "lag"):
        return (rest[0],)
    if op == "list":
        return (rest[0],)
    if op == "places_in":
        return (rest[0], rest[2])
    if op == "covar" or op.startswith("roll_"):
        return tuple(rest[2:])
    return tuple(x for x in rest if x is not None)


def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a < b where NaN is the greatest."""
    out = a < b
    if (odd := np.isnan(b)).any():
        out = out | (odd & ~np.isnan(a))
    return out


def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a = b where NaN equals itself."""
    out = a == b
    if (odd := np.isnan(b)).any():
        out = out | (odd & np.isnan(a))
    return out


def half_away(x: np.ndarray, digits: int) -> np.ndarray:
    """round(x, digits), halves away from zero; as is where the scaled value overflows."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    out = (whole + np.copysign(np.abs(y - whole) >= 0.5, y)) / 10.0**digits
    return np.where(np.isfinite(out), out, x)


class Items:
    """The values of the last w rows, as a list column."""

    def __init__(self, x: np.ndarray, ok: np.ndarray, w: int, last: bool) -> None:
        self.x, self.ok, self.w, self.last = x, ok, w, last


class Block:
    """Groups of like length: arrays of places by groups; those of one row hold one value by group.

    A value is (numbers, mask of known ones). Places beyond a group's end hold anything.
    """

    def __init__(self, columns: dict[str, tuple[np.ndarray, np.ndarray]], length: np.ndarray) -> None:
        self.columns, self.length = columns, length
        self.shape = (int(length.max()), len(length))
        self.inside = np.arange(self.shape[0])[:, None] < length
        self.across = np.arange(self.shape[1])
        self.moments: dict[tuple, tuple] = {}

    def at_end(self, x: np.ndarray, back: int = 0) -> np.ndarray:
        """Values so many rows before the last one; the first row's where the group is too short."""
        x = np.broadcast_to(x, self.shape) if x.ndim < 2 else x
        return x if len(x) == 1 else x[np.maximum(self.length - 1 - back, 0), self.across][None]

    def steps(self, w: int, last: bool, *arrays: np.ndarray) -> Iterator[tuple]:
        """(first row the step is for, arrays as they were so many rows before) from the oldest step to the newest.

        The first array is a mask, which also leaves out what lies before the group.
        """
        arrays = [np.broadcast_to(x, self.shape) for x in arrays]
        for j in range(min(w, self.shape[0]) - 1, -1, -1):
            if last:
                mask, *rest = (self.at_end(x, j) for x in arrays)
                yield 0, mask & (self.length > j)[None], *rest
            else:
                yield j, *(x[: self.shape[0] - j] for x in arrays)

    def _out(self, last: bool, kind: type = float) -> np.ndarray:
        return np.zeros((1, self.shape[1]) if last else self.shape, kind)

    def roll(self, fn: str, w: int, last: bool, *values: tuple) -> tuple[np.ndarray, np.ndarray]:
        (x, ok), n = values[0], self._out(last)
        if fn == "max_by":
            best, out, known, (key, has) = self._out(last), self._out(last), self._out(last, bool), values[1]
            for j, o, v, vk, k in self.steps(w, last, has, x, ok, key):
                newer = o & ((n[j:] == 0) | ~less(k, best[j:]))
                best[j:], out[j:], known[j:] = np.where(newer, k, best[j:]), np.where(newer, v, out[j:]), np.where(newer, vk, known[j:])
                n[j:] += o
            return out, known
        if fn == "count":
            for j, o in self.steps(w, last, ok):
                n[j:] += o
            return n, np.ones_like(n, bool)
        blank = {"min": np.nan, "max": -np.inf}.get(fn, 0.0)
        acc, x = np.full_like(n, blank), np.where(ok, x, blank)
        for j, o, v in self.steps(w, last, ok, x):
            n[j:] += o
            if last:
                v = np.where(o, v, blank)
            into = acc[j:]
            if fn in ("sum", "avg"):
                into += v
            else:
                (np.fmin if fn == "min" else np.maximum)(into, v, out=into)
        return acc / np.maximum(n, 1) if fn == "avg" else acc, n > 0

    def covar(self, w: int, last: bool, a: tuple, b: tuple, pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """covar_pop(a, b) with Spark's updates; that of each alone is kept where both have the same gaps."""
        p, q = pair
        if (w, last, p, q) in self.moments:
            return self.moments.pop((w, last, p, q))
        (x, xk), (y, yk) = a, b
        both = p != q and np.array_equal(np.broadcast_to(xk, self.shape), np.broadcast_to(yk, self.shape))
        ok = xk & yk
        x, y = np.where(ok, x, 0.0), np.where(ok, y, 0.0)
        n, xm, ym, xy, xx, yy = (self._out(last) for _ in range(6))
        for j, o, u, v in self.steps(w, last, ok, x, y):
            m, ux, vy = n[j:], xm[j:], ym[j:]
            m += o
            k = np.maximum(m, 1)
            dx = np.where(o, u - ux, 0.0)
            ux += dx / k
            if p == q:
                xy[j:] += dx * (u - ux)
                continue
            dy = np.where(o, v - vy, 0.0)
            vy += dy / k
            late = v - vy
            xy[j:] += dx * late
            if both:
                xx[j:] += dx * (u - ux)
                yy[j:] += dy * late
        known, k = n > 0, np.maximum(n, 1)
        if both:
            self.moments[w, last, p, p], self.moments[w, last, q, q] = (xx / k, known), (yy / k, known)
        return xy / k, known

    def places(self, x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, rows of the same value) among a group's known values; anything where missing."""
        ok = np.broadcast_to(ok & self.inside, self.shape)
        x = np.broadcast_to(x, self.shape)
        if np.isnan(x[ok]).any():
            x = np.unique(x, return_inverse=True)[1].reshape(self.shape).astype(float)
        x = np.ascontiguousarray(np.where(ok, x, np.nan).T)
        order = np.argsort(x, axis=1)
        s = np.take_along_axis(x, order, 1)
        k = s.shape[1]
        new = np.ones(s.shape, bool)
        new[:, 1:] = s[:, 1:] != s[:, :-1]
        at = np.arange(k)
        first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
        ends = np.ones(s.shape, bool)
        ends[:, :-1] = new[:, 1:]
        last = np.minimum.accumulate(np.where(ends, at, k)[:, ::-1], axis=1)[:, ::-1]
        rank, count = np.empty(s.shape), np.empty(s.shape)
        np.put_along_axis(rank, order, first + 1.0, 1)
        np.put_along_axis(count, order, last - first + 1.0, 1)
        return np.ascontiguousarray(rank.T), np.ascontiguousarray(count.T)

    def places_in(self, items: Items, op: str, x: np.ndarray) -> np.ndarray:
        """How many of the items are less than x, or equal to it."""
        out, test = self._out(items.last), less if op == "<" else same
        x = self.at_end(x) if items.last else np.broadcast_to(x, self.shape)
        for j, o, v in self.steps(items.w, items.last, items.ok, items.x):
            out[j:] += o & test(v, x[j:])
        return out

    def first_greatest(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        n, best, place = self._out(items.last), self._out(items.last), self._out(items.last)
        for j, o, v in self.steps(items.w, items.last, items.ok, items.x):
            more = o & ((n[j:] == 0) | less(best[j:], v))
            n[j:] += o
            best[j:], place[j:] = np.where(more, v, best[j:]), np.where(more, n[j:], place[j:])
        return place, n > 0

    def value(self, node: tuple, v: list):
        """Value of a node; v: values by node number."""
        op, *rest = node
        if op == "col":
            return self.columns[rest[0]]
        if op == "num":
            return np.float64(rest[0]), np.True_
        if op == "pick":
            return v[rest[0]][rest[1]], np.True_
        if op == "places":
            return self.places(*v[rest[0]])
        if op == "list":
            return Items(*v[rest[0]], rest[1], rest[2])
        if op == "places_in":
            x, ok = v[rest[2]]
            return self.places_in(v[rest[0]], rest[1], x), self.at_end(ok) if v[rest[0]].last else ok
        if op == "first_greatest":
            return self.first_greatest(v[rest[0]])
        if op == "covar":
            return self.covar(rest[0], rest[1], v[rest[2]], v[rest[3]], (rest[2], rest[3]))
        if op.startswith("roll_"):
            return self.roll(op[5:], rest[0], rest[1], *(v[i] for i in rest[2:]))
        x, ok = v[rest[0]]
        if op == "lag":
            x, ok, k = np.broadcast_to(x, self.shape), np.broadcast_to(ok, self.shape), rest[1]
            out, known = self._out(False), self._out(False, bool)
            out[k:], known[k:] = x[: max(0, len(x) - k)], ok[: max(0, len(x) - k)]
            return out, known
        if op == "last":
            return self.at_end(x), self.at_end(ok)
        if op in ("all_count", "all_sum"):
            ok = np.broadcast_to(ok & self.inside, self.shape)
            n = ok.sum(axis=0, keepdims=True, dtype=float)
            return (n, np.True_) if op == "all_count" else (np.cumsum(np.where(ok, x, 0.0), axis=0)[-1:], n > 0)
        if op in ("known", "missing"):
            return (ok if op == "known" else ~ok), np.True_
        if op in ("abs", "sign", "sqrt", "neg"):
            return {"abs": np.abs, "sign": np.sign, "sqrt": np.sqrt, "neg": np.negative}[op](x), ok
        if op == "case":
            hit, (y, yk) = x & ok, v[rest[1]]
            z, zk = v[rest[2]] if rest[2] is not None else (np.float64(0.0), np.False_)
            return np.where(hit, y, z), np.where(hit, yk, zk)
        y, yk = v[rest[1]]
        if op == "round":
            return half_away(x, int(y)), ok
        if op == "coalesce":
            return np.where(ok, x, y), ok | yk
        if op == "nullif":
            # 1 stands for the missing divisor, so that no NaN arises where there is no value.
            hit = yk & same(x, y)
            return np.where(hit, 1.0, x), ok & ~hit
        if op in ("least", "greatest"):
            both = np.fmin(x, y) if op == "least" else np.maximum(x, y)
            return np.where(ok & yk, both, np.where(ok, x, y)), ok | yk
        if op == "or":
            return (x & ok) | (y & yk), (ok & yk) | (x & ok) | (y & yk)
        if op == "and":
            return (x & ok) & (y & yk), (ok & yk) | (ok & ~x) | (yk & ~y)
        if op == "<=":
            return ~less(y, x), ok & yk
        return {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "<": less, "=": same}[op](x, y), ok & yk


class Ends:
    """Evaluates columns at the last row of every group of a stream of ordered rows."""

    def __init__(self, plan: Plan, names: list[str]) -> None:
        self.plan, self.names = plan, names
        self.roots = {n: plan.name(n) for n in names}
        self.base = [c for c in plan.base() if c != "seq"]
        # A pair goes before the same moments of its sides alone, which come from its pass.
        pairs = {(*n[1:3], x): i for i, n in enumerate(plan.nodes) if n[0] == "covar" and n[3] != n[4] for x in n[3:]}
        needs = lambda i: (*((pairs[k],) if (n := plan.nodes[i])[0] == "covar" and n[3] == n[4] and (k := n[1:4]) in pairs else ()), *operands(plan.nodes[i]))
        # Depth first, so that few values live at once; each is dropped after its last use.
        order, done, stack = [], set(), [(r, False) for r in reversed(list(self.roots.values()))]
        while stack:
            i, ready = stack.pop()
            if ready:
                order.append(i)
            elif i not in done:
                done.add(i)
                stack += [(i, True), *((x, False) for x in reversed(needs(i)))]
        kept = set(self.roots.values())
        last = {x: i for i in order for x in needs(i)}
        drop: dict[int, list[int]] = {}
        for x, i in last.items():
            if x not in kept:
                drop.setdefault(i, []).append(x)
        self.order = [(i, drop.get(i, [])) for i in order]

    def lists(self) -> set[str]:
        """Columns that are lists."""
        return {n for n, r in self.roots.items() if self.plan.nodes[r][0] == "list"}

    def _block(self, columns: dict[str, tuple], first: np.ndarray, length: np.ndarray) -> dict[str, tuple]:
        rows = first + np.minimum(np.arange(int(length.max()))[:, None], length - 1)
        inside = np.arange(len(rows))[:, None] < length
        block = Block({c: (x[rows], inside & ok[rows]) for c, (x, ok) in columns.items()}, length)
        values: list = [None] * len(self.plan.nodes)
        with np.errstate(all="ignore"):
            for i, drop in self.order:
                values[i] = block.value(self.plan.nodes[i], values)
                for x in drop:
                    values[x] = None
        out = {}
        for name, r in self.roots.items():
            if isinstance(values[r], Items):
                it = values[r]
                steps = [(o[0], x[0]) for _, o, x in block.steps(it.w, True, it.ok, it.x)]
                out[name] = np.stack([x for _, x in steps]).T, np.stack([o for o, _ in steps]).T
            else:
                out[name] = tuple(np.broadcast_to(block.at_end(np.asarray(z)), (1, len(length)))[0] for z in values[r])
        return out

    def _evaluate(self, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        seq = table.column("seq").to_numpy().astype(np.int64)
        starts = np.nonzero(seq == 1)[0]
        length = np.diff(np.append(starts, len(seq)))
        if not len(starts) or starts[0] or (seq != np.arange(len(seq)) - np.repeat(starts, length) + 1).any():
            raise ValueError("rows of a group are missing or out of order")
        columns = {"seq": (seq.astype(float), np.ones(len(seq), bool))}
        for c in self.base:
            x = table.column(c)
            columns[c] = x.cast(pa.float64()).fill_null(0.0).to_numpy(), x.is_valid().to_numpy()
        lists = self.lists()
        found: dict[str, list] = {n: [] for n in self.names}
        by = np.argsort(-length, kind="stable")
        at, groups = 0, []
        while at < len(by):
            longest = length[by[at]]
            # Groups of at least four fifths of the longest, as many as a block has cells for.
            end = min(int(np.searchsorted(-length[by], -0.8 * longest, "right")), at + max(1, int(CELLS // longest)))
            pick = by[at:end]
            for n, value in self._block(columns, starts[pick], length[pick]).items():
                found[n].append(value)
            groups.append(pick)
            at = end
        place = np.argsort(np.concatenate(groups))
        ends = starts + length - 1
        out = [table.column(c).take(pa.array(ends)).combine_chunks() for c in ("dt", "code")]
        for n in self.names:
            if n in lists:
                wide = max(x.shape[1] for x, _ in found[n])
                pad = lambda z: np.pad(z, ((0, 0), (wide - z.shape[1], 0)))
                x, ok = (np.concatenate([pad(p[k]) for p in found[n]])[place] for k in (0, 1))
                offsets = np.concatenate([[0], np.cumsum(ok.sum(axis=1))]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[ok])))
            else:
                x, ok = (np.concatenate([p[k] for p in found[n]])[place] for k in (0, 1))
                out.append(pa.array(x.astype(float), mask=~ok))
        out = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in out]
        return pa.RecordBatch.from_arrays(out, names=["dt", "code", *self.names])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row by group of rows (dt, code, seq, columns) that come group by group in order of seq."""
        held, total = [], 0
        for b in batches:
            if total >= ROWS:
                # Up to the last group that starts here, all are whole.
                starts = np.nonzero(b.column(b.schema.get_field_index("seq")).to_numpy() == 1)[0]
                if len(starts):
                    cut = int(starts[-1])
                    yield self._evaluate([*held, b.slice(0, cut)])
                    held, total, b = [], 0, b.slice(cut)
            held.append(b)
            total += b.num_rows
        if total:
            yield self._evaluate(held)
