"""The few spellings in which Spark SQL and DuckDB differ, for queries that run on both."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass(frozen=True)
class Dialect:
    string: str
    collect: str
    size: str
    keep: str  # filter of a list by a lambda: {list}, {var}, {cond}
    position: str
    greatest_of: str
    days: str  # whole days from {a} to {b}
    seconds: str  # seconds of the day of a timestamp {a}
    last_of: str  # value at the greatest key, which may be null
    first_of: str
    quantile: str  # exact quantile {q} of {x}, linear between values; an aggregate or window function
    to_number: str  # double or null
    json: str  # text of field {k} of a JSON text {x}
    when: str  # timestamp of a date {a} and {s} seconds
    split: str  # part {k} (from 1) of {x} split at {by}
    explode_range: str  # rows of integers {a}..{b} as {as_}; a select item
    swap_pairs: bool  # whether covar_pop(a, b) and the root of covar_pop(a, a) have to stand for covar_pop(b, a) and stddev_pop(a)


SPARK = Dialect(
    string="STRING", collect="collect_list", size="size", keep="filter({list}, {var} -> {cond})", position="array_position", greatest_of="array_max",
    days="datediff({b}, {a})", seconds="(hour({a}) * 3600 + minute({a}) * 60 + second({a}))", last_of="max_by", first_of="min_by", quantile="percentile({x}, {q})",
    to_number="try_cast({x} as double)", json="get_json_object({x}, '$.{k}')", when="(cast({a} as timestamp) + make_interval(0, 0, 0, 0, 0, 0, {s}))", split="split_part({x}, '{by}', {k})",
    explode_range="explode(sequence({a}, {b})) AS {as_}", swap_pairs=True,
)
DUCKDB = Dialect(
    string="VARCHAR", collect="list", size="len", keep="list_filter({list}, lambda {var} : {cond})", position="list_position", greatest_of="list_max",
    days="date_diff('day', {a}, {b})", seconds="(hour({a}) * 3600 + minute({a}) * 60 + second({a}))", last_of="arg_max_null", first_of="arg_min_null", quantile="quantile_cont({x}, {q})",
    to_number="try_cast({x} as double)", json="json_extract_string({x}, '$.{k}')", when="(cast({a} as timestamp) + to_seconds({s}))", split="split_part({x}, '{by}', {k})",
    explode_range="unnest(generate_series({a}, {b})) AS {as_}", swap_pairs=False,
)


def num(v: float) -> str:
    """A double literal (a bare one would be a decimal)."""
    return f"cast({v!r} as double)"


def rounded(x: str) -> str:
    """Results to about nine digits, so that what remains doesn't depend on the order of summation.

    The small addends keep exact halves, which engines round either way, clear of the edge; zero is never negative.
    """
    return (
        f"case when abs({x}) < 1000 then round({x} + {num(1.234e-9)}, 6) + {num(0.0)} when abs({x}) < 1e7 then round({x} + {num(1.234e-5)}, 2) + {num(0.0)}"
        f" else round(({x}) / 1e6 + {num(1.234e-6)}, 3) * 1e6 end"
    )
