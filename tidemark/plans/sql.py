"""Pieces of the comparison SQL."""

from __future__ import annotations

EPS = "1e-9"


def prev(x: str, k: int = 1, by: str = "asset", order: str = "bar") -> str:
    return f"lag({x}, {k}) over (partition by {by} order by {order})"


def roll(fn: str, x: str, n: int, by: str = "asset", order: str = "bar") -> str:
    w = f"over (partition by {by} order by {order} rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {w} = {n} then {fn}({x}) {w} end"


def cum(fn: str, x: str, by: str = "asset", order: str = "bar") -> str:
    return f"{fn}({x}) over (partition by {by} order by {order} rows between unbounded preceding and current row)"


def held(x: str, by: str = "asset", order: str = "bar") -> str:
    return f"last_value({x} ignore nulls) over (partition by {by} order by {order} rows between unbounded preceding and current row)"


def above(a: str, b: str) -> str:
    return f"coalesce(({a}) - ({b}) > {EPS}, false)"


def one(cond: str) -> str:
    return f"case when {cond} then 1.0 else 0.0 end"


def sgn(x: str) -> str:
    return f"case when ({x}) > 1e-12 then 1.0 when ({x}) < -1e-12 then -1.0 when ({x}) is not null then 0.0 end"


def ema(x: str, span: int, adjust: bool = False, by: str = "asset") -> str:
    """By scaled prefix sums; for histories of a few thousand bars."""
    q = 1 - 2 / (span + 1)
    s = f"(pow({q!r}, bar) * {cum('sum', f'({x}) * pow({q!r}, -bar)', by)})"
    a = f"{2 / (span + 1)!r}"
    if adjust:
        return f"{s} * {a} / (1 - pow({q!r}, bar + 1))"
    return f"{s} * {a} + pow({q!r}, bar + 1) * first_value({x}) over (partition by {by} order by bar)"


def ret(by: str = "asset", x: str = "close") -> str:
    return f"coalesce({x} / nullif({prev(x, 1, by)}, 0) - 1, 0)"


def net(by: str = "asset", cost: float = 0.0003) -> str:
    """Over rows with close and position."""
    p = prev("position", 1, by)
    return f"coalesce({p}, 0) * {ret(by)} - coalesce(abs(position - {p}), 0) * {cost}"


def latch(enter: str, leave: str, by: str = "asset") -> str:
    return f"coalesce({held(f'case when {enter} then 1.0 when {leave} then 0.0 end', by)}, 0)"


def pf(x: str = "net") -> str:
    w, l = f"coalesce(sum(case when {x} > 0 then {x} end), 0)", f"coalesce(-sum(case when {x} < 0 then {x} end), 0)"
    return f"case when {l} <= 1e-12 then case when {w} > 0 then cast('infinity' as double) else 1.0 end else {w} / nullif({l}, 0) end"


def total(x: str = "net") -> str:
    return f"coalesce(exp(sum(ln(1 + greatest({x}, -0.999999)))) - 1, 0) * 100"


def sharpe(x: str = "net") -> str:
    return f"case when coalesce(stddev_samp({x}), 0) <= 1e-12 then 0 else avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(252) end"


def corr(x: str, y: str) -> str:
    return f"case when stddev_pop({x}) filter ({y} is not null) > 1e-15 and stddev_pop({y}) filter ({x} is not null) > 1e-15 then covar_pop({x}, {y}) / (stddev_pop({x}) filter ({y} is not null) * stddev_pop({y}) filter ({x} is not null)) end"


def draw(what: str, keys: str, perm_id: str = "perm_id", bar: str = "bar") -> str:
    """The draw of tidemark.operators.scenarios; keys: the keys joined by '|' as SQL."""
    x = f"(({bar}::bigint * 2654435761 + {perm_id}::bigint * 2246822507 + cast('0x' || substr(md5('{what}|' || {keys}), 1, 8) as bigint)) % 4294967296)"
    for _ in range(2):
        x = f"list_transform([{x}], lambda v: xor(v, v >> 16) * 73244475 % 4294967296)[1]"
    return f"list_transform([{x}], lambda v: xor(v, v >> 16))[1]"
