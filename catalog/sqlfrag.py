"""SQL text shared by several checks: recursions, indicators and rules."""

from __future__ import annotations

from catalog.base import ROLL


def EMA(name: str, src: str, cols: dict[str, tuple]) -> str:
    """CTEs `name`: recursive averages of columns of `src`; cols = out -> (x, alpha, min_periods)."""
    base = ", ".join(f"({x})::DOUBLE AS x{i}" for i, (x, _, _) in enumerate(cols.values()))
    init = ", ".join(f"x{i} AS y{i}, (x{i} IS NOT NULL)::INT AS c{i}" for i in range(len(cols)))
    step = ", ".join(
        f"CASE WHEN r.y{i} IS NULL THEN s.x{i} WHEN s.x{i} IS NULL THEN r.y{i} ELSE {a!r}*s.x{i}+{1 - a!r}*r.y{i} END, r.c{i}+(s.x{i} IS NOT NULL)::INT"
        for i, (_, a, _) in enumerate(cols.values())
    )
    res = ", ".join(f"CASE WHEN c{i}>={n} THEN y{i} END AS {o}" for i, (o, (_, _, n)) in enumerate(cols.items()))
    return f"""{name}_x AS MATERIALIZED (SELECT symbol, ord, {base} FROM {src}),
{name}_r AS (SELECT symbol, ord, {init} FROM {name}_x WHERE ord=0 UNION ALL
 SELECT s.symbol, s.ord, {step} FROM {name}_r r JOIN {name}_x s ON s.symbol=r.symbol AND s.ord=r.ord+1),
{name} AS MATERIALIZED (SELECT symbol, ord, {res} FROM {name}_r)"""


def sp(n: int) -> float:
    return 2.0 / (n + 1.0)


def wi(n: int) -> float:
    return 1.0 / n


_W = "OVER (PARTITION BY symbol ORDER BY ord)"
TR = f"greatest(high-low, abs(high-lag(close) {_W}), abs(low-lag(close) {_W}))"
GAIN = f"greatest(close-lag(close) {_W}, 0*(close-lag(close) {_W}))"
LOSS = f"-least(close-lag(close) {_W}, 0*(close-lag(close) {_W}))"

# Bars with the inputs of the recursive indicators.
PRE = f", pre AS MATERIALIZED (SELECT *, {TR} AS tr, {GAIN} AS gain, {LOSS} AS loss FROM b)"


def RSI(g: str, l: str, no_loss: float | None = None) -> str:
    v = f"100-100/(1+{g}/nullif({l},0))"
    return f"coalesce({v},50.0)" if no_loss is None else f"CASE WHEN {l}=0 THEN {no_loss} ELSE {v} END"


def SMA(n: int, x: str = "close") -> str:
    return ROLL("avg({x})", x, n)


def SD(n: int, x: str = "close", pop: bool = False) -> str:
    return ROLL("stddev_pop({x})" if pop else "stddev_samp({x})", x, n)


def HOLD(src: str, name: str = "sig") -> str:
    return f", {name} AS (SELECT * EXCLUDE (state), coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ord), 0.0)::DOUBLE AS weight FROM {src})"
