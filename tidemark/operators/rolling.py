"""Rolling statistics of returns and equity. Frames are bounded, so chunks serve them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import add_moments
from tidemark.plans.series import SERIES, on_chunks

C = F.col


def rolling_volatility(df: DataFrame, ret="r", windows=(21, 63, 252), ppy: float = 252.0, keys=SERIES) -> DataFrame:
    def build(d, c):
        d = add_moments(d, c, {f"_sd{n}": (ret, n, "sd") for n in windows})
        return d.withColumns({f"vol_{n}": C(f"_sd{n}") * ppy**0.5 for n in windows}).drop(*[f"_sd{n}" for n in windows])

    return on_chunks(df, build, keys, back=max(windows))


def _sorted_frame(c, ret: str, n: int) -> Column:
    """The last n values in ascending order, null until n are present."""
    w = c.last(n)
    return F.when(F.count(ret).over(w) >= n, F.sort_array(F.collect_list(ret).over(w)))


def _quantile(values: Column, n: int, q: float) -> Column:
    """Linear interpolation in a sorted array of n values."""
    rank = q * (n - 1)
    lo, part = int(rank), rank - int(rank)
    low = F.get(values, F.lit(lo))
    return low + part * (F.get(values, F.lit(lo + 1)) - low) if part else low


def rolling_var(df: DataFrame, ret="r", n: int = 252, q: float = 0.05, keys=SERIES) -> DataFrame:
    """Rolling quantile and the mean of the frame's values at or below it."""

    def build(d, c):
        d = d.withColumn("_frame", _sorted_frame(c, ret, n))
        d = d.withColumn("var", _quantile(C("_frame"), n, q))
        tail = F.filter(C("_frame"), lambda x: x <= C("var"))
        total = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x)
        return d.withColumn("cvar", total / F.nullif(F.size(tail), F.lit(0))).drop("_frame")

    return on_chunks(df, build, keys, back=n)


def rolling_tail_ratio(df: DataFrame, ret="r", n: int = 252, keys=SERIES) -> DataFrame:
    def build(d, c):
        d = d.withColumn("_frame", _sorted_frame(c, ret, n))
        low = F.nullif(F.abs(_quantile(C("_frame"), n, 0.05)), F.lit(0.0))
        return d.withColumn("tail_ratio", _quantile(C("_frame"), n, 0.95) / low).drop("_frame")

    return on_chunks(df, build, keys, back=n)


def rolling_sharpe(df: DataFrame, ret="r", n: int = 126, ppy: float = 252.0, keys=SERIES) -> DataFrame:
    def build(d, c):
        d = add_moments(d, c, {"_mean": (ret, n, "mean"), "_sd": (ret, n, "sd")})
        return d.withColumn("sharpe", C("_mean") / F.nullif("_sd", F.lit(0.0)) * ppy**0.5).drop("_mean", "_sd")

    return on_chunks(df, build, keys, back=n)


def rolling_cagr(df: DataFrame, equity="equity", windows=(252, 756), ppy: float = 252.0, keys=SERIES) -> DataFrame:
    def build(d, c):
        return d.withColumns({f"cagr_{n}": F.pow(F.col(equity) / c.lag(equity, n), F.lit(ppy / n)) - 1 for n in windows})

    return on_chunks(df, build, keys, back=max(windows))


def rolling_beta(df: DataFrame, strat="s", bench="b", n: int = 252, keys=SERIES) -> DataFrame:
    """Needs rows where both returns are present, numbered without gaps."""

    def build(d, c):
        w = c.last(n)
        full = F.count(F.col(strat) + F.col(bench)).over(w) >= n
        beta = F.covar_samp(strat, bench).over(w) / F.nullif(F.var_samp(bench).over(w), F.lit(0.0))
        return d.withColumn("beta", F.when(full, beta))

    return on_chunks(df, build, keys, back=n)
