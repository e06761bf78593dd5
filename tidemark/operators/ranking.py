"""Scores, ranks, top lists and comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

C = F.col

# Weights of the two scores, metric -> (weight, sign).
SCREEN_SCORE = {"sharpe": (0.40, 1), "calmar": (0.25, 1), "cagr": (0.20, 1), "max_drawdown": (0.15, -1)}
FULL_SCORE = {"sharpe": (0.40, 1), "calmar": (0.25, 1), "cagr": (0.20, 1), "profit_factor": (0.15, 1)}


def percent_rank_average(value: Column, keys) -> Column:
    """Rank of a value among its group's non-null values, ties averaged, as a share; null stays null.

    The group is one data set's parameter grid, whose size is fixed by the caller.
    """
    part = W.partitionBy(*keys)
    low = F.rank().over(part.orderBy(value.asc_nulls_last()))
    ties = F.count(value).over(part.orderBy(value.asc_nulls_last()).rangeBetween(0, 0))
    return F.when(value.isNotNull(), (low + (ties - 1) / 2) / F.count(value).over(part))


def score(df: DataFrame, weights: dict, keys=("symbol",), name: str = "score") -> DataFrame:
    total = F.lit(0.0)
    for metric, (weight, sign) in weights.items():
        df = df.withColumn(f"_{metric}", C(metric) * sign).withColumn(
            f"rank_{metric}", percent_rank_average(C(f"_{metric}"), keys)
        ).drop(f"_{metric}")
        total = total + weight * C(f"rank_{metric}")
    return df.withColumn(name, total)


def with_sample_flags(df: DataFrame, trades: str = "num_trades", least: int = 20) -> DataFrame:
    return df.withColumn("low_sample", C(trades) < least)


def top_per_group(df: DataFrame, keys, order, n: int, name: str = "rank") -> DataFrame:
    """The first n rows per group; the row-number filter keeps n per task before the exchange."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank.cast("long")).filter(C(name) <= n)


def p_class(p: Column) -> Column:
    return F.when(p < 0.01, "strong").when(p < 0.05, "sig").when(p < 0.10, "marginal").otherwise("no")


def excess_class(x: Column) -> Column:
    return F.when(x > 0.30, "substantial").when(x > 0.10, "modest").when(x > 0, "marginal").otherwise("none")


def every_kth(df: DataFrame, sizes: DataFrame, most: int, keys=("symbol",)) -> DataFrame:
    """Every k-th row with k = ceil(n / most), and the last one; `sizes` has keys and n."""
    d = df.join(sizes, list(keys)).withColumn("_step", F.ceil(C("n") / most))
    return d.filter((C("ord") % C("_step") == 0) | (C("ord") == C("n") - 1)).drop("_step", "n")


def comparison_table(df: DataFrame, keys=("strategy",)) -> DataFrame:
    """Metrics as the display columns of a comparison: per cents and rounded numbers as text, missing values as a dash."""
    half_up = lambda x, n: F.floor(x * 10.0**n + 0.5) / 10.0**n
    pct = lambda c: F.format_string("%.2f%%", half_up(C(c) * 100, 2))
    num = lambda c: F.when(C(c) == float("inf"), "inf").otherwise(F.format_string("%.3f", half_up(F.when(C(c) != float("inf"), C(c)), 3)))
    whole = lambda c: C(c).cast("string")
    shown = {
        "cagr": pct, "volatility": pct, "sharpe": num, "sortino": num, "calmar": num, "max_drawdown": pct, "max_drawdown_duration_bars": whole,
        "num_trades": whole, "win_rate": num, "profit_factor": num, "expectancy": num,
    }
    return df.select(*keys, *[F.coalesce(F.when(C(c).isNotNull(), f(c)), F.lit("—")).alias(c) for c, f in shown.items()])


def cross_asset_summary(df: DataFrame, value: str = "excess_sharpe", floor: float | None = None) -> DataFrame:
    """mean, std, min, max, count of `value` per strategy over assets, with rank by mean (strategies are few)."""
    s = df.groupBy("strategy").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.count(value).alias("count"),
    )
    s = s.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean"), "strategy")).cast("long"))
    return s.filter(C("mean") > floor) if floor is not None else s


def cross_asset_pivot(df: DataFrame, value: str = "excess_sharpe", assets: list[str] | None = None) -> DataFrame:
    """`value` by strategy (rows) and asset (columns); `assets` saves a pass that looks for them."""
    return df.groupBy("strategy").pivot("symbol", assets).agg(F.first(value))
