"""Weights to returns, rebalance events and benchmarks. Input: bars with a `weight` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.calendar import rebalance_dates
from tidemark.plans.series import SERIES, equity_scan, on_chunks

C = F.col


def weight_returns(df: DataFrame, cost_bps: float = 6.0, keys=SERIES) -> DataFrame:
    """The weight set at the last close earns this bar's return; changes cost `cost_bps`.

    Adds r_asset, position, turnover and r.
    """

    return on_chunks(df, lambda d, c: weight_returns_on(d, c, cost_bps), keys, back=2)


def weight_returns_on(d: DataFrame, c, cost_bps: float = 6.0) -> DataFrame:
    """`weight_returns` inside a chunk; reaches two rows back."""
    d = d.withColumns(
        {
            "r_asset": F.coalesce(C("close") / c.lag("close") - 1, F.lit(0.0)),
            "position": c.lag("weight", 1, 0.0),
            "_before": c.lag("weight", 2, 0.0),
        }
    )
    d = d.withColumn("turnover", F.abs(C("position") - C("_before"))).drop("_before")
    return d.withColumn("r", C("position") * C("r_asset") - C("turnover") * (cost_bps / 1e4))


def next_open_returns(
    df: DataFrame, commission_bps: float = 1.0, slippage_bps: float = 5.0, warmup: int = 0, keys=SERIES,
    cost: Column | None = None,
) -> DataFrame:
    """A weight read at a close is traded at the next open.

    The old weight carries the move from the last close to the open, the new one the move
    from open to close, and a change of weight costs commission and slippage. Bars before
    `warmup` neither trade nor read weights. Adds r, position (the weight after the open)
    and turnover.
    """
    rate = cost if cost is not None else F.lit((commission_bps + slippage_bps) / 1e4)

    def build(d, c):
        live = F.when(C("ord") >= warmup, C("weight")).otherwise(0.0)
        d = d.withColumn("_live", live)
        return d.withColumns(
            {"position": c.lag("_live", 1, 0.0), "_old": c.lag("_live", 2, 0.0), "_pc": c.lag("close")}
        )

    d = on_chunks(df, build, keys, back=2)
    d = d.withColumn("turnover", F.abs(C("position") - C("_old")))
    gap = 1 + C("_old") * (C("open") / C("_pc") - 1)
    day = 1 + C("position") * (C("close") / C("open") - 1) - C("turnover") * rate
    return d.withColumn("r", F.coalesce(gap * day - 1, F.lit(0.0))).drop("_live", "_old", "_pc")


def fill_events(df: DataFrame, slippage_bps: float = 5.0, keys=SERIES) -> DataFrame:
    """One row per change of target weight that has a next bar to trade on."""

    def build(d, c):
        return d.withColumns(
            {"_prev": c.lag("weight", 1, 0.0), "fill_ts": c.lead("ts"), "_open": c.lead("open")}
        )

    d = on_chunks(df, build, keys, back=1, ahead=1)
    d = d.filter((C("weight") != C("_prev")) & C("fill_ts").isNotNull())
    buys = C("weight") > C("_prev")
    return d.select(
        *keys,
        C("ts").alias("signal_ts"),
        "fill_ts",
        F.when(buys, "BUY").otherwise("SELL").alias("side"),
        (C("_open") * F.when(buys, 1 + slippage_bps / 1e4).otherwise(1 - slippage_bps / 1e4)).alias("price"),
        (C("weight") - C("_prev")).alias("delta_weight"),
        C("weight").alias("target_weight"),
    )


def portfolio_returns(df: DataFrame, cost_bps: float = 6.0, allow_short: bool = True) -> DataFrame:
    """Sum over symbols of weight x return per time, on aligned bars with `weight`."""
    w = C("weight") if allow_short else F.greatest("weight", F.lit(0.0))
    legs = weight_returns(df.withColumn("weight", w), cost_bps)
    legs = legs.withColumn("r", F.coalesce("r", F.lit(0.0)))
    return legs.groupBy("ts", "ord").agg(F.sum("r").alias("r"), F.sum("turnover").alias("turnover"))


def exposure_stats(df: DataFrame, keys=SERIES) -> DataFrame:
    """Average turnover, gross and net exposure per bar over all symbols."""
    d = on_chunks(df, lambda x, c: x.withColumn("_d", F.coalesce(F.abs(C("weight") - c.lag("weight")), F.lit(0.0))), keys, back=1)
    per_ts = d.groupBy("ts").agg(
        F.sum("_d").alias("t"), F.sum(F.abs("weight")).alias("g"), F.sum("weight").alias("n")
    )
    return per_ts.agg(
        F.avg("t").alias("turnover"), F.avg("g").alias("gross_exposure"), F.avg("n").alias("net_exposure")
    )


def same_exposure_benchmark(
    df: DataFrame, commission_bps: float = 1.0, slippage_bps: float = 5.0, costs: bool = True, keys=SERIES
) -> DataFrame:
    """Asset return at the strategy's average weight, less its average cost per bar.

    The averages are one row per series, joined back. Adds avg_weight and r.
    """
    keys = list(keys)

    def build(d, c):
        return d.withColumns(
            {"r_asset": F.coalesce(C("close") / c.lag("close") - 1, F.lit(0.0)), "_d": F.abs(C("weight") - c.lag("weight"))}
        )

    d = on_chunks(df, build, keys, back=1)
    rate = (commission_bps + slippage_bps) / 1e4 if costs else 0.0
    means = d.groupBy(*keys).agg(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg("weight"))).alias("avg_weight"),
        (F.coalesce(F.avg("_d"), F.lit(0.0)) * rate).alias("_cost"),
    )
    return d.join(means, keys).withColumn("r", C("avg_weight") * C("r_asset") - C("_cost")).drop("_d", "_cost")


def equal_weight_benchmark(aligned: DataFrame) -> DataFrame:
    """Mean return of all symbols per time, from the first rebalance time on, compounded."""
    n = aligned.agg(F.count_distinct("symbol").alias("_n"))
    start = rebalance_dates(aligned).agg(F.min("ts").alias("_start"))
    d = on_chunks(aligned, lambda x, c: x.withColumn("_r", F.coalesce(C("close") / c.lag("close") - 1, F.lit(0.0))), back=1)
    per_ts = d.groupBy("ts", "ord").agg(F.sum("_r").alias("_sum"))
    one = F.broadcast(n.join(start))  # one row
    r = per_ts.join(one).withColumn("r", F.when(C("ts") >= C("_start"), C("_sum") / C("_n")).otherwise(0.0))
    curve = equity_scan(r.select(F.lit("EW").alias("symbol"), "ts", "ord", "r"), start=100_000.0)
    return curve.select("ts", "ord", "r", "equity", "drawdown")


def buy_hold_benchmark(df: DataFrame, capital: float = 100_000.0, keys=SERIES) -> DataFrame:
    first = df.groupBy(*keys).agg(F.min_by("close", "ord").alias("_first"))
    return df.join(first, list(keys)).withColumn("benchmark", capital * C("close") / C("_first")).drop("_first")


def excess_returns(df: DataFrame, commission_bps: float = 1.0, slippage_bps: float = 5.0, keys=SERIES) -> DataFrame:
    """Next-open strategy return minus average weight x asset return, per bar."""
    keys = list(keys)
    d = next_open_returns(df, commission_bps, slippage_bps, keys=keys)
    d = on_chunks(d, lambda x, c: x.withColumn("r_asset", F.coalesce(C("close") / c.lag("close") - 1, F.lit(0.0))), keys, back=1)
    mean = df.groupBy(*keys).agg(F.avg("weight").alias("avg_weight"))
    return d.join(mean, keys).withColumn("f", C("r") - C("avg_weight") * C("r_asset"))


def transitions(df: DataFrame, keys=SERIES) -> DataFrame:
    """Number of bars whose position differs from the bar before; the first bar counts."""
    def build(d, c):
        d = d.withColumn("_p", c.lag("weight", 1, 0.0))
        return d.withColumn("_c", ~C("_p").eqNullSafe(c.lag("_p")))

    return on_chunks(df, build, keys, back=2).groupBy(*keys).agg(F.count_if("_c").alias("transitions"))
