"""Peaks, drawdown episodes, streaks and volatility regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.indicators import add_moments
from tidemark.operators.quality import micros
from tidemark.plans.selection import exact_percentiles
from tidemark.plans.series import SERIES, cumulative_runs, on_chunks, scan
from tidemark.session import stage

DAY = 86_400_000_000


def running_drawdown(df: DataFrame, value="equity", keys=SERIES) -> DataFrame:
    return scan(df, {"peak": ("max", value)}, keys).withColumn("drawdown", F.col(value) / F.col("peak") - 1)


def _runs_from_peaks(df: DataFrame, value: str, keys) -> DataFrame:
    """`run` numbers the bars at a peak; bars below a peak share the run of that peak."""
    d = df if "peak" in df.columns else running_drawdown(df, value, keys)
    return cumulative_runs(d, F.col(value) >= F.col("peak"), keys)


def drawdown_episodes(df: DataFrame, value="equity", keys=SERIES) -> DataFrame:
    """One row per stretch below a peak. The recovery is the peak bar of the next run."""
    keys = list(keys)
    runs = _runs_from_peaks(df, value, keys)
    under = F.col(value) < F.col("peak")
    deepest = F.struct(F.col("drawdown").alias("d"), F.col("ord").alias("o"))
    per_run = runs.groupBy(*keys, "run").agg(
        F.min("ts").alias("start_ts"),
        F.count_if(under).alias("bars"),
        F.min(F.when(under, F.col("drawdown"))).alias("depth"),
        F.min_by("ts", F.when(under, deepest)).alias("trough_ts"),
        F.min_by(value, F.when(under, deepest)).alias("trough_value"),
    )
    after = per_run.select(*keys, (F.col("run") - 1).alias("run"), F.col("start_ts").alias("recovery_ts"))
    days = lambda a, b: F.floor((micros(a) - micros(b)) / DAY)
    return (
        per_run.filter("bars > 0")
        .join(after, [*keys, "run"], "left")
        .withColumn("duration_days", days("recovery_ts", "trough_ts"))
        .withColumn("total_days", days("recovery_ts", "start_ts"))
    )


def top_drawdowns(episodes: DataFrame, n: int = 5, keys=SERIES) -> DataFrame:
    """The n deepest per series.

    Row-number filters keep at most n rows per group and task before the exchange.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("depth", "start_ts"))
    return episodes.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def longest_underwater(df: DataFrame, value="equity", keys=SERIES) -> DataFrame:
    """Longest stretch below a peak in bars, and in days counted from the peak bar."""
    keys = list(keys)
    runs = _runs_from_peaks(df, value, keys)
    under = F.col(value) < F.col("peak")
    per_run = runs.groupBy(*keys, "run").agg(
        F.count_if(under).alias("_bars"),
        (F.max(F.when(under, micros("ts"))) - F.min(micros("ts"))).alias("_us"),
    )
    return per_run.groupBy(*keys).agg(
        F.max("_bars").alias("max_drawdown_duration_bars"),
        (F.coalesce(F.max("_us"), F.lit(0)) / DAY).alias("max_drawdown_duration_days"),
    )


def runs_of(df: DataFrame, label, keys=SERIES) -> DataFrame:
    """Contiguous stretches of one label."""
    keys = list(keys)

    def build(d, c):
        return d.withColumn("_l", label).withColumn("_new", ~F.col("_l").eqNullSafe(c.lag("_l")) | (F.col("ord") == 0))

    marked = on_chunks(df, build, keys, back=1)
    return (
        cumulative_runs(marked, F.col("_new"), keys)
        .groupBy(*keys, "run")
        .agg(F.first("_l").alias("label"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("bars"))
    )


def streaks(df: DataFrame, value="pnl", keys=SERIES) -> DataFrame:
    """Runs of equal sign; a zero ends a run and is not a run itself."""
    found = runs_of(df, F.signum(value), keys)
    return found.filter("label <> 0").withColumnRenamed("label", "sign").withColumnRenamed("bars", "length")


def regime_labels(df: DataFrame, ret="r", window: int = 63, keys=SERIES) -> DataFrame:
    """low / mid / high by trailing volatility against the series' own tercile edges.

    A value on both edges is `high`. Series with fewer than 30 volatility values are left out.
    """
    least = max(20, window // 3)
    vol = on_chunks(
        df, lambda d, c: add_moments(d, c, {"vol": (ret, window, "sd", least)}), keys, back=window
    ).filter(F.col("vol").isNotNull())
    vol = stage(vol, "trailing-vol")  # read several times below
    edges = exact_percentiles(vol, keys, "vol", {"q33": 1 / 3, "q67": 2 / 3})
    enough = vol.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 30").drop("_n")
    label = F.when(F.col("vol") >= F.col("q67"), "high").when(F.col("vol") <= F.col("q33"), "low").otherwise("mid")
    return vol.join(edges.join(enough, list(keys)), list(keys)).withColumn("regime", label).drop("q33", "q67")
