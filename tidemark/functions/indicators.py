"""Indicator expressions over a `Chunk` window. Every frame is guarded by its count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.plans.series import Chunk

LONG_FRAME = 48


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(c: Chunk, x, n: int, agg, min_count: int | None = None) -> Column:
    """`agg` over the last n rows, null until `min_count` (default n) values are in the frame."""
    w = c.last(n)
    x = _col(x)
    return F.when(F.count(x).over(w) >= (min_count or n), agg(x).over(w))


def sma(c: Chunk, x, n: int) -> Column:
    return rolling(c, x, n, F.avg)


def add_moments(df: DataFrame, c: Chunk, specs: dict[str, tuple]) -> DataFrame:
    """Rolling mean, sd, sd_pop or sum: `name -> (column name, n, statistic[, min_count])`.

    A frame of n rows is folded anew for every row, n updates each. For long frames the
    series is cut into blocks of n rows instead: a window is the end of one block plus the
    start of the next, both running aggregates, and their moments combine without
    cancellation. The cost per row no longer grows with n.
    """
    short = {k: s for k, s in specs.items() if s[1] < LONG_FRAME}
    agg = {"mean": F.avg, "sd": F.stddev_samp, "sd_pop": F.stddev_pop, "sum": F.sum}
    if short:
        df = df.withColumns({k: rolling(c, s[0], s[1], agg[s[2]], s[3] if len(s) > 3 else None) for k, s in short.items()})
    for x, n in dict.fromkeys((s[0], s[1]) for k, s in specs.items() if k not in short):
        df = df.withColumn("_blk", F.floor(F.col("ord") / F.lit(n)))
        head = W.partitionBy(*c.part, "_blk").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
        tail = W.partitionBy(*c.part, "_blk").orderBy(F.desc("ord")).rowsBetween(W.unboundedPreceding, 0)
        mine = {k: s for k, s in specs.items() if k not in short and (s[0], s[1]) == (x, n)}
        spread = any(s[2] in ("sd", "sd_pop") for s in mine.values())
        part = lambda w: F.struct(
            F.count(x).over(w).alias("n"), F.avg(x).over(w).alias("m"), (F.var_pop(x).over(w) if spread else F.lit(0.0)).alias("v")
        )
        df = df.withColumn("_tail", part(tail)).withColumn("_head", part(head))
        # At the end of a block the frame is the block itself, else it starts n-1 rows back.
        back = F.lag("_tail", n - 1).over(W.partitionBy(*c.part).orderBy("_blk", "ord"))
        df = df.withColumn("_tail", F.when(F.pmod(F.col("ord"), F.lit(n)) != n - 1, back))
        n1, n2 = F.coalesce(F.col("_tail.n"), F.lit(0)), F.col("_head.n")
        m1, m2 = F.coalesce(F.col("_tail.m"), F.lit(0.0)), F.coalesce(F.col("_head.m"), F.lit(0.0))
        v1, v2 = F.coalesce(F.col("_tail.v"), F.lit(0.0)), F.coalesce(F.col("_head.v"), F.lit(0.0))
        # Before the first full frame the start of the series is the frame.
        total = n1 + n2
        some = F.nullif(total, F.lit(0))
        mean = (n1 * m1 + n2 * m2) / some
        m2sum = n1 * v1 + n2 * v2 + (m1 - m2) * (m1 - m2) * (n1 * n2) / some
        stat = {
            "mean": mean,
            "sum": n1 * m1 + n2 * m2,
            "sd_pop": F.sqrt(m2sum / some),
            "sd": F.sqrt(m2sum / F.nullif(total - 1, F.lit(0))),
        }
        df = df.withColumns(
            {k: F.when(total >= (s[3] if len(s) > 3 else n), stat[s[2]]) for k, s in mine.items()}
        ).drop("_blk", "_tail", "_head")
    return df


def bollinger(c: Chunk, x, n: int = 20, k: float = 2.0, population: bool = False):
    """(lower, mid, upper)."""
    mid = sma(c, x, n)
    sd = rolling(c, x, n, F.stddev_pop if population else F.stddev_samp)
    return mid - k * sd, mid, mid + k * sd


def true_range(c: Chunk) -> Column:
    """`greatest` skips nulls, so the first bar gives high - low."""
    prev = c.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def donchian(c: Chunk, n: int = 20):
    """(lowest low, highest high)."""
    return rolling(c, "low", n, F.min), rolling(c, "high", n, F.max)


def zscore(c: Chunk, x, n: int = 20) -> Column:
    return (_col(x) - sma(c, x, n)) / F.nullif(rolling(c, x, n, F.stddev_samp), F.lit(0.0))


def roc(c: Chunk, x, n: int = 1) -> Column:
    return _col(x) / c.lag(x, n) - 1


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def gain_loss(c: Chunk, x="close") -> tuple[Column, Column]:
    d = _col(x) - c.lag(x)
    return F.greatest(d, F.lit(0.0) * d), -F.least(d, F.lit(0.0) * d)


def rsi_from(avg_gain: Column, avg_loss: Column, no_loss: float | None) -> Column:
    """RSI of two Wilder averages; `no_loss` is the value where the average loss is zero.

    The shared indicator fills every undefined value (warm-up too) with 50; the
    double-band rule keeps the warm-up null and reads 100 where there was no loss.
    """
    value = 100 - 100 / (1 + avg_gain / F.nullif(avg_loss, F.lit(0.0)))
    if no_loss is None:
        return F.coalesce(value, F.lit(50.0))
    return F.when(avg_loss == 0, F.lit(no_loss)).otherwise(value)


def crossover(c: Chunk, a: Column, b: Column) -> Column:
    return (a > b) & (c.lag(a) <= c.lag(b))


def crossunder(c: Chunk, a: Column, b: Column) -> Column:
    return (a < b) & (c.lag(a) >= c.lag(b))


def body_ratio() -> Column:
    rng = F.col("high") - F.col("low")
    return F.when(rng <= 0, 0.0).otherwise(F.abs(F.col("close") - F.col("open")) / rng)


def close_location() -> Column:
    rng = F.col("high") - F.col("low")
    return F.when(rng <= 0, 0.5).otherwise((F.col("close") - F.col("low")) / rng)


def rejects(level: Column, direction: int) -> Column:
    """The bar touches `level` and closes beyond it, upward for 1 and downward for -1."""
    if direction == 1:
        return (F.col("low") <= level) & (F.col("close") > level)
    return (F.col("high") >= level) & (F.col("close") < level)


def clamp(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def finite(x) -> Column:
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
