"""Plain return series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.series import SERIES, on_chunks, scan


def asset_returns(df: DataFrame, value: str = "close", name: str = "r", keys=SERIES) -> DataFrame:
    """value / previous value - 1; null on the first row."""
    return on_chunks(df, lambda d, c: d.withColumn(name, F.col(value) / c.lag(value) - 1), keys, back=1)


def cumulative_return(df: DataFrame, value: str = "equity", name: str = "cum", keys=SERIES) -> DataFrame:
    """value / first value - 1; the first value is one row per series, joined back."""
    first = df.groupBy(*keys).agg(F.min_by(value, "ord").alias("_first"))
    return df.join(first, list(keys)).withColumn(name, F.col(value) / F.col("_first") - 1).drop("_first")


def cumulative_excess(df: DataFrame, strategy: str, benchmark: str, keys=SERIES) -> DataFrame:
    """Compounded difference of two return columns."""
    diff = F.coalesce(F.col(strategy) - F.col(benchmark), F.lit(0.0))
    return scan(df, {"_g": ("prod", 1 + diff)}, keys).withColumn("excess", F.col("_g") - 1).drop("_g")


def compounded_growth(df: DataFrame, ret: str = "r", name: str = "growth", keys=SERIES) -> DataFrame:
    """exp of the running sum of ln(1 + return); a null return keeps the level, one of -1 or less is an error.

    A running product rounds at every row and stays at infinity once it is there. Logarithms are summed
    here as whole numbers of 2^-32 and what is left over as whole numbers of 2^-62, so that a value has only
    the error of its sum as one double, however many rows there are and wherever chunks are cut.
    """
    g = 1 + F.coalesce(F.col(ret), F.lit(0.0))
    log = F.when(g > 0, F.ln(g)).otherwise(F.raise_error(F.lit(f"{ret} of -1 or less has no logarithm")).cast("double"))
    d = df.withColumn("_log", log)
    whole = F.rint(F.col("_log") * 2.0**32)
    rest = F.rint((F.col("_log") - whole / 2.0**32) * 2.0**62)
    d = scan(d, {"_whole": ("sum", whole.cast("long")), "_rest": ("sum", rest.cast("long"))}, keys)
    return d.withColumn(name, F.exp(F.col("_whole") / 2.0**32 + F.col("_rest") / 2.0**62)).drop("_log", "_whole", "_rest")
