"""Data-quality and session profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.ingest import FIELDS, bad_ohlc
from tidemark.plans.series import SERIES, on_chunks


def micros(ts) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def dup_ts_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first per (symbol, ts); counted per key first, so both steps merge."""
    per_key = df.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy("symbol").agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def out_of_order(df: DataFrame) -> DataFrame:
    """Whether a file's times ever step back; `ord` is the position in the file."""
    def build(d, c):
        return d.withColumn("_back", c.lag("ts") > F.col("ts"))

    marked = on_chunks(df, build, back=1)
    return marked.groupBy("symbol").agg(
        F.coalesce(F.bool_or("_back"), F.lit(False)).alias("out_of_order"), F.count_if("_back").alias("steps_back")
    )


def null_profile(df: DataFrame, cols=FIELDS) -> DataFrame:
    """Values per text column that are missing or not numeric."""
    nums = {c: F.col(c).try_cast("double") for c in cols}
    return df.groupBy("symbol").agg(*[F.count_if(x.isNull() | F.isnan(x)).alias(f"{c}_nulls") for c, x in nums.items()])


def bad_ohlc_count(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.count_if(bad_ohlc()).alias("bad_rows"))


def spacing(df: DataFrame, keys=SERIES) -> DataFrame:
    """Seconds since the bar before; the first bar of a series is left out."""
    def build(d, c):
        return d.withColumn("prev_ts", c.lag("ts")).withColumn("delta_s", (micros("ts") - micros("prev_ts")) / 1e6)

    return on_chunks(df, build, keys, back=1).filter(F.col("delta_s").isNotNull())


def spacing_histogram(df: DataFrame, top: int = 10) -> DataFrame:
    counts = spacing(df).groupBy("symbol", "delta_s").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("n"), "delta_s"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)


def spacing_vs_expected(df: DataFrame, minutes: float) -> DataFrame:
    want = F.lit(60.0 * minutes)
    return spacing(df).groupBy("symbol").agg(
        F.count_if(F.col("delta_s") == want).alias("exact"),
        F.count_if(F.col("delta_s") < want).alias("shorter"),
        F.count_if(F.col("delta_s") > want).alias("longer"),
    )


def largest_gaps(df: DataFrame, top: int = 10) -> DataFrame:
    """Longest gaps overall; a global sort with limit keeps `top` rows per task."""
    return spacing(df).orderBy(F.desc("delta_s"), "symbol", "ts").limit(top)


def column_diff(spark, actual: list[str], expected: list[str]) -> DataFrame:
    rows = [(c, "missing") for c in expected if c not in actual] + [(c, "extra") for c in actual if c not in expected]
    return spark.createDataFrame(rows, "column string, status string")


def load_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def signal_profile(signals: DataFrame) -> DataFrame:
    """Long, short and flat bars, change events and entries from flat or the other side."""
    return profile_changes(on_chunks(signals, with_previous_weight, back=1))


def with_previous_weight(d: DataFrame, c) -> DataFrame:
    return d.withColumn("_prev", c.lag("weight", 1, 0.0))


def profile_changes(s: DataFrame) -> DataFrame:
    """`signal_profile` of rows that hold the weight before theirs as `_prev`."""
    w, p = F.col("weight"), F.col("_prev")
    entry = (w != 0) & (F.signum(w) != F.signum(p))
    return s.groupBy("symbol").agg(
        F.count_if(w > 0).alias("long_bars"),
        F.count_if(w < 0).alias("short_bars"),
        F.count_if(w == 0).alias("flat_bars"),
        F.count_if(w != p).alias("changes"),
        F.count_if(entry).alias("entries"),
        F.count_distinct(F.when(entry, F.to_date("ts"))).alias("entry_days"),
    )


def signal_audit(reference: DataFrame, actual: DataFrame) -> DataFrame:
    """Full outer match of two signal tables; `direction` is the sign of the signal."""
    a = reference.select("symbol", "ts", F.col("direction").alias("expected"))
    b = actual.select("symbol", "ts", F.col("direction").alias("found"))
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("expected").isNull(), "unexpected")
        .when(F.col("expected") != F.col("found"), "direction_mismatch")
        .otherwise("matched")
    )
    return a.join(b, ["symbol", "ts"], "full_outer").withColumn("status", status)


def more_than_one_per_day(signals: DataFrame, day: Column) -> DataFrame:
    return signals.groupBy("symbol", day.alias("day")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def direction_time_distribution(signals: DataFrame) -> DataFrame:
    """Counts by direction and time of day with totals of either level; the grand total is there without signals too."""
    levels = signals.rollup("direction", F.date_format("ts", "HH:mm").alias("hhmm")).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_level")
    )
    # Spark's rollup of no rows is empty, other engines count them.
    none = signals.sparkSession.sql("SELECT CAST(NULL AS STRING) AS direction, CAST(NULL AS STRING) AS hhmm, 0L AS n, 3L AS _level")
    return levels.unionByName(none).groupBy("direction", "hhmm", "_level").agg(F.sum("n").alias("n")).drop("_level")


def next_bar_mapping(bars: DataFrame) -> DataFrame:
    """The bar after each bar; null where the series ends."""
    def build(d, c):
        return d.withColumn("next_ts", c.lead("ts")).withColumn("next_open", c.lead("open"))

    return on_chunks(bars, build, ahead=1)
