"""Calendars, alignment and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ingest import PRICES
from tidemark.plans.series import on_chunks, scan, time_bucket, with_ordinal

GRID = 4096


def union_calendar(bars: DataFrame) -> DataFrame:
    return bars.select("ts").distinct()


def numbered_calendar(bars: DataFrame) -> DataFrame:
    """ts, cal_ord: dense positions of the distinct times, also without one sorting task."""
    cal = union_calendar(bars).withColumn("_all", F.lit(0))
    return with_ordinal(cal, ["_all"], ["ts"], time_bucket(), "cal_ord").drop("_all")


def intersect_calendar(bars: DataFrame, at_least: int = 10) -> DataFrame:
    """Times at which every symbol has a bar; fewer than `at_least` fails the job."""
    keys = bars.select("symbol", "ts").distinct()
    n = keys.agg(F.count_distinct("symbol").alias("_n"))
    common = keys.groupBy("ts").agg(F.count(F.lit(1)).alias("_k")).join(n, F.col("_k") == F.col("_n")).select("ts")
    size = common.agg(F.count(F.lit(1)).alias("_size"))
    short = F.when(F.col("_size") < at_least, F.raise_error(F.lit("common calendar has too few bars")).cast("boolean"))
    return common.join(size.select(F.coalesce(short, F.lit(True)).alias("_ok")), F.col("_ok")).select("ts")


def align_ffill(bars: DataFrame) -> DataFrame:
    """Every symbol on the union calendar: prices carried forward, volume zero in gaps.

    A bar is valid until the symbol's next bar, so each one unfolds to the calendar
    positions up to there. No symbol x calendar product and no fill window is needed;
    the unfolding goes by blocks of GRID positions, which keeps the arrays small.
    """
    cal = numbered_calendar(bars)
    on_cal = bars.join(cal, "ts")
    last = cal.agg(F.max("cal_ord").alias("_last"))

    def build(d, c):
        return d.withColumn("_until", c.lead("cal_ord"))

    placed = on_chunks(on_cal, build, ahead=1).join(F.broadcast(last))  # one row
    placed = placed.withColumn("_until", F.coalesce(F.col("_until") - 1, F.col("_last")))
    fields = F.struct(*[F.col(c) for c in (*PRICES, "volume")])
    spans = placed.select("symbol", F.col("cal_ord").alias("_from"), "_until", fields.alias("_bar"))
    lead_in = placed.filter((F.col("ord") == 0) & (F.col("cal_ord") > 0)).select(
        "symbol",
        F.lit(0).cast("long").alias("_from"),
        (F.col("cal_ord") - 1).alias("_until"),
        F.lit(None).cast(spans.schema["_bar"].dataType).alias("_bar"),
    )
    g = F.lit(GRID)
    blocks = spans.unionByName(lead_in).withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("_from") / g), F.floor(F.col("_until") / g)))
    )
    grid = blocks.withColumn(
        "cal_ord",
        F.explode(
            F.sequence(
                F.greatest("_from", F.col("_block") * g), F.least("_until", F.col("_block") * g + g - 1)
            )
        ),
    )
    own = F.col("cal_ord") == F.col("_from")
    return grid.join(cal, "cal_ord").select(
        "symbol",
        "ts",
        F.col("cal_ord").alias("ord"),
        *[F.col("_bar")[c].alias(c) for c in PRICES],
        F.when(own, F.coalesce(F.col("_bar")["volume"], F.lit(0.0))).otherwise(0.0).alias("volume"),
        (own & F.col("_bar").isNotNull()).alias("has_bar"),
    )


def ffill_on(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Exact match on (symbol, ts), then the last matched value carried forward."""
    joined = left.join(right.select("symbol", "ts", F.col(value).alias("_v")), ["symbol", "ts"], "left")
    return scan(joined, {value: ("last", "_v")}).drop("_v")


def asof_backward(left: DataFrame, right: DataFrame, value: str, tie=()) -> DataFrame:
    """For each left row the value of the latest right row at or before it.

    Both sides become one series; a running last value over it replaces a range join.
    """
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select("symbol", "ts", F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    both = with_ordinal(both.drop("ord"), ["symbol"], ["ts", "_side", *tie], time_bucket())
    found = scan(both, {value: ("last", "_v")}).filter("_side = 1")
    return found.drop("_side", "_v", "ord")


def month_snap(calendar: DataFrame) -> DataFrame:
    """ts, month_start: the first time at or after each month start inside the calendar's span.

    A time serves all month starts after the time before it, so one look back replaces
    the range join. The first time serves a month start only if it falls on it.
    """
    cal = calendar.select("ts").distinct().withColumn("_all", F.lit(0))
    cal = with_ordinal(cal, ["_all"], ["ts"], time_bucket())

    def build(d, c):
        return d.withColumn("_prev", c.lag("ts"))

    day = F.col("ts").cast("date")
    first_of_month = F.trunc(day, "MM")
    at_midnight = F.col("ts") == day.cast("timestamp_ntz")
    upper = first_of_month
    lower = F.when(
        F.col("_prev").isNull(), F.when(at_midnight & (day == first_of_month), first_of_month).otherwise(F.add_months(first_of_month, 1))
    ).otherwise(F.add_months(F.trunc(F.col("_prev").cast("date"), "MM"), 1))
    return (
        on_chunks(cal, build, ["_all"], back=1)
        .withColumns({"_lo": lower, "_hi": upper})
        .filter("_lo <= _hi")
        .select("ts", F.explode(F.expr("sequence(_lo, _hi, interval 1 month)")).alias("month_start"))
    )


def rebalance_dates(calendar: DataFrame) -> DataFrame:
    return month_snap(calendar).select("ts").distinct()


def ny_time(ts, source_zone: str = "+03:00") -> Column:
    """A naive source time read in `source_zone`, as naive New York time."""
    return F.convert_timezone(F.lit(source_zone), F.lit("America/New_York"), ts)
