"""Opening-range signals on New York session time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators.contracts import in_session
from tidemark.plans.selection import prefix_ranks
from tidemark.plans.series import SERIES, on_chunks

C = F.col


def above_expanding_quantile(
    df: DataFrame, events: Column, value: str, current: str, q: float = 0.5, at_least: int = 50, keys=SERIES
) -> DataFrame:
    """Event rows with `n` earlier values and whether `current`, one of them, reaches their q-quantile.

    With linear interpolation, a member of the sample reaches the quantile exactly if the
    number of values not above it exceeds ceil(q * (n - 1)), so a rank decides and the
    quantile itself is not needed.
    """
    ranks = prefix_ranks(df.withColumn("probe", C(current)), events, keys, value).drop("probe").filter(C("n") >= at_least)
    return ranks.withColumn("at_or_above", C("rank") > F.ceil(F.lit(q) * (C("n") - 1)))


def session_bars(df: DataFrame, start: str = "09:30", end: str = "10:00", zone: str | None = "+03:00", keys=SERIES) -> DataFrame:
    """Add New York `local` time, `day`, `opening` (inside the opening window) and `post` (after it)."""
    local = F.convert_timezone(F.lit(zone), F.lit("America/New_York"), C("ts")) if zone else C("ts")
    d = df.withColumn("local", local)
    return d.withColumns(
        {
            "day": F.date_format("local", "yyyy-MM-dd"),
            "opening": in_session("local", start, end),
            "post": in_session("local", end),
        }
    )


def opening_ranges(d: DataFrame, bars_needed: int = 6, bar_minutes: int = 5, strict_grid: bool = False, keys=SERIES) -> DataFrame:
    """symbol, day, orb_high, orb_low for days with exactly the needed bars in the window.

    `strict_grid` also demands the exact times: first bar at the window start and equal steps,
    which with a unique time per bar is the same as first and last time being right.
    """
    g = d.filter("opening").groupBy(*keys, "day").agg(
        F.max("high").alias("orb_high"),
        F.min("low").alias("orb_low"),
        F.count(F.lit(1)).alias("n_bars"),
        F.count_distinct(F.floor(F.unix_seconds(C("local").cast("timestamp")) / (60 * bar_minutes))).alias("_slots"),
        F.count_if(F.unix_seconds(C("local").cast("timestamp")) % (60 * bar_minutes) == 0).alias("_on_grid"),
    )
    ok = C("n_bars") == bars_needed
    if strict_grid:
        ok = ok & (C("_slots") == bars_needed) & (C("_on_grid") == bars_needed)
    return g.filter(ok).select(*keys, "day", "orb_high", "orb_low")


def first_breakouts(d: DataFrame, ranges: DataFrame, keys=SERIES) -> DataFrame:
    """First bar of a day after the window that closes outside the range."""
    j = d.filter("post").join(ranges, [*keys, "day"]).filter(C("orb_high") > C("orb_low"))
    side = F.when(C("close") > C("orb_high"), 1).when(C("close") < C("orb_low"), -1)
    hits = j.withColumn("direction", side).filter(C("direction").isNotNull())
    row = F.struct("ts", "local", "ord", "direction", "orb_high", "orb_low")
    return hits.groupBy(*keys, "day").agg(F.min_by(row, "ord").alias("_b")).select(*keys, "day", "_b.*")


def both_side_breaks(d: DataFrame, ranges: DataFrame, keys=SERIES) -> DataFrame:
    """Per day the first close above and the first close below the opening range."""
    j = d.filter("post").join(ranges, [*keys, "day"])
    up, dn = C("close") > C("orb_high"), C("close") < C("orb_low")
    return j.groupBy(*keys, "day").agg(
        F.min(F.when(up, C("local"))).alias("long_ts"), F.min(F.when(dn, C("local"))).alias("short_ts")
    )


def session_bar_counts(d: DataFrame, keys=SERIES, needed: int = 6) -> DataFrame:
    """How many days have how many opening bars."""
    per_day = d.filter("opening").groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("bars"))
    return per_day.groupBy(*keys, "bars").agg(F.count(F.lit(1)).alias("days")).withColumn("valid", C("bars") == needed)


def exact_grid_days(d: DataFrame, start: str = "09:30", end: str = "10:00", bar_minutes: int = 5, keys=SERIES) -> DataFrame:
    """Days with the number of expected opening times that have a bar, by an exact-time join."""
    days = d.select(*keys, "day").distinct()
    lo = F.to_timestamp_ntz(F.concat("day", F.lit(f" {start}:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    hi = F.to_timestamp_ntz(F.concat("day", F.lit(f" {end}:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    grid = days.withColumns({"_lo": lo, "_hi": hi}).withColumn(
        "local", F.explode(F.expr(f"sequence(_lo, _hi - interval {bar_minutes} minutes, interval {bar_minutes} minutes)"))
    ).select(*keys, "day", "local")
    have = d.filter("opening").select(*keys, "local", F.lit(1).alias("_has"))
    g = grid.join(have, [*keys, "local"], "left").groupBy(*keys, "day")
    return g.agg(F.count(F.lit(1)).alias("expected"), F.count("_has").alias("present")).withColumn(
        "exact", C("expected") == C("present")
    )


def orb_signals(
    df: DataFrame,
    mode: str = "breakout",
    *,
    start: str = "09:30",
    end: str = "10:00",
    cutoff: str | None = "15:30",
    bars_needed: int = 6,
    zone: str | None = "+03:00",
    min_body: float | None = None,
    min_clv: float | None = None,
    atr_min: float | None = None,
    atr_max: float | None = None,
    quantile: float = 0.5,
    strict_grid: bool = False,
    bar_minutes: int = 5,
    keys=SERIES,
) -> DataFrame:
    """Bars plus `weight`: +1 / -1 on the one signal bar of a day, 0 elsewhere.

    Modes: breakout, retest, retest_rejection, quality, clv, orb_atr, atr_regime. All but
    the first wait for a retest on the bar after the breakout and a confirmation on the
    next one; the last two filter the breakout by the range against ATR and by ATR against
    its own history before the breakout.
    """
    keys = list(keys)
    d = session_bars(df, start, end, zone, keys)

    def build(x, c):
        x = x.withColumn("_tr", ind.true_range(c)).withColumn("_atr", ind.sma(c, "_tr", 14))
        nxt = F.struct("ts", "local", "day", "open", "high", "low", "close")
        return x.withColumns({"atr_before": c.lag("_atr"), "retest": c.lead(nxt, 1), "confirm": c.lead(nxt, 2)})

    rich = on_chunks(d, build, keys, back=16, ahead=2)
    brk = first_breakouts(d, opening_ranges(d, bars_needed, bar_minutes, strict_grid, keys), keys)
    if cutoff:
        brk = brk.filter(in_session("local", upto=cutoff))
    if mode == "breakout":
        hits = brk.select(*keys, "ts", C("direction").cast("double").alias("weight"))
    else:
        brk = brk.join(
            rich.select(*keys, "ord", "high", "low", "atr_before", "retest", "confirm"), [*keys, "ord"]
        )
        width = C("orb_high") - C("orb_low")
        if mode == "orb_atr":
            brk = brk.filter(C("atr_before") > 0)
            if atr_min is not None:
                brk = brk.filter(width / C("atr_before") >= atr_min)
            if atr_max is not None:
                brk = brk.filter(width / C("atr_before") <= atr_max)
        if mode == "atr_regime":
            marks = brk.select(*keys, "ord", F.lit(True).alias("_event"))
            series = rich.select(*keys, "ord", "_atr", "atr_before").join(marks, [*keys, "ord"], "left")
            event = F.coalesce("_event", F.lit(False))
            passed = above_expanding_quantile(series, event, "_atr", "atr_before", quantile, 50, keys)
            brk = brk.join(passed.filter("at_or_above").select(*keys, "ord"), [*keys, "ord"], "left_semi")
        hits = _confirmed(brk, mode, min_body, min_clv, cutoff).select(
            *keys, C("confirm.ts").alias("ts"), C("direction").cast("double").alias("weight")
        )
    return df.join(hits, [*keys, "ts"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def _shape(bar: str, low_share: bool):
    rng = C(f"{bar}.high") - C(f"{bar}.low")
    if low_share:
        return F.when(rng <= 0, 0.5).otherwise((C(f"{bar}.close") - C(f"{bar}.low")) / rng)
    return F.when(rng <= 0, 0.0).otherwise(F.abs(C(f"{bar}.close") - C(f"{bar}.open")) / rng)


def _confirmed(brk: DataFrame, mode: str, min_body, min_clv, cutoff) -> DataFrame:
    """Breakouts whose next bar retests the level and whose second next bar goes further."""
    up = C("direction") == 1
    same_day = (C("retest.day") == C("day")) & (C("confirm.day") == C("day"))
    retests = F.when(
        up, (C("retest.low") <= C("orb_high")) & (C("retest.close") > C("orb_high"))
    ).otherwise((C("retest.high") >= C("orb_low")) & (C("retest.close") < C("orb_low")))
    further = F.when(up, C("confirm.close") > C("high")).otherwise(C("confirm.close") < C("low"))
    out = brk.filter(same_day & retests & further)
    if mode == "retest_rejection":
        place = _shape("retest", True)
        out = out.filter(F.when(up, place >= 0.5).otherwise(place <= 0.5))
    if min_body is not None:
        out = out.filter(_shape("confirm", False) >= min_body)
    if min_clv is not None:
        clv = _shape("confirm", True)
        out = out.filter(F.when(up, clv >= min_clv).otherwise(clv <= 1.0 - min_clv))
    if cutoff:
        out = out.filter(in_session("confirm.local", upto=cutoff))
    return out
