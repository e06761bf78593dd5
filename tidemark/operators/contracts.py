"""Checks and projections of weights, plans and exits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fail(cond: Column, text: str) -> Column:
    return F.when(cond, F.raise_error(F.lit(text)).cast("boolean")).otherwise(True)


def validate_weights(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Weights on the bars' own times, nulls as 0.

    The job fails if a row has no partner on the other side, if a symbol's weights are
    all null, or if a weight lies outside [-1, 1].
    """
    if dict(signals.dtypes)["weight"] == "string":
        raise ValueError("weights must be numeric")
    a = bars.select("symbol", "ts", F.lit(True).alias("_bar"))
    b = signals.select("symbol", "ts", F.col("weight").cast("double").alias("weight"), F.lit(True).alias("_sig"))
    both = a.join(b, ["symbol", "ts"], "full_outer")
    facts = both.groupBy("symbol").agg(
        F.count_if(F.col("_bar").isNull() | F.col("_sig").isNull()).alias("_lost"),
        F.count("weight").alias("_n"),
        F.count_if(F.abs("weight") > 1).alias("_big"),
    )
    checked = facts.select(
        "symbol",
        (
            _fail(F.col("_lost") > 0, "signals are not aligned with the bars")
            & _fail(F.col("_n") == 0, "all weights are null")
            & _fail(F.col("_big") > 0, "weights must lie in [-1, 1]")
        ).alias("_ok"),
    )
    return (
        both.join(checked, "symbol")
        .filter("_ok")
        .select("symbol", "ts", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    )


def mask_to_weight(rules: list[tuple[Column, float]], default: float = 0.0) -> Column:
    """Ordered (condition, value) rules; a later rule overrides an earlier one."""
    return reduce(lambda acc, r: F.when(r[0], F.lit(r[1])).otherwise(acc), rules, F.lit(default))


def plan_is_valid() -> Column:
    e, s, t = F.col("entry_price"), F.col("stop_price"), F.col("target_price")
    return F.when(F.col("direction") == "LONG", (s < e) & (e < t)).otherwise((s > e) & (e > t))


def split_plans(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected)."""
    ok = F.coalesce(plan_is_valid() & F.col("direction").isin("LONG", "SHORT"), F.lit(False))
    return plans.filter(ok), plans.filter(~ok)


def plan_projections(plans: DataFrame) -> DataFrame:
    risk = F.abs(F.col("entry_price") - F.col("stop_price"))
    reward = F.abs(F.col("target_price") - F.col("entry_price"))
    return plans.withColumns(
        {
            "risk_points": risk,
            "reward_points": reward,
            "planned_rr": F.when(risk <= 0, 0.0).otherwise(reward / risk),
        }
    )


def result_projections(exits: DataFrame) -> DataFrame:
    move = F.col("exit_price") - F.col("entry_price")
    gross = F.when(F.col("direction") == "LONG", move).otherwise(-move)
    return exits.withColumns(
        {
            "gross_points": gross,
            "r_multiple": F.when(F.col("risk_per_unit") <= 0, 0.0).otherwise(gross / F.col("risk_per_unit")),
        }
    )


def in_session(ts, start: str | None = None, before: str | None = None, upto: str | None = None) -> Column:
    """start <= time of day, < before, <= upto."""
    hhmm = F.date_format(ts, "HH:mm")
    cond = F.lit(True)
    if start:
        cond = cond & (hhmm >= start)
    if before:
        cond = cond & (hhmm < before)
    if upto:
        cond = cond & (hhmm <= upto)
    return cond
