"""Fills to round trips, and bracket exits of trade plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.series import SERIES, chunk_rows, scan_dealt, split_series
from tidemark.session import stage

C = F.col
TOL = 1e-6


def extract_trades(fills: DataFrame, keys=SERIES) -> DataFrame:
    """Round trips from signed fills (ts, ord, qty, price, commission).

    The running quantity marks each fill as opening, closing, flipping or adding. A
    running count of openings and flips numbers the trades; a flip closes one trade and
    opens the next with half of its commission each. Trades still open are left out.
    Fills are dealt once, by chunk; both counts and the parts of a trade inside a chunk go by that.
    """
    keys = list(keys)
    base = split_series(fills).withColumn("_chunk", F.floor(C("ord") / F.lit(chunk_rows())))
    d = scan_dealt(base.repartition(*keys, "_chunk"), {"pos": ("sum", "qty")}, keys, base)
    prev = C("pos") - C("qty")
    flat_before, flat_after = F.abs(prev) < TOL, F.abs("pos") < TOL
    kind = (
        F.when(flat_before & ~flat_after, "open")
        .when(~flat_before & flat_after, "close")
        .when(((prev > TOL) & (C("pos") < -TOL)) | ((prev < -TOL) & (C("pos") > TOL)), "flip")
        .when(~flat_before, "add")
    )
    d = d.withColumn("kind", kind).filter(C("kind").isNotNull())
    starts = C("kind").isin("open", "flip")
    d = scan_dealt(d, {"trade": ("sum", F.when(starts, 1).otherwise(0).cast("long"))}, keys)
    part = lambda trade, kind_, qty, share: F.struct(
        trade.alias("trade"), F.lit(kind_).alias("kind"), qty.alias("qty"), (C("commission") * share).alias("commission")
    )
    parts = F.when(
        C("kind") == "flip",
        F.array(part(C("trade") - 1, "close", C("qty"), 0.5), part(C("trade"), "open", C("pos"), 0.5)),
    ).otherwise(F.array(F.struct(C("trade"), C("kind"), C("qty"), C("commission"))))
    rows = d.select(*keys, "_chunk", "ts", "ord", "price", F.explode(parts).alias("p")).select(*keys, "_chunk", "ts", "ord", "price", "p.*")
    at = lambda col, which: F.max(F.when(C("kind") == which, C(col)))
    inside = rows.groupBy(*keys, "_chunk", "trade").agg(
        at("ts", "open").alias("entry_ts"),
        at("ts", "close").alias("exit_ts"),
        at("price", "open").alias("entry_price"),
        at("price", "close").alias("exit_price"),
        at("qty", "open").alias("_q"),
        at("commission", "open").alias("_c0"),
        at("commission", "close").alias("_c1"),
        F.count_if(C("kind") == "add").alias("scale_ins"),
        at("ord", "close").alias("exit_ord"),
    )
    ends = ("entry_ts", "exit_ts", "entry_price", "exit_price", "_q", "_c0", "_c1", "exit_ord")
    t = inside.groupBy(*keys, "trade").agg(*[F.max(c).alias(c) for c in ends], F.sum("scale_ins").alias("scale_ins"))
    t = t.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("_c0", "_c1")})
    gross = (C("exit_price") - C("entry_price")) * C("_q")
    return t.filter(C("exit_ts").isNotNull() & C("entry_ts").isNotNull()).select(
        *keys,
        "trade",
        "entry_ts",
        "exit_ts",
        F.when(C("_q") > 0, "LONG").otherwise("SHORT").alias("direction"),
        "entry_price",
        "exit_price",
        F.abs("_q").alias("qty"),
        gross.alias("gross_pnl"),
        (C("_c0") + C("_c1")).alias("commission"),
        (gross - C("_c0") - C("_c1")).alias("pnl"),
        "scale_ins",
        "exit_ord",
    )


def extract_trades_multi(fills: DataFrame) -> DataFrame:
    """As `extract_trades`, with fills of no symbol booked under ASSET."""
    return extract_trades(fills.withColumn("symbol", F.coalesce("symbol", F.lit("ASSET"))))


HIT = ("hit_ord", "hit_ts", "hit_open", "hit_high", "hit_low")


def first_touch(plans: DataFrame, bars: DataFrame, fan: int = 16) -> DataFrame:
    """Plans plus the first bar after their entry that reaches stop or target, or nulls.

    Bars form a tree: a node covers `fan` nodes below it and keeps their lowest low and
    highest high. A plan looks at the siblings to its right, climbs while none of them
    is reached, and then descends into the first node that is. Siblings are packed into one
    row per parent, so each step is an equi-join on (symbol, parent) with one match per
    plan, however long the series is, and only plans still searching take part. The leaves
    carry the bar itself, so the hit needs no join of its own.
    """
    top = bars.agg(F.max("ord")).first()[0] or 0  # one number, read from file statistics
    low, high = F.least("low", "open"), F.greatest("high", "open")
    leaf = F.struct("ord", "ts", "open", "high", "low")
    levels = [bars.select("symbol", C("ord").alias("node"), low.alias("lo"), high.alias("hi"), leaf.alias("bar"))]
    while fan ** len(levels) <= top:
        levels.append(
            levels[-1]
            .groupBy("symbol", F.floor(C("node") / fan).alias("node"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        )
    packed = [
        x.groupBy("symbol", F.floor(C("node") / fan).alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("node", *[c for c in x.columns if c not in ("symbol", "node")]))).alias("_kids")  # at most `fan`
        )
        for x in levels
    ]
    own = plans.columns

    def search(s: DataFrame, level: int, after: Column, tag: str) -> DataFrame:
        """Each plan with `hit`, the first child beyond `after` that it touches; on leaves also its bar."""
        long = C("direction") == "LONG"
        near = s.join(packed[level], ["symbol", "parent"], "left").withColumns(
            {
                "_down": F.when(long, C("stop_price")).otherwise(C("target_price")),
                "_up": F.when(long, C("target_price")).otherwise(C("stop_price")),
                "_after": after,
            }
        )
        touched = F.filter(
            "_kids", lambda k: (k["node"] > C("_after")) & ((k["lo"] <= C("_down")) | (k["hi"] >= C("_up")))
        )
        near = near.withColumn("_hit", F.get(touched, F.lit(0)))
        bar = [C("_hit.bar").alias("bar")] if level == 0 else []
        return stage(near.select(*own, "at", C("_hit.node").alias("hit"), *bar), tag)

    found, climbed = [], {}
    state = plans.withColumn("at", C("ord"))
    for k in range(len(levels)):
        got = search(state.withColumn("parent", F.floor(C("at") / fan)), k, C("at"), "touch-up")
        climbed[k] = got.filter(C("hit").isNotNull())
        state = got.filter(C("hit").isNull()).select(*own, F.floor(C("at") / fan).alias("at"))
    found.append(climbed[0])
    descend = None
    for k in range(len(levels) - 1, 0, -1):
        here = climbed[k].select(*own, "at", C("hit").alias("parent"))
        descend = here if descend is None else here.unionByName(descend)
        got = search(descend, k - 1, F.lit(-1), "touch-down")
        descend = got.select(*own, "at", C("hit").alias("parent"))
        if k == 1:
            found.append(got)
    parts = [
        f.select(*own, *[C(f"bar.{x}").alias(h) for h, x in zip(HIT, ("ord", "ts", "open", "high", "low"))]) for f in found
    ]
    types = dict(parts[0].dtypes)
    parts.append(state.select(*own, *[F.lit(None).cast(types[h]).alias(h) for h in HIT]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bracket_exits(plans: DataFrame, bars: DataFrame, fan: int = 16) -> DataFrame:
    """Exit of each plan (symbol, ts, ord, direction, entry/stop/target price).

    On the first bar that reaches a level the open decides first (gap), then the stop,
    then the target. Without one the last close ends the trade.
    """
    ends = bars.groupBy("symbol").agg(
        F.max("ord").alias("_last"), F.max_by("ts", "ord").alias("_last_ts"), F.max_by("close", "ord").alias("_last_close")
    )
    j = first_touch(plans, bars, fan).join(ends, "symbol").withColumnsRenamed(
        {"hit_ts": "_ts", "hit_open": "_o", "hit_high": "_h", "hit_low": "_l"}
    )
    # Mirrored prices let one rule serve both sides.
    side = F.when(C("direction") == "LONG", 1.0).otherwise(-1.0)
    o, stop, target = side * C("_o"), side * C("stop_price"), side * C("target_price")
    worst = F.when(C("direction") == "LONG", C("_l")).otherwise(-C("_h"))
    gap = (o <= stop) | (o >= target)
    stopped = F.when(gap, o <= stop).otherwise(worst <= stop)
    price = F.when(gap, C("_o")).when(worst <= stop, C("stop_price")).otherwise(C("target_price"))
    no_hit = C("hit_ord").isNull()
    no_bar = C("ord") >= C("_last")
    return j.select(
        *plans.columns,
        F.when(no_bar, C("ts")).when(no_hit, C("_last_ts")).otherwise(C("_ts")).alias("exit_ts"),
        F.when(no_bar, C("entry_price")).when(no_hit, C("_last_close")).otherwise(price).alias("exit_price"),
        F.when(no_hit, "END_OF_DATA").when(stopped, "STOP").otherwise("TARGET").alias("exit_reason"),
        F.coalesce(C("hit_ord"), C("_last")).cast("long").alias("_exit_ord"),
    ).withColumn("bars_held", C("_exit_ord") - C("ord")).drop("_exit_ord")
