"""Parameter grids and sweeps."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.plans.series import SERIES, chunk_rows

C = F.col
WIDE_GRID = 32


def with_grid(df: DataFrame, grid: list[dict]) -> DataFrame:
    """One copy of each row per parameter set. The grid is a literal of fixed size.

    A large grid multiplies small partitions, so their rows are spread evenly first; that
    moves one row per grid-full of output rows.
    """
    if len(grid) >= WIDE_GRID:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(n, *[c for c in ("symbol", "ord") if c in df.columns])
    kinds = {int: "int", float: "double", str: "string"}
    fields = ", ".join(f"`{k}`: {kinds[type(v)]}" for k, v in grid[0].items())
    sets = F.from_json(F.lit(json.dumps(grid)), f"array<struct<{fields}>>")  # one literal, folded by the optimizer
    return df.withColumn("_g", F.explode(sets)).select(*df.columns, "_g.*")


def _averages(x: np.ndarray, periods) -> dict[int, np.ndarray]:
    out = {}
    for n in periods:
        m = np.full(len(x), np.nan)
        if len(x) >= n:
            m[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n).mean(axis=1)
        out[n] = m
    return out


def _pair_weights(x, f, s, modes, filters, buffers) -> np.ndarray:
    """(rows, modes * filters * buffers) weights of one fast/slow pair."""
    df_, ds = np.diff(f, prepend=np.nan), np.diff(s, prepend=np.nan)
    yes = np.ones(len(x), bool)
    gates = {
        "none": (yes, yes),
        "price_slow": (x > s, x < s),
        "slow_slope": (ds > 0, ds < 0),
        "fast_slope": (df_ > 0, df_ < 0),
        "combined": ((x > s) & (ds > 0) & (df_ > 0), (x < s) & (ds < 0) & (df_ < 0)),
    }
    cols = []
    for mode in modes:
        for name in filters:
            for b in buffers:
                w = ((f > s * (1 + b)) & gates[name][0]).astype(float)
                if mode == "long_short":
                    w[(f < s * (1 - b)) & gates[name][1]] = -1.0
                cols.append(w)
    return np.stack(cols, axis=1)


def screen_variants(
    df: DataFrame, fast, slow, modes, filters, buffers, cost: float = 0.0006, keys=SERIES, rows: int | None = None
) -> DataFrame:
    """Screening metrics of every golden-cross variant of every series.

    A sweep has thousands of variants per bar, so rows are not multiplied. Each chunk (with
    the rows before it that its longest average needs) is reduced to one short summary
    per variant: sums, growth, its extremes and its own drawdown. Summaries of
    consecutive chunks then combine exactly: earlier growth scales a chunk, and the
    drawdown is the deeper of the chunk's own and its low against the earlier peak.
    """
    keys = list(keys)
    periods = sorted({*fast, *slow})
    pairs = [(a, b) for a in fast for b in slow if a < b]
    combos = [(m, x, b) for m in modes for x in filters for b in buffers]
    back = max(periods) + 3
    rows = max(chunk_rows(rows), back)
    home = F.floor(C("ord") / rows)
    copied = df.select(*keys, "ord", "close").withColumn(
        "_chunk", F.explode(F.array_compact(F.array(home, F.when(F.pmod(C("ord"), F.lit(rows)) >= rows - back, home + 1))))
    )

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        x, o = pdf["close"].to_numpy(), pdf["ord"].to_numpy()
        chunk = int(pdf["_chunk"].iloc[0])
        own = o // rows == chunk
        if not own.any():
            return pd.DataFrame(columns=out_cols)
        r = np.zeros(len(x))
        r[1:] = x[1:] / x[:-1] - 1
        sma = _averages(x, periods)
        parts = []
        for p, (a, b) in enumerate(pairs):
            w = _pair_weights(x, sma[a], sma[b], modes, filters, buffers)
            w[o < b] = 0.0
            pos = np.vstack([np.zeros((1, w.shape[1])), w[:-1]])
            prev = np.vstack([np.zeros((1, w.shape[1])), pos[:-1]])
            net = (pos * r[:, None] - np.abs(pos - prev) * cost)[own]
            moved = (pos != prev)[own].sum(axis=0) + (1 if o[own][0] == 0 else 0)
            g = np.cumprod(1 + net, axis=0)
            top = np.maximum.accumulate(g, axis=0)
            parts.append(
                pd.DataFrame(
                    {
                        "vid": p * len(combos) + np.arange(len(combos)),
                        "n": len(net), "s1": net.sum(axis=0), "s2": (net**2).sum(axis=0), "growth": g[-1],
                        "low": g.min(axis=0), "high": top[-1], "dd": (g / top - 1).min(axis=0), "moves": moved,
                    }
                )
            )
        res = pd.concat(parts, ignore_index=True)
        for k in keys:
            res[k] = pdf[k].iloc[0]
        res["_chunk"] = chunk
        return res[out_cols]

    out_cols = [*keys, "_chunk", "vid", "n", "s1", "s2", "growth", "low", "high", "dd", "moves"]
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    schema = f"{key_types}, _chunk bigint, vid bigint, n bigint, s1 double, s2 double, growth double, low double, high double, dd double, moves bigint"
    parts = copied.groupBy(*keys, "_chunk").applyInPandas(summary, schema)
    before = W.partitionBy(*keys, "vid").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.product("growth").over(before), F.lit(1.0)))
    parts = parts.withColumn("_top", F.max(C("_base") * C("high")).over(before))
    deep = F.least(C("dd"), C("_base") * C("low") / C("_top") - 1)
    span = df.groupBy(*keys).agg(
        ((F.max(F.unix_micros(C("ts").cast("timestamp"))) - F.min(F.unix_micros(C("ts").cast("timestamp")))) / 1e6 / (365.2425 * 86400)).alias("years")
    )
    m = parts.groupBy(*keys, "vid").agg(
        F.sum("n").alias("_n"), F.sum("s1").alias("_s1"), F.sum("s2").alias("_s2"), F.product("growth").alias("_g"),
        F.min(deep).alias("max_drawdown"), F.sum("moves").alias("approx_trades"),
    ).join(span, keys)
    mean = C("_s1") / C("_n")
    sd = F.sqrt(F.greatest(F.lit(0.0), (C("_s2") - C("_n") * mean * mean) / (C("_n") - 1)))
    ppy = (C("_n") - 1) / C("years")
    m = m.withColumns(
        {
            "total_return": C("_g") - 1,
            "cagr": F.when(C("_g") > 0, F.pow(C("_g"), 1 / C("years")) - 1),
            "sharpe": F.when(sd > 1e-12, mean / sd * F.sqrt(ppy)),
        }
    ).withColumn("calmar", F.when(C("max_drawdown") < 0, C("cagr") / F.abs("max_drawdown")))
    cols = ["approx_trades", "total_return", "cagr", "sharpe", "calmar", "max_drawdown"]
    return m.select(*keys, "vid", *cols).join(_variant_names(df, pairs, combos), "vid")


def rank_screen(screen: DataFrame, least_trades: int = 10, top: int = 10, keys=SERIES) -> DataFrame:
    """Score by percentile ranks per data set and keep the best `top`."""
    from tidemark.operators.ranking import SCREEN_SCORE, score, top_per_group

    ranked = score(screen.filter(C("approx_trades") >= least_trades), SCREEN_SCORE, keys)
    order = [F.desc("score"), F.desc("sharpe"), F.desc("cagr"), C("vid")]
    return top_per_group(ranked, keys, order, top)


def full_sweep(df: DataFrame, grid: list[dict], commission_bps: float = 1.0, slippage_bps: float = 5.0, keys=SERIES) -> DataFrame:
    """Net-of-cost metrics and trade statistics per variant, at the next open.

    For the finalists of `screen_variants`, or for grids that are small by themselves:
    here each bar becomes one row per variant.
    """
    from tidemark.operators.metrics import core_metrics, trade_metrics
    from tidemark.operators.pnl import fill_events, next_open_returns
    from tidemark.operators.signals import golden_cross_variants
    from tidemark.operators.trades import extract_trades
    from tidemark.plans.series import equity_scan, time_bucket, with_ordinal
    from tidemark.session import stage

    vk = [*keys, "fast", "slow", "mode", "filter", "buffer"]
    variants = stage(golden_cross_variants(df, grid, keys).select(*vk, "ts", "ord", "open", "close", "weight"), "variants")
    curve = equity_scan(next_open_returns(variants, commission_bps, slippage_bps, keys=vk), keys=vk)
    curve = curve.withColumn("r", F.when(C("ord") > 0, C("r")))
    core = core_metrics(curve, vk)
    fills = fill_events(variants, slippage_bps, vk).select(
        *vk, C("fill_ts").alias("ts"), C("delta_weight").alias("qty"), "price",
        (F.abs("delta_weight") * C("price") * commission_bps / 1e4).alias("commission"),
    )
    fills = stage(with_ordinal(stage(fills, "variant-fills"), vk, ["ts"], time_bucket()), "variant-fills")
    trades = trade_metrics(extract_trades(fills, vk), vk).select(*vk, "num_trades", "win_rate", "profit_factor", "expectancy")
    none = {"num_trades": 0}
    return core.join(trades, vk, "left").fillna(none)


def sweep_variants(
    df: DataFrame, fast, slow, modes, filters, buffers, commission_bps: float = 1.0, slippage_bps: float = 5.0, keys=SERIES,
    ppy: float = 252.0, rows: int | None = None,
) -> DataFrame:
    """As `full_sweep` for every golden-cross variant of every series, without a row per bar and variant.

    A chunk is folded into one row per variant: the segment of its next-open path, and its trades.
    Weights do not depend on the path, so a chunk knows the position it starts with; of the trade
    carried in it only lacks the entry price. It returns sums over the trades it closes itself, the
    exit price of the one carried in and the entry price of the one carried out; consecutive rows
    then complete each other.
    """
    from tidemark.operators.metrics import nz, span_days

    keys = list(keys)
    periods = sorted({*fast, *slow})
    pairs = [(a, b) for a in fast for b in slow if a < b]
    combos = [(m, x, b) for m in modes for x in filters for b in buffers]
    back = max(periods) + 3
    rows = max(chunk_rows(rows), back)
    rate, slip, fee = (commission_bps + slippage_bps) / 1e4, slippage_bps / 1e4, commission_bps / 1e4
    home, pos = F.floor(C("ord") / rows), F.pmod(C("ord"), F.lit(rows))
    copies = F.array_compact(F.array(home, F.when(pos >= rows - back, home + 1), F.when((pos == 0) & (home > 0), home - 1)))
    copied = df.select(*keys, "ord", "open", "close").withColumn("_chunk", F.explode(copies))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        x, op, o = (pdf[c].to_numpy() for c in ("close", "open", "ord"))
        chunk = int(pdf["_chunk"].iloc[0])
        own = o // rows == chunk
        if not own.any():
            return pd.DataFrame(columns=out_cols)
        gap, after = np.zeros(len(x)), np.full(len(x), np.nan)
        gap[1:], after[:-1] = op[1:] / x[:-1] - 1, op[1:]
        day, live = x / op - 1, o[own] > 0
        fills = own & ~np.isnan(after)
        sma, parts = _averages(x, periods), []
        late = lambda w: np.vstack([np.zeros((1, w.shape[1])), w[:-1]])
        for p, (a, b) in enumerate(pairs):
            w = _pair_weights(x, sma[a], sma[b], modes, filters, buffers)
            w[o < b] = 0.0
            m = w.shape[1]
            prev = late(w)
            old = late(prev)
            net = ((1 + old * gap[:, None]) * (1 + prev * day[:, None] - np.abs(prev - old) * rate) - 1)[own]
            net[~live] = 0.0
            g = np.cumprod(1 + net, axis=0)
            top = np.maximum.accumulate(g, axis=0)
            v, t = np.nonzero(((w != prev) & fills[:, None]).T)
            price = after[t] * (1 + slip * np.sign(w[t, v] - prev[t, v]))
            side, same = prev[t, v], np.append(False, v[1:] == v[:-1])
            inside, carried = (side != 0) & same, (side != 0) & ~same
            pnl = np.zeros(len(v))
            pnl[1:] = side[1:] * (price[1:] - price[:-1]) - fee * (price[1:] + price[:-1])
            pnl = np.where(inside, pnl, 0.0)
            exit_price, exit_side, entry = np.full(m, np.nan), np.zeros(m), np.full(m, np.nan)
            exit_price[v[carried]], exit_side[v[carried]] = price[carried], side[carried]
            last = np.flatnonzero(np.append(v[1:] != v[:-1], True)) if len(v) else np.zeros(0, int)
            entry[v[last]] = np.where(w[t[last], v[last]] != 0, price[last], np.nan)
            held = w[own] != 0
            add = lambda values: np.bincount(v, values, m)
            parts.append(
                pd.DataFrame(
                    {
                        "vid": p * len(combos) + np.arange(len(combos)),
                        "n": live.sum(), "s1": net.sum(axis=0), "s2": (net**2).sum(axis=0), "growth": g[-1],
                        "low": g.min(axis=0), "high": top[-1], "dd": (g / top - 1).min(axis=0),
                        "trades": add(inside).astype(int), "wins": add(pnl > 0).astype(int), "won": add(np.maximum(pnl, 0)), "lost": add(np.minimum(pnl, 0)),
                        "exit": exit_price, "side": exit_side, "entry": entry,
                        "longs": (w[own] > 0).sum(axis=0), "shorts": (w[own] < 0).sum(axis=0),
                        "first_ord": np.where(held.any(axis=0), o[own][held.argmax(axis=0)], -1),
                    }
                )
            )
        res = pd.concat(parts, ignore_index=True)
        for k in keys:
            res[k] = pdf[k].iloc[0]
        res["_chunk"] = chunk
        return res[out_cols]

    kinds = {
        "_chunk": "bigint", "vid": "bigint", "n": "bigint", "s1": "double", "s2": "double", "growth": "double", "low": "double", "high": "double", "dd": "double",
        "trades": "bigint", "wins": "bigint", "won": "double", "lost": "double", "exit": "double", "side": "double", "entry": "double",
        "longs": "bigint", "shorts": "bigint", "first_ord": "bigint",
    }
    out_cols = [*keys, *kinds]
    key_types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys]
    parts = copied.groupBy(*keys, "_chunk").applyInPandas(fold, ", ".join([*key_types, *[f"{c} {t}" for c, t in kinds.items()]]))
    known = lambda c: F.when(~F.isnan(c), C(c))
    parts = parts.withColumns({"exit": known("exit"), "entry": known("entry")})
    before = W.partitionBy(*keys, "vid").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({"_base": F.coalesce(F.product("growth").over(before), F.lit(1.0)), "_in": F.last("entry", ignorenulls=True).over(before)})
    pnl = C("side") * (C("exit") - C("_in")) - fee * (C("exit") + C("_in"))
    parts = parts.withColumns({"_top": F.max(C("_base") * C("high")).over(before), "_pnl": pnl})
    deep = F.least(C("dd"), C("_base") * C("low") / C("_top") - 1)
    m = parts.groupBy(*keys, "vid").agg(
        F.sum("n").alias("_n"), F.sum("s1").alias("_s1"), F.sum("s2").alias("_s2"), F.product("growth").alias("_g"), F.min(deep).alias("max_drawdown"),
        (F.sum("trades") + F.count("_pnl")).alias("num_trades"), (F.sum("wins") + F.count_if(C("_pnl") > 0)).alias("_wins"),
        (F.sum("won") + F.coalesce(F.sum(F.when(C("_pnl") > 0, C("_pnl"))), F.lit(0.0))).alias("_won"),
        (F.sum("lost") + F.coalesce(F.sum(F.when(C("_pnl") <= 0, C("_pnl"))), F.lit(0.0))).alias("_lost"),
        F.sum("longs").alias("longs"), F.sum("shorts").alias("shorts"), F.min(F.when(C("first_ord") >= 0, C("first_ord"))).alias("first_ord"),
    )
    m = m.join(df.groupBy(*keys).agg(span_days().alias("_days")), keys)
    mean = C("_s1") / nz("_n")
    sd = F.sqrt(F.greatest(F.lit(0.0), (C("_s2") - C("_n") * mean * mean) / nz(C("_n") - 1)))
    years = F.when(C("_days") > 0, C("_days") / 365.25).otherwise(C("_n") / ppy)
    some = C("num_trades") > 0
    m = m.withColumns(
        {
            "total_return": C("_g") - 1,
            "cagr": F.when((years > 0) & (C("_g") > 0), F.pow(C("_g"), 1 / years) - 1),
            "sharpe": mean / nz(sd) * ppy**0.5,
            "win_rate": F.when(some, C("_wins") / C("num_trades")),
            "profit_factor": F.when(some, F.when(C("_lost") != 0, C("_won") / F.abs("_lost")).when(C("_won") > 0, F.lit(float("inf"))).otherwise(0.0)),
            "expectancy": F.when(some, (C("_won") + C("_lost")) / C("num_trades")),
        }
    ).withColumn("calmar", F.when(C("max_drawdown") < 0, C("cagr") / F.abs("max_drawdown")))
    cols = ["total_return", "cagr", "sharpe", "calmar", "max_drawdown", "num_trades", "win_rate", "profit_factor", "expectancy", "longs", "shorts", "first_ord"]
    return m.select(*keys, "vid", *cols).join(_variant_names(df, pairs, combos), "vid")


def _variant_names(df: DataFrame, pairs, combos) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(p * len(combos) + c, a, b, *combo) for p, (a, b) in enumerate(pairs) for c, combo in enumerate(combos)],
        "vid long, fast long, slow long, mode string, filter string, buffer double",
    )


def rank_full(metrics: DataFrame, keys=SERIES) -> DataFrame:
    from tidemark.operators.ranking import FULL_SCORE, score, with_sample_flags

    return with_sample_flags(score(metrics, FULL_SCORE, keys, "research_score"))


def cost_sensitivity(df: DataFrame, slippages=(0.0, 2.0, 5.0, 10.0, 20.0, 50.0), commission_bps: float = 1.0, keys=SERIES) -> DataFrame:
    """Curve metrics at several slippages. Positions are found once, only costs differ."""
    from tidemark.operators.metrics import core_metrics
    from tidemark.operators.pnl import next_open_returns
    from tidemark.plans.series import equity_scan, on_chunks

    d = next_open_returns(df, 0.0, 0.0, keys=keys)
    d = on_chunks(d, lambda x, c: x.withColumn("_gap", F.coalesce((1 + c.lag("position", 1, 0.0) * (C("open") / c.lag("close") - 1)), F.lit(1.0))), keys, back=1)
    grid = with_grid(d.select(*keys, "ts", "ord", "r", "turnover", "_gap"), [{"slippage_bps": float(s)} for s in slippages])
    rate = (F.lit(commission_bps) + C("slippage_bps")) / 1e4
    grid = grid.withColumn("r", C("r") - C("_gap") * C("turnover") * rate)
    vk = [*keys, "slippage_bps"]
    curve = equity_scan(grid, keys=vk).withColumn("r", F.when(C("ord") > 0, C("r")))
    return core_metrics(curve, vk)


def rule_signals(df: DataFrame, rules: dict, keys=SERIES) -> DataFrame:
    """keys, strategy, ts, ord, open, close, weight of each rule, one below the other."""
    from functools import reduce

    cols = [*keys, "ts", "ord", "open", "close", "weight"]
    return reduce(DataFrame.unionByName, [f(df).select(*cols).withColumn("strategy", F.lit(n)) for n, f in rules.items()])


def rule_curves(signals: DataFrame, commission_bps: float = 1.0, slippage_bps: float = 5.0, keys=("symbol", "strategy")) -> DataFrame:
    """Next-open equity of each asset and rule; the first bar has no return."""
    from tidemark.operators.pnl import next_open_returns
    from tidemark.plans.series import equity_scan

    curve = equity_scan(next_open_returns(signals, commission_bps, slippage_bps, keys=keys), keys=keys)
    return curve.withColumn("r", F.when(C("ord") > 0, C("r")))


def rule_trades(signals: DataFrame, commission_bps: float = 1.0, slippage_bps: float = 5.0, keys=("symbol", "strategy")) -> DataFrame:
    """Round trips of a unit of weight, filled at the next open."""
    from tidemark.operators.pnl import fill_events
    from tidemark.operators.trades import extract_trades
    from tidemark.plans.series import time_bucket, with_ordinal
    from tidemark.session import stage

    fills = fill_events(signals, slippage_bps, keys).select(
        *keys, C("fill_ts").alias("ts"), C("delta_weight").alias("qty"), "price",
        (F.abs("delta_weight") * C("price") * commission_bps / 1e4).alias("commission"),
    )
    return extract_trades(stage(with_ordinal(stage(fills, "rule-fills"), keys, ["ts"], time_bucket()), "rule-fills"), keys)


def screen_assets(signals: DataFrame, curves: DataFrame, trades: DataFrame, keys=("symbol", "strategy"), ppy: float = 252.0, rf: float = 0.0) -> DataFrame:
    """One row per asset and rule: curve metrics, trade statistics (null without trades) and the Sharpe ratio over that
    of a static position of the rule's average weight."""
    from tidemark.operators.drawdown import longest_underwater
    from tidemark.operators.metrics import core_metrics, nz, trade_metrics
    from tidemark.operators.pnl import same_exposure_benchmark

    keys = list(keys)
    core = core_metrics(curves, keys, ppy, rf).select(*keys, "cagr", "volatility", "sharpe", "sortino", "calmar", "max_drawdown")
    bench = same_exposure_benchmark(signals, costs=False, keys=keys).filter("ord > 0").groupBy(*keys)
    bench = bench.agg((F.avg("r") / nz(F.stddev_samp("r")) * ppy**0.5).alias("benchmark_sharpe"), F.first("avg_weight").alias("avg_exposure"))
    under = longest_underwater(curves, keys=keys).select(*keys, "max_drawdown_duration_bars")
    stats = trade_metrics(trades, keys).select(*keys, "num_trades", "win_rate", "profit_factor", "expectancy")
    out = core.join(bench, keys).join(under, keys, "left").join(stats, keys, "left")
    return out.withColumns({"excess_sharpe": C("sharpe") - C("benchmark_sharpe"), "num_trades": F.coalesce("num_trades", F.lit(0))})
