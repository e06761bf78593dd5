"""Rules that turn bars into target weights: bars in, the same rows plus `weight` out.

Parameters are plain arguments. `REGISTRY` maps rule names to callables, so that sweeps
and screens can name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import indicators as ind
from tidemark.functions.ewm import ewm, ewm_reach, span_alpha, wilder_alpha
from tidemark.operators.calendar import rebalance_dates
from tidemark.operators.contracts import mask_to_weight
from tidemark.operators.sweep import with_grid
from tidemark.plans.fold import keyed_fold
from tidemark.plans.series import SERIES, on_chunks, scan

C = F.col


def _with(df: DataFrame, keys, back: int, build) -> DataFrame:
    """Evaluate `build`, whose helper columns start with `_`, and drop those columns."""
    out = on_chunks(df, build, keys, back=back)
    return out.select(*df.columns, *[c for c in out.columns if c not in df.columns and not c.startswith("_")])


def hold(df: DataFrame, state: str = "state", keys=SERIES) -> DataFrame:
    """Weight = last non-null state, 0 before the first."""
    return scan(df, {"weight": ("last", state)}, keys).withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop(state)


def states(rules: list[tuple[Column, float]]) -> Column:
    """As `mask_to_weight`, but null where no rule holds."""
    out = F.lit(None).cast("double")
    for cond, value in rules:
        out = F.when(cond, F.lit(value)).otherwise(out)
    return out


def add_ema(df, c, name: str, value, n: int) -> DataFrame:
    return ewm(df, c, {name: (value, span_alpha(n), n)})


def add_rsi(df, c, name: str, n: int, no_loss: float | None = None) -> DataFrame:
    gain, loss = ind.gain_loss(c)
    a = wilder_alpha(n)
    df = ewm(df, c, {f"_{name}_g": (gain, a, n), f"_{name}_l": (loss, a, n)})
    return df.withColumn(name, ind.rsi_from(C(f"_{name}_g"), C(f"_{name}_l"), no_loss))


def add_atr(df, c, name: str, n: int = 14) -> DataFrame:
    return ewm(df, c, {name: (ind.true_range(c), wilder_alpha(n), n)})


def add_atr_simple(df, c, name: str, n: int = 14) -> DataFrame:
    return df.withColumn("_tr", ind.true_range(c)).withColumn(name, ind.sma(c, "_tr", n))


def add_macd(df, c, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm(df, c, {"_mf": ("close", span_alpha(fast), fast), "_ms": ("close", span_alpha(slow), slow)})
    df = df.withColumn("macd", C("_mf") - C("_ms"))
    df = ewm(df, c, {"macd_signal": ("macd", span_alpha(signal), signal)})
    return df.withColumn("macd_hist", C("macd") - C("macd_signal"))


def directional_moves(c) -> tuple[Column, Column]:
    """(upward, downward) directional movement of each bar."""
    up, down = C("high") - c.lag("high"), c.lag("low") - C("low")
    larger = lambda x, y: F.when((x > y) & (x > 0), x).otherwise(0.0)
    return larger(up, down), larger(down, up)


def adx_from(df, c, tr: str, up: str, down: str, n: int) -> DataFrame:
    """plus_di, minus_di and adx from smoothed true range and directional movement."""
    zero = F.lit(0.0)
    share = lambda x: 100 * C(x) / F.nullif(tr, zero)
    df = df.withColumns({"plus_di": share(up), "minus_di": share(down)})
    dx = 100 * F.abs(C("plus_di") - C("minus_di")) / F.nullif(C("plus_di") + C("minus_di"), zero)
    return ewm(df, c, {"adx": (dx, wilder_alpha(n), n)})


def add_adx(df, c, n: int = 14) -> DataFrame:
    up, down = directional_moves(c)
    a = wilder_alpha(n)
    df = ewm(df, c, {"_trw": (ind.true_range(c), a, n), "_pw": (up, a, n), "_mw": (down, a, n)})
    return adx_from(df, c, "_trw", "_pw", "_mw", n)


def reach(*alphas_and_ns) -> int:
    return sum(ewm_reach(a, n) for a, n in alphas_and_ns) + 2


def buy_hold(df: DataFrame, keys=SERIES) -> DataFrame:
    return df.withColumn("weight", F.lit(1.0))


def golden_cross(df: DataFrame, fast: int = 50, slow: int = 200, kind: str = "sma", keys=SERIES) -> DataFrame:
    back = ewm_reach(span_alpha(slow), slow) if kind == "ema" else slow
    return _with(df, keys, back, lambda d, c: golden_cross_on(d, c, fast, slow, kind))


def golden_cross_on(d: DataFrame, c, fast: int, slow: int, kind: str = "sma") -> DataFrame:
    """`golden_cross` inside a chunk, with its helper columns `_f` and `_s`."""
    if kind == "ema":
        d = ewm(d, c, {"_f": ("close", span_alpha(fast), fast), "_s": ("close", span_alpha(slow), slow)})
    else:
        d = ind.add_moments(d, c, {"_f": ("close", fast, "mean"), "_s": ("close", slow, "mean")})
    return d.withColumn("weight", F.when(C("_f") > C("_s"), 1.0).otherwise(0.0))


def ema_cross(df: DataFrame, fast: int = 12, slow: int = 26, keys=SERIES) -> DataFrame:
    def build(d, c):
        d = ewm(d, c, {"_f": ("close", span_alpha(fast), fast), "_s": ("close", span_alpha(slow), slow)})
        return d.withColumn("weight", mask_to_weight([(C("_f") > C("_s"), 1.0), (C("_f") < C("_s"), -1.0)]))

    return _with(df, keys, ewm_reach(span_alpha(slow), slow), build)


def rsi_meanrev(df: DataFrame, n: int = 2, lo: float = 10.0, hi: float = 70.0, trend: int = 200, keys=SERIES) -> DataFrame:
    def build(d, c):
        d = ind.add_moments(add_rsi(d, c, "_rsi", n), c, {"_trend": ("close", trend, "mean")})
        return d.withColumn("state", states([((C("_rsi") < lo) & (C("close") > C("_trend")), 1.0), (C("_rsi") > hi, 0.0)]))

    return hold(_with(df, keys, max(trend, reach((wilder_alpha(n), n))), build), keys=keys)


def bollinger_meanrev(df: DataFrame, n: int = 20, k: float = 2.0, keys=SERIES) -> DataFrame:
    def build(d, c):
        lower, mid, _ = ind.bollinger(c, "close", n, k)
        d = d.withColumns({"_lo": lower, "_mid": mid})
        return d.withColumn("state", states([(C("close") < C("_lo"), 1.0), (C("close") > C("_mid"), 0.0)]))

    return hold(_with(df, keys, n, build), keys=keys)


def donchian_breakout(df: DataFrame, entry: int = 20, exit_: int = 10, keys=SERIES) -> DataFrame:
    def build(d, c):
        d = d.withColumns({"_up": ind.donchian(c, entry)[1], "_dn": ind.donchian(c, exit_)[0]})
        d = d.withColumns({"_pu": c.lag("_up"), "_pd": c.lag("_dn")})
        return d.withColumn("state", states([(C("close") > C("_pu"), 1.0), (C("close") < C("_pd"), 0.0)]))

    return hold(_with(df, keys, max(entry, exit_) + 1, build), keys=keys)


def macd_cross(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys=SERIES) -> DataFrame:
    def build(d, c):
        d = add_macd(d, c, fast, slow, signal)
        m, s = C("macd"), C("macd_signal")
        return d.withColumn("weight", mask_to_weight([(m > s, 1.0), (m < s, -1.0)])).drop("macd", "macd_signal", "macd_hist")

    return _with(df, keys, reach((span_alpha(slow), slow), (span_alpha(signal), signal)), build)


def absolute_momentum(df: DataFrame, n: int = 252, keys=SERIES) -> DataFrame:
    return _with(df, keys, n, lambda d, c: d.withColumn("weight", F.when(ind.roc(c, "close", n) > 0, 1.0).otherwise(0.0)))


def roc_momentum(df: DataFrame, n: int = 60, threshold: float = 0.02, keys=SERIES) -> DataFrame:
    def build(d, c):
        m = ind.roc(c, "close", n)
        return d.withColumn("weight", mask_to_weight([(m > threshold, 1.0), (m < -threshold, -1.0)]))

    return _with(df, keys, n, build)


def atr_breakout(df: DataFrame, n: int = 20, atr_n: int = 14, k: float = 1.5, keys=SERIES) -> DataFrame:
    def build(d, c):
        d = add_atr(add_ema(d, c, "_mid", "close", n), c, "_atr", atr_n)
        up, dn = C("_mid") + k * C("_atr"), C("_mid") - k * C("_atr")
        x = C("close")
        return d.withColumn("state", states([(x > up, 1.0), (x < dn, -1.0), ((x <= up) & (x >= dn), 0.0)]))

    return hold(_with(df, keys, max(reach((span_alpha(n), n)), reach((wilder_alpha(atr_n), atr_n))), build), keys=keys)


def zscore_meanrev(df: DataFrame, n: int = 20, enter: float = 2.0, leave: float = 0.5, keys=SERIES) -> DataFrame:
    def build(d, c):
        d = d.withColumn("_z", ind.zscore(c, "close", n))
        z = C("_z")
        return d.withColumn("state", states([(z < -enter, 1.0), (z > enter, -1.0), (F.abs(z) < leave, 0.0)]))

    return hold(_with(df, keys, n, build), keys=keys)


def vwap_reversion(df: DataFrame, threshold: float = 0.015, keys=SERIES) -> DataFrame:
    d = scan(df, {"_pv": ("sum", ind.typical_price() * C("volume")), "_v": ("sum", "volume")}, keys)
    vwap = C("_pv") / F.nullif(C("_v"), F.lit(0.0))
    dev = (C("close") - vwap) / vwap
    return d.withColumn("weight", mask_to_weight([(dev > threshold, -1.0), (dev < -threshold, 1.0)])).drop("_pv", "_v")


def bollinger_rsi_double(
    df: DataFrame, rsi_n: int = 6, level_lo: float = 50.0, level_hi: float = 50.0, n: int = 200, k: float = 2.0, keys=SERIES
) -> DataFrame:
    def build(d, c):
        d = add_rsi(d, c, "_rsi", rsi_n, no_loss=100.0)
        d = ind.add_moments(d, c, {"_mid": ("close", n, "mean"), "_sd": ("close", n, "sd_pop")})
        lower, upper = C("_mid") - k * C("_sd"), C("_mid") + k * C("_sd")
        d = d.withColumns({"_lo": lower, "_up": upper, "_l50": F.lit(level_lo), "_h50": F.lit(level_hi)})
        x = C("close")
        long = ind.crossover(c, C("_rsi"), C("_l50")) & ind.crossover(c, x, C("_lo"))
        short = ind.crossunder(c, C("_rsi"), C("_h50")) & ind.crossunder(c, x, C("_up"))
        return d.withColumn("state", states([(long, 1.0), (short, -1.0)]))

    return hold(_with(df, keys, max(n, reach((wilder_alpha(rsi_n), rsi_n))) + 1, build), keys=keys)


def vwap_reversion_grid(df: DataFrame, thresholds, keys=SERIES) -> DataFrame:
    """`vwap_reversion` at several thresholds: adds `weights`, an array in their order."""
    d = scan(df, {"_pv": ("sum", ind.typical_price() * C("volume")), "_v": ("sum", "volume")}, keys)
    vwap = C("_pv") / F.nullif(C("_v"), F.lit(0.0))
    dev = (C("close") - vwap) / vwap
    return d.withColumn("weights", F.array(*[mask_to_weight([(dev > t, -1.0), (dev < -t, 1.0)]) for t in thresholds])).drop("_pv", "_v")


def bollinger_rsi_grid(df: DataFrame, rsi_lengths, bb_lengths, bb_mults, keys=SERIES) -> DataFrame:
    """`bollinger_rsi_double` for all triples: adds `weights`, an array in order of length, length, multiple.

    Each average is worked out once, and one scan carries all states.
    """
    triples = [(r, n, k) for r in rsi_lengths for n in bb_lengths for k in bb_mults]

    def build(d, c):
        for r in rsi_lengths:
            d = add_rsi(d, c, f"_rsi{r}", r, no_loss=100.0)
        d = ind.add_moments(d, c, {f"_{m}{n}": ("close", n, m) for n in bb_lengths for m in ("mean", "sd_pop")})
        x, level = C("close"), F.lit(50.0)
        lagged = {f"_rsi{r}": c.lag(f"_rsi{r}") for r in rsi_lengths} | {f"_{m}{n}": c.lag(f"_{m}{n}") for n in bb_lengths for m in ("mean", "sd_pop")}
        d = d.withColumns({"_px": c.lag("close"), **{f"_p{k}": v for k, v in lagged.items()}})
        out = {}
        for i, (r, n, k) in enumerate(triples):
            rsi, was = C(f"_rsi{r}"), C(f"_p_rsi{r}")
            lo, lo_was = C(f"_mean{n}") - k * C(f"_sd_pop{n}"), C(f"_p_mean{n}") - k * C(f"_p_sd_pop{n}")
            up, up_was = C(f"_mean{n}") + k * C(f"_sd_pop{n}"), C(f"_p_mean{n}") + k * C(f"_p_sd_pop{n}")
            long = (rsi > level) & (was <= level) & (x > lo) & (C("_px") <= lo_was)
            short = (rsi < level) & (was >= level) & (x < up) & (C("_px") >= up_was)
            out[f"state{i}"] = states([(long, 1.0), (short, -1.0)])
        return d.withColumns(out)

    names = [f"state{i}" for i in range(len(triples))]
    d = _with(df, keys, max(*bb_lengths, *[reach((wilder_alpha(r), r)) for r in rsi_lengths]) + 1, build)
    d = scan(d, {f"w_{c}": ("last", c) for c in names}, keys)
    return d.withColumn("weights", F.array(*[F.coalesce(f"w_{c}", F.lit(0.0)) for c in names])).drop(*names, *[f"w_{c}" for c in names])


REGISTRY = {
    "buy_hold": buy_hold,
    "golden_cross": golden_cross,
    "ema_cross": ema_cross,
    "rsi_meanrev": rsi_meanrev,
    "bollinger_meanrev": bollinger_meanrev,
    "donchian_breakout": donchian_breakout,
    "macd_cross": macd_cross,
    "absolute_momentum": absolute_momentum,
    "atr_breakout": atr_breakout,
    "zscore_meanrev": zscore_meanrev,
    "roc_momentum": roc_momentum,
    "vwap_reversion": vwap_reversion,
    "bollinger_rsi_double": bollinger_rsi_double,
}


def _pullback_fold(cols: dict, state: list[float], stop_atr: float, trail_atr: float):
    """State: side, entry price, most favourable price since entry."""
    side, entry, best = state
    out = []
    for c, h, l, a, slow, enter in zip(cols["close"], cols["high"], cols["low"], cols["_atr"], cols["_slow"], cols["_enter"]):
        if a == a:
            if side:
                best = max(best, h) if side > 0 else min(best, l)
                # Mirrored so that one rule serves both sides: exit when the price falls to a stop.
                stop = max(side * entry - stop_atr * a, side * best - trail_atr * a)
                if side * c <= stop or side * c < side * slow:
                    side, entry, best = 0.0, 0.0, 0.0
            if not side and enter:
                side, entry, best = enter, c, h if enter > 0 else l
        out.append(side)
    return out, [side, entry, best]


def trend_pullback(
    df: DataFrame, near: float = 0.005, adx_min: float = 25.0, stop_atr: float = 1.5, trail_atr: float = 2.0,
    fast: int = 50, slow: int = 200, pull: int = 20, n: int = 14, keys=SERIES, rows: int | None = None,
) -> DataFrame:
    """Trend with pullback entries. `near` is 0.005 on four-hour and 0.003 on hourly bars."""

    def build(d, c):
        gain, loss = ind.gain_loss(c)
        up_move, down_move = directional_moves(c)
        a = wilder_alpha(n)
        d = ewm(
            d, c,
            {
                **{f"_{k}": ("close", span_alpha(v), v) for k, v in (("fast", fast), ("slow", slow), ("pull", pull))},
                "_gain": (gain, a, n), "_loss": (loss, a, n), "_atr": (ind.true_range(c), a, n),
                "_up": (up_move, a, n), "_dn": (down_move, a, n),
            },
        )
        d = adx_from(d, c, "_atr", "_up", "_dn", n)
        d = d.withColumn("_rsi", ind.rsi_from(C("_gain"), C("_loss"), None))
        x, r, pr = C("close"), C("_rsi"), c.lag("_rsi")
        close_by = F.abs(x - C("_pull")) / F.nullif("_pull", F.lit(0.0)) <= near
        strong = C("adx") > adx_min
        long = (
            (C("_fast") > C("_slow")) & (x > C("_slow")) & (C("plus_di") > C("minus_di")) & strong & close_by
            & (x > C("_pull")) & (r > 50) & (pr <= 50)
        )
        short = (
            (C("_fast") < C("_slow")) & (x < C("_slow")) & (C("minus_di") > C("plus_di")) & strong & close_by
            & (x < C("_pull")) & (r < 50) & (pr >= 50)
        )
        return d.withColumn("_enter", F.when(long, 1.0).when(short, -1.0).otherwise(0.0))

    back = max(ewm_reach(span_alpha(slow), slow), reach((wilder_alpha(n), n), (wilder_alpha(n), n)))
    rich = on_chunks(df, build, keys, back=back)
    rich = rich.select(*df.columns, "_atr", "_slow", "_enter")
    done = keyed_fold(
        rich, lambda cols, s: _pullback_fold(cols, s, stop_atr, trail_atr),
        ["close", "high", "low", "_atr", "_slow", "_enter"], [0.0, 0.0, 0.0], keys, rows=rows,
    )
    return done.drop("_atr", "_slow", "_enter")


def _reversion_fold(cols: dict, state: list[float], z_in: float, z_stop: float, max_hold: int):
    """State: side, entry price, ATR at entry, bars held."""
    side, entry, risk, held = state
    out = []
    for c, dev, a in zip(cols["close"], cols["_dev"], cols["_atr"]):
        if side:
            held += 1
            adverse = side * (entry - c) / risk if risk > 0 else 0.0
            if adverse >= z_stop or held >= max_hold or side * dev >= 0:
                side, entry, risk, held = 0.0, 0.0, 0.0, 0.0
        elif abs(dev) > z_in:
            side, entry, risk, held = (-1.0 if dev > 0 else 1.0), c, a, 0.0
        out.append(side)
    return out, [side, entry, risk, held]


def vwap_refined(
    df: DataFrame, z_threshold: float = 1.5, z_stop: float = 3.0, vwap_window: int = 20, atr_window: int = 20,
    max_hold: int = 10, keys=SERIES, rows: int | None = None,
) -> DataFrame:
    """Fade moves away from a rolling VWAP, measured in ATR."""

    def build(d, c):
        d = add_atr(d.withColumn("_pv", ind.typical_price() * C("volume")), c, "_atr", atr_window)
        total = F.nullif(ind.rolling(c, "volume", vwap_window, F.sum), F.lit(0.0))
        vwap = ind.rolling(c, "_pv", vwap_window, F.sum) / total
        return d.withColumn("_dev", (C("close") - vwap) / F.nullif("_atr", F.lit(0.0)))

    rich = on_chunks(df, build, keys, back=max(vwap_window, reach((wilder_alpha(atr_window), atr_window))))
    rich = rich.select(*df.columns, "_atr", "_dev")
    done = keyed_fold(
        rich, lambda cols, s: _reversion_fold(cols, s, z_threshold, z_stop, max_hold),
        ["close", "_dev", "_atr"], [0.0, 0.0, 0.0, 0.0], keys, rows=rows,
    )
    return done.drop("_atr", "_dev")


REGISTRY["trend_pullback"] = trend_pullback
REGISTRY["vwap_refined"] = vwap_refined

# Grid of the golden-cross sweep.
FAST_PERIODS = [5, 10, 20, 30, 40, 50, 60, 75, 100]
SLOW_PERIODS = [50, 75, 100, 150, 200, 250, 300, 400, 500]
MODES = ["long_only", "long_short"]
FILTERS = ["none", "price_slow", "slow_slope", "fast_slope", "combined"]
BUFFERS = [0.0, 0.001, 0.0025, 0.005]


def variant_grid(fast=FAST_PERIODS, slow=SLOW_PERIODS, modes=MODES, filters=FILTERS, buffers=BUFFERS) -> list[dict]:
    return [
        {"fast": f, "slow": s, "mode": m, "filter": x, "buffer": b}
        for f in fast for s in slow if f < s for m in modes for x in filters for b in buffers
    ]


def variant_weight(x: Column, f: Column, s: Column, df_: Column, ds: Column, mode, filt, buf) -> Column:
    """Weight of one golden-cross variant from price, two averages and their slopes."""
    up, dn = f > s * (1 + buf), f < s * (1 - buf)
    named = [
        ("price_slow", x > s, x < s),
        ("slow_slope", ds > 0, ds < 0),
        ("fast_slope", df_ > 0, df_ < 0),
        ("combined", (x > s) & (ds > 0) & (df_ > 0), (x < s) & (ds < 0) & (df_ < 0)),
    ]
    go_long, go_short = F.lit(True), F.lit(True)
    for label, a, b in named:
        go_long = F.when(filt == label, a).otherwise(go_long)
        go_short = F.when(filt == label, b).otherwise(go_short)
    return F.when((mode == "long_short") & dn & go_short, -1.0).when(up & go_long, 1.0).otherwise(0.0)


def golden_cross_variants(df: DataFrame, grid: list[dict], keys=SERIES) -> DataFrame:
    """One row per bar and parameter set. Each average is computed once per bar, before the grid."""
    periods = sorted({g["fast"] for g in grid} | {g["slow"] for g in grid})
    place = {n: i for i, n in enumerate(periods)}

    def build(d, c):
        d = ind.add_moments(d, c, {f"_m{n}": ("close", n, "mean") for n in periods})
        return d.withColumns(
            {
                "_sma": F.array(*[C(f"_m{n}") for n in periods]),
                "_slope": F.array(*[C(f"_m{n}") - c.lag(f"_m{n}") for n in periods]),
            }
        )

    rich = on_chunks(df, build, keys, back=max(periods) + 1).select(*df.columns, "_sma", "_slope")
    sets = [{**g, "_fi": place[g["fast"]], "_si": place[g["slow"]]} for g in grid]
    wide = with_grid(rich, sets)
    at = lambda arr, i: F.get(C(arr), C(i))
    weight = variant_weight(
        C("close"), at("_sma", "_fi"), at("_sma", "_si"), at("_slope", "_fi"), at("_slope", "_si"), C("mode"), C("filter"), C("buffer")
    )
    return wide.withColumn("weight", F.when(C("ord") < C("slow"), 0.0).otherwise(weight)).drop("_sma", "_slope", "_fi", "_si")


def xs_momentum(
    aligned: DataFrame, lookback: int = 252, skip: int = 21, top_k: int = 3, bottom_k: int = 3,
    long_short: bool = True, gross: float = 1.0, reset_unselected: bool = False,
) -> DataFrame:
    """Monthly long-short weights by past return across symbols, on aligned bars.

    Only rebalance times are ranked. By default a symbol that is not selected keeps its
    old weight, so the gross weight can exceed `gross`; `reset_unselected` sets it to 0.
    """

    def build(d, c):
        return d.withColumn("mom", c.lag("close", skip) / c.lag("close", lookback + skip) - 1)

    d = on_chunks(aligned, build, back=lookback + skip)
    dates = rebalance_dates(aligned)
    ranked = d.join(dates, "ts").filter(C("mom").isNotNull())
    by_ts = W.partitionBy("ts")
    ranked = ranked.withColumns(
        {
            "_n": F.count(F.lit(1)).over(by_ts),
            "_top": F.row_number().over(by_ts.orderBy(F.desc("mom"), "symbol")),
        }
    )
    ranked = ranked.filter(C("_n") >= top_k + (bottom_k if long_short else 0))
    leg = gross / 2 if long_short else gross
    state = F.when(C("_top") <= top_k, leg / top_k)
    if long_short:
        state = state.when(C("_top") > C("_n") - bottom_k, -leg / bottom_k)
    if reset_unselected:
        state = state.otherwise(0.0)
    picks = ranked.select("symbol", "ts", state.alias("state")).filter(C("state").isNotNull())
    return hold(d.join(picks, ["symbol", "ts"], "left"))
