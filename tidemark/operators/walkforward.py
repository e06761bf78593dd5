"""Walk-forward windows and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ingest import sort_dedupe
from tidemark.operators.metrics import nz, span_days
from tidemark.operators.pnl import next_open_returns, same_exposure_benchmark
from tidemark.operators.resample import inferred_ppy
from tidemark.plans.series import SERIES, equity_scan, time_bucket, with_ordinal

C = F.col
SEGMENTS = ("IS", "OOS", "BM")


SHORT = "shorter than one window"


def window_counts(df: DataFrame, train: int, test: int, step: int | None = None, keys=SERIES) -> DataFrame:
    """n_bars and n_windows of every series, and `reason` where it has no window."""
    n = C("n_bars")
    windows = F.when(n >= train + test, F.floor((n - train - test) / (step or test)) + 1).otherwise(0).cast("bigint")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"))
    return sizes.withColumns({"n_windows": windows, "reason": F.when(n < train + test, SHORT)})


def window_rows(df: DataFrame, train: int, test: int, step: int | None = None, burn_in: int = 0, keys=SERIES, strict: bool = False) -> DataFrame:
    """Each bar once per (window, segment) that holds it, with its place `ord` in the segment.

    Window w (from 1) trains on [s, s+train) and tests on the next `test` bars, with
    s = (w-1) * step. A position belongs to a short run of windows, found by arithmetic.
    Segment OOS starts `burn_in` bars early; BM is the plain test slice. A series shorter
    than train + test has no windows (`window_counts` says so); with `strict` it fails the job.
    """
    keys = list(keys)
    step = step or test
    last = C("n_windows") - 1
    if strict:
        last = F.when(last < 0, F.raise_error(F.lit("train + test exceeds the data length")).cast("bigint")).otherwise(last)
    n = window_counts(df, train, test, step, keys).select(*keys, last.alias("_last"))
    n = n if strict else n.filter("_last >= 0")
    d = df.withColumnRenamed("ord", "bar").join(n, keys)

    def held_by(seg: str, lo: int, hi: int) -> Column:
        """Windows k with lo <= bar - k * step < hi."""
        first = F.greatest(F.lit(0), F.floor((C("bar") - hi) / step) + 1)
        last = F.least(C("_last"), F.floor((C("bar") - lo) / step))
        ks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        place = lambda k: F.struct(k.alias("k"), F.lit(seg).alias("segment"), (C("bar") - k * step - lo).alias("ord"))
        return F.transform(ks, place)

    held = F.concat(
        held_by("IS", 0, train),
        held_by("OOS", max(0, train - burn_in), train + test),
        held_by("BM", train, train + test),
    )
    d = d.withColumn("_w", F.explode(held)).drop("_last")
    return d.select(
        *[c for c in d.columns if c != "_w"],
        (C("_w.k") + 1).alias("window"),
        C("_w.segment").alias("segment"),
        C("_w.ord").alias("ord"),
    )


def segment_curves(rows: DataFrame, train: int, burn_in: int = 0, commission_bps: float = 1.0, slippage_bps: float = 5.0, keys=SERIES) -> DataFrame:
    """Returns and equity per (window, segment); the first bar of a reported slice has no return."""
    wk = [*keys, "window", "segment"]
    live = next_open_returns(rows.filter("segment <> 'BM'"), commission_bps, slippage_bps, keys=wk)
    lead = min(burn_in, train)
    oos_start = F.when(C("segment") == "OOS", F.lit(lead)).otherwise(F.lit(0))
    live = live.filter(C("ord") >= oos_start).withColumn("ord", C("ord") - oos_start)
    bm = same_exposure_benchmark(rows.filter("segment = 'BM'"), commission_bps, slippage_bps, keys=wk)
    active = rows.filter("segment = 'BM'").groupBy(*wk).agg(F.avg(F.abs("weight")).alias("_a")).filter("_a > 1e-9")
    bm = bm.join(active.drop("_a"), wk, "left_semi")
    cols = [*wk, "bar", "ts", "ord"]
    both = live.select(*cols, "r").unionByName(bm.select(*cols, "r"))
    both = both.withColumn("r", F.when(C("ord") > 0, C("r")))
    return equity_scan(both, "r", wk, start=100_000.0)


def _curve_metrics(curves: DataFrame, by, keys, ppy: DataFrame) -> DataFrame:
    g = curves.groupBy(*by).agg(
        F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.min("drawdown").alias("maxdd"),
        F.max_by("equity", "ord").alias("_e"), F.min_by("equity", "ord").alias("_e0"), span_days().alias("_d"),
        F.count("r").alias("_n"), F.min("ts").alias("start"), F.max("ts").alias("end"),
    ).join(ppy, list(keys))
    years = F.when(C("_d") > 0, C("_d") / 365.25).otherwise(C("_n") / C("ppy"))
    return g.select(
        *by, "start", "end", (C("_n") + 1).alias("bars"), "maxdd",
        (C("_m") / nz("_s") * F.sqrt("ppy")).alias("sharpe"),
        (F.pow(C("_e") / C("_e0"), 1 / years) - 1).alias("cagr"),
    )


def windows_table(curves: DataFrame, df: DataFrame, keys=SERIES) -> DataFrame:
    """One row per window with in-sample, out-of-sample, benchmark and excess metrics."""
    keys = list(keys)
    m = _curve_metrics(curves, [*keys, "window", "segment"], keys, inferred_ppy(df, keys))
    wide = m.groupBy(*keys, "window")
    at = lambda seg, col: F.max(F.when(C("segment") == seg, C(col)))
    t = wide.agg(
        at("IS", "start").alias("is_start"), at("IS", "end").alias("is_end"),
        at("OOS", "start").alias("oos_start"), at("OOS", "end").alias("oos_end"),
        at("IS", "bars").alias("is_bars"), at("OOS", "bars").alias("oos_bars"),
        *[at(seg, c).alias(f"{seg.lower()}_{c}") for seg in SEGMENTS for c in ("sharpe", "cagr", "maxdd")],
    )
    return t.withColumns(
        {"oos_excess_sharpe": C("oos_sharpe") - C("bm_sharpe"), "oos_excess_cagr": C("oos_cagr") - C("bm_cagr")}
    ).withColumnsRenamed({"bm_sharpe": "oos_benchmark_sharpe", "bm_cagr": "oos_benchmark_cagr", "bm_maxdd": "oos_benchmark_maxdd"})


def oos_trade_counts(rows: DataFrame, keys=SERIES) -> DataFrame:
    """Changes of weight inside each test slice, the trade count behind the confidence flag."""
    from tidemark.operators.pnl import transitions

    wk = [*keys, "window"]
    return transitions(rows.filter("segment = 'BM'"), wk).select(*wk, (C("transitions") - 1).alias("oos_n_trades"))


def aggregate_windows(windows: DataFrame, keys=SERIES) -> DataFrame:
    """Summary over windows; windows per series are few, and nulls are skipped."""
    s, x = C("oos_sharpe"), C("oos_excess_sharpe")
    one = lambda n, sd: F.when(n > 1, sd).otherwise(0.0)
    g = windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count(s).alias("n_oos_clean"),
        F.avg("is_sharpe").alias("mean_is_sharpe"),
        F.avg(s).alias("mean_oos_sharpe"),
        F.median(s).alias("median_oos_sharpe"),
        one(F.count(s), F.stddev_samp(s)).alias("std_oos_sharpe"),
        F.min(s).alias("min_oos_sharpe"),
        F.max(s).alias("max_oos_sharpe"),
        (F.count_if(s > 0) / F.nullif(F.count(s), F.lit(0))).alias("pct_positive_oos"),
        F.avg(x).alias("mean_excess_sharpe"),
        F.median(x).alias("median_excess_sharpe"),
        (F.count_if(x > 0) / F.nullif(F.count(x), F.lit(0))).alias("pct_positive_excess"),
    )
    ratio = F.when(F.abs("mean_is_sharpe") > 1e-9, C("mean_oos_sharpe") / C("mean_is_sharpe"))
    g = g.withColumn("degradation_ratio", ratio)
    robust = (C("degradation_ratio") >= 0.5) & (C("mean_oos_sharpe") > 0) & (C("pct_positive_oos") >= 0.5)
    return g.withColumn("robust", F.coalesce(robust, F.lit(False)))


def chain(curves: DataFrame, df: DataFrame, step: int, segment: str, keys=SERIES) -> DataFrame:
    """Metrics of the first `step` returns of each window, joined end to end; overlaps keep the earlier window."""
    keys = list(keys)
    part = curves.filter((C("segment") == segment) & (C("ord") > 0) & (C("ord") <= step))
    rows = sort_dedupe(part.select(*keys, "ts", "window", C("r").alias("x")), (*keys, "ts"), "window")
    rows = with_ordinal(rows, keys, ["ts"], time_bucket())
    curve = equity_scan(rows, "x", keys, start=100_000.0).withColumn("r", F.when(C("ord") > 0, C("x")))
    m = _curve_metrics(curve, keys, keys, inferred_ppy(df, keys))
    return m.filter("bars >= 3").select(*keys, "bars", "sharpe", "cagr", "maxdd")


def with_short_series(summary: DataFrame, counts: DataFrame, keys=SERIES) -> DataFrame:
    """One row for every series of `window_counts`: those without a window have no metrics, false flags and a `reason`."""
    summary = counts.select(*keys, "n_bars", "reason").join(summary, list(keys), "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_windows", "n_oos_clean")}
    return summary.withColumns(zero | {c: F.coalesce(c, F.lit(False)) for c in ("robust", "has_edge") if c in summary.columns})


def walk_forward_summary(curves: DataFrame, df: DataFrame, step: int, keys=SERIES) -> DataFrame:
    """Window aggregate plus chained out-of-sample metrics, excess and verdict flags, for series with a window."""
    keys = list(keys)
    agg = aggregate_windows(windows_table(curves, df, keys), keys)
    oos = chain(curves, df, step, "OOS", keys)
    bm = chain(curves, df, step, "BM", keys).select(*keys, C("sharpe").alias("_bs"), C("cagr").alias("_bc"))
    j = agg.join(oos.withColumnsRenamed({c: f"chained_{c}" for c in ("bars", "sharpe", "cagr", "maxdd")}), keys, "left")
    j = j.join(bm, keys, "left").withColumns(
        {
            "chained_benchmark_sharpe": C("_bs"),
            "chained_excess_sharpe": C("chained_sharpe") - C("_bs"),
            "chained_excess_cagr": C("chained_cagr") - C("_bc"),
        }
    )
    return j.withColumn("has_edge", F.coalesce(C("chained_excess_sharpe") > 0.20, F.lit(False))).drop("_bs", "_bc")


def walk_forward(
    df: DataFrame, train: int = 756, test: int = 252, step: int | None = None, burn_in: int = 0,
    commission_bps: float = 1.0, slippage_bps: float = 5.0, keys=SERIES, strict: bool = False,
) -> DataFrame:
    """Curves of all windows of bars with `weight`, ready for the tables above."""
    rows = window_rows(df, train, test, step, burn_in, keys, strict)
    return segment_curves(rows, train, burn_in, commission_bps, slippage_bps, keys)


def sweep_walk_forward(
    df: DataFrame, lengths: dict[str, tuple[int, int, int]], variants: list[dict], timeframe: str = "timeframe",
    commission_bps: float = 1.0, slippage_bps: float = 5.0, keys=("timeframe", "symbol"), least_trades: int = 5, rows: int | None = None,
) -> DataFrame:
    """Walk-forward of many variants of many series, with window lengths by timeframe.

    `df` has ts, ord, open, close and `weights`, one per variant. Windows are as in `walk_forward` with a
    burn-in: test slices start with the position held before them, training slices start flat. No
    curve is copied: a slice is put together from the nodes of `segment_tree` that cover it, for all
    variants at once; only its first two bars are worked out by themselves. The chained result is the joined
    segments of the first `step` bars of each test slice.

    One row per series and variant: the columns of `variants`, n_bars, n_windows, the window summary of
    `aggregate_windows`, n_low_confidence, chained_sharpe, chained_cagr, chained_maxdd,
    chained_benchmark_sharpe, chained_excess_sharpe, has_edge, and `reason` where a series is too short
    or its timeframe has no lengths.
    """
    import numpy as np
    import pandas as pd

    from tidemark.plans.segment_tree import Piece, cover, joined, segment_tree, top_level
    from tidemark.plans.series import merge_segments
    from tidemark.session import stage

    keys, spark, n_variants = list(keys), df.sparkSession, len(variants)
    top, rate = top_level(rows), (commission_bps + slippage_bps) / 1e4
    tree = stage(segment_tree(df, commission_bps, slippage_bps, keys, rows), "segment-tree")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"))
    table = spark.createDataFrame([(k, *v) for k, v in lengths.items()], f"{timeframe} string, _train int, _test int, _step int")
    sizes = stage(sizes.join(table, timeframe, "left"), "sizes")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.schema if f.name in keys)

    def pieces(batches):
        """The bars and nodes that each window needs, by tag: first bars, training slice, chained and other part of the test slice."""
        for pdf in batches:
            for row in pdf.to_dict("records"):
                train, test, step = (int(row[c]) for c in ("_train", "_test", "_step"))
                chained = min(step, test - 1)
                for k in range((int(row["n_bars"]) - train - test) // step + 1):
                    a = k * step
                    p, e = a + train, a + train + test
                    parts = [("a", a, a + 1), ("a1", a + 1, a + 2), ("train", a + 2, p), ("p", p, p + 1), ("p1", p + 1, p + 2)]
                    parts += [("chain", p + 2, p + chained + 1), ("rest", p + chained + 1, e), ("last", e - 1, e), ("end", p + chained, p + chained + 1)]
                    found = [(tag, i, *x) for tag, lo, hi in parts for i, x in enumerate(cover(lo, hi, top))]
                    out = pd.DataFrame(found, columns=["tag", "at", "level", "node"])
                    for c in keys:
                        out[c] = row[c]
                    out["window"] = k + 1
                    yield out[[*keys, "window", "tag", "at", "level", "node"]]

    some = sizes.filter(C("n_bars") >= C("_train") + C("_test"))
    needed = some.mapInPandas(pieces, f"{types}, window bigint, tag string, at int, level int, node bigint")
    held = needed.join(tree, [*keys, "level", "node"])

    def ratio(s, q, n):
        """Mean over sample deviation; null without one."""
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s / n
            var = np.maximum(0.0, q - n * mean * mean) / (n - 1) if n > 1 else np.full_like(mean, np.nan)
            return np.where(var > 0, mean / np.sqrt(var), np.nan)

    def window(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        by: dict[str, list] = {t: [] for t in ("a", "a1", "train", "p", "p1", "chain", "rest", "last", "end")}
        for tag, level, body, asset in zip(pdf["tag"], pdf["level"], pdf["body"], pdf["asset"]):
            by[tag].append(Piece(level, body, asset))
        a, a1, p, p1, last, end = (by[t][0] for t in ("a", "a1", "p", "p1", "last", "end"))
        start = a.w * a1.day - np.abs(a.w) * rate  # from flat into the first weight
        train, _, n = joined(by["train"], n_variants)
        test, sums, m = joined([p1, *by["chain"], *by["rest"]], n_variants)
        chain, chain_sums, length = joined(by["chain"] if int(pdf["window"].iloc[0]) == 1 else [p1, *by["chain"]], n_variants)
        weight = np.clip((test["weight"] + p.w) / (m + 1), -1, 1)
        cost = test["moved"] / m * rate
        active = (test["gross"] + np.abs(p.w)) / (m + 1) > 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt(max(0.0, sums[1] - sums[0] ** 2 / m) / (m - 1)) * np.abs(weight)
            bench = np.where(active & (spread > 0), (weight * sums[0] / m - cost) / spread, np.nan)
        first = weight * p1.asset - cost
        own, square, bars = chain_sums[0], chain_sums[1], length
        if int(pdf["window"].iloc[0]) == 1:
            own, square, bars = own + p1.asset, square + p1.asset**2, bars + 1
        out = pd.DataFrame(
            {
                "variant": np.arange(n_variants), "is_ratio": ratio(train["s"] + start, train["q"] + start**2, n + 1), "oos_ratio": ratio(test["s"], test["q"], m),
                "bm_ratio": bench, "trades": (p.w != 0) + test["changes"] - last.seg["changes"], "from": p1.time, "to": end.time, "n": length,
                **{c: chain[c] for c in ("s", "q", "growth", "low", "high", "dd")},
                "bm_n": np.where(active, bars, 0), "bm_s": np.where(active, weight * own - cost * bars, 0.0),
                "bm_q": np.where(active, weight**2 * square - 2 * weight * cost * own + cost**2 * bars, 0.0), "bm_first": np.where(active, first, np.nan),
            }
        )
        for c in [*keys, "window"]:
            out[c] = pdf[c].iloc[0]
        return out[cols]

    doubles = ["is_ratio", "oos_ratio", "bm_ratio", "trades", "from", "to", "s", "q", "growth", "low", "high", "dd", "bm_s", "bm_q", "bm_first"]
    cols = [*keys, "window", "variant", "n", "bm_n", *doubles]
    found = held.groupBy(*keys, "window").applyInPandas(window, f"{types}, window bigint, variant bigint, n bigint, bm_n bigint, {', '.join(f'`{c}` double' for c in doubles)}")
    found = stage(found, "window-sweep")
    by = [*keys, "variant"]
    known = lambda c: F.when(~F.isnan(c), C(c))
    ppy = inferred_ppy(df, keys)
    per = found.join(ppy, keys).select(
        *by, (known("is_ratio") * F.sqrt("ppy")).alias("is_sharpe"), (known("oos_ratio") * F.sqrt("ppy")).alias("oos_sharpe"),
        ((known("oos_ratio") - known("bm_ratio")) * F.sqrt("ppy")).alias("oos_excess_sharpe"), "trades",
    )
    agg = aggregate_windows(per, by).join(per.groupBy(*by).agg(F.count_if(C("trades") < least_trades).alias("n_low_confidence")), by)
    path = merge_segments(found, by, "window")
    more = found.groupBy(*by).agg(
        F.min("from").alias("_from"), F.max("to").alias("_to"), F.sum("bm_n").alias("_bn"), F.sum("bm_s").alias("_bs"), F.sum("bm_q").alias("_bq"),
        F.min_by("bm_first", F.when(C("bm_n") > 0, C("window"))).alias("_bf"),
    )

    def sharpe(n, s, q):
        mean = s / nz(n)
        return mean / nz(F.sqrt(F.greatest(F.lit(0.0), q - n * mean * mean) / nz(n - 1))) * F.sqrt("ppy")

    days = F.floor((C("_to") - C("_from")) / 86_400_000_000)
    years = F.when(days > 0, days / 365.25).otherwise(C("n") / C("ppy"))
    enough = C("n") >= 2
    bench = sharpe(C("_bn") - 1, C("_bs") - C("_bf"), C("_bq") - C("_bf") * C("_bf"))
    chained = path.join(more, by).join(ppy, keys).select(
        *by, F.when(enough, sharpe(C("n"), C("s"), C("q"))).alias("chained_sharpe"), F.when(enough, F.pow("growth", 1 / years) - 1).alias("chained_cagr"),
        F.when(enough, F.least(F.lit(0.0), C("dd"), C("low") - 1)).alias("chained_maxdd"), F.when(C("_bn") >= 3, bench).alias("chained_benchmark_sharpe"),
    )
    names = spark.createDataFrame([(i, *v.values()) for i, v in enumerate(variants)], ", ".join(["variant long", *[f"`{k}` {'string' if isinstance(x, str) else 'double'}" for k, x in _kinds(variants).items()]]))
    every = sizes.withColumn("variant", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_variants - 1).cast("long"))))
    excess = C("chained_sharpe") - C("chained_benchmark_sharpe")
    reason = F.when(C("_train").isNull(), "no window lengths for its timeframe").when(C("n_bars") < C("_train") + C("_test"), SHORT)
    return (
        every.join(agg, by, "left").join(chained, by, "left").join(names, "variant")
        .withColumns({"reason": reason, "chained_excess_sharpe": excess, "has_edge": F.coalesce(excess > 0.20, F.lit(False))})
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_windows", "n_low_confidence")})
        .withColumn("robust", F.coalesce("robust", F.lit(False)))
        .drop("_train", "_test", "_step")
    )


def _kinds(rows: list[dict]) -> dict:
    """A value of each column of `rows` that is not null."""
    return {k: next((r[k] for r in rows if r[k] is not None), 0.0) for k in rows[0]}
