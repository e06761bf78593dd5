"""Bootstraps, shuffles and the reality check.

A resample is a key, so all resamples of all series run as one job. Summaries of paths come
from `blocks.block_paths`; where draws themselves are wanted, rows are (series, sim, i) and gather
their value by an equi-join on the drawn index, whatever the length of a series.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.rng import uniform, uniform_rows
from tidemark.operators.blocks import TILE, block_paths, packed_paths, packed_series
from tidemark.operators.metrics import nz, span_days
from tidemark.operators.quality import micros
from tidemark.plans.series import SERIES, equity_scan, on_chunks, scan, split_series, with_ordinal
from tidemark.session import stage

C = F.col
SPAN = 4096


def numbered(sizes: DataFrame, n: str = "n", name: str = "i") -> DataFrame:
    """Rows 0..n-1 per input row, unfolded in three steps so that no long array is built."""
    d = sizes.filter(C(n) > 0)
    upper = C(n) - 1
    outer = None
    for i, width in enumerate((SPAN * SPAN, SPAN, 1)):
        lo = F.lit(0).cast("long") if outer is None else outer * SPAN
        hi = F.floor(upper / width)
        hi = hi if outer is None else F.least(lo + SPAN - 1, hi)
        d = d.withColumn(f"_u{i}", F.explode(F.sequence(lo, hi)))
        outer = C(f"_u{i}")
    return d.withColumnRenamed("_u2", name).drop("_u0", "_u1")


def with_sims(df: DataFrame, n_sims: int) -> DataFrame:
    return df.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))


def sample_sizes(returns: DataFrame, keys=SERIES) -> DataFrame:
    return returns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def iid_draws(sizes: DataFrame, n_sims: int, seed: int = 42, stream: str = "iid") -> DataFrame:
    d = numbered(with_sims(sizes, n_sims))
    return d.withColumn("idx", F.floor(uniform(seed, stream, "sim", "i") * C("n")).cast("long"))


def block_starts(sizes: DataFrame, n_sims: int, block: int, seed: int = 42, stream: str = "block") -> DataFrame:
    """One row per (sim, block number k): `start` in [0, n - block) and `take`, cut at n draws in all."""
    d = with_sims(sizes.filter(C("n") > block), n_sims).withColumn("_k", F.ceil(C("n") / block))
    d = numbered(d, "_k", "k").drop("_k")
    start = F.floor(uniform(seed, stream, "sim", "k") * (C("n") - block)).cast("long")
    return d.withColumns({"start": start, "take": F.least(F.lit(block), C("n") - C("k") * block).cast("int")})


def block_draws(sizes: DataFrame, n_sims: int, block: int, seed: int = 42, stream: str = "block") -> DataFrame:
    """The blocks of `block_starts` unfolded to draws i with index idx."""
    d = block_starts(sizes, n_sims, block, seed, stream)
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0), C("take") - 1)))
    return d.withColumns({"i": C("k") * block + C("_j"), "idx": C("start") + C("_j")}).drop("_j", "k", "start", "take")


def stationary_draws(sizes: DataFrame, n_sims: int, mean_block: float | None = None, seed: int = 42, keys=()) -> DataFrame:
    """Blocks of geometric length with uniform starts, wrapping at n.

    A draw starts a new block with probability 1 / mean_block; the running last start says
    where its block began.
    """
    p = 1.0 / F.lit(float(mean_block)) if mean_block else 1.0 / F.greatest(F.lit(5.0), F.sqrt("n"))
    d = numbered(with_sims(sizes, n_sims)).withColumnRenamed("i", "ord")
    fresh = (C("ord") == 0) | (uniform(seed, "new", "sim", "ord") < p)
    if mean_block is None:
        # About sqrt(n) starts per sim: keep only those and unfold each up to the next one.
        d = d.filter(fresh).withColumn("_s", F.floor(uniform(seed, "start", "sim", "ord") * C("n")).cast("long"))
        until = F.lead("ord").over(W.partitionBy(*keys, "sim").orderBy("ord"))
        d = d.withColumn("_len", F.coalesce(until, C("n")) - C("ord"))
        d = d.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), C("_len") - 1)))
        return d.withColumns({"i": C("ord") + C("_j"), "idx": F.pmod(C("_s") + C("_j"), C("n"))}).drop("ord", "_s", "_len", "_j")
    start = F.floor(uniform(seed, "start", "sim", "ord") * C("n")).cast("long")
    d = scan(d, {"_s": ("last", F.when(fresh, start)), "_t": ("last", F.when(fresh, C("ord")))}, [*keys, "sim"])
    return d.withColumn("idx", F.pmod(C("_s") + C("ord") - C("_t"), C("n"))).withColumnRenamed("ord", "i").drop("_s", "_t")


def gather(draws: DataFrame, returns: DataFrame, keys=SERIES) -> DataFrame:
    """Value `x` at each drawn index."""
    return draws.join(returns.select(*keys, "idx", "x"), [*keys, "idx"])


def indexed_returns(equity: DataFrame, keys=SERIES) -> DataFrame:
    """Returns of an equity table as (keys, idx, x), without the first bar."""
    return equity.filter(C("ord") > 0).select(*keys, (C("ord") - 1).alias("idx"), C("r").alias("x"))


def inferred_ppy(equity: DataFrame, keys=SERIES) -> DataFrame:
    g = equity.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), span_days().alias("_d"))
    return g.select(*keys, F.when((C("_d") > 0) & (C("_n") >= 3), C("_n") / (C("_d") / 365.25)).otherwise(252.0).alias("ppy"))


def _observed(equity: DataFrame, keys) -> DataFrame:
    """Sharpe, CAGR and largest drawdown of the curve itself."""
    g = equity.groupBy(*keys).agg(
        F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.min("drawdown").alias("real_maxdd"),
        F.max_by("equity", "ord").alias("_e"), F.min_by("equity", "ord").alias("_e0"), span_days().alias("_d"),
    ).join(inferred_ppy(equity, keys), list(keys))
    return g.select(
        *keys, "ppy", "real_maxdd",
        (C("_m") / nz("_s") * F.sqrt("ppy")).alias("real_sharpe"),
        (F.pow(C("_e") / C("_e0"), 365.25 / C("_d")) - 1).alias("real_cagr"),
    )


def path_sharpe(n: Column, s: Column, q: Column) -> Column:
    """Mean over deviation of a path's returns; what sums of squares cannot tell from equal returns has no spread."""
    mean = s / F.nullif(n, F.lit(0))
    around = q - n * mean * mean
    sd = F.sqrt(F.when(around > 1e-12 * q, around).otherwise(0.0) / F.nullif(n - 1, F.lit(0)))
    return mean / F.nullif(sd, F.lit(0.0))


def over_paths(f, *fields: str) -> Column:
    """Array of `f` of the fields of each path."""
    return F.transform(F.arrays_zip(*fields), lambda v: f(*[v[c] for c in fields]))


def array_mean(a: Column) -> Column:
    """Mean of the values that are not null."""
    a = F.array_compact(a)
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.nullif(F.size(a), F.lit(0))


def array_std(a: str, mean: str) -> Column:
    """Population deviation around a mean worked out before."""
    return F.sqrt(array_mean(F.transform(a, lambda v: (v - C(mean)) * (v - C(mean)))))


def array_share(a, test) -> Column:
    return array_mean(F.transform(a, lambda v: test(v).cast("double")))


def array_percentile(a: str, p: float) -> Column:
    """Interpolated percentile of an ascending array without nulls."""
    at = F.lit(p) * (F.size(a) - 1)
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    low, high = F.get(a, lo), F.get(a, hi)
    return F.when(lo == hi, low).otherwise((hi - at) * low + (at - lo) * high)


def _ascending(a: Column) -> Column:
    return F.sort_array(F.array_compact(a))


def _summary(paths: DataFrame, equity: DataFrame, observed: DataFrame, keys) -> DataFrame:
    """Reduce the simulations inside the row of their series."""
    ppy = inferred_ppy(equity, keys).withColumnRenamed("ppy", "_ppy")
    d = paths.join(observed.drop("ppy"), keys).join(ppy, keys)
    n, ppy = C("n"), C("_ppy")
    d = d.select(
        *keys, "real_sharpe", "real_cagr", "real_maxdd", "dd",
        _ascending(over_paths(lambda s, q: path_sharpe(n, s, q) * F.sqrt(ppy), "s", "q")).alias("_s"),
        over_paths(lambda g, _: F.pow(g, ppy / n) - 1, "growth", "dd").alias("_c"),
    ).withColumn("sharpe_mean", array_mean(C("_s")))
    return d.select(
        *keys, "real_sharpe", "real_cagr", "real_maxdd", "sharpe_mean",
        array_std("_s", "sharpe_mean").alias("sharpe_std"),
        *[array_percentile("_s", p / 100).alias(f"sharpe_p{p:02d}") for p in (5, 50, 95)],
        array_share("_s", lambda v: v >= C("real_sharpe")).alias("p_value_sharpe"),
        array_share("_c", lambda v: v >= C("real_cagr")).alias("p_value_cagr"),
        array_share("dd", lambda v: v <= -0.5).alias("prob_ruin"),
    )


def bootstrap_iid(equity: DataFrame, n_sims: int = 5000, seed: int = 42, keys=SERIES) -> DataFrame:
    """Single returns drawn with replacement, as blocks of one. As in the curve metrics, the first draw only
    sets the starting level. A series of fewer than three returns has no simulations, and a reason."""
    keys = list(keys)
    x = indexed_returns(equity, keys)
    sizes = too_short(sample_sizes(x, keys), 3)
    paths = packed_paths(x, sizes.filter(C("reason").isNull()), n_sims, 1, seed, "iid", keys, skip_first=True, wholly=True)
    observed = stage(_observed(equity, keys), "observed")
    found = _summary(paths, equity, observed, keys)
    return _with_all(observed.select(*keys, "real_sharpe", "real_cagr", "real_maxdd"), found, sizes, keys)


def too_short(sizes: DataFrame, least: int) -> DataFrame:
    """`sizes` with `reason`, null for series of `least` values or more."""
    return sizes.withColumn("reason", F.when(C("n") < least, F.lit(f"fewer than {least} returns")))


def _moments(paths: DataFrame) -> DataFrame:
    """Paths with mean and sd of their returns; what sums of squares cannot tell from equal returns has no spread."""
    mean = C("s") / nz("n")
    around = C("q") - C("n") * mean * mean
    sd = F.sqrt(F.when(around > 1e-12 * C("q"), around).otherwise(0.0) / nz(C("n") - 1))
    return paths.withColumns({"mean": mean, "sd": sd})


def bootstrap_block(equity: DataFrame, n_sims: int = 5000, block: int = 20, seed: int = 42, keys=SERIES) -> DataFrame:
    """Blocks of neighbouring returns, looked up by start. A series of `block` returns or fewer has no simulations, and a reason."""
    keys = list(keys)
    x = indexed_returns(equity, keys)
    sizes = sample_sizes(x, keys)
    paths = packed_paths(x, sizes, n_sims, block, seed, "block", keys, skip_first=True)
    observed = stage(_observed(equity, keys), "observed")
    found = _summary(paths, equity, observed, keys)
    return _with_all(observed.select(*keys, "real_sharpe", "real_cagr", "real_maxdd"), found, too_short(sizes, block + 1), keys)


def _with_all(every: DataFrame, found: DataFrame, sizes: DataFrame, keys) -> DataFrame:
    """`found` completed by the series of `every` that it lacks, with their `reason`."""
    both = [c for c in every.columns if c in found.columns and c not in keys]
    return every.join(found.drop(*both), list(keys), "left").join(sizes.select(*keys, "reason"), list(keys), "left")


def exact_moments(x: Column, square: Column, n: Column) -> tuple[Column, Column]:
    """Mean and sample deviation from sums of values and of squares, as aggregates."""
    total = lambda c: F.sum(c.cast("decimal(28,18)")).cast("double")
    mean = total(x) / n
    return mean, F.sqrt(F.greatest(total(square) - n * mean * mean, F.lit(0.0)) / nz(n - 1))


def bootstrap_null(equity: DataFrame, n_sims: int = 5000, block: int = 20, seed: int = 42, keys=SERIES) -> DataFrame:
    """Blocks of de-meaned returns: how often a world without drift reaches the Sharpe ratio.

    The mean is added up in decimals, which no order of arrival can change, and blocks of a path in their
    order. A series of `block` returns or fewer has its own ratio, no simulations and a reason.
    """
    keys = list(keys)
    x = indexed_returns(equity, keys)
    m, s = exact_moments(C("x"), C("x") * C("x"), F.count("x"))
    mean = stage(x.groupBy(*keys).agg(m.alias("_mean"), (m / nz(s)).alias("_obs"), F.count(F.lit(1)).alias("n")), "means")
    flat = x.join(mean.select(*keys, "_mean"), keys).withColumn("x", C("x") - C("_mean")).drop("_mean")
    paths = packed_paths(flat, mean, n_sims, block, seed, "null", keys)
    own = mean.join(inferred_ppy(equity, keys), keys).withColumn("o", F.coalesce("_obs", F.lit(0.0)) * F.sqrt("ppy")).select(*keys, "n", "ppy", "o")
    sims = paths.join(own.drop("n"), keys)
    found = sims.select(*keys, "o", F.sort_array(over_paths(lambda s, q: F.coalesce(path_sharpe(C("n"), s, q), F.lit(0.0)) * F.sqrt("ppy"), "s", "q")).alias("_s"))
    found = found.withColumn("null_sharpe_mean", array_mean(C("_s"))).select(
        *keys, "null_sharpe_mean",
        array_std("_s", "null_sharpe_mean").alias("null_sharpe_std"),
        array_percentile("_s", 0.05).alias("null_sharpe_p05"),
        array_percentile("_s", 0.95).alias("null_sharpe_p95"),
        array_share("_s", lambda v: v >= C("o")).alias("p_value_one_sided"),
        array_share("_s", lambda v: F.abs(v) >= F.abs("o")).alias("p_value_two_sided"),
    )
    return _with_all(own.select(*keys, C("o").alias("observed_sharpe")), found, too_short(mean, block + 1), keys)


def trade_years(trades: DataFrame, keys=SERIES) -> DataFrame:
    """Whole days from first entry to last exit in years, else five business days per trade."""
    g = trades.groupBy(*keys).agg(
        F.floor((F.max(micros("exit_ts")) - F.min(micros("entry_ts"))) / 86_400_000_000).alias("_d"),
        F.count(F.lit(1)).alias("_n"),
    )
    return g.select(*keys, F.when(C("_d") > 0, C("_d") / 365.25).otherwise(C("_n") * 5 / 252.0).alias("years"))


def bootstrap_trades(
    trades: DataFrame, n_sims: int = 5000, block: int | None = None, seed: int = 42, keys=SERIES, at_least: int = 5
) -> DataFrame:
    """Resampled trade returns, single or in blocks; `trades` carries a dense `ord`.

    The per-trade return of the resampled curve is measured against the value after the trade,
    x / (1 + x), which does not depend on order; the same draws give its sums and the growth. A series of
    fewer than `at_least` trades, or of a block at most, has its own figures, no simulations and a reason.
    """
    keys = list(keys)
    x = trades.select(*keys, C("ord").alias("idx"), (C("pnl") / (C("qty") * C("entry_price"))).alias("x"))
    least = max(at_least, (block or 0) + 1)
    sizes = sample_sizes(x, keys).withColumn("reason", F.when(C("n") < least, F.lit(f"fewer than {least} trades")))
    some = sizes.filter(C("reason").isNull())
    drawn = lambda values: block_paths(values, some, n_sims, block or 1, seed, "tblock" if block else "trade", keys, wholly=not block)
    after = _moments(drawn(x.withColumn("x", C("x") / (1 + C("x"))))).select(*keys, "sim", F.coalesce(C("mean") / nz("sd"), F.lit(0.0)).alias("_s"))
    sims = after.join(drawn(x).select(*keys, "sim", C("growth").alias("final")), [*keys, "sim"])
    real = x.groupBy(*keys).agg(F.coalesce(F.avg("x") / nz(F.stddev_samp("x")), F.lit(0.0)).alias("_rs"), F.exp(F.sum(F.ln(1 + C("x")))).alias("real_final"))
    own = sizes.join(trade_years(trades, keys), keys).join(real, keys)
    root = F.sqrt(C("n") / C("years"))
    own = own.select(*keys, "n", "years", "reason", "real_final", root.alias("_root"), (C("_rs") * root).alias("real_sharpe"))
    j = sims.join(own, keys).withColumns({"sharpe": C("_s") * C("_root"), "cagr": F.pow("final", 1 / C("years")) - 1})
    found = j.groupBy(*keys).agg(
        F.avg("sharpe").alias("sharpe_mean"),
        F.percentile("sharpe", 0.05).alias("sharpe_p05"),
        F.percentile("sharpe", 0.50).alias("sharpe_p50"),
        F.percentile("sharpe", 0.95).alias("sharpe_p95"),
        F.avg((C("sharpe") >= C("real_sharpe")).cast("double")).alias("p_value_sharpe"),
        F.percentile("final", 0.05).alias("final_eq_p05"),
        F.percentile("final", 0.95).alias("final_eq_p95"),
        F.percentile("cagr", 0.05).alias("cagr_p05"),
        F.percentile("cagr", 0.95).alias("cagr_p95"),
    )
    own = own.select(
        *keys, C("n").alias("n_trades"), C("years").alias("elapsed_years"), "real_sharpe", C("real_final").alias("real_final_equity_mult"),
        (F.pow("real_final", 1 / C("years")) - 1).alias("real_cagr"), "reason",
    )
    return own.join(found, keys, "left")


def shuffled_weights(df: DataFrame, blocks: list[int], n_sims: int, seed: int = 42, keys=SERIES) -> DataFrame:
    """keys, block, sim, ord, weight with whole blocks of the weights in random order, the tail in place."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks])))
    full = sizes.withColumn("k", F.floor(C("n") / C("block")))
    source = numbered(with_sims(full, n_sims), "k", "src").withColumn("u", uniform(seed, "shuffle", "block", "sim", "src"))
    placed = with_ordinal(source, [*keys, "block", "sim"], ["u", "src"], F.floor(C("u") * 256), "dst")
    cut = df.join(full.select(*keys, "block", "k"), keys).withColumn("src", F.floor(C("ord") / C("block")))
    moved = cut.filter(C("src") < C("k")).join(placed.select(*keys, "block", "sim", "src", "dst"), [*keys, "block", "src"])
    moved = moved.select(*keys, "block", "sim", (C("dst") * C("block") + C("ord") % C("block")).alias("ord"), "weight")
    tail = with_sims(cut.filter(C("src") >= C("k")), n_sims).select(*keys, "block", "sim", "ord", "weight")
    return moved.unionByName(tail)


def _placed_blocks(sizes: DataFrame, n_sims: int, seed: int, keys) -> DataFrame:
    """keys, block, sim, src, dst, prev: where each block of a series goes and which block stands before it.

    The tail keeps its place. Simulation -1 leaves all blocks where they are. Blocks are
    ordered in buckets of about SPAN, so no task sorts a whole series.
    """
    by = [*keys, "block", "sim"]
    d = sizes.withColumns({"_k": F.floor(C("n") / C("block")), "_m": F.ceil(C("n") / C("block"))})
    d = d.withColumn("sim", F.explode(F.sequence(F.lit(-1), F.lit(n_sims - 1))))
    d = numbered(d, "_m", "src")
    d = d.withColumn("_u", F.when(C("src") >= C("_k"), 1.0).when(C("sim") < 0, C("src") / C("_m")).otherwise(uniform(seed, "shuffle", "block", "sim", "src")))
    d = d.select(*by, "src", "_u", F.floor(C("_u") * F.ceil(C("_m") / SPAN)).alias("_bucket"))
    before = W.partitionBy(*by).orderBy("_bucket")
    starts = d.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.max_by("src", F.struct("_u", "src")).alias("_last"))
    starts = starts.select(
        *by, "_bucket", F.coalesce(F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.lag("_last").over(before).alias("_before")
    )
    inside = W.partitionBy(*by, "_bucket").orderBy("_u", "src")
    d = d.repartition(*by, "_bucket").withColumns({"_rn": F.row_number().over(inside), "_p": F.lag("src").over(inside)}).join(starts.hint("merge"), [*by, "_bucket"])
    return d.select(*by, "src", (C("_start") + C("_rn") - 1).alias("dst"), F.coalesce("_p", "_before").alias("prev"))


def _shuffled_sharpe(w: np.ndarray, o: np.ndarray, c: np.ndarray, block: int, n_sims: int, rate: float, seed: int, warmup: int) -> np.ndarray:
    """Mean over deviation of the weights as they are (first) and of each shuffle of their blocks."""
    n, k = len(w), len(w) // block
    if n < 3:
        return np.zeros(n_sims + 1)
    gap, day = o[1:] / c[:-1] - 1, c[1:] / o[1:] - 1
    order = np.vstack([np.arange(k), block_orders(seed, block, n_sims, k)])
    out = np.zeros(n_sims + 1)
    some = max(1, 65_536 // n)
    for at in range(0, n_sims + 1, some):
        lot = order[at : at + some]
        src = (lot[:, :, None] * block + np.arange(block)).reshape(len(lot), k * block)
        placed = np.concatenate([w[src], np.broadcast_to(w[k * block :], (len(src), n - k * block))], axis=1)
        if warmup:
            placed[:, :warmup] = 0.0
        new = placed[:, :-1]
        old = np.concatenate([np.zeros((len(new), 1)), new[:, :-1]], axis=1)
        r = (1 + old * gap) * (1 + new * day - np.abs(new - old) * rate) - 1
        r = np.where(np.isnan(r), 0.0, r)
        sd = r.std(axis=1, ddof=1)
        out[at : at + some] = np.divide(r.mean(axis=1), sd, out=np.zeros(len(r)), where=sd > 0)
    return out


@lru_cache(maxsize=512)
def block_orders(seed: int, block: int, n_sims: int, k: int) -> np.ndarray:
    """Source block of each place in each simulation; series of as many blocks share it."""
    return np.argsort(uniform_rows(seed, "shuffle", n_sims, k, block), axis=1, kind="stable").astype(np.int32)


def signal_block_shuffle(
    df: DataFrame, blocks: list[int], n_sims: int = 500, commission_bps: float = 1.0, slippage_bps: float = 5.0,
    seed: int = 42, warmup: int = 0, keys=SERIES,
) -> DataFrame:
    """Sharpe ratio of the rule against the same weights with their blocks shuffled.

    A series of one tile is one row all the way, as in the bootstraps. In longer ones the weights of a block and
    the price moves they meet travel as one row each; a placed block is reduced to its count and sums in its row, as
    in the null test. The rule itself is one more placement, so that a shuffle that changes nothing ties with it
    exactly. Estimates of size do not count unfolded rows, and a broadcast would not fit the driver, hence the merge
    joins of the latter.
    """
    keys = list(keys)
    df = df.select(*keys, "ord", "ts", "open", "close", "weight")
    sizes = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "shuffle-sizes")
    rate = (commission_bps + slippage_bps) / 1e4
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    cols = [*keys, "block", "_s"]

    def simulated(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                w, o, c = (np.array(row[v], dtype=float) for v in ("weight", "open", "close"))
                for b in blocks:
                    rows.append({**{v: row[v] for v in keys}, "block": b, "_s": _shuffled_sharpe(w, o, c, b, n_sims, rate, seed, warmup)})
                if len(rows) * n_sims >= 65_536:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
            yield pd.DataFrame(rows, columns=cols)

    values = ["weight", "open", "close"]
    packed = packed_series(df, sizes.filter(C("n") <= TILE), values, keys, "ord")
    d = packed.mapInPandas(simulated, f"{types}, block int, _s array<double>").join(inferred_ppy(df, keys), keys)
    d = d.select(*keys, "block", (F.get("_s", F.lit(0)) * F.sqrt("ppy")).alias("o"), F.sort_array(F.transform(F.slice("_s", 2, n_sims), lambda v: v * F.sqrt("ppy"))).alias("_s"))
    d = d.withColumn("null_sharpe_mean", array_mean(C("_s")))
    short = d.select(
        *keys, "block", C("o").alias("observed_sharpe"), "null_sharpe_mean",
        array_std("_s", "null_sharpe_mean").alias("null_sharpe_std"),
        array_percentile("_s", 0.05).alias("null_sharpe_p05"),
        array_percentile("_s", 0.95).alias("null_sharpe_p95"),
        array_share("_s", lambda v: v >= C("o")).alias("p_value"),
    )
    wide = sizes.filter(C("n") > TILE)
    if wide.isEmpty():
        return short
    return short.unionByName(_placed_shuffle(df.join(wide.select(*keys), keys), blocks, n_sims, rate, seed, warmup, keys))


def _placed_shuffle(df: DataFrame, blocks: list[int], n_sims: int, rate: float, seed: int, warmup: int, keys) -> DataFrame:
    """`signal_block_shuffle` of long series, a row for each placed block."""
    df = split_series(df)
    each = lambda d: d.withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks])))
    pack = lambda d, at, row: each(d).groupBy(*keys, "block", F.floor(at / C("block")).alias("_at")).agg(F.sort_array(F.collect_list(row)).alias("_v"))
    weights = pack(df, C("ord"), F.struct("ord", C("weight").alias("w"))).select(*keys, "block", "_at", F.transform("_v", lambda v: v["w"]).alias("ws"))
    moves = on_chunks(df.select(*keys, "ord", "open", "close"), lambda d, c: d.withColumn("_pc", c.lag("close")), keys, back=1).filter("ord > 0")
    moves = pack(moves, C("ord") - 1, F.struct("ord", (C("open") / C("_pc") - 1).alias("gap"), (C("close") / C("open") - 1).alias("day")))
    sizes = each(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    d = _placed_blocks(sizes, n_sims, seed, keys)
    last = weights.select(*keys, "block", C("_at").alias("prev"), F.element_at("ws", -1).alias("_last"))
    d = d.join(last.hint("merge"), [*keys, "block", "prev"], "left").withColumn("_last", F.when(C("prev").isNull(), 0.0).otherwise(C("_last")))
    d = d.select(*keys, "block", "sim", "dst", "_last", C("src").alias("_at")).join(weights.hint("merge"), [*keys, "block", "_at"])
    d = d.select(*keys, "block", "sim", "ws", "_last", C("dst").alias("_at")).join(moves.hint("merge"), [*keys, "block", "_at"], "left")

    def at(w: Column, v: Column, lag: int) -> Column:
        return F.when(v["ord"] - lag >= warmup, w).otherwise(0.0) if warmup else w

    def r(v: Column, j: Column) -> Column:
        new = at(F.get("ws", j), v, 1)
        old = at(F.when(j > 0, F.get("ws", j - 1)).otherwise(C("_last")), v, 2)
        return F.coalesce((1 + old * v["gap"]) * (1 + new * v["day"] - F.abs(new - old) * rate) - 1, F.lit(0.0))

    d = d.select(*keys, "block", "sim", F.transform(F.coalesce("_v", F.array()), r).alias("rs"))
    add = lambda f: F.aggregate("rs", F.lit(0.0), lambda acc, v: acc + f(v))
    d = d.select(*keys, "block", "sim", F.size("rs").alias("_n"), add(lambda v: v).alias("_a"), add(lambda v: v * v).alias("_b"))
    m, s = exact_moments(C("_a"), C("_b"), nz(F.sum("_n")))
    sims = d.groupBy(*keys, "block", "sim").agg(F.coalesce(m / nz(s), F.lit(0.0)).alias("_s")).join(inferred_ppy(df, keys).hint("merge"), keys)
    sims = sims.select(*keys, "block", "sim", (C("_s") * F.sqrt("ppy")).alias("s"))
    own = F.max(F.when(C("sim") < 0, C("s"))).over(W.partitionBy(*keys, "block"))  # over n_sims + 1 rows
    return sims.withColumn("o", own).filter("sim >= 0").groupBy(*keys, "block").agg(
        F.first("o").alias("observed_sharpe"),
        F.avg("s").alias("null_sharpe_mean"),
        F.stddev_pop("s").alias("null_sharpe_std"),
        F.percentile("s", 0.05).alias("null_sharpe_p05"),
        F.percentile("s", 0.95).alias("null_sharpe_p95"),
        F.avg((C("s") >= C("o")).cast("double")).alias("p_value"),
    )


def _path_draws(equity: DataFrame, n_sims: int, block: int, seed: int, keys) -> DataFrame:
    """Block draws of series longer than three blocks."""
    x = indexed_returns(equity, keys)
    sizes = sample_sizes(x, keys).filter(C("n") >= 3 * block)
    rows = gather(block_draws(sizes, n_sims, block, seed, "paths"), x, keys)
    return rows.select(*keys, "sim", "n", C("i").alias("ord"), C("x").alias("r"))


def simulated_paths(equity: DataFrame, n_sims: int = 5000, block: int = 20, seed: int = 42, keys=SERIES) -> DataFrame:
    """keys, sim, n, ord, equity, drawdown of block-resampled curves. The draws are written
    once, since the running product reads them twice."""
    keys = list(keys)
    return equity_scan(stage(_path_draws(equity, n_sims, block, seed, keys), "draws"), "r", [*keys, "sim"])


def kept_bars(paths: DataFrame, max_bars: int = 400) -> DataFrame:
    """Every k-th bar with k = ceil(n / max_bars), and the last one: the kept bars span the path."""
    step = F.ceil(C("n") / max_bars)
    return paths.filter((C("ord") % step == 0) | (C("ord") == C("n") - 1))


def path_bands(paths: DataFrame, max_bars: int = 400, keys=SERIES) -> DataFrame:
    """Percentiles over simulations at each kept bar; a group holds one value per simulation."""
    return kept_bars(paths, max_bars).groupBy(*keys, "ord").agg(
        *[F.percentile("equity", p / 100).alias(f"p{p:02d}") for p in (5, 25, 50, 75, 95)]
    )


def simulated_bands(equity: DataFrame, n_sims: int = 5000, block: int = 20, seed: int = 42, max_bars: int = 400, keys=SERIES) -> DataFrame:
    """`path_bands` of `simulated_paths`. Curves of a series of one tile are built beside it, a kept bar's values at
    a time taken from them; only bands leave the task."""
    keys = list(keys)
    x = indexed_returns(equity, keys)
    sizes = stage(sample_sizes(x, keys).filter(C("n") >= 3 * block), "band-sizes")
    probs = (5, 25, 50, 75, 95)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name in keys)

    def bands(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                v, n = np.asarray(row["x"]), int(row["n"])
                u = uniform_rows(seed, "paths", n_sims, -(-n // block))
                step = -(-n // max_bars)
                ords = np.unique(np.append(np.arange(0, n, step), n - 1))
                level = np.empty((n_sims, len(ords)))
                some = max(1, 65_536 // n)
                for at in range(0, n_sims, some):
                    start = np.floor(u[at : at + some] * (n - block)).astype(np.int64)
                    drawn = v[(start[:, :, None] + np.arange(block)).reshape(len(start), -1)[:, :n]]
                    level[at : at + some] = np.cumprod(1 + drawn, axis=1)[:, ords]
                found = np.percentile(level, probs, axis=0)
                out = pd.DataFrame({"ord": ords, **{f"p{p:02d}": f for p, f in zip(probs, found)}})
                for i, c in enumerate(keys):
                    out.insert(i, c, row[c])
                yield out

    schema = f"{types}, ord bigint, {', '.join(f'p{p:02d} double' for p in probs)}"
    short = packed_series(x, sizes.filter(C("n") <= TILE), ["x"], keys).mapInPandas(bands, schema)
    wide = sizes.filter(C("n") > TILE)
    if wide.isEmpty():
        return short
    return short.unionByName(path_bands(simulated_paths(equity.join(wide.select(*keys), keys), n_sims, block, seed, keys), max_bars, keys))


def _packed_outcomes(equity: DataFrame, n_sims: int, block: int, seed: int, keys) -> DataFrame:
    """keys, reason and arrays terminal and maxdd over simulations, null for a series of fewer than three blocks."""
    x = indexed_returns(equity, keys)
    sizes = too_short(sample_sizes(x, keys), 3 * block)
    g = packed_paths(x, sizes.filter(C("reason").isNull()), n_sims, block, seed, "paths", keys)
    g = g.select(*keys, C("growth").alias("terminal"), C("dd").alias("maxdd"))
    return sizes.select(*keys, "reason").join(g, keys, "left")


def path_outcomes(equity: DataFrame, n_sims: int = 5000, block: int = 20, seed: int = 42, keys=SERIES) -> DataFrame:
    """Terminal wealth and largest drawdown per simulation of `simulated_paths`, without building the curves.

    A series of fewer than three blocks has one row without a simulation, and a reason.
    """
    keys = list(keys)
    d = _packed_outcomes(equity, n_sims, block, seed, keys)
    d = d.select(*keys, "reason", F.posexplode_outer(F.arrays_zip("terminal", "maxdd")).alias("sim", "_v"))
    return d.select(*keys, "sim", C("_v.terminal").alias("terminal"), C("_v.maxdd").alias("maxdd"), "reason")


def outcome_percentiles(equity: DataFrame, n_sims: int = 5000, block: int = 20, seed: int = 42, keys=SERIES) -> DataFrame:
    """`marker_percentiles` of `path_outcomes`, worked out inside the row of each series."""
    keys = list(keys)
    d = _packed_outcomes(equity, n_sims, block, seed, keys).withColumns({c: F.sort_array(c) for c in ("terminal", "maxdd")})
    return d.select(*keys, *[array_percentile(c, p / 100).alias(f"{c}_p{p:02d}") for c in ("terminal", "maxdd") for p in (5, 50, 95)], "reason")


def sampled_paths(paths: DataFrame, n_paths: int, n_sims: int, max_bars: int = 400, seed: int = 42) -> DataFrame:
    """Whole kept paths of `n_paths` simulations, chosen by the order of their hash numbers."""
    chosen = with_sims(paths.sparkSession.range(1), n_sims).orderBy(uniform(seed, "sample", "sim"), "sim").limit(n_paths)
    return kept_bars(paths, max_bars).join(chosen.select("sim"), "sim", "left_semi")


def marker_percentiles(outcomes: DataFrame, keys=SERIES) -> DataFrame:
    """Percentiles over simulations per series; a series without any keeps its reason."""
    return outcomes.groupBy(*keys).agg(
        *[F.percentile(c, p / 100).alias(f"{c}_p{p:02d}") for c in ("terminal", "maxdd") for p in (5, 50, 95)], F.first("reason").alias("reason")
    )


def reality_check(f: DataFrame, n_bootstrap: int = 5000, mean_block: float | None = None, seed: int = 42,
    sims_per_block: int = 256, combos_per_block: int = 256, by: tuple[str, ...] = (),
) -> DataFrame:
    """Best-of-many test on excess returns f(ord, combo, f), one value per time and combo.

    The resampled time indices are shared by all combos and counted first. The sums over
    time are then a product of a (sim x time) count matrix with the (time x combo) matrix
    of centred returns, done tile by tile and added up, so neither side is ever whole in
    one place. With `by` there is a test for each value of these columns over its own times and combos; tiles carry
    them, and all tests run as one job.
    """
    by = list(by)
    sizes = f.groupBy(*by, "combo").agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.max("_n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("_n").alias("_min"))
    checked = sizes.select(
        *by,
        F.when(C("_min") != C("n"), F.raise_error(F.lit("combos differ in length")).cast("bigint"))
        .when(C("n") < 10, F.raise_error(F.lit("need at least 10 bars")).cast("bigint"))
        .otherwise(C("n"))
        .alias("n")
    )
    counts = stationary_draws(checked, n_bootstrap, mean_block, seed, by).groupBy(*by, "sim", "idx").agg(F.count(F.lit(1)).alias("w"))
    means = f.groupBy(*by, "combo").agg(F.avg("f").alias("mean"))
    centred = f.join(means, [*by, "combo"]).select(*by, C("ord").alias("idx"), "combo", (C("f") - C("mean")).alias("c"))
    tile = F.floor(C("idx") / SPAN)
    groups = -(-n_bootstrap // sims_per_block)
    lots = sizes.select(*by, F.ceil(C("k") / combos_per_block).alias("_lots"))
    meet = lambda a, b: a.join(b, by) if by else a.join(F.broadcast(b))  # one row without `by`
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = meet(counts, lots).withColumns({"tile": tile, "part": F.floor(C("sim") / sims_per_block), "lot": upto(C("_lots"))})
    right = meet(centred, lots).withColumns(
        {"tile": tile, "part": upto(F.lit(groups).cast("long")), "lot": F.pmod(F.xxhash64("combo"), C("_lots"))}
    )
    tile_keys = ("tile", "part", "lot")
    left = left.withColumnsRenamed({c: f"_of_{c}" for c in by})  # both sides come from `f`

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({**{c: [] for c in by}, "sim": [], "combo": [], "s": []}).astype({**{c: "str" for c in by}, "sim": "int32", "combo": "str", "s": "float64"})
        sims, si = np.unique(a["sim"].to_numpy(), return_inverse=True)
        names, ci = np.unique(b["combo"].to_numpy(dtype=str), return_inverse=True)
        base = int(b["idx"].min())
        span = int(b["idx"].max()) - base + 1
        w = np.zeros((len(sims), span))
        w[si, a["idx"].to_numpy() - base] = a["w"].to_numpy()
        c = np.zeros((span, len(names)))
        c[b["idx"].to_numpy() - base, ci] = b["c"].to_numpy()
        s = w @ c
        out = pd.DataFrame({"sim": np.repeat(sims, len(names)), "combo": np.tile(names, len(sims)), "s": s.ravel()})
        for i, c in enumerate(by):
            out.insert(i, c, a[f"_of_{c}"].iloc[0])
        return out

    sums = left.drop("_lots").groupBy(*[f"_of_{c}" for c in by], *tile_keys).cogroup(right.drop("_lots").groupBy(*by, *tile_keys)).applyInPandas(product, "".join(f"`{c}` {f.dtypes[f.columns.index(c)][1]}, " for c in by) + "sim int, combo string, s double")
    per_sim = sums.groupBy(*by, "sim", "combo").agg(F.sum("s").alias("s")).groupBy(*by, "sim").agg(F.max("s").alias("best"))
    observed = means.groupBy(*by).agg(
        F.max("mean").alias("best_mean"), F.max_by("combo", F.struct(C("mean"), C("combo"))).alias("best_combo"),
        F.count_if(C("mean") > 0).alias("n_positive"), F.count_if(C("mean") < 0).alias("n_negative"),
    )
    one = meet(observed, sizes.select(*by, "n", "k"))
    v = meet(per_sim, one).select(
        "*", (C("best") / F.sqrt("n")).alias("v"), (C("best_mean") * F.sqrt("n")).alias("v_obs")
    )
    return v.groupBy(*by, "n", "k", "best_combo", "best_mean", "n_positive", "n_negative", "v_obs").agg(
        F.avg("v").alias("v_mean"), F.stddev_samp("v").alias("v_std"),
        F.percentile("v", 0.5).alias("v_p50"), F.percentile("v", 0.95).alias("v_p95"), F.percentile("v", 0.99).alias("v_p99"),
        F.max("v").alias("v_max"), F.avg((C("v") >= C("v_obs")).cast("double")).alias("p_value"),
    )


def top_combos(f: DataFrame, n: int = 5) -> DataFrame:
    """Best combos by mean excess return, with rank and yearly value."""
    top = f.groupBy("combo").agg(F.avg("f").alias("mean")).orderBy(F.desc("mean"), F.desc("combo")).limit(n)
    rank = F.row_number().over(W.orderBy(F.desc("mean"), F.desc("combo")))  # over n rows
    return top.select("combo", "mean", (C("mean") * 252).alias("annualized"), rank.cast("long").alias("rank"))
