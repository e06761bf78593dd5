"""Chunked plans must not depend on the chunk size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions.ewm import ewm, ewm_reach, span_alpha
from tidemark.operators import signals as sig
from tidemark.plans.selection import exact_percentiles, prefix_ranks, ranks_before, value_positions
from tidemark.plans.series import equity_scan, on_chunks, path_summary, scan, time_bucket, with_ordinal


@pytest.fixture(scope="module")
def walk(make_bars):
    rng = np.random.default_rng(3)
    closes = 100 * np.cumprod(1 + rng.normal(0.0003, 0.01, 700))
    return make_bars(closes).union(make_bars(closes[::-1][:400], "BBB"))


def frame(df):
    return df.toPandas().sort_values(["symbol", "ord"]).reset_index(drop=True)


def test_ordinals_across_buckets(walk):
    df = with_ordinal(walk.withColumnRenamed("ord", "want").repartition(7), ["symbol"], ["ts"], time_bucket(days=10))
    assert df.filter("ord <> want").count() == 0


@pytest.mark.parametrize("rows", [64, 100_000])
def test_bounded_frames(walk, rows):
    def build(d, c):
        d = ind.add_moments(d, c, {"m20": ("close", 20, "mean"), "m60": ("close", 60, "mean"), "s60": ("close", 60, "sd"), "q60": ("close", 60, "sd", 21)})
        return d.withColumn("nxt", c.lead("close"))

    got = frame(on_chunks(walk, build, back=61, ahead=1, rows=rows))
    p = frame(walk)
    g = p.groupby("symbol").close
    for name, want in {
        "m20": g.transform(lambda s: s.rolling(20).mean()),
        "m60": g.transform(lambda s: s.rolling(60).mean()),
        "s60": g.transform(lambda s: s.rolling(60).std()),
        "q60": g.transform(lambda s: s.rolling(60, min_periods=21).std()),
        "nxt": g.shift(-1),
    }.items():
        np.testing.assert_allclose(got[name], want, rtol=1e-9, atol=1e-9, err_msg=name)


@pytest.mark.parametrize("rows", [160, 100_000])
def test_recursive_average(walk, rows):
    a = span_alpha(5)
    got = frame(on_chunks(walk, lambda d, c: ewm(d, c, {"y": (F.col("close") - c.lag("close"), a, 5)}), back=ewm_reach(a, 5), rows=rows))
    want = frame(walk).groupby("symbol").close.transform(lambda s: s.diff().ewm(span=5, adjust=False, min_periods=5).mean())
    np.testing.assert_allclose(got["y"], want, atol=1e-10)


@pytest.mark.parametrize("rows", [50, 100_000])
def test_scans(walk, rows):
    p = frame(walk)
    g = p.groupby("symbol").close
    got = frame(scan(walk, {"s": ("sum", "close"), "m": ("max", "close"), "l": ("last", F.when(F.col("ord") % 7 == 3, F.col("close")))}, rows=rows))
    np.testing.assert_allclose(got["s"], g.cumsum())
    np.testing.assert_allclose(got["m"], g.cummax())
    np.testing.assert_allclose(got["l"], p.close.where(p.ord % 7 == 3).groupby(p.symbol).ffill())
    r = walk.withColumn("r", F.sin("ord") / 50)
    eq = frame(equity_scan(r, rows=rows))
    want = (1 + np.sin(p.ord) / 50).groupby(p.symbol).cumprod()
    np.testing.assert_allclose(eq["equity"], want)
    dd = want / want.groupby(p.symbol).cummax() - 1
    np.testing.assert_allclose(eq["drawdown"], dd, atol=1e-12)
    s = path_summary(r, rows=rows).toPandas().set_index("symbol")
    np.testing.assert_allclose(s["max_drawdown"].sort_index(), dd.groupby(p.symbol).min())
    np.testing.assert_allclose(s["growth"].sort_index(), want.groupby(p.symbol).last())


def test_percentiles_and_positions(walk, spark):
    probs = {"a": 0.05, "b": 0.5, "c": 1.0, "d": 0.0}
    got = exact_percentiles(walk, ["symbol"], "close", probs).toPandas().set_index("symbol").sort_index()
    want = frame(walk).groupby("symbol").close.quantile(list(probs.values())).unstack().sort_index()
    np.testing.assert_allclose(got[list(probs)], want)
    ties = spark.range(1000).select(F.lit("T").alias("symbol"), (F.col("id") % 3).cast("double").alias("close"))
    assert exact_percentiles(ties, ["symbol"], "close", {"m": 0.5}).first()["m"] == 1.0
    pos = value_positions(walk, ["symbol"], "close", ["ts"]).toPandas().sort_values(["symbol", "pos"])
    assert (pos.groupby("symbol").cumcount() == pos.pos).all()
    assert (pos.groupby("symbol").close.diff().dropna() >= 0).all()


@pytest.mark.parametrize("base", [8, 4096])
def test_prefix_ranks_against_brute_force(walk, base):
    df = walk.withColumns({"value": F.col("close"), "probe": F.col("close")})
    got = prefix_ranks(df, F.col("ord") % 5 == 0, base=base).toPandas().set_index(["symbol", "ord"])["rank"]
    p = frame(walk)
    for (sym, o), n in got.items():
        v = p[p.symbol == sym].close.to_numpy()
        assert n == (v[:o] <= v[o]).sum()


@pytest.mark.parametrize(
    "rule", [sig.vwap_refined, lambda b, **kw: sig.trend_pullback(b, near=0.03, adx_min=5.0, fast=10, slow=40, **kw)]
)
def test_fold_is_chunk_free(make_bars, rule):
    rng = np.random.default_rng(5)
    bars = make_bars(100 * np.cumprod(1 + 0.004 * np.sin(np.arange(900) / 40) + rng.normal(0, 0.004, 900)))
    whole, cut = frame(rule(bars)), frame(rule(bars, rows=37))
    assert (whole.weight != 0).any()
    assert (whole.weight == cut.weight).all()


def test_value_positions_on_a_skewed_series_with_ties(spark):
    """Lognormal values, half of them equal: exact ranks, and no bucket near the whole series."""
    rng = np.random.default_rng(8)
    v = np.exp(rng.normal(0, 3, 4000))
    v[rng.random(4000) < 0.5] = 1.5
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(v)], "symbol string, t long, x double")
    got = value_positions(df, ["symbol"], "x", ["t"], rows=256).toPandas().sort_values("t")
    want = np.empty(4000, int)
    want[np.lexsort((np.arange(4000), v))] = np.arange(4000)
    assert (got.pos.to_numpy() == want).all()


@pytest.mark.parametrize("build", ["chunks", "scan", "equity"])
def test_windows_are_dealt_by_chunk_after_a_join_on_symbol(spark, walk, build):
    """With broadcasts off the join deals rows by symbol; windows on (symbol, chunk) must deal them anew."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_symbol = walk.groupBy("symbol").agg(F.max("close").alias("top"))
        joined = walk.join(per_symbol, "symbol").withColumn("r", F.col("close") / F.col("top") - 1)
        made = {
            "chunks": lambda: on_chunks(joined, lambda d, c: d.withColumn("x", c.lag("r")), back=1, rows=64),
            "scan": lambda: scan(joined, {"x": ("sum", "r")}, rows=64),
            "equity": lambda: equity_scan(joined, "r", rows=64),
        }[build]()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(symbol" in plan and "_chunk" in plan
        below = None
        for line in plan.splitlines():
            if "Window" in line and "_chunk" in line.split("], [", 1)[-1].split("]")[0]:
                below = True
            elif below and "Exchange hashpartitioning" in line:
                assert "_chunk" in line, line
                below = None
        assert made.count() == walk.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("base", [16, None])
def test_prefix_ranks_hold_every_event(spark, base):
    """pairs of each event with its block were formed, and events above no earlier value had no row."""
    rng = np.random.default_rng(11)
    rows = []
    for sym, n in (("A", 1300), ("B", 40), ("C", 1), ("D", 16), ("E", 33)):
        for i in range(n):
            v = None if rng.random() < 0.2 else float(rng.integers(0, 9))
            rows.append((sym, i, v, float(rng.integers(-2, 11)) if rng.random() < 0.4 else None))
    rows += [("F", i, float("nan") if i % 3 == 0 else float(i % 5), float("nan") if i % 2 else 2.0) for i in range(50)]
    df = spark.createDataFrame(rows, "symbol string, ord long, value double, probe double").repartition(5)
    got = {(r["symbol"], r["ord"]): (r["n"], r["rank"]) for r in prefix_ranks(df, F.col("ord") != 3, base=base).collect()}
    below = lambda x, probe: x <= probe or probe != probe  # as in Spark, NaN is above all numbers and equal to itself
    want = {}
    for sym, o, _, probe in rows:
        if probe is not None and o != 3:
            v = [r[2] for r in rows if r[0] == sym and r[1] < o and r[2] is not None]
            want[sym, o] = (len(v), sum(below(x, probe) for x in v))
    assert got == want


def test_prefix_ranks_of_a_long_block_are_counted_by_tiles():
    rng = np.random.default_rng(12)
    v, probes, upto = rng.normal(0, 1, 3000), rng.normal(0, 1, 400), np.sort(rng.integers(0, 3001, 400))
    assert (ranks_before(v, upto, probes) == [(v[:u] <= p).sum() for u, p in zip(upto, probes)]).all()


def test_prefix_ranks_form_no_pairs(walk):
    """an event met every earlier row of its block in a join."""
    df = walk.withColumns({"value": F.col("close"), "probe": F.col("close")})
    plan = prefix_ranks(df, F.lit(True))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
