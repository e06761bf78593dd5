import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar as cal
from tidemark.operators import orb
from tidemark.operators import resample as rs
from tidemark.operators import signals as sig
from tidemark.operators import sweep as sw
from tidemark.operators import walkforward as wf
from tidemark.plans.series import equity_scan


@pytest.fixture(scope="module")
def equity(make_bars):
    rng = np.random.default_rng(11)
    b = make_bars(100 * np.cumprod(1 + rng.normal(0.0004, 0.012, 600)))
    from tidemark.operators.returns import asset_returns

    return equity_scan(asset_returns(b))


def test_null_bootstrap_is_centred_and_repeatable(equity):
    a = rs.bootstrap_null(equity, 200).first()
    n, ppy = 599, 600 / (599 / 365.25)
    assert abs(a["null_sharpe_mean"]) < 4 * (ppy / n) ** 0.5 / 200**0.5 * 3
    assert a["null_sharpe_std"] == pytest.approx((ppy / n) ** 0.5, rel=0.35)
    assert a["null_sharpe_p05"] < a["null_sharpe_mean"] < a["null_sharpe_p95"]
    for again in (equity, equity.repartition(5)):
        b = rs.bootstrap_null(again, 200).first()
        assert b["p_value_one_sided"] == a["p_value_one_sided"]
        assert b["symbol"] == a["symbol"] and b["reason"] is None and list(b)[1:-1] == pytest.approx(list(a)[1:-1], rel=1e-9)


def test_drawn_blocks_do_not_depend_on_partitions(equity):
    x = rs.indexed_returns(equity)
    draws = lambda d: sorted(map(tuple, rs.block_starts(rs.sample_sizes(d), 20, 20).collect()))
    assert draws(x) == draws(x.repartition(7))


@pytest.mark.parametrize("n,most", [(10, 400), (401, 400), (799, 400), (1000, 400)])
def test_kept_bars_span_the_path(spark, n, most):
    paths = spark.range(n).select(F.col("id").alias("ord"), F.lit(n).alias("n"))
    kept = sorted(r["ord"] for r in rs.kept_bars(paths, most).collect())
    assert kept[0] == 0 and kept[-1] == n - 1 and len(kept) <= most + 1
    assert max(b - a for a, b in zip(kept, kept[1:])) <= -(-n // most)


def test_block_paths_match_brute_force(equity):
    """The packed block path must equal drawing row by row."""
    x = rs.indexed_returns(equity)
    rows = rs.gather(rs.block_draws(rs.sample_sizes(x), 5, 20, stream="paths"), x).toPandas().sort_values(["sim", "i"])
    out = rs.path_outcomes(equity, 5, 20).toPandas().set_index("sim").sort_index()
    for sim, g in rows.groupby("sim"):
        assert len(g) == 599
        e = np.cumprod(1 + g.x.to_numpy())
        assert out.loc[sim, "terminal"] == pytest.approx(e[-1])
        assert out.loc[sim, "maxdd"] == pytest.approx((e / np.maximum.accumulate(e) - 1).min())


@pytest.mark.parametrize("warmup", [0, 30])
def test_packed_shuffle_matches_shuffled_rows(make_bars, warmup):
    """Packed blocks must give what moving each weight gives; a shuffle that changes nothing ties."""
    from tidemark.operators.pnl import next_open_returns

    rng = np.random.default_rng(3)
    closes = 100 * np.cumprod(1 + rng.normal(0.0003, 0.012, 103))
    b = make_bars(closes.tolist(), opens=(closes * (1 + rng.normal(0, 0.003, 103))).tolist()).withColumn("weight", F.expr("CAST((ord * 7) % 5 AS DOUBLE) / 4"))
    got = {r["block"]: r for r in rs.signal_block_shuffle(b, [2, 5, 40, 160], 12, warmup=warmup).collect()}
    ppy = rs.inferred_ppy(b).first()["ppy"]
    sharpe = lambda x: x.mean() / x.std(ddof=1) * ppy**0.5
    own = sharpe(next_open_returns(b, warmup=warmup).filter("ord > 0").toPandas()["r"])
    rows = rs.shuffled_weights(b.select("symbol", "ord", "weight"), [2, 5, 40, 160], 12).join(b.select("symbol", "ord", "open", "close"), ["symbol", "ord"])
    rows = next_open_returns(rows, warmup=warmup, keys=["symbol", "block", "sim"]).filter("ord > 0").toPandas()
    for block, g in rows.groupby("block"):
        s = g.groupby("sim")["r"].apply(sharpe)
        assert got[block]["observed_sharpe"] == pytest.approx(own)
        assert got[block]["null_sharpe_mean"] == pytest.approx(s.mean())
        assert got[block]["p_value"] == pytest.approx((s >= own - 1e-9).mean())
    assert set(got) == {2, 5, 40, 160} and got[160]["p_value"] == 1.0


def test_whole_shuffle_can_tell_every_class():
    """One shuffle of the registered sweep must weigh at most a hundredth, over all sizes of the reference."""
    from catalog import ORACLE
    from catalog import k_validation as k

    assert k.ALL_BLOCKS == [2, 5, 20, 40, 80, 160] and k.SHUFFLES >= 100
    for name in ("op_K8_signal_block_shuffle_sizes", "op_I5_best_block_sizes", "op_I6_p_value_class_sizes"):
        assert "generate_series(0,99)" in ORACLE[name] and "[2, 5, 20, 40, 80, 160]" in ORACLE[name]


def test_stationary_blocks_wrap_and_have_the_mean_length(spark):
    n = spark.createDataFrame([(2000,)], "n long")
    d = rs.stationary_draws(n, 20).toPandas().sort_values(["sim", "i"])
    assert (d.groupby("sim").size() == 2000).all() and d.idx.between(0, 1999).all()
    jumps = ((d.idx.diff() - 1) % 2000 != 0).sum() / 20
    assert 2000 / jumps == pytest.approx(2000**0.5, rel=0.3)
    same = rs.stationary_draws(n, 3, mean_block=2000**0.5).toPandas().sort_values(["sim", "i"]).idx.to_numpy()
    assert (same == d[d.sim < 3].idx.to_numpy()).all()


@pytest.mark.parametrize("alpha,low,high", [(0.0, 0.05, 1.0), (0.002, 0.0, 0.05)])
def test_reality_check(spark, alpha, low, high):
    rng = np.random.default_rng(42)
    f = rng.normal(0, 0.01, (1500, 8))
    f[:, 5] += alpha
    rows = [(t, f"c{k}", float(f[t, k])) for t in range(1500) for k in range(8)]
    r = rs.reality_check(spark.createDataFrame(rows, "ord long, combo string, f double"), 200, sims_per_block=64).first()
    assert low <= r["p_value"] <= high
    assert (r["n"], r["k"]) == (1500, 8)
    if alpha:
        assert r["best_combo"] == "c5"


def test_walk_forward_windows_and_flat_excess(make_bars):
    rng = np.random.default_rng(2)
    b = make_bars([100 * 1.0003**i + rng.normal(0, 1) for i in range(700)]).withColumn("weight", F.lit(1.0))
    c = wf.walk_forward(b, train=300, test=100, commission_bps=0, slippage_bps=0)
    t = wf.windows_table(c, b).orderBy("window").collect()
    assert [r["window"] for r in t] == [1, 2, 3, 4]
    assert all(r["oos_bars"] == 100 and r["is_bars"] == 300 for r in t)
    s = wf.walk_forward_summary(c, b, 100).first()
    assert abs(s["chained_excess_sharpe"]) < 0.2 and not s["has_edge"]
    with pytest.raises(Exception, match="exceeds the data length"):
        wf.walk_forward(b, train=600, test=200, strict=True).collect()


def test_short_series_have_a_reason_and_leave_the_others_alone(make_bars):
    """A series a bar short of a window has one row with a reason; the rest is as without it."""
    rng = np.random.default_rng(4)
    prices = (100 * np.exp(np.cumsum(rng.normal(0, 0.01, 500)))).tolist()
    long, edge, short = (make_bars(prices[:n]).withColumns({"symbol": F.lit(s), "weight": F.lit(1.0)}) for s, n in (("long", 500), ("edge", 300), ("short", 299)))
    every = long.unionByName(edge).unionByName(short)
    counts = wf.window_counts(every, 200, 100, 50)
    assert {r["symbol"]: (r["n_bars"], r["n_windows"], r["reason"]) for r in counts.collect()} == {"long": (500, 5, None), "edge": (300, 1, None), "short": (299, 0, wf.SHORT)}
    got = wf.with_short_series(wf.walk_forward_summary(wf.walk_forward(every, 200, 100, 50), every, 50), counts)
    got = {r["symbol"]: r.asDict() for r in got.collect()}
    assert set(got) == {"long", "edge", "short"}
    assert (got["short"]["n_windows"], got["short"]["robust"], got["short"]["has_edge"], got["short"]["mean_oos_sharpe"], got["short"]["reason"]) == (0, False, False, None, wf.SHORT)
    alone = wf.walk_forward_summary(wf.walk_forward(long, 200, 100, 50), long, 50).first().asDict()
    assert all(got["long"][c] == pytest.approx(v) for c, v in alone.items()) and got["long"]["reason"] is None


@pytest.mark.parametrize("rows", [520, 100_000])
def test_screen_equals_row_model(make_bars, rows):
    from tidemark.operators.metrics import core_metrics
    from tidemark.operators.pnl import weight_returns

    rng = np.random.default_rng(8)
    b = make_bars(100 * np.cumprod(1 + rng.normal(0.0002, 0.01, 1300)))
    s = sw.screen_variants(b, [20], [100], ["long_short"], ["combined"], [0.001], rows=rows).first()
    v = sig.golden_cross_variants(b, sig.variant_grid([20], [100], ["long_short"], ["combined"], [0.001]))
    e = equity_scan(weight_returns(v)).toPandas().sort_values("ord")
    assert s["total_return"] == pytest.approx(e.equity.iloc[-1] - 1)
    assert s["max_drawdown"] == pytest.approx(e.drawdown.min())
    assert s["approx_trades"] == (e.position.diff().fillna(1) != 0).sum()


def test_xs_momentum(make_bars):
    lines = {"A": (100, 200), "B": (100, 150), "C": (100, 50), "D": (100, 30)}
    df = None
    for s, (a, z) in lines.items():
        one = make_bars(np.linspace(a, z, 500), s)
        df = one if df is None else df.union(one)
    w = sig.xs_momentum(cal.align_ffill(df), lookback=100, skip=10, top_k=1, bottom_k=1).toPandas()
    last = w[w.ts == w.ts.max()].set_index("symbol").weight
    assert last["A"] == 0.5 and last["D"] == -0.5 and last.abs().sum() == 1.0
    assert (w[w.ord < 110].weight == 0).all()


def orb_day(spark, start, gap=False):
    rows = []
    for i in range(6):
        t = start + dt.timedelta(minutes=5 * i)
        if gap and i == 3:
            t = start + dt.timedelta(minutes=30)
        rows.append(("X", t, i, 3300.0 + i, 3302.0 + i, 3298.0 + i, 3301.0 + i))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ord long, open double, high double, low double, close double")


@pytest.mark.parametrize("start", [dt.datetime(2025, 7, 15, 16, 30), dt.datetime(2025, 1, 15, 17, 30)])
def test_opening_range_in_summer_and_winter(spark, start):
    d = orb.session_bars(orb_day(spark, start))
    assert d.agg(F.date_format(F.min("local"), "HH:mm").alias("t")).first()["t"] == "09:30"
    r = orb.opening_ranges(d, strict_grid=True).first()
    assert (r["orb_high"], r["orb_low"]) == (3307.0, 3298.0)
    assert orb.exact_grid_days(d).first()["exact"]


def test_opening_range_with_a_missing_bar(spark):
    d = orb.session_bars(orb_day(spark, dt.datetime(2025, 7, 15, 16, 30), gap=True))
    assert orb.opening_ranges(d).count() == 0
    assert not orb.exact_grid_days(d).first()["exact"]


def test_align_keeps_leading_gap_null(make_bars):
    a = make_bars([1, 2, 3, 4])
    late = make_bars([10, 11], "BBB", start=dt.datetime(2020, 1, 3), step=dt.timedelta(days=1))
    g = cal.align_ffill(a.union(late)).filter("symbol = 'BBB'").orderBy("ts").collect()
    assert [r["close"] for r in g] == [None, None, 10.0, 11.0]
    assert [r["volume"] for r in g] == [0.0, 0.0, 1000.0, 1000.0]


@pytest.mark.parametrize("rows", [520, 100_000])
def test_trade_fold_equals_row_model(make_bars, rows):
    """Chunks that trades cross must give what one row per bar and variant gives."""
    rng = np.random.default_rng(8)
    closes = 100 * np.cumprod(1 + rng.normal(0.0002, 0.01, 1300))
    b = make_bars(closes.tolist(), opens=(closes * (1 + rng.normal(0, 0.003, 1300))).tolist())
    axes = dict(fast=[5, 20], slow=[100], modes=["long_only", "long_short"], filters=["none", "combined"], buffers=[0.0, 0.001])
    vk = ["fast", "slow", "mode", "filter", "buffer"]
    got = {tuple(r[k] for k in vk): r for r in sw.sweep_variants(b, **axes, rows=rows).collect()}
    want = sw.full_sweep(b, sig.variant_grid(**axes)).collect()
    assert len(got) == len(want) == 16
    for w in want:
        g = got[tuple(w[k] for k in vk)]
        for c in ("total_return", "cagr", "sharpe", "calmar", "max_drawdown", "num_trades", "win_rate", "profit_factor", "expectancy"):
            assert g[c] == pytest.approx(w[c], rel=1e-9, nan_ok=True), c
    assert sum(w["num_trades"] for w in want) > 100


@pytest.mark.parametrize("rows", [64, 65_536])
def test_tree_sweep_equals_copied_curves(make_bars, rows):
    """Windows put together from tree nodes must give what copying each window gives; short series get a reason."""
    rng = np.random.default_rng(21)
    closes = 100 * np.cumprod(1 + rng.normal(0.0003, 0.012, 500))
    b = make_bars(closes.tolist(), opens=(closes * (1 + rng.normal(0, 0.003, 500))).tolist()).union(make_bars([100.0] * 50, "BBB"))
    b = b.withColumns({"timeframe": F.lit("1D"), "w0": F.expr("CAST((ord * 7 % 11) % 3 - 1 AS DOUBLE)"), "w1": F.expr("IF(ord > 290, 1D, 0D)")})
    got = wf.sweep_walk_forward(b.withColumn("weights", F.array("w0", "w1")), {"1D": (200, 80, 30)}, [{"v": "w0"}, {"v": "w1"}], rows=rows).collect()
    assert {(r["symbol"], r["v"], r["n_windows"], r["reason"]) for r in got} == {("AAA", "w0", 8, None), ("AAA", "w1", 8, None), ("BBB", "w0", 0, "shorter than one window"), ("BBB", "w1", 0, "shorter than one window")}
    a = b.filter("symbol = 'AAA'")
    for v in ("w0", "w1"):
        d = a.withColumn("weight", F.col(v))
        want = wf.walk_forward_summary(wf.walk_forward(d, 200, 80, 30, burn_in=10), d, 30).first()
        g = next(r for r in got if r["symbol"] == "AAA" and r["v"] == v)
        for c in ("mean_is_sharpe", "mean_oos_sharpe", "std_oos_sharpe", "mean_excess_sharpe", "chained_sharpe", "chained_cagr", "chained_maxdd", "chained_benchmark_sharpe", "chained_excess_sharpe"):
            assert (g[c] is None) == (want[c] is None) and (want[c] is None or g[c] == pytest.approx(want[c], rel=1e-7, abs=1e-9)), (v, c)
        assert g["robust"] == want["robust"]


def test_cover_is_in_order_and_short():
    from tidemark.plans.segment_tree import LEAST, cover

    for lo, hi in ((0, 1), (3, 3), (5, 130), (0, 1 << 12), (77, 5000)):
        at = lo
        found = list(cover(lo, hi, 10))
        for level, node in found:
            assert node << level == at and (level == 0 or LEAST <= level <= 10)
            at += 1 << level
        assert at == max(lo, hi) and len(found) <= 2 * (10 + 2**LEAST) + (hi - lo >> 10)


@pytest.mark.parametrize("block,whole", [(20, False), (5, False), (1, True)])
def test_tiles_of_starts_give_the_same_paths(make_bars, monkeypatch, block, whole):
    """Draws dealt to tiles and brought back must equal those looked up beside their series."""
    from tidemark.operators import blocks

    rng = np.random.default_rng(4)
    b = make_bars(rng.normal(0, 0.01, 333).tolist()).union(make_bars(rng.normal(0, 0.01, 90).tolist(), "BBB"))
    x = b.select("symbol", F.col("ord").alias("idx"), F.col("close").alias("x"))
    run = lambda: {(r["symbol"], r["sim"]): list(r)[2:] for r in blocks.block_paths(x, rs.sample_sizes(x), 7, block, skip_first=True, wholly=whole).collect()}
    want = run()
    for k, v in {"TILE": 64, "SIMS": 3, "BLOCKS": 4}.items():
        monkeypatch.setattr(blocks, k, v)
    got = run()
    assert set(got) == set(want) and len(got) == 14
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9), k


def test_short_series_have_a_reason(make_bars):
    from tidemark.operators.returns import asset_returns

    rng = np.random.default_rng(5)
    b = make_bars((100 * np.cumprod(1 + rng.normal(0, 0.01, 120))).tolist()).union(make_bars([100.0 + i % 3 for i in range(12)], "BBB"))
    e = equity_scan(asset_returns(b))
    for d, least in ((rs.bootstrap_iid(e, 5), 0), (rs.bootstrap_block(e, 5), 21), (rs.bootstrap_null(e, 5), 21), (rs.marker_percentiles(rs.path_outcomes(e, 5)), 60)):
        reasons = {r["symbol"]: r["reason"] for r in d.collect()}
        assert reasons == {"AAA": None, "BBB": f"fewer than {least} returns" if least else None}


def test_reality_check_by_key_equals_one_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, f"c{k}", float(rng.normal(0.0005 * k, 0.01))) for s, n in (("A", 300), ("B", 180)) for t in range(n) for k in range(3)]
    f = spark.createDataFrame(rows, "symbol string, ord long, combo string, f double")
    both = {r["symbol"]: r.asDict() for r in rs.reality_check(f, 40, by=("symbol",), sims_per_block=16).collect()}
    for s in ("A", "B"):
        one = rs.reality_check(f.filter(F.col("symbol") == s).drop("symbol"), 40).first().asDict()
        assert {k: both[s][k] for k in ("n", "k", "best_combo", "p_value")} == {k: one[k] for k in ("n", "k", "best_combo", "p_value")}
        assert both[s]["v_p95"] == pytest.approx(one["v_p95"])


def test_short_series_and_rare_regimes_keep_a_row(spark, make_bars):
    from tidemark.operators import metrics as met
    from tidemark.operators.returns import asset_returns

    r = asset_returns(make_bars([100.0 + (i * 7 % 5) for i in range(40)]).union(make_bars([100.0 + i % 3 for i in range(9)], "BBB")).union(make_bars([5.0] * 30, "CCC")))
    got = met.qq_table(r).collect()
    assert {(x["symbol"], x["reason"]) for x in got if x["pos"] is None} == {("BBB", "fewer than 20 returns"), ("CCC", "returns do not differ")}
    assert all(x["reason"] is None for x in got if x["symbol"] == "AAA") and sum(x["symbol"] == "AAA" for x in got) >= 39
    labels = spark.createDataFrame([("A", "low", 0.01 * i) for i in range(6)] + [("A", "high", 0.02)] * 2, "symbol string, regime string, r double")
    p = {x["regime"]: x for x in met.regime_performance(labels).collect()}
    assert p["low"]["reason"] is None and p["low"]["sharpe"] > 0
    assert (p["high"]["n_bars"], p["high"]["sharpe"], p["high"]["reason"]) == (2, None, "fewer than 5 bars")
