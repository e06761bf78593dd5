"""Ten rules over assets: the screen, the comparison table and the verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ORACLE, TICKS, R, bars, out, query, rnd
from catalog.f_signals import _NOTE_SELECT
from catalog.g_returns import TRADE_SQL, g2_sql, gold
from catalog.h_metrics import _RF, CAGR, DAYS
from catalog.k_validation import _BAR, _FLAT, _JOIN, _PAIR_SQL, _SD, ALL_BLOCKS, BLOCK_SIMS, BLOCKS, CHAIN, OBS_SQL, PAIRS, PPY_SQL, SHUF_OUT, SHUF_SQL, SHUFFLES, SIZES_P, STAT_SQL, WF, WFQ, X_SQL, drawn_sql, null_sql, wf_curves
from tidemark.functions import indicators as ind
from tidemark.operators import metrics as met
from tidemark.operators import pnl
from tidemark.operators import ranking as rk
from tidemark.operators import resample as rs
from tidemark.operators import signals as sig
from tidemark.operators import sweep as sw
from tidemark.operators import walkforward as wf
from tidemark.plans.series import on_chunks, time_bucket, with_ordinal
from tidemark.session import stage, staged_once

C = F.col
RULES = {
    "golden_cross": (sig.golden_cross, "op_F1_golden_cross"),
    "ema_cross": (sig.ema_cross, "op_F2_ema_cross"),
    "rsi_meanrev": (sig.rsi_meanrev, "op_F3_rsi_meanrev"),
    "bollinger_meanrev": (sig.bollinger_meanrev, "op_F4_bollinger_meanrev"),
    "donchian_breakout": (sig.donchian_breakout, "op_F5_donchian_breakout"),
    "macd_cross": (sig.macd_cross, "op_F6_macd_cross"),
    "absolute_momentum": (sig.absolute_momentum, "op_F7_absolute_momentum"),
    "atr_breakout": (sig.atr_breakout, "op_F8_atr_breakout"),
    "zscore_meanrev": (sig.zscore_meanrev, "op_F9_zscore_meanrev"),
    "roc_momentum": (sig.roc_momentum, "op_F10_roc_momentum"),
}
ASSETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FLOOR = 0.10


def rule_sql(name: str, query_name: str) -> str:
    """The rule's own SQL, over order bars."""
    sql = ORACLE[query_name].removesuffix(_NOTE_SELECT).replace(TICKS["supp"], TICKS["orders"])
    return f"SELECT * FROM ({sql} SELECT symbol, ts, ord, open, close, weight::DOUBLE AS weight, '{name}' AS strategy FROM sig)"


_K = "symbol, strategy"
SIGNALS = "WITH u AS MATERIALIZED (" + " UNION ALL ".join(rule_sql(n, q) for n, (_, q) in RULES.items()) + "), uk AS MATERIALIZED (SELECT *, symbol||'/'||strategy AS key FROM u)"
CURVES = SIGNALS + g2_sql(0, "uk", name="ur", part="key") + f""", u1 AS (SELECT {_K}, ts, ord, weight, CASE WHEN ord>0 THEN r END AS r, product(1+r) OVER (PARTITION BY {_K} ORDER BY ord) AS equity FROM ur),
 ue AS MATERIALIZED (SELECT *, max(equity) OVER (PARTITION BY {_K} ORDER BY ord) AS peak, equity/max(equity) OVER (PARTITION BY {_K} ORDER BY ord)-1 AS drawdown FROM u1)"""
SCREEN = CURVES + f""", ub AS (SELECT {_K}, ord, weight, coalesce(close/lag(close) OVER (PARTITION BY key ORDER BY ord)-1,0) AS ra FROM uk), uw AS (SELECT {_K}, greatest(-1,least(1,avg(weight))) AS aw FROM u GROUP BY {_K}),
 ut AS (SELECT {_K}, avg(aw*ra)/nullif(stddev_samp(aw*ra),0)*sqrt(252.0) AS bench, any_value(aw) AS aw FROM ub JOIN uw USING ({_K}) WHERE ord>0 GROUP BY {_K}),
 ux AS (SELECT {_K}, max(n) AS dd_bars FROM (SELECT {_K}, run, count(*) FILTER (equity<peak) AS n FROM (SELECT *, sum(CASE WHEN equity>=peak THEN 1 ELSE 0 END) OVER (PARTITION BY {_K} ORDER BY ord) AS run FROM ue) GROUP BY {_K}, run) GROUP BY {_K}),
 g0 AS (SELECT {_K}, lead(ts) OVER k AS fts, lead(open) OVER k AS no, weight-coalesce(lag(weight) OVER k,0) AS dw FROM u WINDOW k AS (PARTITION BY {_K} ORDER BY ord)),
 fl AS MATERIALIZED (SELECT symbol||'/'||strategy AS symbol, fts AS ts, dw AS qty, no*(CASE WHEN dw>0 THEN 1.0005 ELSE 0.9995 END) AS price, abs(dw)*no*(CASE WHEN dw>0 THEN 1.0005 ELSE 0.9995 END)*1e-4 AS commission, row_number() OVER (PARTITION BY {_K} ORDER BY fts)-1 AS ord FROM g0 WHERE dw<>0 AND fts IS NOT NULL)""" + TRADE_SQL + f""",
 tm AS (SELECT symbol AS key, count(*) AS num_trades, CASE WHEN coalesce(sum(pnl) FILTER (pnl<=0),0)<>0 THEN coalesce(sum(pnl) FILTER (pnl>0),0)/abs(sum(pnl) FILTER (pnl<=0)) WHEN sum(pnl) FILTER (pnl>0)>0 THEN 1e9 ELSE 0 END AS pf, count(*) FILTER (pnl>0)/count(*) AS wr, avg(pnl) AS ex FROM tr GROUP BY symbol),
 uq AS (SELECT {_K}, avg(r)/nullif(stddev_samp(r),0)*sqrt(252.0) AS sharpe, (avg(r)-RFP)*252.0/nullif(stddev_samp(r)*sqrt(252.0),0) AS sharpe_rf, CASE WHEN count(*) FILTER (r<RFP)>1 THEN (avg(r)-RFP)*252.0/nullif(stddev_samp(r) FILTER (r<RFP)*sqrt(252.0),0) END AS sortino,
  stddev_samp(r)*sqrt(252.0) AS vol, {CAGR} AS cagr, min(drawdown) AS mdd FROM ue GROUP BY {_K}),
 sx AS MATERIALIZED (SELECT uq.*, sharpe-bench AS excess_sharpe, bench, aw, dd_bars, coalesce(num_trades,0) AS num_trades, wr, pf, ex FROM uq JOIN ut USING ({_K}) JOIN ux USING ({_K}) LEFT JOIN tm ON tm.key=symbol||'/'||strategy)"""
SCREEN = SCREEN.replace("RFP", _RF)


def signals(spark, sf):
    return staged_once(spark, (sf, "rule-signals"), lambda: sw.rule_signals(bars(spark, sf, "orders"), {n: f for n, (f, _) in RULES.items()}))


def curves(spark, sf):
    return staged_once(spark, (sf, "rule-curves"), lambda: sw.rule_curves(signals(spark, sf)))


def rule_trades(spark, sf):
    return staged_once(spark, (sf, "rule-trades"), lambda: sw.rule_trades(signals(spark, sf)))


def screen(spark, sf, rf: float = 0.0):
    return staged_once(spark, (sf, "screen19", str(rf)), lambda: sw.screen_assets(signals(spark, sf), curves(spark, sf), rule_trades(spark, sf), rf=rf))


@query(
    "op_H19_cross_asset_screen",
    SCREEN + f" SELECT {_K}, num_trades, {R('sharpe')} AS sharpe, {R('excess_sharpe')} AS excess_sharpe, {R('bench')} AS benchmark_sharpe, {R('cagr', 6)} AS cagr, {R('mdd', 6)} AS max_drawdown, {R('CASE WHEN mdd<0 THEN cagr/abs(mdd) END')} AS calmar, {R('aw', 6)} AS avg_exposure, {R('wr', 6)} AS win_rate, {R('pf')} AS profit_factor FROM sx",
)
def _(spark, sf):
    d = screen(spark, sf).withColumn("profit_factor", F.when(C("profit_factor") > 1e9, 1e9).otherwise(C("profit_factor")))
    return out(d, "symbol", "strategy", "num_trades", sharpe=4, excess_sharpe=4, benchmark_sharpe=4, cagr=6, max_drawdown=6, calmar=4, avg_exposure=6, win_rate=6, profit_factor=4)


@query("op_H19_cross_asset_pivot", SCREEN + " SELECT strategy, " + ", ".join(f"any_value({R('excess_sharpe', 3)}) FILTER (symbol='{a}') AS \"{a}\"" for a in ASSETS) + " FROM sx GROUP BY strategy")
def _(spark, sf):
    return rk.cross_asset_pivot(screen(spark, sf).withColumn("excess_sharpe", rnd("excess_sharpe", 3)), assets=ASSETS)


@query(
    "op_H19_cross_asset_summary",
    SCREEN + f""" SELECT strategy, count(excess_sharpe) AS "count", {R("avg(excess_sharpe)")} AS mean, {R("stddev_samp(excess_sharpe)")} AS std, {R("min(excess_sharpe)")} AS min, {R("max(excess_sharpe)")} AS max, row_number() OVER (ORDER BY avg(excess_sharpe) DESC, strategy) AS rank, coalesce(avg(excess_sharpe)>{FLOOR}, false) AS survives FROM sx GROUP BY strategy""",
)
def _(spark, sf):
    s = rk.cross_asset_summary(screen(spark, sf)).withColumn("survives", F.coalesce(C("mean") > FLOOR, F.lit(False)))
    return out(s, "strategy", "count", "rank", "survives", mean=4, std=4, min=4, max=4)


def _PCT(x: str) -> str:
    return f"coalesce(printf('%.2f%%', {R(f'({x})*100', 2)}), '—')"


def _NUM(x: str) -> str:
    return f"coalesce(CASE WHEN ({x})>=1e9 THEN 'inf' ELSE printf('%.3f', {R(x, 3)}) END, '—')"


@query(
    "op_H20_comparison_table",
    SCREEN + f""" SELECT {_K}, {_PCT('cagr')} AS cagr, {_PCT('vol')} AS volatility, {_NUM('sharpe_rf')} AS sharpe, {_NUM('sortino')} AS sortino, {_NUM('CASE WHEN mdd<0 THEN cagr/abs(mdd) END')} AS calmar, {_PCT('mdd')} AS max_drawdown,
 coalesce(dd_bars::VARCHAR, '—') AS max_drawdown_duration_bars, num_trades::VARCHAR AS num_trades, {_NUM('wr')} AS win_rate, {_NUM('pf')} AS profit_factor, {_NUM('ex')} AS expectancy FROM sx""",
)
def _(spark, sf):
    """Ratios over 4 % a year without risk."""
    return rk.comparison_table(screen(spark, sf, 0.04), ("symbol", "strategy"))


# The verdict joins the walk-forward summary with a reality check of each asset over its own crossover pairs.
RC_KEYED = f""", cs AS MATERIALIZED ({_PAIR_SQL})""" + g2_sql(0, "cs", name="er", part="combo") + """, ew AS (SELECT combo, avg(weight) AS aw FROM cs GROUP BY combo), ra AS (SELECT symbol, combo, ord, r, coalesce(close/lag(close) OVER (PARTITION BY combo ORDER BY ord)-1,0) AS ra FROM er),
 fx AS MATERIALIZED (SELECT symbol, combo, r-aw*ra AS f, ord AS idx FROM ra JOIN ew USING (combo)), sz AS (SELECT symbol, count(*) AS n FROM b GROUP BY symbol)""" + STAT_SQL.format(sims=200).replace("SELECT n, sim", "SELECT symbol, n, sim").replace("PARTITION BY sim", "PARTITION BY symbol, sim").replace("SELECT sim, i,", "SELECT symbol, sim, i,") + """,
 fm AS (SELECT symbol, combo, avg(f) AS m FROM fx GROUP BY symbol, combo), bs AS (SELECT symbol, sim, max(s) AS s FROM (SELECT symbol, sim, combo, sum(f-m) AS s FROM sd JOIN fx USING (symbol, idx) JOIN fm USING (symbol, combo) GROUP BY symbol, sim, combo) GROUP BY symbol, sim),
 rp AS (SELECT bs.symbol, avg((s/sqrt(n)>=mx*sqrt(n))::INT) AS p_value, any_value(bc) AS best_combo FROM bs JOIN sz USING (symbol) JOIN (SELECT symbol, max(m) AS mx, arg_max(combo,(m,combo)) AS bc FROM fm GROUP BY symbol) USING (symbol) GROUP BY bs.symbol)"""


def reality_by_asset(spark, sf):
    def make():
        b = bars(spark, sf, "lines")
        ns = sorted({n for p in PAIRS for n in p})
        rich = on_chunks(b, lambda d, c: ind.add_moments(d, c, {f"m{n}": ("close", n, "mean") for n in ns}), back=max(ns))
        sets = F.array(*[F.struct(F.concat("symbol", F.lit(f" × {f}/{s}")).alias("combo"), F.when(C(f"m{f}") > C(f"m{s}"), 1.0).otherwise(0.0).alias("weight")) for f, s in PAIRS])
        d = rich.withColumn("_g", F.explode(sets)).select("symbol", "ts", "ord", "open", "close", "_g.*")
        f = stage(pnl.excess_returns(d, keys=("symbol", "combo")).select("symbol", "ord", "combo", "f"), "excess-by-asset")
        return rs.reality_check(f, 200, by=("symbol",))

    return staged_once(spark, (sf, "rc-by-asset"), make)


@query("op_K12_reality_check_by_asset", WFQ + RC_KEYED + f" SELECT symbol, best_combo, {R('p_value', 6)} AS p_value FROM rp")
def _(spark, sf):
    return out(reality_by_asset(spark, sf), "symbol", "best_combo", p_value=6)


@query(
    "op_H18_verdict",
    WFQ + CHAIN + RC_KEYED + f""", v AS (SELECT symbol, robust, ch.sharpe-cb.sharpe AS x, coalesce(ch.sharpe-cb.sharpe>0.2,false) AS has_edge, p_value, best_combo FROM (SELECT DISTINCT symbol FROM b) LEFT JOIN ag3 USING (symbol) LEFT JOIN ch USING (symbol) LEFT JOIN cb USING (symbol) LEFT JOIN rp USING (symbol))
 SELECT symbol, CASE WHEN robust IS NULL THEN '—' WHEN robust THEN 'YES' ELSE 'NO' END AS wf_robust, CASE WHEN x IS NULL THEN '—' WHEN has_edge THEN 'YES' ELSE 'NO' END AS edge, CASE WHEN p_value IS NULL THEN '—' WHEN p_value<0.05 THEN 'YES' ELSE 'NO' END AS rc_significant,
 {R('p_value', 6)} AS rc_p_value, best_combo AS rc_best_combo, CASE WHEN robust IS NULL THEN 'not validated' WHEN robust AND has_edge THEN 'robust, beats its exposure' WHEN robust THEN 'robust, only its exposure' ELSE 'not robust' END AS summary FROM v""",
)
def _(spark, sf):
    s = wf.walk_forward_summary(wf_curves(spark, sf), gold(spark, sf, "lines"), WF["step"]).select("symbol", "robust", "has_edge", C("chained_excess_sharpe").alias("chained_excess"))
    rc = reality_by_asset(spark, sf).select("symbol", "p_value", C("best_combo").alias("rc_best_combo"))
    v = bars(spark, sf, "lines").select("symbol").distinct().join(s, "symbol", "left").join(rc, "symbol", "left")
    return out(met.verdict(v).withColumn("rc_p_value", C("p_value")), "symbol", "wf_robust", "edge", "rc_significant", "rc_best_combo", "summary", rc_p_value=6)


# Validation of the pairs of asset and rule that the screen finds above the floor.
KEYS, NULL_BLOCK, TRADES = ["symbol", "strategy"], 21, 20
TARGETS = f", tg AS MATERIALIZED (SELECT {_K} FROM sx WHERE excess_sharpe>{FLOOR})"
PAIR_EQ = f", eq AS MATERIALIZED (SELECT symbol||'/'||strategy AS symbol, ts, ord, r, equity, drawdown FROM ue JOIN tg USING ({_K}))"
K22_SQL = SCREEN + TARGETS + PAIR_EQ + PPY_SQL + X_SQL + OBS_SQL + null_sql(NULL_BLOCK).replace(" pt AS ", " pn AS ").replace("FROM pt ", "FROM pn ") + drawn_sql("iid", None, 3, tag="i") + f""", pi AS MATERIALIZED (SELECT symbol, sim, list_reduce(list_concat([{_FLAT}], list_transform(ys[2:], lambda x: {_BAR})), {_JOIN}) AS p FROM dli),
 ii AS (SELECT symbol, quantile_cont(s,0.05) AS p05, quantile_cont(s,0.95) AS p95 FROM (SELECT symbol, p.s/(n-1)/{_SD('n-1')}*sqrt(ppy) AS s FROM pi JOIN sz USING (symbol) JOIN pp USING (symbol)) GROUP BY symbol),
 tt AS (SELECT tr.* FROM tr JOIN tg ON tr.symbol=tg.symbol||'/'||tg.strategy), tx AS MATERIALIZED (SELECT symbol, pnl/(qty*entry_price) AS x, row_number() OVER (PARTITION BY symbol ORDER BY exit_ts, exit_ord, trade)-1 AS idx FROM tt),
 ty AS (SELECT symbol, count(*) AS nt, CASE WHEN {DAYS.replace('max(ts)', 'max(exit_ts)').replace('min(ts)', 'min(entry_ts)')}>0 THEN {DAYS.replace('max(ts)', 'max(exit_ts)').replace('min(ts)', 'min(entry_ts)')}/365.25 ELSE count(*)*5/252.0 END AS years FROM tt GROUP BY symbol)""" + drawn_sql("trade", None, TRADES, x="tx", tag="t") + f""",
 ti AS (SELECT symbol, quantile_cont(s,0.05) AS p05, quantile_cont(s,0.95) AS p95 FROM (SELECT symbol, coalesce(list_avg(zs)/nullif(list_stddev_samp(zs),0),0)*sqrt(n/years) AS s FROM (SELECT symbol, n, years, list_transform(ys, lambda y: y/(1+y)) AS zs FROM dlt JOIN ty USING (symbol))) GROUP BY symbol)
 SELECT sx.symbol, sx.strategy, num_trades AS n_trades, {R('mu.o*sqrt(ppy)')} AS observed_sharpe, {R('bench')} AS benchmark_sharpe, {R('excess_sharpe')} AS excess_sharpe, {R('aw', 6)} AS avg_weight, {R('p1', 6)} AS null_p_value, {R('ii.p05')} AS sharpe_p05, {R('ii.p95')} AS sharpe_p95, {R('ti.p05')} AS trade_sharpe_p05, {R('ti.p95')} AS trade_sharpe_p95
 FROM sx JOIN mu ON mu.symbol=sx.symbol||'/'||sx.strategy JOIN pp ON pp.symbol=mu.symbol LEFT JOIN nn ON nn.symbol=mu.symbol LEFT JOIN ii ON ii.symbol=mu.symbol LEFT JOIN ti ON ti.symbol=mu.symbol"""


def targets(spark, sf):
    return screen(spark, sf).filter(C("excess_sharpe") > FLOOR)


@query("op_K22_targeted_validation", K22_SQL)
def _(spark, sf):
    """Null test and interval of each target, and from 20 trades on the interval of its trades."""
    t = targets(spark, sf)
    mine = lambda d: d.join(t.select(*KEYS), KEYS, "left_semi")
    e = stage(mine(curves(spark, sf)), "target-curves")
    null = rs.bootstrap_null(e, BLOCK_SIMS, NULL_BLOCK, keys=KEYS).select(*KEYS, "observed_sharpe", C("p_value_one_sided").alias("null_p_value"))
    iid = rs.bootstrap_iid(e, BLOCK_SIMS, keys=KEYS).select(*KEYS, "sharpe_p05", "sharpe_p95")
    tr = stage(with_ordinal(mine(rule_trades(spark, sf)), KEYS, ["exit_ts", "exit_ord", "trade"], time_bucket("exit_ts")), "target-trades")
    own = rs.bootstrap_trades(tr, BLOCK_SIMS, keys=KEYS, at_least=TRADES).select(*KEYS, C("sharpe_p05").alias("trade_sharpe_p05"), C("sharpe_p95").alias("trade_sharpe_p95"))
    d = t.select(*KEYS, C("num_trades").alias("n_trades"), "benchmark_sharpe", "excess_sharpe", C("avg_exposure").alias("avg_weight"))
    d = d.join(null, KEYS).join(iid, KEYS, "left").join(own, KEYS, "left")
    four = ("observed_sharpe", "benchmark_sharpe", "excess_sharpe", "sharpe_p05", "sharpe_p95", "trade_sharpe_p05", "trade_sharpe_p95")
    return out(d, "symbol", "strategy", "n_trades", avg_weight=6, null_p_value=6, **dict.fromkeys(four, 4))


SWEEP_SQL = SCREEN + TARGETS + f", b AS MATERIALIZED (SELECT key AS symbol, ts, ord, open, close FROM uk JOIN tg USING ({_K})), sg AS MATERIALIZED (SELECT key AS symbol, ts, ord, open, close, weight FROM uk JOIN tg USING ({_K}))" + SHUF_SQL.replace(str(BLOCKS), str(ALL_BLOCKS)).replace("generate_series(0,5)", f"generate_series(0,{SHUFFLES - 1})") + g2_sql(0, "sp", name="sr", part="key") + g2_sql(0) + SHUF_OUT + SIZES_P


@query(
    "op_K22_targeted_shuffles",
    SWEEP_SQL + f" SELECT split_part(symbol,'/',1) AS symbol, split_part(symbol,'/',2) AS strategy, b AS block, {R('p', 6)} AS p_value, CASE WHEN p<0.01 THEN 'strong' WHEN p<0.05 THEN 'sig' WHEN p<0.1 THEN 'marginal' ELSE 'no' END AS class, b=arg_min(b,(p,b)) OVER (PARTITION BY symbol) AS best FROM bp",
)
def _(spark, sf):
    """Shuffle sweep of each target over all block sizes, its best size marked."""
    from pyspark.sql import Window as W

    s = signals(spark, sf).join(targets(spark, sf).select(*KEYS), KEYS, "left_semi")
    d = stage(rs.signal_block_shuffle(stage(s, "target-signals"), ALL_BLOCKS, SHUFFLES, keys=KEYS), "target-shuffles").withColumn("p_value", rnd("p_value", 6))
    best = F.min_by("block", F.struct("p_value", "block")).over(W.partitionBy(*KEYS))  # over six sizes
    d = d.withColumns({"class": rk.p_class(C("p_value")), "best": C("block") == best})
    return out(d, "symbol", "strategy", "block", "class", "best", "p_value")
