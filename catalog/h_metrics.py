"""Metric library."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import B, ISO, R, W_SQL, bars, out, query
from catalog.e_windows import EPISODE_SQL, REGIME_SQL, RET
from catalog.g_returns import FILL_SQL, G1, GOLD, TRADE_SQL, gold_equity, trades
from tidemark.operators import drawdown as dd
from tidemark.operators import metrics as met
from tidemark.operators import returns as ret
from tidemark.plans.series import time_bucket, with_ordinal

C = F.col
EQ = B() + GOLD + G1
DAYS = "floor((epoch_us(max(ts))-epoch_us(min(ts)))/86400000000)"
FIRST, LAST = "arg_min(equity,ord)", "arg_max(equity,ord)"
CAGR = f"pow({LAST}/{FIRST}, 1/({DAYS}/365.25))-1"


def core(spark, sf):
    return met.core_metrics(gold_equity(spark, sf))


@query("op_H1_return_metrics", EQ + f" SELECT symbol, count(r) AS n_periods, {R(f'{LAST}/{FIRST}-1', 6)} AS total_return, {R(CAGR, 6)} AS cagr, {R(f'{DAYS}/365.25', 6)} AS years FROM eq GROUP BY symbol")
def _(spark, sf):
    return out(core(spark, sf), "symbol", "n_periods", total_return=6, cagr=6, years=6)


@query(
    "op_H2_periods_per_year",
    B() + f" SELECT symbol, {R(f'count(*)/({DAYS}/365.25)')} AS ppy, {R('(count(*)-1)/((epoch_us(max(ts))-epoch_us(min(ts)))/1e6/(365.2425*86400))')} AS ppy_exact FROM b GROUP BY symbol",
)
def _(spark, sf):
    b = bars(spark, sf)
    x = met.periods_per_year(b).join(met.periods_per_year(b, exact=True).withColumnRenamed("ppy", "ppy_exact"), "symbol")
    return out(x, "symbol", ppy=4, ppy_exact=4)


@query("op_H3_volatility", EQ + f" SELECT symbol, {R('stddev_samp(r)*sqrt(252.0)', 6)} AS volatility, {R('CASE WHEN count(*) FILTER (r<0)>1 THEN stddev_samp(r) FILTER (r<0)*sqrt(252.0) END', 6)} AS downside_deviation FROM eq GROUP BY symbol")
def _(spark, sf):
    return out(core(spark, sf), "symbol", volatility=6, downside_deviation=6)


_RF = "(pow(1.04,1/252.0)-1)"


@query(
    "op_H4_risk_adjusted",
    EQ + f""" SELECT symbol, {R(f'(avg(r)-{_RF})*252.0/nullif(stddev_samp(r)*sqrt(252.0),0)')} AS sharpe, {R(f'CASE WHEN count(*) FILTER (r<{_RF})>1 THEN (avg(r)-{_RF})*252.0/nullif(stddev_samp(r) FILTER (r<{_RF})*sqrt(252.0),0) END')} AS sortino,
 {R(f'CASE WHEN min(drawdown)<0 THEN ({CAGR})/abs(min(drawdown)) END')} AS calmar FROM eq GROUP BY symbol""",
)
def _(spark, sf):
    return out(met.core_metrics(gold_equity(spark, sf), rf=0.04), "symbol", sharpe=4, sortino=4, calmar=4)


@query(
    "op_H5_var_cvar",
    EQ + f""", q AS (SELECT symbol, quantile_cont(r,0.05) AS a, quantile_cont(r,0.01) AS z FROM eq GROUP BY symbol) SELECT symbol, {R('any_value(a)', 6)} AS var_95, {R('avg(r) FILTER (r<=a)', 6)} AS cvar_95, {R('any_value(z)', 6)} AS var_99, {R('avg(r) FILTER (r<=z)', 6)} AS cvar_99 FROM eq JOIN q USING (symbol) GROUP BY symbol""",
)
def _(spark, sf):
    return out(met.tail_metrics(gold_equity(spark, sf)), "symbol", var_95=6, cvar_95=6, var_99=6, cvar_99=6)


@query("op_H6_skew_kurtosis", EQ + f" SELECT symbol, {R('skewness(r)')} AS skew, {R('kurtosis(r)')} AS kurtosis FROM eq GROUP BY symbol")
def _(spark, sf):
    return out(core(spark, sf), "symbol", skew=4, kurtosis=4)


@query(
    "op_H7_drawdown_metrics",
    EQ + f""", rn AS (SELECT *, sum(CASE WHEN equity>=peak THEN 1 ELSE 0 END) OVER w AS run FROM eq {W_SQL}), ep AS (SELECT symbol, run, count(*) FILTER (equity<peak) AS n, CASE WHEN count(*) FILTER (equity<peak)>0 THEN epoch_us(max(ts))-epoch_us(min(ts)) ELSE 0 END AS us FROM rn GROUP BY symbol, run),
 lg AS (SELECT symbol, max(n) AS max_drawdown_duration_bars, max(us)/86400000000.0 AS max_drawdown_duration_days FROM ep GROUP BY symbol)
 SELECT symbol, {R('min(drawdown)', 6)} AS max_drawdown, {R('coalesce(avg(drawdown) FILTER (drawdown<0),0)', 6)} AS avg_drawdown, any_value(max_drawdown_duration_bars) AS max_drawdown_duration_bars, any_value(max_drawdown_duration_days) AS max_drawdown_duration_days FROM eq JOIN lg USING (symbol) GROUP BY symbol""",
)
def _(spark, sf):
    m = met.metric_set(gold_equity(spark, sf))
    return out(m, "symbol", "max_drawdown_duration_bars", "max_drawdown_duration_days", max_drawdown=6, avg_drawdown=6)


TR = FILL_SQL + TRADE_SQL
TM_SQL = f""", tm0 AS (SELECT symbol, count(*) AS n, count(*) FILTER (pnl>0) AS w, coalesce(sum(pnl) FILTER (pnl>0),0) AS ws, coalesce(sum(pnl) FILTER (pnl<=0),0) AS ls, avg(pnl) AS ex, coalesce(avg(pnl) FILTER (pnl>0),0) AS aw, coalesce(avg(pnl) FILTER (pnl<=0),0) AS al,
 avg(pnl/nullif(qty*entry_price,0)) AS exp_, coalesce(avg(pnl/nullif(qty*entry_price,0)) FILTER (pnl>0),0) AS awp, coalesce(avg(pnl/nullif(qty*entry_price,0)) FILTER (pnl<=0),0) AS alp, coalesce(max(pnl) FILTER (pnl>0),0) AS bw, coalesce(min(pnl) FILTER (pnl<=0),0) AS wl FROM tr GROUP BY symbol)"""


@query(
    "op_H8_trade_metrics",
    TR + TM_SQL + f""" SELECT symbol, n AS num_trades, {R('w/n', 6)} AS win_rate, CASE WHEN ls<>0 THEN {R('ws/abs(ls)')} WHEN ws>0 THEN 'inf'::DOUBLE ELSE 0 END AS profit_factor, {R('ex')} AS expectancy, {R('aw')} AS avg_win, {R('al')} AS avg_loss,
 CASE WHEN al<>0 THEN {R('abs(aw/al)')} ELSE 'inf'::DOUBLE END AS payoff_ratio, {R('exp_', 6)} AS expectancy_pct, {R('awp', 6)} AS avg_win_pct, {R('alp', 6)} AS avg_loss_pct FROM tm0""",
)
def _(spark, sf):
    m = met.trade_metrics(trades(spark, sf))
    inf = float("inf")
    # Rounding by floor would turn an infinite ratio into the largest integer.
    safe = lambda c: F.when(C(c) == inf, C(c)).otherwise(F.floor(F.when(C(c) != inf, C(c)) * 1e4 + 0.5) / 1e4)
    m = m.withColumns({"profit_factor": safe("profit_factor"), "payoff_ratio": safe("payoff_ratio")})
    return out(m, "symbol", "num_trades", "profit_factor", "payoff_ratio", win_rate=6, expectancy=4, avg_win=4, avg_loss=4, expectancy_pct=6, avg_win_pct=6, avg_loss_pct=6)


@query("op_H9_win_loss_breakdown", TR + TM_SQL + f" SELECT symbol, {R('aw')} AS avg_win, {R('bw')} AS best_win, {R('al')} AS avg_loss, {R('wl')} AS worst_loss FROM tm0")
def _(spark, sf):
    return out(met.trade_metrics(trades(spark, sf)), "symbol", avg_win=4, best_win=4, avg_loss=4, worst_loss=4)


@query("op_H10_holding_period", TR + f" SELECT symbol, trade, greatest(0,(epoch_us(exit_ts)-epoch_us(entry_ts))/86400000000.0) AS holding_days FROM tr")
def _(spark, sf):
    return out(met.holding_days(trades(spark, sf)), "symbol", "trade", "holding_days")


@query("op_H11_cumulative_pnl", TR + f" SELECT symbol, trade, {R('sum(pnl) OVER (PARTITION BY symbol ORDER BY exit_ts, exit_ord, trade)', 3)} AS cum_pnl FROM tr")
def _(spark, sf):
    t = with_ordinal(trades(spark, sf), ["symbol"], ["exit_ts", "exit_ord", "trade"], time_bucket("exit_ts"))
    return out(met.cumulative_pnl(t), "symbol", "trade", cum_pnl=3)


MONTH_SQL = """, lm AS (SELECT symbol, date_trunc('UNIT', ts) AS period, max_by(equity, ord) AS e FROM eq GROUP BY 1,2), sp AS (SELECT symbol, unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL 1 UNIT)) AS period FROM lm GROUP BY symbol),
 fe AS (SELECT symbol, period, last_value(e IGNORE NULLS) OVER w AS e FROM sp LEFT JOIN lm USING (symbol, period) WINDOW w AS (PARTITION BY symbol ORDER BY period)), mr AS (SELECT *, e/lag(e) OVER (PARTITION BY symbol ORDER BY period)-1 AS ret FROM fe)"""


@query("op_H12_annual_returns", EQ + MONTH_SQL.replace("UNIT", "year") + f" SELECT symbol, year(period) AS year, {R('ret', 6)} AS ret FROM mr")
def _(spark, sf):
    return out(met.period_returns(gold_equity(spark, sf), "year").withColumn("year", F.year("period")), "symbol", "year", ret=6)


_MONTHS = ", ".join(R(f"max(ret) FILTER (month(period)={i})", 6) + f" AS m{i:02d}" for i in range(1, 13))


@query("op_H12_month_table", EQ + MONTH_SQL.replace("UNIT", "month") + f" SELECT symbol, year(period) AS year, {_MONTHS} FROM mr GROUP BY symbol, year(period)")
def _(spark, sf):
    m = met.month_table(met.period_returns(gold_equity(spark, sf), "month"))
    return out(m, "symbol", "year", **{f"m{i:02d}": 6 for i in range(1, 13)})


@query(
    "op_H13_histogram",
    B() + RET + f""", e AS (SELECT symbol, min(r) AS lo, max(r) AS hi, avg(r) AS mean, stddev_samp(r) AS sd FROM r GROUP BY symbol) SELECT symbol, bin, count(*) AS n, {R('any_value(lo)+bin*(any_value(hi)-any_value(lo))/80', 6)} AS left_edge, {R('any_value(mean)', 6)} AS mean, {R('any_value(sd)', 6)} AS sd
 FROM (SELECT *, least(79, floor((r-lo)/((hi-lo)/80)))::BIGINT AS bin FROM r JOIN e USING (symbol) WHERE r IS NOT NULL) GROUP BY symbol, bin""",
)
def _(spark, sf):
    h = met.histogram(ret.asset_returns(bars(spark, sf)), "r", 80)
    return out(h, "symbol", "bin", "n", left_edge=6, mean=6, sd=6)


def _poly(coef, x):
    s = repr(coef[0])
    for c in coef[1:]:
        s = f"({s}*{x}+{c!r})"
    return s


_T = "sqrt(-2*ln(CASE WHEN p<0.5 THEN p ELSE 1-p END))"
_TAIL = f"({_poly(met.ACKLAM_C, 't')}/({_poly(met.ACKLAM_D, 't')}*t+1))"
_CENTRE = f"({_poly(met.ACKLAM_A, '(q*q)')}*q/({_poly(met.ACKLAM_B, '(q*q)')}*(q*q)+1))"


@query(
    "op_H14_qq_table",
    B() + RET + f""", s0 AS (SELECT symbol, count(r) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM r GROUP BY symbol), s AS (SELECT * FROM s0 WHERE n>=20 AND sd>0),
 k AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r, ord)-1 AS pos FROM r WHERE r IS NOT NULL), pp AS (SELECT *, CASE WHEN pos=0 THEN 1-pow(0.5,1.0/n) WHEN pos=n-1 THEN pow(0.5,1.0/n) ELSE (pos+1-0.3175)/(n+0.365) END AS p FROM k JOIN s USING (symbol)),
 z AS (SELECT *, p-0.5 AS q, {_T} AS t FROM pp) SELECT symbol, pos, {R(f'CASE WHEN p<0.02425 THEN {_TAIL} WHEN p>1-0.02425 THEN -{_TAIL} ELSE {_CENTRE} END')} AS theoretical, {R('(r-m)/sd')} AS sample, NULL::VARCHAR AS reason FROM z UNION ALL SELECT symbol, NULL, NULL, NULL, CASE WHEN n<20 THEN 'fewer than 20 returns' ELSE 'returns do not differ' END FROM s0 WHERE n<20 OR sd=0""",
)
def _(spark, sf):
    return out(met.qq_table(ret.asset_returns(bars(spark, sf))), "symbol", "pos", "reason", theoretical=4, sample=4)


@query(
    "op_H15_regime_performance",
    B() + REGIME_SQL + f""" SELECT symbol, regime, count(r) AS n_bars, {R('CASE WHEN count(r)>=5 THEN count(*) FILTER (r>0)/count(r) END', 6)} AS hit_rate, {R('CASE WHEN count(r)>=5 THEN stddev_samp(r)*sqrt(252.0) END', 6)} AS ann_vol, {R('CASE WHEN count(r)>=5 THEN coalesce(avg(r)/nullif(stddev_samp(r),0)*sqrt(252.0),0) END')} AS sharpe, CASE WHEN count(r)<5 THEN 'fewer than 5 bars' END AS reason FROM lb GROUP BY symbol, regime""",
)
def _(spark, sf):
    p = met.regime_performance(dd.regime_labels(ret.asset_returns(bars(spark, sf))))
    return out(p, "symbol", "regime", "n_bars", "reason", hit_rate=6, ann_vol=6, sharpe=4)


@query(
    "op_H16_bull_bear",
    B("lines") + RET + f""", mk AS (SELECT ts, avg(r) AS m FROM r WHERE r IS NOT NULL GROUP BY ts), x AS (SELECT symbol, r AS s, m FROM r JOIN mk USING (ts) WHERE r IS NOT NULL)
 SELECT symbol, CASE WHEN m>0 THEN 'Bull' ELSE 'Bear' END AS period, {R('avg(s)*252.0')} AS strat, {R('avg(m)*252.0')} AS bench, count(*) AS n_bars FROM x GROUP BY 1, 2""",
)
def _(spark, sf):
    r = ret.asset_returns(bars(spark, sf, "lines"))
    market = r.groupBy("ts").agg(F.avg("r").alias("m"))
    pairs = r.select("symbol", "ts", C("r").alias("s")).join(market, "ts")
    return out(met.bull_bear(pairs, "s", "m", keys=["symbol"]), "symbol", "period", "n_bars", strat=4, bench=4)


@query(
    "op_H17_top_drawdowns",
    B() + EPISODE_SQL + f" SELECT symbol, rank, {ISO('start_ts')} AS start_ts, {ISO('trough_ts')} AS trough_ts, bars, {R('depth', 6)} AS depth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, start_ts) AS rank FROM ep2 WHERE bars>0) WHERE rank<=5",
)
def _(spark, sf):
    return out(dd.top_drawdowns(dd.drawdown_episodes(bars(spark, sf), "close")), "symbol", "rank", "start_ts", "trough_ts", "bars", depth=6)
