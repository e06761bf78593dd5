"""Ranking, resampling, walk-forward windows and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import B, ISO, R, W_SQL, bars, ctes, out, query, rnd
from catalog.f_signals import variant_sql
from catalog.g_returns import FILL_SQL, GOLD, SAME_SQL, TRADE_SQL, g2_sql, gold, gold_equity, trades
from catalog.h_metrics import CAGR, DAYS, EQ
from catalog.sqlfrag import EMA, PRE, RSI, SD, SMA, wi
from tidemark.operators import metrics as met
from tidemark.operators import pnl
from tidemark.operators import ranking as rk
from tidemark.operators import resample as rs
from tidemark.operators import signals as sig
from tidemark.operators import sweep as sw
from tidemark.operators import walkforward as wf
from tidemark.plans.series import equity_scan, time_bucket, with_ordinal
from tidemark.session import stage, staged_once

C = F.col
SIMS = 100


def U(stream: str, *coords: str) -> str:
    return f"(('0x'||substr(md5(concat_ws('|','42','{stream}',{','.join(coords)})),1,8))::BIGINT/4294967296.0)"


PPY_SQL = f", pp AS (SELECT symbol, count(*)/({DAYS}/365.25) AS ppy FROM eq GROUP BY symbol)"
X_SQL = ", x AS MATERIALIZED (SELECT symbol, ord-1 AS idx, r AS x FROM eq WHERE ord>0), sz AS (SELECT symbol, count(*) AS n FROM x GROUP BY symbol)"
SIMS_SQL = f", si AS (SELECT symbol, n, sim, unnest(generate_series(0,n-1)) AS i FROM sz, (SELECT unnest(generate_series(0,{SIMS - 1})) AS sim))"
OBS_SQL = f", ob AS (SELECT symbol, avg(r)/stddev_samp(r)*sqrt(any_value(ppy)) AS rs, {CAGR} AS rc, min(drawdown) AS rd FROM eq JOIN pp USING (symbol) GROUP BY symbol)"


def block_sql(stream: str, b: int, x: str = "x") -> str:
    return f", dr AS MATERIALIZED (SELECT symbol, n, sim, i, x FROM (SELECT *, floor({U(stream, 'sim', f'i//{b}')}*(n-{b}))::BIGINT+i%{b} AS idx FROM si WHERE n>{b}) JOIN {x} USING (symbol, idx))"


IID_SQL = f", dr AS MATERIALIZED (SELECT symbol, n, sim, i, x FROM (SELECT *, floor({U('iid', 'sim', 'i')}*n)::BIGINT AS idx FROM si) JOIN x USING (symbol, idx))"
PATH_SQL = """, pa AS (SELECT *, product(CASE WHEN i>0 THEN 1+x ELSE 1 END) OVER w AS e FROM dr WINDOW w AS (PARTITION BY symbol, sim ORDER BY i)),
 pd AS (SELECT *, e/max(e) OVER w-1 AS dd FROM pa WINDOW w AS (PARTITION BY symbol, sim ORDER BY i)),
 ss AS MATERIALIZED (SELECT symbol, sim, avg(x) FILTER (i>0)/stddev_samp(x) FILTER (i>0)*sqrt(any_value(ppy)) AS s, exp(sum(ln(1+x)) FILTER (i>0)*any_value(ppy)/(any_value(n)-1))-1 AS c, min(dd) AS d FROM pd JOIN pp USING (symbol) GROUP BY symbol, sim)"""
SUM_SQL = f""" SELECT symbol, {R('any_value(rs)')} AS real_sharpe, {R('any_value(rc)', 6)} AS real_cagr, {R('any_value(rd)', 6)} AS real_maxdd, {R('avg(s)')} AS sharpe_mean, {R('stddev_pop(s)')} AS sharpe_std, {R('quantile_cont(s,0.05)')} AS sharpe_p05, {R('quantile_cont(s,0.5)')} AS sharpe_p50, {R('quantile_cont(s,0.95)')} AS sharpe_p95,
 {R('avg((s>=rs)::INT)', 6)} AS p_value_sharpe, {R('avg((c>=rc)::INT)', 6)} AS p_value_cagr, {R('avg((d<=-0.5)::INT)', 6)} AS prob_ruin FROM ss JOIN ob USING (symbol) GROUP BY symbol"""
_SUM = dict(real_sharpe=4, real_cagr=6, real_maxdd=6, sharpe_mean=4, sharpe_std=4, sharpe_p05=4, sharpe_p50=4, sharpe_p95=4, p_value_sharpe=6, p_value_cagr=6, prob_ruin=6)
BOOT = EQ + PPY_SQL + X_SQL + SIMS_SQL


BLOCK_SIMS = 1000
_BAR = "{'s': x, 'q': x*x, 'g': 1+x, 'lo': 1+x, 'hi': 1+x, 'dd': 0.0::DOUBLE}"
_FLAT = "{'s': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'g': 1.0::DOUBLE, 'lo': 1.0::DOUBLE, 'hi': 1.0::DOUBLE, 'dd': 0.0::DOUBLE}"
_JOIN = "lambda a, b: {'s': a.s+b.s, 'q': a.q+b.q, 'g': a.g*b.g, 'lo': least(a.lo, a.g*b.lo), 'hi': greatest(a.hi, a.g*b.hi), 'dd': least(a.dd, b.dd, a.g*b.lo/a.hi-1)}"


def block_path_sql(stream: str, b: int, skip_first: bool = False, x: str = "x", least: int | None = None) -> str:
    """`pt`: symbol, sim and `p`, the joined segments of its blocks. Whole blocks are looked up by start, others folded bar by bar."""
    bars_of = lambda take: f"list_transform(xs[:{take}], lambda x: {_BAR})"
    first = f"list_concat([{_FLAT}], list_transform(xs[2:take], lambda x: {_BAR}))" if skip_first else bars_of("take")
    return f""", us AS MATERIALIZED (SELECT sim, k, {U(stream, 'sim', 'k')} AS u FROM (SELECT unnest(generate_series(0,{BLOCK_SIMS - 1})) AS sim), (SELECT unnest(generate_series(0,(SELECT ceil(max(n)/{b}.0)::BIGINT FROM sz)-1)) AS k)),
 bl AS (SELECT symbol, sim, k, floor(u*(n-{b}))::BIGINT AS start, least({b}, n-k*{b}) AS take FROM sz JOIN us ON k<ceil(n/{b}.0) WHERE n>={least or b + 1}),
 st0 AS (SELECT symbol, idx AS start, list(x) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN CURRENT ROW AND {b - 1} FOLLOWING) AS xs FROM {x}),
 st AS MATERIALIZED (SELECT symbol, start, xs, list_reduce({bars_of(b)}, {_JOIN}) AS seg FROM st0),
 pt AS MATERIALIZED (SELECT symbol, sim, list_reduce(list(g ORDER BY k), {_JOIN}) AS p FROM (
  SELECT symbol, sim, k, seg AS g FROM bl JOIN st USING (symbol, start) WHERE take={b} AND k>={int(skip_first)}
  UNION ALL SELECT symbol, sim, k, list_reduce({bars_of('take')}, {_JOIN}) FROM bl JOIN st USING (symbol, start) WHERE take<{b} AND k>={int(skip_first)}
  {f"UNION ALL SELECT symbol, sim, k, list_reduce({first}, {_JOIN}) FROM bl JOIN st USING (symbol, start) WHERE k=0" if skip_first else ''}) GROUP BY symbol, sim)"""


def REASON(n: int) -> str:
    return f"CASE WHEN n<{n} THEN 'fewer than {n} returns' END AS reason"


_SD = lambda n: f"nullif(sqrt(greatest(0,p.q-({n})*(p.s/({n}))*(p.s/({n})))/(({n})-1)),0)"
BASE = EQ + PPY_SQL + X_SQL
K3_SQL = BASE + OBS_SQL + block_path_sql("block", 20, skip_first=True) + f""", ss AS (SELECT symbol, p.s/(n-1)/{_SD('n-1')}*sqrt(ppy) AS s, pow(p.g, ppy/(n-1))-1 AS c, p.dd AS d FROM pt JOIN sz USING (symbol) JOIN pp USING (symbol)),
 sm AS (SELECT symbol, avg(s) AS a, stddev_pop(s) AS b, quantile_cont(s,0.05) AS p05, quantile_cont(s,0.5) AS p50, quantile_cont(s,0.95) AS p95, avg((s>=rs)::INT) AS ps, avg((c>=rc)::INT) AS pc, avg((d<=-0.5)::INT) AS pr FROM ss JOIN ob USING (symbol) GROUP BY symbol)
 SELECT symbol, {R('rs')} AS real_sharpe, {R('rc', 6)} AS real_cagr, {R('rd', 6)} AS real_maxdd, {R('a')} AS sharpe_mean, {R('b')} AS sharpe_std, {R('p05')} AS sharpe_p05, {R('p50')} AS sharpe_p50, {R('p95')} AS sharpe_p95, {R('ps', 6)} AS p_value_sharpe, {R('pc', 6)} AS p_value_cagr, {R('pr', 6)} AS prob_ruin, {REASON(21)} FROM ob JOIN sz USING (symbol) LEFT JOIN sm USING (symbol)"""


def drawn_sql(stream: str, b: int | None, least: int, x: str = "x", tag: str = "") -> str:
    """`dl`: symbol, n, sim and ys, the drawn values in order; CTE names end in `tag`."""
    at = f"xs[floor(ul[i//{b}+1]*(n-{b}))::BIGINT+i%{b}+1]" if b else "xs[floor(ul[i+1]*n)::BIGINT+1]"
    return f""", us{tag} AS MATERIALIZED (SELECT sim, list({U(stream, 'sim', 'k')} ORDER BY k) AS ul FROM (SELECT unnest(generate_series(0,{BLOCK_SIMS - 1})) AS sim), (SELECT unnest(generate_series(0,(SELECT max(n) FROM sz)-1)) AS k) GROUP BY sim),
 xl{tag} AS MATERIALIZED (SELECT symbol, count(*) AS n, list(x ORDER BY idx) AS xs FROM {x} GROUP BY symbol HAVING count(*)>={least}), dl{tag} AS (SELECT symbol, n, sim, list_transform(range(n), lambda i: {at}) AS ys FROM xl{tag}, us{tag})"""


K2_SQL = BASE + OBS_SQL + drawn_sql("iid", None, 3) + f""", pt AS MATERIALIZED (SELECT symbol, sim, list_reduce(list_concat([{_FLAT}], list_transform(ys[2:], lambda x: {_BAR})), {_JOIN}) AS p FROM dl)""" + K3_SQL[K3_SQL.index(", ss AS (") :].replace(REASON(21), REASON(3))


@query("op_K2_bootstrap_iid", K2_SQL)
def _(spark, sf):
    return out(rs.bootstrap_iid(gold_equity(spark, sf), BLOCK_SIMS), "symbol", "reason", **_SUM)


@query("op_K3_bootstrap_block", K3_SQL)
def _(spark, sf):
    return out(rs.bootstrap_block(gold_equity(spark, sf), BLOCK_SIMS, 20), "symbol", "reason", **_SUM)


@query("op_D10_bootstrap_gather", BOOT + IID_SQL + f" SELECT symbol, sim, count(*) AS n, {R('sum(x)', 8)} AS sum_x FROM dr GROUP BY symbol, sim")
def _(spark, sf):
    x = rs.indexed_returns(gold_equity(spark, sf))
    g = rs.block_paths(x, rs.sample_sizes(x), SIMS, 1, 42, "iid", wholly=True).withColumnRenamed("s", "sum_x")
    return out(g, "symbol", "sim", "n", sum_x=8)


def null_sql(b: int) -> str:
    return f""", mu AS (SELECT symbol, avg(x) AS m, coalesce(avg(x)/nullif(stddev_samp(x),0),0) AS o FROM x GROUP BY symbol), xz AS MATERIALIZED (SELECT symbol, idx, x-m AS x FROM x JOIN mu USING (symbol)){block_path_sql('null', b, x='xz')},
 ns AS (SELECT symbol, sim, coalesce(p.s/n/{_SD('n')},0)*sqrt(ppy) AS s, o*sqrt(ppy) AS o FROM pt JOIN sz USING (symbol) JOIN pp USING (symbol) JOIN mu USING (symbol)),
 nn AS (SELECT symbol, avg(s) AS a, stddev_pop(s) AS b, quantile_cont(s,0.05) AS p05, quantile_cont(s,0.95) AS p95, avg((s>=o)::INT) AS p1, avg((abs(s)>=abs(o))::INT) AS p2 FROM ns GROUP BY symbol)"""


@query(
    "op_K4_bootstrap_null",
    BASE + null_sql(20) + f""" SELECT symbol, {R('mu.o*sqrt(ppy)')} AS observed_sharpe, {R('a')} AS null_sharpe_mean, {R('b')} AS null_sharpe_std, {R('p05')} AS null_sharpe_p05, {R('p95')} AS null_sharpe_p95,
 {R('p1', 6)} AS p_value_one_sided, {R('p2', 6)} AS p_value_two_sided, {REASON(21)} FROM mu JOIN sz USING (symbol) JOIN pp USING (symbol) LEFT JOIN nn USING (symbol)""",
)
def _(spark, sf):
    d = rs.bootstrap_null(gold_equity(spark, sf), BLOCK_SIMS, 20)
    return out(d, "symbol", "reason", observed_sharpe=4, null_sharpe_mean=4, null_sharpe_std=4, null_sharpe_p05=4, null_sharpe_p95=4, p_value_one_sided=6, p_value_two_sided=6)


TX_SQL = FILL_SQL + TRADE_SQL + """, x AS MATERIALIZED (SELECT symbol, pnl/(qty*entry_price) AS x, row_number() OVER (PARTITION BY symbol ORDER BY exit_ts, exit_ord, trade)-1 AS idx FROM tr), sz AS (SELECT symbol, count(*) AS n FROM x GROUP BY symbol HAVING count(*)>=MIN),
 ty AS (SELECT symbol, CASE WHEN floor((epoch_us(max(exit_ts))-epoch_us(min(entry_ts)))/86400000000)>0 THEN floor((epoch_us(max(exit_ts))-epoch_us(min(entry_ts)))/86400000000)/365.25 ELSE count(*)*5/252.0 END AS years FROM tr GROUP BY symbol)"""
TS_SQL = f""", rl AS (SELECT symbol, coalesce(avg(x)/nullif(stddev_samp(x),0),0) AS rs, exp(sum(ln(1+x))) AS rf FROM x GROUP BY symbol),
 ts AS MATERIALIZED (SELECT symbol, years, coalesce(list_avg(zs)/nullif(list_stddev_samp(zs),0),0)*sqrt(n/years) AS s, f FROM (SELECT symbol, n, years, list_transform(ys, lambda y: y/(1+y)) AS zs, exp(list_sum(list_transform(ys, lambda y: ln(1+y)))) AS f FROM dl JOIN ty USING (symbol))),
 tq AS (SELECT symbol, avg(s) AS a, quantile_cont(s,0.05) AS p05, quantile_cont(s,0.95) AS p95, avg((s>=rs*sqrt(n/ts.years))::INT) AS ps, quantile_cont(f,0.05) AS f05, quantile_cont(f,0.95) AS f95, quantile_cont(pow(f,1/ts.years)-1,0.05) AS c05 FROM ts JOIN rl USING (symbol) JOIN sz USING (symbol) GROUP BY symbol)
 SELECT symbol, n AS n_trades, {R('years', 6)} AS elapsed_years, {R('rs*sqrt(n/years)')} AS real_sharpe, {R('rf', 6)} AS real_final_equity_mult, {R('a')} AS sharpe_mean, {R('p05')} AS sharpe_p05, {R('p95')} AS sharpe_p95,
 {R('ps', 6)} AS p_value_sharpe, {R('f05', 6)} AS final_eq_p05, {R('f95', 6)} AS final_eq_p95, {R('c05', 6)} AS cagr_p05, CASE WHEN n<LEAST THEN 'fewer than LEAST trades' END AS reason FROM sz JOIN ty USING (symbol) JOIN rl USING (symbol) LEFT JOIN tq USING (symbol)"""
_TS = dict(elapsed_years=6, real_sharpe=4, real_final_equity_mult=6, sharpe_mean=4, sharpe_p05=4, sharpe_p95=4, p_value_sharpe=6, final_eq_p05=6, final_eq_p95=6, cagr_p05=6)


def ordered_trades(spark, sf):
    t = trades(spark, sf)
    return staged_once(spark, (sf, "trades-ord"), lambda: with_ordinal(t, ["symbol"], ["exit_ts", "exit_ord", "trade"], time_bucket("exit_ts")))


@query("op_K5_bootstrap_trades", TX_SQL.replace("MIN", "1") + drawn_sql("trade", None, 5) + TS_SQL.replace("LEAST", "5"))
def _(spark, sf):
    return out(rs.bootstrap_trades(ordered_trades(spark, sf), BLOCK_SIMS), "symbol", "n_trades", "reason", **_TS)


@query("op_K6_bootstrap_trades_block", TX_SQL.replace("MIN", "1") + drawn_sql("tblock", 5, 6) + TS_SQL.replace("LEAST", "6"))
def _(spark, sf):
    return out(rs.bootstrap_trades(ordered_trades(spark, sf), BLOCK_SIMS, 5), "symbol", "n_trades", "reason", **_TS)


@query("op_K7_trade_years", TX_SQL.replace("MIN", "1") + f" SELECT symbol, {R('years', 6)} AS years FROM ty")
def _(spark, sf):
    return out(rs.trade_years(trades(spark, sf)), "symbol", years=6)


BLOCKS = [20, 60]
SHUF_SQL = f""", bz AS (SELECT symbol, n, b, n//b AS k, sim FROM (SELECT symbol, count(*) AS n FROM sg GROUP BY symbol), (SELECT unnest({BLOCKS}) AS b), (SELECT unnest(generate_series(0,5)) AS sim)),
 pm AS (SELECT symbol, b, sim, src, row_number() OVER (PARTITION BY symbol, b, sim ORDER BY {U('shuffle', 'b', 'sim', 'src')}, src)-1 AS dst FROM (SELECT *, unnest(generate_series(0,k-1)) AS src FROM bz)),
 sw AS MATERIALIZED (SELECT s.symbol, p.b, p.sim, p.dst*p.b+s.ord%p.b AS ord, s.weight FROM sg s JOIN pm p ON p.symbol=s.symbol AND p.src=s.ord//p.b UNION ALL SELECT s.symbol, z.b, z.sim, s.ord, s.weight FROM sg s JOIN bz z ON z.symbol=s.symbol AND s.ord//z.b>=z.k),
 sp AS MATERIALIZED (SELECT sw.symbol||'/'||b||'/'||sim AS key, sw.symbol, b, sim, sw.ord, sw.weight, open, close FROM sw JOIN b ON b.symbol=sw.symbol AND b.ord=sw.ord)"""
SHUF_OUT = f""", st AS (SELECT symbol, b, sim, coalesce(avg(r)/nullif(stddev_samp(r),0),0) AS s FROM sr WHERE ord>0 GROUP BY symbol, b, sim), oo AS (SELECT symbol, coalesce(avg(r)/nullif(stddev_samp(r),0),0) AS o FROM nr WHERE ord>0 GROUP BY symbol),
 py AS (SELECT symbol, count(*)/({DAYS}/365.25) AS ppy FROM b GROUP BY symbol), sf AS MATERIALIZED (SELECT symbol, b, s*sqrt(ppy) AS s, o*sqrt(ppy) AS o FROM st JOIN oo USING (symbol) JOIN py USING (symbol))"""
SHUFFLE = B() + GOLD + SHUF_SQL + g2_sql(0, "sp", name="sr", part="key") + g2_sql(0) + SHUF_OUT


def shuffled(spark, sf):
    return rs.signal_block_shuffle(gold(spark, sf), BLOCKS, 6)


@query("op_K8_signal_block_shuffle", SHUFFLE + f" SELECT symbol, b AS block, {R('any_value(o)')} AS observed_sharpe, {R('avg(s)')} AS null_sharpe_mean, {R('stddev_pop(s)')} AS null_sharpe_std, {R('quantile_cont(s,0.05)')} AS null_sharpe_p05, {R('avg((s>=o)::INT)', 6)} AS p_value FROM sf GROUP BY symbol, b")
def _(spark, sf):
    return out(shuffled(spark, sf), "symbol", "block", observed_sharpe=4, null_sharpe_mean=4, null_sharpe_std=4, null_sharpe_p05=4, p_value=6)


PATHS = BOOT + block_sql("paths", 20) + """, pe AS MATERIALIZED (SELECT *, product(1+x) OVER (PARTITION BY symbol, sim ORDER BY i) AS e FROM dr WHERE n>=60), pq AS MATERIALIZED (SELECT *, e/max(e) OVER (PARTITION BY symbol, sim ORDER BY i)-1 AS dd FROM pe)"""


@query(
    "op_K9_path_bands",
    PATHS + f" SELECT symbol, i AS ord, {', '.join(R(f'quantile_cont(e,{p/100})', 6) + f' AS p{p:02d}' for p in (5, 25, 50, 75, 95))} FROM pq WHERE i%ceil(n/400.0)::BIGINT=0 OR i=n-1 GROUP BY symbol, i",
)
def _(spark, sf):
    return out(rs.simulated_bands(gold_equity(spark, sf), SIMS, 20), "symbol", "ord", p05=6, p25=6, p50=6, p75=6, p95=6)


OUTCOMES = BASE + block_path_sql("paths", 20, least=60)


@query("op_K9_path_outcomes", OUTCOMES + f" SELECT symbol, sim, {R('p.g', 6)} AS terminal, {R('p.dd', 6)} AS maxdd, {REASON(60)} FROM sz LEFT JOIN pt USING (symbol)")
def _(spark, sf):
    return out(rs.path_outcomes(gold_equity(spark, sf), BLOCK_SIMS, 20), "symbol", "sim", "reason", terminal=6, maxdd=6)


@query(
    "op_K10_marker_percentiles",
    OUTCOMES + f", oc AS (SELECT symbol, p.g AS terminal, p.dd AS maxdd FROM pt), om AS (SELECT symbol, {', '.join(f'quantile_cont({c},{p/100}) AS {c}_p{p:02d}' for c in ('terminal', 'maxdd') for p in (5, 50, 95))} FROM oc GROUP BY symbol) SELECT symbol, {', '.join(R(f'{c}_p{p:02d}', 6) + f' AS {c}_p{p:02d}' for c in ('terminal', 'maxdd') for p in (5, 50, 95))}, {REASON(60)} FROM sz LEFT JOIN om USING (symbol)",
)
def _(spark, sf):
    m = rs.outcome_percentiles(gold_equity(spark, sf), BLOCK_SIMS, 20)
    return out(m, "symbol", "reason", **{f"{c}_p{p:02d}": 6 for c in ("terminal", "maxdd") for p in (5, 50, 95)})


STAT_SQL = f""", st0 AS (SELECT n, sim, unnest(generate_series(0,n-1)) AS i FROM sz, (SELECT unnest(generate_series(0,{{sims}}-1)) AS sim)), st1 AS (SELECT *, i=0 OR {U('new', 'sim', 'i')}<1.0/greatest(5.0,sqrt(n)) AS fresh, floor({U('start', 'sim', 'i')}*n)::BIGINT AS s FROM st0),
 st2 AS (SELECT n, sim, i, last_value(CASE WHEN fresh THEN s END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN fresh THEN i END IGNORE NULLS) OVER w AS t FROM st1 WINDOW w AS (PARTITION BY sim ORDER BY i)), sd AS MATERIALIZED (SELECT sim, i, (s+i-t)%n AS idx FROM st2)"""


@query("op_K11_stationary_index", B("lines") + ", sz AS (SELECT count(DISTINCT ts) AS n FROM b)" + STAT_SQL.format(sims=50) + " SELECT sim, i, idx FROM sd")
def _(spark, sf):
    n = bars(spark, sf, "lines").agg(F.count_distinct("ts").alias("n"))
    return out(rs.stationary_draws(n, 50), "sim", "i", "idx")


PAIRS = [(5, 20), (5, 50), (10, 50), (20, 60), (20, 100), (50, 200)]
_PAIR_SQL = " UNION ALL ".join(
    f"SELECT symbol||' × {f}/{s}' AS combo, symbol, ts, ord, open, close, CASE WHEN ({SMA(f)})>({SMA(s)}) THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM b" for f, s in PAIRS
)
EXC_SQL = B("lines") + f", cs AS MATERIALIZED ({_PAIR_SQL})" + g2_sql(0, "cs", name="er", part="combo") + """, ew AS (SELECT combo, avg(weight) AS aw FROM cs GROUP BY combo), ra AS (SELECT combo, ts, r, coalesce(close/lag(close) OVER (PARTITION BY combo ORDER BY ord)-1,0) AS ra FROM er),
 cm AS (SELECT ts FROM b GROUP BY ts HAVING count(DISTINCT symbol)=3), fx AS MATERIALIZED (SELECT combo, ts, r-aw*ra AS f, row_number() OVER (PARTITION BY combo ORDER BY ts)-1 AS idx FROM ra JOIN ew USING (combo) WHERE ts IN (SELECT ts FROM cm))"""
RC_SQL = EXC_SQL + ", sz AS (SELECT count(*) AS n FROM cm)" + STAT_SQL.format(sims=200) + """, fm AS (SELECT combo, avg(f) AS m FROM fx GROUP BY combo), bs AS (SELECT sim, max(s) AS s FROM (SELECT sim, combo, sum(f-m) AS s FROM sd JOIN fx USING (idx) JOIN fm USING (combo) GROUP BY sim, combo) GROUP BY sim),
 vv AS (SELECT s/sqrt(n) AS v, (SELECT max(m) FROM fm)*sqrt(n) AS vo FROM bs, sz)"""


def excess_matrix(spark, sf):
    """ord, combo, f over the common calendar of all symbols and crossover pairs."""

    def make():
        from tidemark.functions import indicators as ind
        from tidemark.operators.calendar import intersect_calendar
        from tidemark.plans.series import on_chunks

        b = bars(spark, sf, "lines")
        ns = sorted({n for p in PAIRS for n in p})
        rich = on_chunks(b, lambda d, c: ind.add_moments(d, c, {f"m{n}": ("close", n, "mean") for n in ns}), back=max(ns))
        sets = F.array(
            *[
                F.struct(
                    F.concat("symbol", F.lit(f" × {f}/{s}")).alias("combo"),
                    F.when(C(f"m{f}") > C(f"m{s}"), 1.0).otherwise(0.0).alias("weight"),
                )
                for f, s in PAIRS
            ]
        )
        d = rich.withColumn("_g", F.explode(sets)).select("symbol", "ts", "ord", "open", "close", "_g.*")
        f = pnl.excess_returns(d, keys=("combo",)).select("combo", "ts", "f")
        cal = intersect_calendar(b).withColumn("_all", F.lit(0))
        cal = with_ordinal(cal, ["_all"], ["ts"], time_bucket()).drop("_all")
        return f.join(cal, "ts")

    return staged_once(spark, (sf, "excess"), make)


@query(
    "op_K12_reality_check",
    RC_SQL + f""" SELECT (SELECT n FROM sz) AS n, (SELECT count(*) FROM fm) AS k, (SELECT arg_max(combo,(m,combo)) FROM fm) AS best_combo, (SELECT count(*) FROM fm WHERE m>0) AS n_positive, (SELECT count(*) FROM fm WHERE m<0) AS n_negative,
 {R('any_value(vo)', 8)} AS v_obs, {R('avg(v)', 8)} AS v_mean, {R('stddev_samp(v)', 8)} AS v_std, {R('quantile_cont(v,0.5)', 8)} AS v_p50, {R('quantile_cont(v,0.95)', 8)} AS v_p95, {R('max(v)', 8)} AS v_max, {R('avg((v>=vo)::INT)', 6)} AS p_value FROM vv""",
)
def _(spark, sf):
    d = rs.reality_check(excess_matrix(spark, sf), 200)
    return out(d, "n", "k", "best_combo", "n_positive", "n_negative", v_obs=8, v_mean=8, v_std=8, v_p50=8, v_p95=8, v_max=8, p_value=6)


@query("op_I7_top_combos", EXC_SQL + f" SELECT combo, {R('avg(f)', 8)} AS mean, {R('avg(f)*252', 6)} AS annualized, row_number() OVER (ORDER BY avg(f) DESC, combo DESC) AS rank FROM fx GROUP BY combo ORDER BY avg(f) DESC LIMIT 5")
def _(spark, sf):
    return out(rs.top_combos(excess_matrix(spark, sf)), "combo", "rank", mean=8, annualized=6)


# Walk-forward on daily lines: two thirds of a year to train, a quarter to test.
WF = dict(train=504, test=252, step=126)
BURN = 60


def wf_sql(src: str = "sg", train: int | str = 504, test: int | str = 252, step: int | str = 126, burn: int = BURN, part: str = "symbol", name: str = "") -> str:
    """Lengths are numbers, or SQL over the columns of `src`. Series shorter than a window have none."""
    k = part
    whole = f"({train})+({test})"
    seg = lambda label, lo, hi: f"SELECT s.*, k+1 AS win, '{label}' AS segment, s.ord-k*({step})-({lo}) AS o FROM {src} s JOIN wn USING ({k}) WHERE s.ord>=k*({step})+({lo}) AND s.ord<k*({step})+({hi})"
    return f""", wn AS (SELECT {k}, unnest(generate_series(0, (n-({whole}))//({step}))) AS k FROM (SELECT {k}, count(*) AS n FROM {src} GROUP BY {k}) WHERE n>={whole}),
 wq AS MATERIALIZED (SELECT * EXCLUDE (ord, o), ord AS bar, o AS ord, {k}||'/'||win||'/'||segment AS key FROM ({seg('IS', 0, train)} UNION ALL {seg('OOS', f'({train})-{burn}', whole)} UNION ALL {seg('BM', train, whole)})), wl AS (SELECT * FROM wq WHERE segment<>'BM')""" + g2_sql(0, "wl", name="wv", part="key") + f""",
 wa AS (SELECT *, coalesce(close/lag(close) OVER w-1,0) AS ra, abs(weight-lag(weight) OVER w) AS dw FROM wq WHERE segment='BM' WINDOW w AS (PARTITION BY key ORDER BY ord)), wm AS (SELECT key, greatest(-1,least(1,avg(weight))) AS aw, coalesce(avg(dw),0)*0.0006 AS cst FROM wa GROUP BY key HAVING avg(abs(weight))>1e-9),
 wc0 AS (SELECT {k}, win, segment, bar, ts, ord-(CASE segment WHEN 'OOS' THEN {burn} ELSE 0 END) AS ord, r FROM wv UNION ALL SELECT {k}, win, segment, bar, ts, ord, aw*ra-cst FROM wa JOIN wm USING (key)),
 wc AS MATERIALIZED (SELECT * EXCLUDE (r), CASE WHEN ord>0 THEN r END AS r, product(CASE WHEN ord>0 THEN 1+r ELSE 1 END) OVER w AS equity FROM wc0 WHERE ord>=0 WINDOW w AS (PARTITION BY {k}, win, segment ORDER BY ord)),
 wd AS MATERIALIZED (SELECT *, equity/max(equity) OVER w-1 AS dd FROM wc WINDOW w AS (PARTITION BY {k}, win, segment ORDER BY ord)),
 wp AS (SELECT {k}, count(*)/({DAYS}/365.25) AS ppy FROM {src} GROUP BY {k}),
 ws AS MATERIALIZED (SELECT {k}, win, segment, min(ts) AS st, max(ts) AS en, count(*) AS bars, min(dd) AS maxdd, avg(r)/nullif(stddev_samp(r),0)*sqrt(any_value(ppy)) AS sharpe, pow(arg_max(equity,ord)/arg_min(equity,ord), 1/({DAYS}/365.25))-1 AS cagr FROM wd JOIN wp USING ({k}) GROUP BY {k}, win, segment),
 wt AS MATERIALIZED (SELECT {k}, win AS "window", any_value(st) FILTER (segment='IS') AS is_start, any_value(en) FILTER (segment='IS') AS is_end, any_value(st) FILTER (segment='OOS') AS oos_start, any_value(en) FILTER (segment='OOS') AS oos_end, any_value(bars) FILTER (segment='IS') AS is_bars, any_value(bars) FILTER (segment='OOS') AS oos_bars,
  {', '.join(f"any_value({c}) FILTER (segment='{s}') AS {n}_{c}" for s, n in (('IS', 'is'), ('OOS', 'oos'), ('BM', 'oos_benchmark')) for c in ('sharpe', 'cagr', 'maxdd'))} FROM ws GROUP BY {k}, win),
 wz AS MATERIALIZED (SELECT *, oos_sharpe-oos_benchmark_sharpe AS oos_excess_sharpe, oos_cagr-oos_benchmark_cagr AS oos_excess_cagr FROM wt)"""


def chain_sql(segment: str, name: str, step: int = 126, k: str = "symbol") -> str:
    return f""", {name}0 AS (SELECT {k}, ts, r AS x, row_number() OVER (PARTITION BY {k}, ts ORDER BY win) AS rn FROM wd WHERE segment='{segment}' AND ord>0 AND ord<={step}), {name}1 AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts)-1 AS ord FROM {name}0 WHERE rn=1),
 {name}2 AS (SELECT *, product(1+x) OVER (PARTITION BY {k} ORDER BY ord) AS equity FROM {name}1), {name}3 AS (SELECT *, CASE WHEN ord>0 THEN x END AS r, equity/max(equity) OVER (PARTITION BY {k} ORDER BY ord)-1 AS dd FROM {name}2),
 {name} AS (SELECT {k}, count(*) AS bars, min(dd) AS maxdd, avg(r)/nullif(stddev_samp(r),0)*sqrt(any_value(ppy)) AS sharpe, pow(arg_max(equity,ord)/arg_min(equity,ord), 1/({DAYS}/365.25))-1 AS cagr FROM {name}3 JOIN wp USING ({k}) GROUP BY {k} HAVING count(*)>=3)"""


WFQ = B("lines") + GOLD + wf_sql()


# Every series, with the reason where it holds no window.
WN_SQL = f", wi AS (SELECT symbol, count(*) AS n_bars, CASE WHEN count(*)<{WF['train'] + WF['test']} THEN '{wf.SHORT}' END AS reason FROM sg GROUP BY symbol)"


def wf_counts(spark, sf):
    return wf.window_counts(gold(spark, sf, "lines"), **WF)


def wf_curves(spark, sf):
    return staged_once(spark, (sf, "wf"), lambda: wf.walk_forward(gold(spark, sf, "lines"), **WF, burn_in=BURN))


@query("op_K13_walk_forward_windows", WFQ + WN_SQL + ' SELECT symbol, win AS "window", segment, min(bar) AS first_bar, max(bar) AS last_bar, count(bar) AS bars, any_value(reason) AS reason FROM wi LEFT JOIN wq USING (symbol) GROUP BY symbol, win, segment')
def _(spark, sf):
    rows = wf.window_rows(gold(spark, sf, "lines"), **WF, burn_in=BURN)
    slices = rows.groupBy("symbol", "window", "segment").agg(F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"), F.count(F.lit(1)).alias("bars"))
    every = wf_counts(spark, sf).select("symbol", "reason").join(slices, "symbol", "left")
    return every.withColumn("bars", F.coalesce("bars", F.lit(0)))


_SEG = [f"{s}_{c}" for s in ("is", "oos", "oos_benchmark") for c in ("sharpe", "cagr", "maxdd")]


@query("op_K14_window_metrics", WFQ + f' SELECT symbol, "window", {", ".join(R(c) + f" AS {c}" for c in _SEG)} FROM wz')
def _(spark, sf):
    t = wf.windows_table(wf_curves(spark, sf), gold(spark, sf, "lines"))
    return out(t, "symbol", "window", **{c: 4 for c in _SEG})


AGG_SQL = """, ag AS (SELECT KEYCOL, count(*) AS n_windows, count(oos_sharpe) AS n_oos_clean, avg(is_sharpe) AS mean_is_sharpe, avg(oos_sharpe) AS mean_oos_sharpe, median(oos_sharpe) AS median_oos_sharpe, CASE WHEN count(oos_sharpe)>1 THEN stddev_samp(oos_sharpe) ELSE 0 END AS std_oos_sharpe, min(oos_sharpe) AS min_oos_sharpe, max(oos_sharpe) AS max_oos_sharpe,
 count(*) FILTER (oos_sharpe>0)/count(oos_sharpe) AS pct_positive_oos, avg(oos_excess_sharpe) AS mean_excess_sharpe, median(oos_excess_sharpe) AS median_excess_sharpe, count(*) FILTER (oos_excess_sharpe>0)/nullif(count(oos_excess_sharpe),0) AS pct_positive_excess FROM wz GROUP BY KEYCOL),
 ag2 AS (SELECT *, CASE WHEN abs(mean_is_sharpe)>1e-9 THEN mean_oos_sharpe/mean_is_sharpe END AS degradation_ratio FROM ag), ag3 AS (SELECT *, coalesce(degradation_ratio>=0.5 AND mean_oos_sharpe>0 AND pct_positive_oos>=0.5, false) AS robust FROM ag2)"""
_AGG = ["mean_is_sharpe", "mean_oos_sharpe", "median_oos_sharpe", "std_oos_sharpe", "min_oos_sharpe", "max_oos_sharpe", "pct_positive_oos", "mean_excess_sharpe", "median_excess_sharpe", "pct_positive_excess", "degradation_ratio"]


@query("op_K15_walk_forward_aggregate", WFQ + WN_SQL + AGG_SQL.replace("KEYCOL", "symbol") + f" SELECT symbol, n_bars, reason, coalesce(n_windows,0) AS n_windows, coalesce(n_oos_clean,0) AS n_oos_clean, coalesce(robust,false) AS robust, {', '.join(R(c) + f' AS {c}' for c in _AGG)} FROM wi LEFT JOIN ag3 USING (symbol)")
def _(spark, sf):
    t = wf.aggregate_windows(wf.windows_table(wf_curves(spark, sf), gold(spark, sf, "lines")))
    t = wf.with_short_series(t, wf_counts(spark, sf))
    return out(t, "symbol", "n_bars", "reason", "n_windows", "n_oos_clean", "robust", **{c: 4 for c in _AGG})


CHAIN = AGG_SQL.replace("KEYCOL", "symbol") + chain_sql("OOS", "ch") + chain_sql("BM", "cb")


@query(
    "op_K16_chained_oos",
    WFQ + WN_SQL + CHAIN + f""" SELECT symbol, reason, ch.bars AS chained_bars, {R('ch.sharpe')} AS chained_sharpe, {R('ch.cagr', 6)} AS chained_cagr, {R('ch.maxdd', 6)} AS chained_maxdd, {R('ch.sharpe-cb.sharpe')} AS chained_excess_sharpe, {R('ch.cagr-cb.cagr', 6)} AS chained_excess_cagr, coalesce(ch.sharpe-cb.sharpe>0.2,false) AS has_edge, coalesce(robust,false) AS robust FROM wi LEFT JOIN ag3 USING (symbol) LEFT JOIN ch USING (symbol) LEFT JOIN cb USING (symbol)""",
)
def _(spark, sf):
    s = wf.walk_forward_summary(wf_curves(spark, sf), gold(spark, sf, "lines"), WF["step"])
    s = wf.with_short_series(s, wf_counts(spark, sf))
    return out(s, "symbol", "reason", "chained_bars", "has_edge", "robust", chained_sharpe=4, chained_cagr=6, chained_maxdd=6, chained_excess_sharpe=4, chained_excess_cagr=6)


@query(
    "op_K17_windows_table",
    WFQ + f""", tc AS (SELECT symbol, win AS "window", count(*) FILTER (p IS DISTINCT FROM pp)-1 AS oos_n_trades FROM (SELECT *, lag(p) OVER (PARTITION BY key ORDER BY ord) AS pp FROM (SELECT *, coalesce(lag(weight) OVER (PARTITION BY key ORDER BY ord),0) AS p FROM wq WHERE segment='BM')) GROUP BY symbol, win)
 SELECT symbol, "window", {ISO('is_start')} AS is_start, {ISO('is_end')} AS is_end, {ISO('oos_start')} AS oos_start, {ISO('oos_end')} AS oos_end, is_bars, oos_bars, {R('oos_excess_sharpe')} AS oos_excess_sharpe, {R('oos_excess_cagr', 6)} AS oos_excess_cagr, oos_n_trades, oos_n_trades<5 AS low_confidence FROM wz JOIN tc USING (symbol, "window")""",
)
def _(spark, sf):
    b = gold(spark, sf, "lines")
    t = wf.windows_table(wf_curves(spark, sf), b)
    n = wf.oos_trade_counts(wf.window_rows(b, **WF, burn_in=BURN))
    t = t.join(n, ["symbol", "window"]).withColumn("low_confidence", C("oos_n_trades") < 5)
    return out(t, "symbol", "window", "is_start", "is_end", "oos_start", "oos_end", "is_bars", "oos_bars", "oos_n_trades", "low_confidence", oos_excess_sharpe=4, oos_excess_cagr=6)


_V = "symbol, fast, slow, mode, filter, buffer"
SCREEN_SQL = B("lines") + variant_sql(fast=tuple(sig.FAST_PERIODS), slow=tuple(sig.SLOW_PERIODS)) + f""", v1 AS (SELECT *, coalesce(lag(weight) OVER w,0) AS p, coalesce(lag(weight,2) OVER w,0) AS q, coalesce(close/lag(close) OVER w-1,0) AS ra FROM vw WINDOW w AS (PARTITION BY {_V} ORDER BY ord)),
 v2 AS (SELECT {_V}, ts, ord, p<>q OR ord=0 AS mv, p*ra-abs(p-q)*0.0006 AS r FROM v1), v3 AS (SELECT *, product(1+r) OVER (PARTITION BY {_V} ORDER BY ord) AS e FROM v2), v4 AS (SELECT *, e/max(e) OVER (PARTITION BY {_V} ORDER BY ord)-1 AS dd FROM v3),
 v5 AS (SELECT {_V}, count(*) FILTER (mv) AS approx_trades, min(dd) AS mdd, arg_max(e,ord) AS g, avg(r) AS m, stddev_samp(r) AS sd, (epoch_us(max(ts))-epoch_us(min(ts)))/1e6/(365.2425*86400) AS years, count(*) AS n FROM v4 GROUP BY ALL),
 v6 AS MATERIALIZED (SELECT {_V}, approx_trades, {R('g-1', 6)} AS total_return, {R('pow(g,1/years)-1', 6)} AS cagr, {R('CASE WHEN sd>1e-12 THEN m/sd*sqrt((n-1)/years) END', 6)} AS sharpe, {R('CASE WHEN mdd<0 THEN (pow(g,1/years)-1)/abs(mdd) END', 6)} AS calmar, {R('mdd', 6)} AS max_drawdown FROM v5)"""


def screened(spark, sf, digits: int = 6):
    """All 2 960 variants per series, rounded so that equal variants tie exactly."""

    def make():
        s = sw.screen_variants(bars(spark, sf, "lines"), sig.FAST_PERIODS, sig.SLOW_PERIODS, sig.MODES, sig.FILTERS, sig.BUFFERS)
        return s.withColumns({c: rnd(c, digits) for c in ("total_return", "cagr", "sharpe", "calmar", "max_drawdown")})

    return staged_once(spark, (sf, "screen"), make)


@query("op_K18_screening_sweep", SCREEN_SQL + f" SELECT {_V}, approx_trades, total_return, cagr, sharpe, calmar, max_drawdown FROM v6")
def _(spark, sf):
    return screened(spark, sf).select(*_V.split(", "), "approx_trades", "total_return", "cagr", "sharpe", "calmar", "max_drawdown")


def RANK(x: str, part: str = "symbol") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST)+(count({x}) OVER (PARTITION BY {part}, {x})-1)/2)/count({x}) OVER (PARTITION BY {part}) END"


SCORE_SQL = SCREEN_SQL + f", sc AS (SELECT *, 0.4*({RANK('sharpe')})+0.25*({RANK('calmar')})+0.2*({RANK('cagr')})+0.15*({RANK('(-max_drawdown)')}) AS score FROM v6 WHERE approx_trades>=10)"


@query("op_I1_percentile_score", SCORE_SQL + f" SELECT {_V}, {R('score', 8)} AS score FROM sc")
def _(spark, sf):
    s = rk.score(screened(spark, sf).filter("approx_trades >= 10"), rk.SCREEN_SCORE)
    return out(s, *_V.split(", "), score=8)


@query("op_I2_sample_filter", SCREEN_SQL + f" SELECT {_V}, approx_trades, approx_trades<20 AS low_sample FROM v6 WHERE approx_trades>=10")
def _(spark, sf):
    return rk.with_sample_flags(screened(spark, sf).filter("approx_trades >= 10"), "approx_trades").select(*_V.split(", "), "approx_trades", "low_sample")


@query(
    "op_I3_top_per_dataset",
    SCORE_SQL + f", so AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY floor(score*1e9+0.5) DESC, sharpe DESC, cagr DESC, fast, slow, mode, filter, buffer) AS rank FROM sc) SELECT {_V}, rank FROM so WHERE rank<=10",
)
def _(spark, sf):
    s = rk.score(screened(spark, sf).filter("approx_trades >= 10"), rk.SCREEN_SCORE)
    order = [F.floor(C("score") * 1e9 + 0.5).desc(), F.desc("sharpe"), F.desc("cagr"), "fast", "slow", "mode", "filter", "buffer"]
    return rk.top_per_group(s, ["symbol"], order, 10).select(*_V.split(", "), "rank")


FULL_SQL = B("lines") + variant_sql(fast=tuple(sig.FAST_PERIODS), slow=tuple(sig.SLOW_PERIODS)) + f""", f0 AS (SELECT {_V}, ts, ord, open, weight, coalesce(lag(weight) OVER k,0) AS position, coalesce(lag(weight,2) OVER k,0) AS old, lag(close) OVER k AS pc, close, lead(ts) OVER k AS fts, lead(open) OVER k AS no FROM vw WINDOW k AS (PARTITION BY {_V} ORDER BY ord)),
 fr AS MATERIALIZED (SELECT {_V}, ts, ord, weight-position AS dw, fts, no, coalesce((1+old*(open/pc-1))*(1+position*(close/open-1)-abs(position-old)*0.0006)-1,0) AS r FROM f0),
 f1 AS (SELECT {_V}, ts, ord, r, product(1+r) OVER (PARTITION BY {_V} ORDER BY ord) AS equity FROM fr), f2 AS (SELECT *, equity/max(equity) OVER (PARTITION BY {_V} ORDER BY ord)-1 AS dd FROM f1),
 f3 AS (SELECT {_V}, avg(r) FILTER (ord>0)/nullif(stddev_samp(r) FILTER (ord>0),0)*sqrt(252.0) AS sharpe, {CAGR} AS cagr, min(dd) AS mdd FROM f2 GROUP BY {_V}),
 fl AS MATERIALIZED (SELECT concat_ws('/',{_V}) AS symbol, fts AS ts, dw AS qty, no*(CASE WHEN dw>0 THEN 1.0005 ELSE 0.9995 END) AS price, abs(dw)*no*(CASE WHEN dw>0 THEN 1.0005 ELSE 0.9995 END)*1e-4 AS commission, row_number() OVER (PARTITION BY {_V} ORDER BY fts)-1 AS ord FROM fr WHERE dw<>0 AND fts IS NOT NULL)""" + TRADE_SQL + f""",
 tm AS (SELECT symbol AS key, count(*) AS num_trades, CASE WHEN coalesce(sum(pnl) FILTER (pnl<=0),0)<>0 THEN coalesce(sum(pnl) FILTER (pnl>0),0)/abs(sum(pnl) FILTER (pnl<=0)) WHEN sum(pnl) FILTER (pnl>0)>0 THEN 1e9 ELSE 0 END AS pf, count(*) FILTER (pnl>0)/count(*) AS wr FROM tr GROUP BY symbol),
 f4 AS MATERIALIZED (SELECT {_V}, {R('sharpe', 6)} AS sharpe, {R('cagr', 6)} AS cagr, {R('CASE WHEN mdd<0 THEN cagr/abs(mdd) END', 6)} AS calmar, coalesce(num_trades,0) AS num_trades, {R('pf', 6)} AS profit_factor, {R('wr', 6)} AS win_rate FROM f3 LEFT JOIN tm ON tm.key=concat_ws('/',{_V}))"""


def full(spark, sf):
    """All 2 960 variants per series, net of costs at the next open."""

    def make():
        m = sw.sweep_variants(bars(spark, sf, "lines"), sig.FAST_PERIODS, sig.SLOW_PERIODS, sig.MODES, sig.FILTERS, sig.BUFFERS)
        m = m.withColumn("profit_factor", F.when(C("profit_factor") > 1e9, 1e9).otherwise(C("profit_factor")))
        return m.withColumns({c: rnd(c, 6) for c in ("sharpe", "cagr", "calmar", "profit_factor", "win_rate")})

    return staged_once(spark, (sf, "full"), make)


@query("op_K19_full_sweep", FULL_SQL + f" SELECT {_V}, sharpe, cagr, calmar, num_trades, profit_factor, win_rate, {R('0.4*(' + RANK('sharpe') + ')+0.25*(' + RANK('calmar') + ')+0.2*(' + RANK('cagr') + ')+0.15*(' + RANK('profit_factor') + ')', 8)} AS research_score, num_trades<20 AS low_sample FROM f4")
def _(spark, sf):
    r = sw.rank_full(full(spark, sf))
    return out(r, *_V.split(", "), "sharpe", "cagr", "calmar", "num_trades", "profit_factor", "win_rate", "low_sample", research_score=8)


# The thresholds and triples of the two walk-forward sweeps.
THRESH = [0.005, 0.008, 0.010, 0.012, 0.015, 0.018, 0.020, 0.022, 0.025, 0.030, 0.035, 0.040]
RSI_N, BB_N, BB_K = [6, 14], [20, 50, 100, 200], [1.5, 2.0, 2.5]
#: Train, test and step in bars by timeframe: years on days, hundreds of half hours.
LENGTHS = {"1D": (756, 252, 126), "30m": (400, 200, 100)}
VARIANTS = [{"rule": "vwap_reversion", "threshold": t, "rsi_length": None, "bb_length": None, "bb_mult": None} for t in THRESH] + [
    {"rule": "bollinger_rsi", "threshold": None, "rsi_length": float(r), "bb_length": float(n), "bb_mult": k} for r in RSI_N for n in BB_N for k in BB_K
]
_TP = "(high+low+close)/3"
_K = "key0"
_LEN = lambda i: "CASE WHEN key0 LIKE '1D/%' THEN " + str(LENGTHS["1D"][i]) + " ELSE " + str(LENGTHS["30m"][i]) + " END"
_RSI_LONG = " UNION ALL ".join(f"SELECT symbol, ord, {n} AS rn, {RSI('g', 'l', 100.0)} AS rsi FROM e{n}" for n in RSI_N)
_BB_LONG = " UNION ALL ".join(f"SELECT symbol, ord, {n} AS n, {SMA(n)} AS mid, {SD(n, pop=True)} AS sd FROM b" for n in BB_N)
K20_SQL = f"""WITH RECURSIVE {ctes('lines', 'lb')}, {ctes('events', 'vb')}, b AS MATERIALIZED (SELECT '1D/'||symbol AS symbol, ts, ord, open, high, low, close, volume FROM lb UNION ALL SELECT '30m/'||symbol, ts, ord, open, high, low, close, volume FROM vb)""" + PRE + "".join(
    ", " + EMA(f"e{n}", "pre", {"g": ("gain", wi(n), n), "l": ("loss", wi(n), n)}) for n in RSI_N
) + f""", rl AS MATERIALIZED ({_RSI_LONG}), bl AS MATERIALIZED ({_BB_LONG}), i AS (SELECT *, sum({_TP}*volume) OVER w/sum(volume) OVER w AS v FROM b {W_SQL}),
 db AS (SELECT b.symbol, b.ts, b.ord, b.open, b.close, rn, n, k, rsi, mid-k*sd AS lo, mid+k*sd AS up FROM b JOIN rl USING (symbol, ord) JOIN bl USING (symbol, ord), (SELECT unnest({BB_K}::DOUBLE[]) AS k)),
 ds AS (SELECT *, CASE WHEN rsi<50 AND lag(rsi) OVER w>=50 AND close<up AND lag(close) OVER w>=lag(up) OVER w THEN -1.0 WHEN rsi>50 AND lag(rsi) OVER w<=50 AND close>lo AND lag(close) OVER w<=lag(lo) OVER w THEN 1.0 END AS state FROM db WINDOW w AS (PARTITION BY symbol, rn, n, k ORDER BY ord)),
 sg AS MATERIALIZED (SELECT symbol||'/'||'v/'||th AS key0, ts, ord, open, close, CASE WHEN (close-v)/v<-th THEN 1.0 WHEN (close-v)/v>th THEN -1.0 ELSE 0.0 END::DOUBLE AS weight FROM i, (SELECT unnest({THRESH}::DOUBLE[]) AS th)
  UNION ALL SELECT symbol||'/b/'||rn||'/'||n||'/'||k, ts, ord, open, close, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY symbol, rn, n, k ORDER BY ord), 0.0)::DOUBLE FROM ds)"""
K20_SQL += wf_sql(train=_LEN(0), test=_LEN(1), step=_LEN(2), part=_K)
K20_SQL += AGG_SQL.replace("KEYCOL", _K) + chain_sql("OOS", "ch", k=_K, step=f"({_LEN(2)})") + chain_sql("BM", "cb", k=_K, step=f"({_LEN(2)})") + f""",
 lc AS (SELECT key0, count(*) FILTER (t<5) AS n_low FROM (SELECT key0, win, count(*) FILTER (p IS DISTINCT FROM pp)-1 AS t FROM (SELECT *, lag(p) OVER (PARTITION BY key ORDER BY ord) AS pp FROM (SELECT *, coalesce(lag(weight) OVER (PARTITION BY key ORDER BY ord),0) AS p FROM wq WHERE segment='BM')) GROUP BY key0, win) GROUP BY key0),
 k20 AS MATERIALIZED (SELECT split_part(key0,'/',1) AS timeframe, split_part(key0,'/',2) AS symbol, CASE split_part(key0,'/',3) WHEN 'v' THEN 'vwap_reversion' ELSE 'bollinger_rsi' END AS rule, CASE WHEN split_part(key0,'/',3)='v' THEN split_part(key0,'/',4)::DOUBLE END AS threshold,
  CASE WHEN split_part(key0,'/',3)='b' THEN split_part(key0,'/',4)::DOUBLE END AS rsi_length, CASE WHEN split_part(key0,'/',3)='b' THEN split_part(key0,'/',5)::DOUBLE END AS bb_length, CASE WHEN split_part(key0,'/',3)='b' THEN split_part(key0,'/',6)::DOUBLE END AS bb_mult,
  coalesce(n_windows,0) AS n_windows, {R('mean_is_sharpe')} AS mean_is_sharpe, {R('mean_oos_sharpe')} AS mean_oos_sharpe, {R('degradation_ratio', 3)} AS degradation_ratio, coalesce(robust,false) AS robust, coalesce(n_low,0) AS n_low_confidence,
  {R('ch.sharpe')} AS chained_sharpe, {R('ch.cagr', 6)} AS chained_cagr, {R('ch.maxdd', 6)} AS chained_maxdd, {R('cb.sharpe')} AS chained_benchmark_sharpe, {R('ch.sharpe-cb.sharpe')} AS chained_excess_sharpe, coalesce(ch.sharpe-cb.sharpe>0.2,false) AS has_edge, CASE WHEN n_windows IS NULL THEN 'shorter than one window' END AS reason
  FROM (SELECT DISTINCT key0 FROM sg) LEFT JOIN ag3 USING (key0) LEFT JOIN ch USING (key0) LEFT JOIN cb USING (key0) LEFT JOIN lc USING (key0))"""
_KEYS20 = ("timeframe", "symbol", "rule", "threshold", "rsi_length", "bb_length", "bb_mult")
_ORDER20 = ("chained_excess_sharpe DESC", "symbol", "rule", "threshold", "rsi_length", "bb_length", "bb_mult")


def wf_sweep(spark, sf):
    """Both rules at all parameters over daily and half-hour bars."""

    def make():
        both = None
        for name, kind in (("1D", "lines"), ("30m", "events")):
            b = bars(spark, sf, kind)
            d = sig.vwap_reversion_grid(b, THRESH).withColumnRenamed("weights", "_first")
            d = sig.bollinger_rsi_grid(d, RSI_N, BB_N, BB_K)
            d = d.select(F.lit(name).alias("timeframe"), "symbol", "ts", "ord", "open", "close", F.concat("_first", "weights").alias("weights"))
            both = d if both is None else both.unionByName(d)
        s = wf.sweep_walk_forward(stage(both, "sweep-weights"), LENGTHS, VARIANTS)
        four = ("mean_is_sharpe", "mean_oos_sharpe", "chained_sharpe", "chained_benchmark_sharpe", "chained_excess_sharpe")
        return s.withColumns({c: rnd(c, 4) for c in four} | {"degradation_ratio": rnd("degradation_ratio", 3), "chained_cagr": rnd("chained_cagr", 6), "chained_maxdd": rnd("chained_maxdd", 6)})

    return staged_once(spark, (sf, "wfsweep"), make)


_COLS20 = (*_KEYS20, "n_windows", "mean_is_sharpe", "mean_oos_sharpe", "degradation_ratio", "robust", "n_low_confidence", "chained_sharpe", "chained_cagr", "chained_maxdd", "chained_benchmark_sharpe", "chained_excess_sharpe", "has_edge", "reason")


@query("op_K20_walk_forward_sweep", K20_SQL + f" SELECT {', '.join(_COLS20)} FROM k20")
def _(spark, sf):
    return wf_sweep(spark, sf).select(*_COLS20)


@query("op_I4_best_per_asset", K20_SQL + f" SELECT {', '.join(_KEYS20)}, chained_excess_sharpe FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY chained_excess_sharpe DESC, timeframe, {', '.join(_ORDER20[2:])}) AS r FROM k20 WHERE chained_excess_sharpe IS NOT NULL) WHERE r=1")
def _(spark, sf):
    s = wf_sweep(spark, sf).filter(C("chained_excess_sharpe").isNotNull())
    order = [F.desc("chained_excess_sharpe"), "timeframe", "rule", *[F.asc_nulls_last(c) for c in _KEYS20[3:]]]
    return rk.top_per_group(s, ["symbol"], order, 1).select(*_KEYS20, "chained_excess_sharpe")


@query("op_I4_top_per_timeframe", K20_SQL + f" SELECT {', '.join(_KEYS20)}, chained_excess_sharpe, rank FROM (SELECT *, row_number() OVER (PARTITION BY timeframe ORDER BY {', '.join(_ORDER20)}) AS rank FROM k20 WHERE chained_excess_sharpe IS NOT NULL) WHERE rank<=10")
def _(spark, sf):
    s = wf_sweep(spark, sf).filter(C("chained_excess_sharpe").isNotNull())
    order = [F.desc("chained_excess_sharpe"), "symbol", "rule", *[F.asc_nulls_last(c) for c in _KEYS20[3:]]]
    return rk.top_per_group(s, ["timeframe"], order, 10).select(*_KEYS20, "chained_excess_sharpe", "rank")


SLIPS = [0, 2, 5, 10, 20, 50]
_COST = ", ".join(f"({s},{(1 + s) / 1e4!r})" for s in SLIPS)


@query(
    "op_K21_cost_sensitivity",
    B() + GOLD + f", cg AS MATERIALIZED (SELECT symbol||'/'||slip AS key, sg.*, slip, rate FROM sg, (VALUES {_COST}) t(slip, rate))" + g2_sql(0, "cg", rate="rate", name="cr", part="key") + f""", c1 AS (SELECT *, product(1+r) OVER (PARTITION BY key ORDER BY ord) AS equity FROM cr)
 SELECT symbol, slip::DOUBLE AS slippage_bps, {R('arg_max(equity,ord)/arg_min(equity,ord)-1', 6)} AS total_return, {R('avg(r) FILTER (ord>0)/nullif(stddev_samp(r) FILTER (ord>0),0)*sqrt(252.0)')} AS sharpe FROM c1 GROUP BY symbol, slip""",
)
def _(spark, sf):
    return out(sw.cost_sensitivity(gold(spark, sf)), "symbol", "slippage_bps", total_return=6, sharpe=4)


@query(
    "op_K23_excess_summary",
    EQ + SAME_SQL + f""", b1 AS (SELECT *, product(1+r) OVER w AS equity FROM bm {W_SQL}), b2 AS (SELECT *, equity/max(equity) OVER w-1 AS dd, CASE WHEN ord>0 THEN r END AS rr FROM b1 {W_SQL}), s AS (SELECT symbol, avg(r)/nullif(stddev_samp(r),0)*sqrt(252.0) AS sharpe, {CAGR} AS cagr, min(drawdown) AS mdd FROM eq GROUP BY symbol),
 t AS (SELECT symbol, avg(rr)/nullif(stddev_samp(rr),0)*sqrt(252.0) AS sharpe, {CAGR} AS cagr, min(dd) AS mdd FROM b2 GROUP BY symbol) SELECT symbol, {R('s.sharpe-t.sharpe')} AS excess_sharpe, {R('s.cagr-t.cagr', 6)} AS excess_cagr, {R('s.mdd', 6)} AS strategy_maxdd, {R('t.mdd', 6)} AS benchmark_maxdd,
 CASE WHEN s.sharpe-t.sharpe>0.3 THEN 'substantial' WHEN s.sharpe-t.sharpe>0.1 THEN 'modest' WHEN s.sharpe-t.sharpe>0 THEN 'marginal' ELSE 'none' END AS class FROM s JOIN t USING (symbol)""",
)
def _(spark, sf):
    b = equity_scan(pnl.same_exposure_benchmark(gold(spark, sf))).withColumn("r", F.when(C("ord") > 0, C("r")))
    s = met.core_metrics(gold_equity(spark, sf)).select("symbol", "sharpe", "cagr", C("max_drawdown").alias("strategy_maxdd"))
    t = met.core_metrics(b).select("symbol", C("sharpe").alias("bs"), C("cagr").alias("bc"), C("max_drawdown").alias("benchmark_maxdd"))
    j = s.join(t, "symbol").withColumns({"excess_sharpe": C("sharpe") - C("bs"), "excess_cagr": C("cagr") - C("bc")})
    return out(j.withColumn("class", rk.excess_class(C("excess_sharpe"))), "symbol", "class", excess_sharpe=4, excess_cagr=6, strategy_maxdd=6, benchmark_maxdd=6)


@query("op_I5_best_block", SHUFFLE + f", bp AS (SELECT symbol, b, floor(avg((s>=o)::INT)*1e6+0.5)/1e6 AS p FROM sf GROUP BY symbol, b) SELECT symbol, arg_min(b,(p,b)) AS block, min(p) AS p_value FROM bp GROUP BY symbol")
def _(spark, sf):
    s = shuffled(spark, sf).withColumn("p", rnd("p_value", 6))
    return s.groupBy("symbol").agg(F.min_by("block", F.struct("p", "block")).alias("block"), F.min("p").alias("p_value")).select(
        "symbol", C("block").cast("long").alias("block"), "p_value"
    )


@query("op_I6_p_value_class", SHUFFLE + ", bp AS (SELECT symbol, b AS block, avg((s>=o)::INT) AS p FROM sf GROUP BY symbol, b) SELECT symbol, block, CASE WHEN p<0.01 THEN 'strong' WHEN p<0.05 THEN 'sig' WHEN p<0.1 THEN 'marginal' ELSE 'no' END AS class FROM bp")
def _(spark, sf):
    return out(shuffled(spark, sf).withColumn("class", rk.p_class(C("p_value"))), "symbol", "block", "class")


# The same three over all block sizes, with enough shuffles to tell the classes apart. Ties of the SQL's sums differ in the last digits.
ALL_BLOCKS, SHUFFLES = [2, 5, 20, 40, 80, 160], 100
SIZES_SQL = SHUFFLE.replace(str(BLOCKS), str(ALL_BLOCKS)).replace("generate_series(0,5)", f"generate_series(0,{SHUFFLES - 1})")
SIZES_P = ", bp AS (SELECT symbol, b, floor(avg((s>=o-1e-9)::INT)*1e6+0.5)/1e6 AS p FROM sf GROUP BY symbol, b)"


def shuffled_sizes(spark, sf):
    return staged_once(spark, (sf, "shuffle-sizes"), lambda: rs.signal_block_shuffle(gold(spark, sf), ALL_BLOCKS, SHUFFLES))


@query("op_K8_signal_block_shuffle_sizes", SIZES_SQL + f" SELECT symbol, b AS block, {R('any_value(o)')} AS observed_sharpe, {R('avg(s)')} AS null_sharpe_mean, {R('stddev_pop(s)')} AS null_sharpe_std, {R('quantile_cont(s,0.05)')} AS null_sharpe_p05, {R('avg((s>=o-1e-9)::INT)', 6)} AS p_value FROM sf GROUP BY symbol, b")
def _(spark, sf):
    return out(shuffled_sizes(spark, sf), "symbol", "block", observed_sharpe=4, null_sharpe_mean=4, null_sharpe_std=4, null_sharpe_p05=4, p_value=6)


@query("op_I5_best_block_sizes", SIZES_SQL + SIZES_P + " SELECT symbol, arg_min(b,(p,b)) AS block, min(p) AS p_value FROM bp GROUP BY symbol")
def _(spark, sf):
    s = shuffled_sizes(spark, sf).withColumn("p", rnd("p_value", 6))
    return s.groupBy("symbol").agg(F.min_by("block", F.struct("p", "block")).cast("long").alias("block"), F.min("p").alias("p_value"))


@query("op_I6_p_value_class_sizes", SIZES_SQL + SIZES_P + " SELECT symbol, b AS block, CASE WHEN p<0.01 THEN 'strong' WHEN p<0.05 THEN 'sig' WHEN p<0.1 THEN 'marginal' ELSE 'no' END AS class FROM bp")
def _(spark, sf):
    s = shuffled_sizes(spark, sf).withColumn("class", rk.p_class(rnd("p_value", 6)))
    return out(s, "symbol", "block", "class")


@query("op_I8_downsample", B() + ", n AS (SELECT symbol, count(*) AS n FROM b GROUP BY symbol) SELECT symbol, ord, " + R("close") + " AS close FROM b JOIN n USING (symbol) WHERE ord%ceil(n/100.0)::BIGINT=0 OR ord=n-1")
def _(spark, sf):
    b = bars(spark, sf)
    sizes = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return out(rk.every_kth(b, sizes, 100), "symbol", "ord", close=4)
