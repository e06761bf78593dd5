"""Rolling, recursive and path-dependent series functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import B, ISO, R, ROLL, W_SQL, bars, out, query
from catalog.sqlfrag import EMA, PRE, RSI, SD, SMA, sp, wi
from tidemark.functions import indicators as ind
from tidemark.functions.ewm import ewm, ewm_reach, span_alpha, wilder_alpha
from tidemark.operators import drawdown as dd
from tidemark.operators import returns as ret
from tidemark.operators import rolling as rol
from tidemark.operators import signals as sig
from tidemark.plans.series import on_chunks, scan

C = F.col
KEYED = f"symbol, {ISO('ts')} AS ts"


@query("op_E1_sma", B() + f" SELECT {KEYED}, {R(SMA(20))} AS sma20, {R(SMA(60))} AS sma60 FROM b")
def _(spark, sf):
    d = on_chunks(bars(spark, sf), lambda d, c: ind.add_moments(d, c, {f"sma{n}": ("close", n, "mean") for n in (20, 60)}), back=60)
    return out(d, "symbol", "ts", sma20=4, sma60=4)


@query(
    "op_E2_ema",
    B(recursive=True) + ", " + EMA("e", "b", {"ema12": ("close", sp(12), 12), "ema200": ("close", sp(200), 200)})
    + f" SELECT {KEYED}, {R('ema12')} AS ema12, {R('ema200')} AS ema200 FROM b JOIN e USING (symbol, ord)",
)
def _(spark, sf):
    specs = {f"ema{n}": ("close", span_alpha(n), n) for n in (12, 200)}
    d = on_chunks(bars(spark, sf), lambda d, c: ewm(d, c, specs), back=ewm_reach(span_alpha(200)))
    return out(d, "symbol", "ts", ema12=4, ema200=4)


@query(
    "op_E3_wilder",
    B(recursive=True) + ", " + EMA("e", "b", {"w14": ("close", wi(14), 14)}) + f" SELECT {KEYED}, {R('w14')} AS w14 FROM b JOIN e USING (symbol, ord)",
)
def _(spark, sf):
    d = on_chunks(bars(spark, sf), lambda d, c: ewm(d, c, {"w14": ("close", wilder_alpha(14), 14)}), back=ewm_reach(wilder_alpha(14)))
    return out(d, "symbol", "ts", w14=4)


@query(
    "op_E4_rsi",
    B(recursive=True) + PRE + ", " + EMA("e", "pre", {"g": ("gain", wi(14), 14), "l": ("loss", wi(14), 14)})
    + f" SELECT {KEYED}, {R(RSI('g','l'))} AS rsi FROM b JOIN e USING (symbol, ord)",
)
def _(spark, sf):
    d = on_chunks(bars(spark, sf), lambda d, c: sig.add_rsi(d, c, "rsi", 14), back=sig.reach((wilder_alpha(14), 14)))
    return out(d, "symbol", "ts", rsi=4)


@query(
    "op_E5_rsi_no_loss_100",
    B(recursive=True) + PRE + ", " + EMA("e", "pre", {"g": ("gain", wi(6), 6), "l": ("loss", wi(6), 6)})
    + f" SELECT {KEYED}, {R(RSI('g','l',100.0))} AS rsi FROM b JOIN e USING (symbol, ord)",
)
def _(spark, sf):
    d = on_chunks(bars(spark, sf), lambda d, c: sig.add_rsi(d, c, "rsi", 6, 100.0), back=sig.reach((wilder_alpha(6), 6)))
    return out(d, "symbol", "ts", rsi=4)


def _bands(population):
    def run(spark, sf):
        def build(d, c):
            lo, mid, up = ind.bollinger(c, "close", 20, 2.0, population)
            return d.withColumns({"lower": lo, "mid": mid, "upper": up})

        return out(on_chunks(bars(spark, sf), build, back=20), "symbol", "ts", lower=4, mid=4, upper=4)

    return run


for _name, _pop in (("op_E6_bollinger", False), ("op_E7_bollinger_population", True)):
    query(
        _name,
        B() + f", i AS (SELECT *, {SMA(20)} AS mid, {SD(20, pop=_pop)} AS sd FROM b) SELECT {KEYED}, {R('mid-2*sd')} AS lower, {R('mid')} AS mid, {R('mid+2*sd')} AS upper FROM i",
    )(_bands(_pop))


@query(
    "op_E8_atr_wilder",
    B(recursive=True) + PRE + ", " + EMA("e", "pre", {"atr": ("tr", wi(14), 14)}) + f" SELECT symbol, {ISO('ts')} AS ts, {R('tr')} AS tr, {R('atr')} AS atr FROM pre JOIN e USING (symbol, ord)",
)
def _(spark, sf):
    def build(d, c):
        return sig.add_atr(d.withColumn("tr", ind.true_range(c)), c, "atr")

    return out(on_chunks(bars(spark, sf), build, back=sig.reach((wilder_alpha(14), 14))), "symbol", "ts", tr=4, atr=4)


@query("op_E9_atr_simple", B() + PRE + f" SELECT {KEYED}, {R(SMA(14, 'tr'))} AS atr FROM pre")
def _(spark, sf):
    return out(on_chunks(bars(spark, sf), lambda d, c: sig.add_atr_simple(d, c, "atr"), back=15), "symbol", "ts", atr=4)


@query("op_E10_donchian", B() + f" SELECT {KEYED}, {R(ROLL('min({x})','low',20))} AS lower, {R(ROLL('max({x})','high',20))} AS upper FROM b")
def _(spark, sf):
    def build(d, c):
        lo, up = ind.donchian(c, 20)
        return d.withColumns({"lower": lo, "upper": up})

    return out(on_chunks(bars(spark, sf), build, back=20), "symbol", "ts", lower=4, upper=4)


@query(
    "op_E11_macd",
    B(recursive=True) + ", " + EMA("e", "b", {"f": ("close", sp(12), 12), "s": ("close", sp(26), 26)})
    + ", ln AS (SELECT symbol, ord, f-s AS line FROM e), " + EMA("g", "ln", {"sg": ("line", sp(9), 9)})
    + f" SELECT {KEYED}, {R('line')} AS macd, {R('sg')} AS macd_signal, {R('line-sg')} AS macd_hist FROM b JOIN ln USING (symbol, ord) JOIN g USING (symbol, ord)",
)
def _(spark, sf):
    d = on_chunks(bars(spark, sf), sig.add_macd, back=sig.reach((span_alpha(26), 26), (span_alpha(9), 9)))
    return out(d, "symbol", "ts", macd=4, macd_signal=4, macd_hist=4)


@query("op_E12_zscore", B() + f", i AS (SELECT *, {SMA(20)} AS m, {SD(20)} AS sd FROM b) SELECT {KEYED}, {R('(close-m)/nullif(sd,0)')} AS z FROM i")
def _(spark, sf):
    return out(on_chunks(bars(spark, sf), lambda d, c: d.withColumn("z", ind.zscore(c, "close", 20)), back=20), "symbol", "ts", z=4)


@query("op_E13_roc", B() + f" SELECT {KEYED}, {R('close/lag(close,20) OVER w-1',6)} AS roc FROM b {W_SQL}")
def _(spark, sf):
    return out(on_chunks(bars(spark, sf), lambda d, c: d.withColumn("roc", ind.roc(c, "close", 20)), back=20), "symbol", "ts", roc=6)


ADX_SQL = (
    ", dm AS MATERIALIZED (SELECT *, high-lag(high) OVER w AS up, lag(low) OVER w-low AS dn FROM pre "
    + W_SQL
    + "), dmx AS MATERIALIZED (SELECT *, CASE WHEN up>dn AND up>0 THEN up ELSE 0 END AS pdm, CASE WHEN dn>up AND dn>0 THEN dn ELSE 0 END AS mdm FROM dm), "
    + EMA("di0", "dmx", {"trw": ("tr", wi(14), 14), "pw": ("pdm", wi(14), 14), "mw": ("mdm", wi(14), 14)})
    + ", di AS MATERIALIZED (SELECT symbol, ord, 100*pw/nullif(trw,0) AS plus_di, 100*mw/nullif(trw,0) AS minus_di FROM di0)"
    + ", dxx AS MATERIALIZED (SELECT *, 100*abs(plus_di-minus_di)/nullif(plus_di+minus_di,0) AS dx FROM di), "
    + EMA("ax", "dxx", {"adx": ("dx", wi(14), 14)})
)


@query(
    "op_E14_adx",
    B(recursive=True) + PRE + ADX_SQL + f" SELECT {KEYED}, {R('adx')} AS adx, {R('plus_di')} AS plus_di, {R('minus_di')} AS minus_di FROM b JOIN di USING (symbol, ord) JOIN ax USING (symbol, ord)",
)
def _(spark, sf):
    d = on_chunks(bars(spark, sf), sig.add_adx, back=sig.reach((wilder_alpha(14), 14), (wilder_alpha(14), 14)))
    return out(d, "symbol", "ts", adx=4, plus_di=4, minus_di=4)


_TP = "(high+low+close)/3"


@query("op_E15_cumulative_vwap", B() + f" SELECT {KEYED}, {R(f'sum({_TP}*volume) OVER w/sum(volume) OVER w')} AS vwap FROM b {W_SQL}")
def _(spark, sf):
    d = scan(bars(spark, sf), {"pv": ("sum", ind.typical_price() * C("volume")), "v": ("sum", "volume")})
    return out(d.withColumn("vwap", C("pv") / C("v")), "symbol", "ts", vwap=4)


def _rolling_vwap(d, c, n=20):
    d = d.withColumn("_pv", ind.typical_price() * C("volume"))
    return d.withColumn("vwap", ind.rolling(c, "_pv", n, F.sum) / F.nullif(ind.rolling(c, "volume", n, F.sum), F.lit(0.0)))


VWAP_SQL = f", rv AS MATERIALIZED (SELECT *, {ROLL('sum({x})', f'({_TP}*volume)', 20)}/nullif({ROLL('sum({x})', 'volume', 20)},0) AS vwap FROM pre)"


@query("op_E16_rolling_vwap", B() + PRE + VWAP_SQL + f" SELECT {KEYED}, {R('vwap')} AS vwap FROM rv")
def _(spark, sf):
    return out(on_chunks(bars(spark, sf), _rolling_vwap, back=20), "symbol", "ts", vwap=4)


@query(
    "op_E17_deviation_in_atr",
    B(recursive=True) + PRE + VWAP_SQL + ", " + EMA("e", "pre", {"atr": ("tr", wi(20), 20)}) + f" SELECT {KEYED}, {R('(close-vwap)/nullif(atr,0)')} AS dev FROM rv JOIN e USING (symbol, ord)",
)
def _(spark, sf):
    def build(d, c):
        d = sig.add_atr(_rolling_vwap(d, c), c, "atr", 20)
        return d.withColumn("dev", (C("close") - C("vwap")) / F.nullif("atr", F.lit(0.0)))

    return out(on_chunks(bars(spark, sf), build, back=sig.reach((wilder_alpha(20), 20))), "symbol", "ts", dev=4)


@query(
    "op_E18_state_ffill",
    B() + f", s AS (SELECT *, CASE WHEN close<501 THEN 0.0 WHEN close>520 THEN 1.0 END AS state FROM b) SELECT {KEYED}, coalesce(last_value(state IGNORE NULLS) OVER w,0.0)::DOUBLE AS weight FROM s {W_SQL}",
)
def _(spark, sf):
    d = bars(spark, sf).withColumn("state", sig.states([(C("close") > 520, 1.0), (C("close") < 501, 0.0)]))
    return out(sig.hold(d), "symbol", "ts", "weight")


@query("op_E19_returns", B() + f" SELECT {KEYED}, {R('close/lag(close) OVER w-1',6)} AS r FROM b {W_SQL}")
def _(spark, sf):
    return out(ret.asset_returns(bars(spark, sf)), "symbol", "ts", r=6)


RET = f", r AS MATERIALIZED (SELECT *, close/lag(close) OVER w-1 AS r FROM b {W_SQL})"


@query("op_E20_compounding", B() + RET + f" SELECT {KEYED}, {R('exp(sum(ln(1+coalesce(r,0)/2)) OVER w)')} AS growth FROM r {W_SQL}")
def _(spark, sf):
    d = ret.asset_returns(bars(spark, sf)).withColumn("h", C("r") / 2)
    return out(ret.compounded_growth(d, "h"), "symbol", "ts", growth=4)


@query("op_E21_running_drawdown", B() + f" SELECT {KEYED}, {R('max(close) OVER w')} AS peak, {R('close/max(close) OVER w-1',6)} AS drawdown FROM b {W_SQL}")
def _(spark, sf):
    return out(dd.running_drawdown(bars(spark, sf), "close"), "symbol", "ts", peak=4, drawdown=6)


_PPY = "sqrt(252.0)"


@query(
    "op_E22_rolling_volatility",
    B() + RET + f" SELECT {KEYED}, {R(SD(21, 'r') + ' * ' + _PPY)} AS vol_21, {R(SD(63, 'r') + ' * ' + _PPY)} AS vol_63, {R(SD(252, 'r') + ' * ' + _PPY)} AS vol_252 FROM r",
)
def _(spark, sf):
    return out(rol.rolling_volatility(ret.asset_returns(bars(spark, sf))), "symbol", "ts", vol_21=4, vol_63=4, vol_252=4)


VAR_SQL = RET + f", q AS MATERIALIZED (SELECT *, {ROLL('quantile_cont({x},0.05)', 'r', 252)} AS var, CASE WHEN count(r) OVER f>=252 THEN list(r) OVER f END AS fr FROM r WINDOW f AS (PARTITION BY symbol ORDER BY ord ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))"


@query("op_E23_rolling_var", B() + VAR_SQL + f" SELECT {KEYED}, {R('var', 6)} AS var FROM q")
def _(spark, sf):
    return out(rol.rolling_var(ret.asset_returns(bars(spark, sf))), "symbol", "ts", var=6)


@query("op_E24_rolling_cvar", B() + VAR_SQL + f" SELECT {KEYED}, {R('list_avg(list_filter(fr, lambda x: x<=var))', 6)} AS cvar FROM q")
def _(spark, sf):
    return out(rol.rolling_var(ret.asset_returns(bars(spark, sf))), "symbol", "ts", cvar=6)


@query(
    "op_E25_rolling_tail_ratio",
    B() + RET + f", q AS (SELECT *, {ROLL('quantile_cont({x},0.95)', 'r', 252)} AS hi, {ROLL('quantile_cont({x},0.05)', 'r', 252)} AS lo FROM r) SELECT {KEYED}, {R('hi/nullif(abs(lo),0)')} AS tail_ratio FROM q",
)
def _(spark, sf):
    return out(rol.rolling_tail_ratio(ret.asset_returns(bars(spark, sf))), "symbol", "ts", tail_ratio=4)


@query("op_E26_rolling_sharpe", B() + RET + f" SELECT {KEYED}, {R('(' + SMA(126, 'r') + ')/nullif(' + SD(126, 'r') + ',0)*' + _PPY)} AS sharpe FROM r")
def _(spark, sf):
    return out(rol.rolling_sharpe(ret.asset_returns(bars(spark, sf))), "symbol", "ts", sharpe=4)


@query(
    "op_E27_rolling_cagr",
    B("lines") + f" SELECT {KEYED}, {R('pow(close/lag(close,252) OVER w, 1.0)-1', 6)} AS cagr_252, {R('pow(close/lag(close,756) OVER w, 252.0/756)-1', 6)} AS cagr_756 FROM b {W_SQL}",
)
def _(spark, sf):
    return out(rol.rolling_cagr(bars(spark, sf, "lines"), "close"), "symbol", "ts", cagr_252=6, cagr_756=6)


_PAIR = """, mk AS (SELECT ts, avg(r) AS bb FROM r WHERE r IS NOT NULL GROUP BY ts),
 y AS (SELECT symbol, ts, r AS s, bb, row_number() OVER (PARTITION BY symbol ORDER BY ts)-1 AS ord FROM r JOIN mk USING (ts) WHERE r IS NOT NULL)"""


@query(
    "op_E28_rolling_beta",
    B("lines") + RET + _PAIR + f", z AS (SELECT *, CASE WHEN count(s) OVER f>=252 THEN covar_samp(s,bb) OVER f/var_samp(bb) OVER f END AS beta FROM y WINDOW f AS (PARTITION BY symbol ORDER BY ord ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) SELECT {KEYED}, {R('beta', 6)} AS beta FROM z",
)
def _(spark, sf):
    from tidemark.plans.series import time_bucket, with_ordinal

    r = ret.asset_returns(bars(spark, sf, "lines"))
    market = r.groupBy("ts").agg(F.avg("r").alias("b"))
    pair = r.select("symbol", "ts", C("r").alias("s")).join(market, "ts").dropna()
    pair = with_ordinal(pair, ["symbol"], ["ts"], time_bucket())
    return out(rol.rolling_beta(pair), "symbol", "ts", beta=6)


REGIME_SQL = RET + f""", v AS MATERIALIZED (SELECT *, {ROLL('stddev_samp({x})', 'r', 63, 21)} AS vol FROM r),
 qq AS (SELECT symbol, quantile_cont(vol,1.0/3) AS q33, quantile_cont(vol,2.0/3) AS q67 FROM v GROUP BY symbol HAVING count(vol)>=30),
 lb AS MATERIALIZED (SELECT symbol, ts, ord, r, vol, CASE WHEN vol>=q67 THEN 'high' WHEN vol<=q33 THEN 'low' ELSE 'mid' END AS regime FROM v JOIN qq USING (symbol) WHERE vol IS NOT NULL)"""


@query("op_E29_regime_label", B() + REGIME_SQL + f" SELECT {KEYED}, regime FROM lb")
def _(spark, sf):
    return out(dd.regime_labels(ret.asset_returns(bars(spark, sf))), "symbol", "ts", "regime")


@query(
    "op_E30_regime_runs",
    B() + REGIME_SQL + f""", ch AS (SELECT *, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER w THEN 1 ELSE 0 END AS nw FROM lb {W_SQL}), g AS (SELECT *, sum(nw) OVER w AS run FROM ch {W_SQL})
 SELECT symbol, any_value(regime) AS label, {ISO('min(ts)')} AS start_ts, {ISO('max(ts)')} AS end_ts, count(*) AS bars FROM g GROUP BY symbol, run""",
)
def _(spark, sf):
    labels = dd.regime_labels(ret.asset_returns(bars(spark, sf)))
    return out(dd.runs_of(labels, C("regime")), "symbol", "label", "start_ts", "end_ts", "bars")


EPISODE_SQL = f""", pk AS (SELECT *, max(close) OVER w AS peak FROM b {W_SQL}), rn AS (SELECT *, close/peak-1 AS dd, sum(CASE WHEN close>=peak THEN 1 ELSE 0 END) OVER w AS run FROM pk {W_SQL}),
 ep AS (SELECT symbol, run, min(ts) AS start_ts, count(*) FILTER (close<peak) AS bars, min(dd) FILTER (close<peak) AS depth, min_by(ts, (dd, ord)) FILTER (close<peak) AS trough_ts, max(ts) AS last_ts FROM rn GROUP BY symbol, run),
 ep2 AS (SELECT *, lead(start_ts) OVER (PARTITION BY symbol ORDER BY run) AS recovery_ts FROM ep)"""


@query(
    "op_E31_drawdown_episodes",
    B() + EPISODE_SQL + f""" SELECT symbol, {ISO('start_ts')} AS start_ts, {ISO('trough_ts')} AS trough_ts, {ISO('recovery_ts')} AS recovery_ts, bars, {R('depth',6)} AS depth,
 floor((epoch_us(recovery_ts)-epoch_us(trough_ts))/86400000000)::DOUBLE AS duration_days, floor((epoch_us(recovery_ts)-epoch_us(start_ts))/86400000000)::DOUBLE AS total_days FROM ep2 WHERE bars>0""",
)
def _(spark, sf):
    e = dd.drawdown_episodes(bars(spark, sf), "close")
    e = e.withColumns({c: C(c).cast("double") for c in ("duration_days", "total_days")})
    return out(e, "symbol", "start_ts", "trough_ts", "recovery_ts", "bars", "duration_days", "total_days", depth=6)


@query(
    "op_E32_longest_underwater",
    B() + EPISODE_SQL + " SELECT symbol, max(bars) AS max_drawdown_duration_bars, max(CASE WHEN bars>0 THEN (epoch_us(last_ts)-epoch_us(start_ts)) ELSE 0 END)/86400000000.0 AS max_drawdown_duration_days FROM ep2 GROUP BY symbol",
)
def _(spark, sf):
    return out(dd.longest_underwater(bars(spark, sf), "close"), "symbol", "max_drawdown_duration_bars", "max_drawdown_duration_days")


@query(
    "op_E33_streaks",
    B() + f""", p AS (SELECT *, sign(close-open)::DOUBLE AS s FROM b), ch AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER w THEN 1 ELSE 0 END AS nw FROM p {W_SQL}), g AS (SELECT *, sum(nw) OVER w AS run FROM ch {W_SQL})
 SELECT symbol, any_value(s) AS sign, {ISO('min(ts)')} AS start_ts, count(*) AS length FROM g GROUP BY symbol, run HAVING any_value(s)<>0""",
)
def _(spark, sf):
    d = bars(spark, sf).withColumn("pnl", C("close") - C("open"))
    return out(dd.streaks(d), "symbol", "sign", "start_ts", "length")


POS_SQL = f", p AS (SELECT *, CASE WHEN close>open THEN 1.0 WHEN close<open THEN -0.5 ELSE 0.0 END AS weight FROM b), ps AS MATERIALIZED (SELECT *, coalesce(lag(weight) OVER w, 0) AS position FROM p {W_SQL})"


def positions(spark, sf):
    w = F.when(C("close") > C("open"), 1.0).when(C("close") < C("open"), -0.5).otherwise(0.0)
    return bars(spark, sf).withColumn("weight", w)


@query("op_E34_lag_position", B() + POS_SQL + f" SELECT {KEYED}, position::DOUBLE AS position FROM ps")
def _(spark, sf):
    d = on_chunks(positions(spark, sf), lambda d, c: d.withColumn("position", c.lag("weight", 1, 0.0)), back=1)
    return out(d, "symbol", "ts", "position")


@query("op_E35_turnover", B() + POS_SQL + f" SELECT {KEYED}, {R('abs(position-coalesce(lag(position) OVER w,0))')} AS turnover FROM ps {W_SQL}")
def _(spark, sf):
    def build(d, c):
        d = d.withColumn("position", c.lag("weight", 1, 0.0))
        return d.withColumn("turnover", F.abs(C("position") - c.lag("position", 1, 0.0)))

    return out(on_chunks(positions(spark, sf), build, back=2), "symbol", "ts", turnover=4)


@query("op_E36_slope", B() + f", i AS (SELECT *, {SMA(50)} AS m FROM b) SELECT {KEYED}, {R('m-lag(m) OVER w')} AS slope FROM i {W_SQL}")
def _(spark, sf):
    def build(d, c):
        d = ind.add_moments(d, c, {"_m": ("close", 50, "mean")})
        return d.withColumn("slope", C("_m") - c.lag("_m"))

    return out(on_chunks(bars(spark, sf), build, back=51), "symbol", "ts", slope=4)


@query(
    "op_E37_expanding_quantile",
    B() + PRE + f", a AS MATERIALIZED (SELECT *, {SMA(14, 'tr')} AS atr FROM pre), l AS MATERIALIZED (SELECT *, lag(atr) OVER w AS cur FROM a {W_SQL}), ev AS (SELECT * FROM l WHERE close>515 AND cur IS NOT NULL)"
    + f""" SELECT ev.symbol, {ISO('ev.ts')} AS ts, count(*) AS n, bool_and(ev.cur >= q) AS at_or_above FROM (SELECT ev.symbol, ev.ord, quantile_cont(a.atr,0.5) AS q, count(a.atr) AS n FROM ev JOIN a ON a.symbol=ev.symbol AND a.ord<ev.ord AND a.atr IS NOT NULL GROUP BY ALL) z
 JOIN ev USING (symbol, ord) WHERE n>=50 GROUP BY ALL""".replace("count(*) AS n,", "any_value(z.n) AS n,"),
)
def _(spark, sf):
    from tidemark.operators.orb import above_expanding_quantile

    def build(d, c):
        d = sig.add_atr_simple(d, c, "atr")
        return d.withColumn("cur", c.lag("atr"))

    a = on_chunks(bars(spark, sf), build, back=16).select("symbol", "ts", "ord", "close", "atr", "cur")
    e = above_expanding_quantile(a, C("close") > 515, "atr", "cur", 0.5, 50)
    return out(e, "symbol", "ts", "n", "at_or_above")


@query("op_E38_value_before_event", B() + PRE + f", a AS (SELECT *, {SMA(14, 'tr')} AS atr FROM pre), l AS (SELECT *, lag(atr) OVER w AS cur FROM a {W_SQL}) SELECT {KEYED}, {R('cur')} AS atr_before FROM l WHERE close>515")
def _(spark, sf):
    def build(d, c):
        d = sig.add_atr_simple(d, c, "_atr")
        return d.withColumn("atr_before", c.lag("_atr"))

    return out(on_chunks(bars(spark, sf), build, back=16).filter("close > 515"), "symbol", "ts", atr_before=4)


@query("op_E39_cumulative_return", B() + f" SELECT {KEYED}, {R('close/first_value(close) OVER w-1',6)} AS cum FROM b {W_SQL}")
def _(spark, sf):
    return out(ret.cumulative_return(bars(spark, sf), "close"), "symbol", "ts", cum=6)
