"""Signal rules and session profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import B, ISO, ROLL, W_SQL, bars, ctes, out, query
from catalog.d_alignment import ALIGN_SQL, SNAP_SQL
from catalog.e_windows import ADX_SQL, KEYED, VWAP_SQL
from catalog.sqlfrag import EMA, HOLD, PRE, RSI, SD, SMA, sp, wi
from tidemark.operators import orb
from tidemark.operators import quality as qa
from tidemark.operators import signals as sig
from tidemark.operators.calendar import align_ffill, ny_time

C = F.col
REC = B(recursive=True)
_NOTE_SELECT = f" SELECT {KEYED}, weight::DOUBLE AS weight FROM sig"


def rule(name, fn, sql):
    query(name, sql + _NOTE_SELECT)(lambda spark, sf: out(fn(bars(spark, sf)), "symbol", "ts", "weight"))


def cross_sql(kind, fast, slow, short):
    if kind == "sma":
        i = f", i AS (SELECT *, {SMA(fast)} AS f, {SMA(slow)} AS s FROM b)"
        head = B()
    else:
        i = ", " + EMA("e", "b", {"f": ("close", sp(fast), fast), "s": ("close", sp(slow), slow)}) + ", i AS (SELECT * FROM b JOIN e USING (symbol, ord))"
        head = REC
    return head + i + f", sig AS (SELECT *, CASE WHEN f>s THEN 1.0 {'WHEN f<s THEN -1.0' if short else ''} ELSE 0.0 END AS weight FROM i)"


rule("op_F0_buy_hold", sig.buy_hold, B() + ", sig AS (SELECT *, 1.0 AS weight FROM b)")
GOLD_SQL = cross_sql("sma", 50, 200, False)
rule("op_F1_golden_cross", sig.golden_cross, GOLD_SQL)
# F1a is F1 with its default periods; b to e are the exponential variants.
for _tag, _f, _s in (("b", 50, 200), ("c", 30, 100), ("d", 20, 60), ("e", 10, 50)):
    rule(f"op_F1{_tag}_ema_{_f}_{_s}", lambda b, f=_f, s=_s: sig.golden_cross(b, f, s, "ema"), cross_sql("ema", _f, _s, False))
rule("op_F1a_sma_50_200", lambda b: sig.golden_cross(b, 50, 200, "sma"), GOLD_SQL)
rule("op_F2_ema_cross", sig.ema_cross, cross_sql("ema", 12, 26, True))
rule(
    "op_F3_rsi_meanrev",
    sig.rsi_meanrev,
    REC + PRE + ", " + EMA("e", "pre", {"g": ("gain", wi(2), 2), "l": ("loss", wi(2), 2)})
    + f", i AS (SELECT b.*, {RSI('g', 'l')} AS rsi, {SMA(200)} AS t FROM b JOIN e USING (symbol, ord)), st AS (SELECT *, CASE WHEN rsi>70 THEN 0.0 WHEN rsi<10 AND close>t THEN 1.0 END AS state FROM i)" + HOLD("st"),
)
rule(
    "op_F4_bollinger_meanrev",
    sig.bollinger_meanrev,
    B() + f", i AS (SELECT *, {SMA(20)} AS m, {SD(20)} AS sd FROM b), st AS (SELECT *, CASE WHEN close>m THEN 0.0 WHEN close<m-2*sd THEN 1.0 END AS state FROM i)" + HOLD("st"),
)
rule(
    "op_F5_donchian_breakout",
    sig.donchian_breakout,
    B() + f", i AS (SELECT *, {ROLL('max({x})', 'high', 20)} AS up, {ROLL('min({x})', 'low', 10)} AS dn FROM b), st AS (SELECT *, CASE WHEN close<lag(dn) OVER w THEN 0.0 WHEN close>lag(up) OVER w THEN 1.0 END AS state FROM i {W_SQL})" + HOLD("st"),
)
rule(
    "op_F6_macd_cross",
    sig.macd_cross,
    REC + ", " + EMA("e", "b", {"f": ("close", sp(12), 12), "s": ("close", sp(26), 26)}) + ", ln AS (SELECT symbol, ord, f-s AS line FROM e), " + EMA("g", "ln", {"sg": ("line", sp(9), 9)})
    + ", sig AS (SELECT b.*, CASE WHEN line<sg THEN -1.0 WHEN line>sg THEN 1.0 ELSE 0.0 END AS weight FROM b JOIN ln USING (symbol, ord) JOIN g USING (symbol, ord))",
)
rule("op_F7_absolute_momentum", sig.absolute_momentum, B() + f", sig AS (SELECT *, CASE WHEN close/lag(close,252) OVER w-1>0 THEN 1.0 ELSE 0.0 END AS weight FROM b {W_SQL})")
rule(
    "op_F8_atr_breakout",
    sig.atr_breakout,
    REC + PRE + ", " + EMA("e", "pre", {"m": ("close", sp(20), 20), "a": ("tr", wi(14), 14)})
    + ", st AS (SELECT b.*, CASE WHEN close<=m+1.5*a AND close>=m-1.5*a THEN 0.0 WHEN close<m-1.5*a THEN -1.0 WHEN close>m+1.5*a THEN 1.0 END AS state FROM b JOIN e USING (symbol, ord))" + HOLD("st"),
)
rule(
    "op_F9_zscore_meanrev",
    sig.zscore_meanrev,
    B() + f", i AS (SELECT *, (close-({SMA(20)}))/nullif({SD(20)},0) AS z FROM b), st AS (SELECT *, CASE WHEN abs(z)<0.5 THEN 0.0 WHEN z>2 THEN -1.0 WHEN z<-2 THEN 1.0 END AS state FROM i)" + HOLD("st"),
)
rule(
    "op_F10_roc_momentum",
    sig.roc_momentum,
    B() + f", i AS (SELECT *, close/lag(close,60) OVER w-1 AS m FROM b {W_SQL}), sig AS (SELECT *, CASE WHEN m<-0.02 THEN -1.0 WHEN m>0.02 THEN 1.0 ELSE 0.0 END AS weight FROM i)",
)
_TP = "(high+low+close)/3"
rule(
    "op_F24_vwap_reversion",
    sig.vwap_reversion,
    B() + f", i AS (SELECT *, sum({_TP}*volume) OVER w/sum(volume) OVER w AS v FROM b {W_SQL}), sig AS (SELECT *, CASE WHEN (close-v)/v<-0.015 THEN 1.0 WHEN (close-v)/v>0.015 THEN -1.0 ELSE 0.0 END AS weight FROM i)",
)
DOUBLE_SQL = (
    REC + PRE + ", " + EMA("e", "pre", {"g": ("gain", wi(6), 6), "l": ("loss", wi(6), 6)})
    + f", i AS (SELECT b.*, {RSI('g', 'l', 100.0)} AS rsi, ({SMA(100)})-1*({SD(100, pop=True)}) AS lo, ({SMA(100)})+1*({SD(100, pop=True)}) AS up FROM b JOIN e USING (symbol, ord)), st AS (SELECT *, CASE WHEN rsi<50 AND lag(rsi) OVER w>=50 AND close<up AND lag(close) OVER w>=lag(up) OVER w THEN -1.0"
    + f" WHEN rsi>50 AND lag(rsi) OVER w<=50 AND close>lo AND lag(close) OVER w<=lag(lo) OVER w THEN 1.0 END AS state FROM i {W_SQL})"
    + HOLD("st")
)
rule("op_F25a_bollinger_rsi_double", lambda b: sig.bollinger_rsi_double(b, n=100, k=1.0), DOUBLE_SQL)

PULL_SQL = REC + PRE + ADX_SQL + ", " + EMA(
    "e", "pre", {"f": ("close", sp(50), 50), "s": ("close", sp(200), 200), "p": ("close", sp(20), 20), "g": ("gain", wi(14), 14), "l": ("loss", wi(14), 14), "a": ("tr", wi(14), 14)}
) + f""", i AS (SELECT b.symbol, b.ts, b.ord, close AS c, high AS h, low AS lw, e.* EXCLUDE (symbol, ord), {RSI('g', 'l')} AS rsi, plus_di, minus_di, adx FROM b JOIN e USING (symbol, ord) JOIN di USING (symbol, ord) JOIN ax USING (symbol, ord)),
 en AS MATERIALIZED (SELECT *, CASE WHEN f>s AND c>s AND plus_di>minus_di AND adx>25 AND abs(c-p)/p<=NEAR AND c>p AND rsi>50 AND lag(rsi) OVER w<=50 THEN 1
  WHEN f<s AND c<s AND minus_di>plus_di AND adx>25 AND abs(c-p)/p<=NEAR AND c<p AND rsi<50 AND lag(rsi) OVER w>=50 THEN -1 ELSE 0 END AS enter FROM i {W_SQL}),
 fold AS (SELECT symbol, ord, 0 AS pos, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS best FROM en WHERE ord=0
  UNION ALL SELECT symbol, ord, CASE WHEN go<>0 THEN go ELSE p1 END, CASE WHEN go<>0 THEN c ELSE entry END, CASE WHEN go=1 THEN h WHEN go=-1 THEN lw ELSE bst END FROM (
   SELECT *, CASE WHEN a IS NOT NULL AND p1=0 THEN enter ELSE 0 END AS go FROM (
    SELECT *, CASE WHEN a IS NULL OR pos=0 THEN pos WHEN pos=1 AND (c<=entry-1.5*a OR c<=bst-2*a OR c<s) THEN 0 WHEN pos=-1 AND (c>=entry+1.5*a OR c>=bst+2*a OR c>s) THEN 0 ELSE pos END AS p1 FROM (
     SELECT n.symbol, n.ord, n.c, n.h, n.lw, n.a, n.s, n.enter, f.pos, f.entry, CASE WHEN n.a IS NULL OR f.pos=0 THEN f.best WHEN f.pos=1 THEN greatest(f.best,n.h) ELSE least(f.best,n.lw) END AS bst FROM fold f JOIN en n ON n.symbol=f.symbol AND n.ord=f.ord+1)))),
 sig AS (SELECT symbol, ts, ord, pos AS weight FROM fold JOIN b USING (symbol, ord))"""
rule("op_F15_trend_pullback_4h", lambda b: sig.trend_pullback(b, 0.005), PULL_SQL.replace("NEAR", "0.005"))
rule("op_F16_trend_pullback_1h", lambda b: sig.trend_pullback(b, 0.003), PULL_SQL.replace("NEAR", "0.003"))

FADE_SQL = REC + PRE + VWAP_SQL + ", " + EMA("e", "pre", {"a": ("tr", wi(20), 20)}) + """, en AS MATERIALIZED (SELECT symbol, ord, close AS c, a, (close-vwap)/nullif(a,0) AS dev FROM rv JOIN e USING (symbol, ord)),
 fold AS (SELECT symbol, ord, 0 AS pos, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS risk, 0 AS held FROM en WHERE ord=0
  UNION ALL SELECT symbol, ord, CASE WHEN pos=0 THEN go WHEN leave THEN 0 ELSE pos END, CASE WHEN pos=0 AND go<>0 THEN c ELSE entry END, CASE WHEN pos=0 AND go<>0 THEN a ELSE risk END, CASE WHEN pos=0 THEN 0 ELSE held+1 END FROM (
   SELECT n.symbol, n.ord, n.c, n.a, f.pos, f.entry, f.risk, f.held, CASE WHEN n.dev>1.5 THEN -1 WHEN n.dev<-1.5 THEN 1 ELSE 0 END AS go,
    coalesce((CASE WHEN f.risk>0 THEN f.pos*(f.entry-n.c)/f.risk ELSE 0 END)>=3.0, false) OR f.held+1>=10 OR coalesce(f.pos*n.dev>=0, false) AS leave FROM fold f JOIN en n ON n.symbol=f.symbol AND n.ord=f.ord+1)),
 sig AS (SELECT symbol, ts, ord, pos AS weight FROM fold JOIN b USING (symbol, ord))"""
rule("op_F25b_vwap_refined", sig.vwap_refined, FADE_SQL)

query("op_K1_keyed_fold", FADE_SQL.replace(REC, B("orders", recursive=True)) + _NOTE_SELECT)(
    lambda spark, sf: out(sig.vwap_refined(bars(spark, sf, "orders")), "symbol", "ts", "weight")
)

# Opening ranges on half-hour bars: the window holds six bars of 30 minutes.
SESSION = dict(start="08:00", end="11:00", cutoff="15:30", bars_needed=6, zone=None, bar_minutes=30)


def orb_cte(start: str = "08:00", end: str = "11:00", needed: int = 6) -> str:
    return f""", t AS (SELECT *, strftime((ts),'%Y-%m-%d') AS day, strftime((ts),'%H:%M') AS hm FROM b), tr AS (SELECT *, greatest(high-low, abs(high-lag(close) OVER w), abs(low-lag(close) OVER w)) AS tr FROM t {W_SQL}),
 at0 AS (SELECT *, {SMA(14, 'tr')} AS atr FROM tr), x AS MATERIALIZED (SELECT *, lag(atr) OVER w AS cur FROM at0 {W_SQL}),
 rg AS (SELECT symbol, day, max(high) AS oh, min(low) AS ol FROM x WHERE hm>='{start}' AND hm<'{end}' GROUP BY symbol, day HAVING count(*)={needed}),
 po AS (SELECT x.*, oh, ol, row_number() OVER (PARTITION BY symbol, day ORDER BY ord) AS pos FROM x JOIN rg USING (symbol, day) WHERE hm>='{end}'),
 br AS (SELECT * FROM (SELECT *, CASE WHEN close>oh THEN 1 ELSE -1 END AS dir, row_number() OVER (PARTITION BY symbol, day ORDER BY ord) AS k FROM po WHERE (close>oh OR close<ol) AND oh>ol) WHERE k=1 AND hm<='15:30')"""


ORB_CTE = orb_cte()
# Retests need tight ranges to occur: an hour of two bars.
TIGHT = dict(SESSION, start="10:00", end="11:00", bars_needed=2)


def orb_sql(extra_break: str = "true", extra_confirm: str = "true") -> str:
    return orb_cte("10:00", "11:00", 2) + f""", cf AS (SELECT c.symbol, c.ts, b.dir FROM br b JOIN po r ON r.symbol=b.symbol AND r.day=b.day AND r.pos=b.pos+1 JOIN po c ON c.symbol=b.symbol AND c.day=b.day AND c.pos=b.pos+2
  WHERE {extra_break} AND CASE WHEN b.dir=1 THEN r.low<=b.oh AND r.close>b.oh AND c.close>b.high ELSE r.high>=b.ol AND r.close<b.ol AND c.close<b.low END AND c.hm<='15:30' AND {extra_confirm}),
 sig AS (SELECT b.*, coalesce(cf.dir,0) AS weight FROM b LEFT JOIN cf USING (symbol, ts))"""


_CLV = lambda r: f"(CASE WHEN {r}.high-{r}.low<=0 THEN 0.5 ELSE ({r}.close-{r}.low)/({r}.high-{r}.low) END)"
_BODY = "(CASE WHEN c.high-c.low<=0 THEN 0 ELSE abs(c.close-c.open)/(c.high-c.low) END)"
_CLVOK = f"CASE WHEN b.dir=1 THEN {_CLV('c')}>=0.7 ELSE {_CLV('c')}<=0.3 END"


# Supplier bars, four to a candle, laid out as sessions of twelve half hours from 10:00.
SESSION_SQL = "WITH " + ctes("supp", "bb") + """, b AS (SELECT symbol, TIMESTAMP '2024-01-01 10:00:00' + to_days((ord//48)::INT) + to_minutes(30*((ord//4)%12)) AS ts, min_by(open,ord) AS open, max(high) AS high, min(low) AS low, max_by(close,ord) AS close, sum(volume) AS volume, ord//4 AS ord FROM bb GROUP BY symbol, ord//48, ord//4)"""


def half_hour_bars(spark, sf):
    n = F.floor(C("ord") / 4)
    four = bars(spark, sf, "supp").groupBy("symbol", n.alias("n")).agg(
        F.min_by("open", "ord").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ord").alias("close"), F.sum("volume").alias("volume"),
    )
    at = "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(cast(n div 12 as int), 0, cast(30 * (n % 12) as int), 0)"
    return four.select("symbol", F.expr(at).alias("ts"), "open", "high", "low", "close", "volume", C("n").alias("ord"))


def orb_rule(name, sql, **kw):
    if kw["mode"] == "breakout":
        make, head, times = (lambda spark, sf: bars(spark, sf, "events")), B("events"), SESSION
    else:
        make, head, times = half_hour_bars, SESSION_SQL, TIGHT
    query(name, head + sql + _NOTE_SELECT)(
        lambda spark, sf: out(orb.orb_signals(make(spark, sf), **times, **kw), "symbol", "ts", "weight")
    )
    # The same rule on New York sessions of bars stamped in UTC, daylight saving included.
    local = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
    query(f"{name}_ny", B("events") + sql.replace("strftime((ts)", f"strftime({local}") + _NOTE_SELECT)(
        lambda spark, sf: out(orb.orb_signals(bars(spark, sf, "events"), **{**times, "zone": "UTC"}, **kw), "symbol", "ts", "weight")
    )


orb_rule("op_F17_orb_breakout", ORB_CTE + ", sig AS (SELECT b.*, coalesce(br.dir,0) AS weight FROM b LEFT JOIN br USING (symbol, ts))", mode="breakout")
orb_rule("op_F18_orb_retest", orb_sql(), mode="retest")
orb_rule("op_F19_orb_retest_rejection", orb_sql(extra_confirm=f"CASE WHEN b.dir=1 THEN {_CLV('r')}>=0.5 ELSE {_CLV('r')}<=0.5 END"), mode="retest_rejection")
orb_rule("op_F20_orb_quality", orb_sql(extra_confirm=f"{_BODY}>=0.6 AND {_CLVOK}"), mode="quality", min_body=0.6, min_clv=0.7)
orb_rule("op_F21_orb_clv", orb_sql(extra_confirm=_CLVOK), mode="clv", min_clv=0.7)
orb_rule("op_F22_orb_atr_range", orb_sql(extra_break="b.cur>0 AND (b.oh-b.ol)/b.cur BETWEEN 0.5 AND 2.5"), mode="orb_atr", atr_min=0.5, atr_max=2.5)
orb_rule(
    "op_F23_orb_atr_regime",
    orb_sql(extra_break="(SELECT count(a.atr)>=50 AND b.cur>=quantile_cont(a.atr,0.5) FROM x a WHERE a.symbol=b.symbol AND a.ord<b.ord AND a.atr IS NOT NULL)"),
   
    mode="atr_regime",
)

def variant_sql(bars_cte: str = "b", fast=(5, 20, 50, 100), slow=(50, 100, 200, 400)) -> str:
    ps = sorted({*fast, *slow})
    smas = ", ".join(f"{SMA(n)} AS m{n}" for n in ps)
    long = " UNION ALL ".join(f"SELECT symbol, ts, ord, close, open, {n} AS n, m{n} AS m, m{n}-lag(m{n}) OVER (PARTITION BY symbol ORDER BY ord) AS d FROM sm" for n in ps)
    return f""", sm AS MATERIALIZED (SELECT symbol, ts, ord, open, close, {smas} FROM {bars_cte}), lg AS MATERIALIZED ({long}),
 g AS (SELECT fast, slow, mode, filter, buffer FROM (SELECT unnest({list(fast)}) AS fast), (SELECT unnest({list(slow)}) AS slow), (SELECT unnest(['long_only','long_short']) AS mode), (SELECT unnest(['none','price_slow','slow_slope','fast_slope','combined']) AS filter), (SELECT unnest([0.0,0.001,0.0025,0.005]::DOUBLE[]) AS buffer) WHERE fast<slow),
 pr AS (SELECT f.symbol, f.ts, f.ord, f.open, f.close, f.n AS fast, s.n AS slow, f.m AS fm, s.m AS sm, f.d AS fd, s.d AS sd FROM lg f JOIN lg s ON s.symbol=f.symbol AND s.ord=f.ord AND f.n<s.n AND f.n IN {tuple(fast)} AND s.n IN {tuple(slow)}),
 vw AS (SELECT symbol, ts, ord, open, close, fast, slow, mode, filter, buffer, CASE WHEN ord<slow THEN 0.0
  WHEN mode='long_short' AND fm<sm*(1-buffer) AND CASE filter WHEN 'none' THEN true WHEN 'price_slow' THEN close<sm WHEN 'slow_slope' THEN sd<0 WHEN 'fast_slope' THEN fd<0 ELSE close<sm AND sd<0 AND fd<0 END THEN -1.0
  WHEN fm>sm*(1+buffer) AND CASE filter WHEN 'none' THEN true WHEN 'price_slow' THEN close>sm WHEN 'slow_slope' THEN sd>0 WHEN 'fast_slope' THEN fd>0 ELSE close>sm AND sd>0 AND fd>0 END THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM pr JOIN g USING (fast, slow))"""


@query(
    "op_F26_golden_cross_variants",
    B("lines") + variant_sql(fast=tuple(sig.FAST_PERIODS), slow=tuple(sig.SLOW_PERIODS))
    + " SELECT symbol, fast, slow, mode, filter, buffer, count(*) FILTER (weight>0) AS longs, count(*) FILTER (weight<0) AS shorts, coalesce(min(ord) FILTER (weight<>0),-1) AS first_ord FROM vw GROUP BY ALL",
)
def _(spark, sf):
    """All 2 960 variants; the sweep counts their weights chunk by chunk."""
    from catalog.k_validation import full

    g = full(spark, sf).withColumn("first_ord", F.coalesce("first_ord", F.lit(-1)))
    return out(g, "symbol", "fast", "slow", "mode", "filter", "buffer", "longs", "shorts", "first_ord")


XS_SQL = ALIGN_SQL + SNAP_SQL + """, mo AS (SELECT *, lag(close,21) OVER w/lag(close,273) OVER w-1 AS mom FROM al WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 rk AS (SELECT symbol, ts, count(*) OVER (PARTITION BY ts) AS n, row_number() OVER (PARTITION BY ts ORDER BY mom DESC, symbol) AS k FROM mo WHERE mom IS NOT NULL AND ts IN (SELECT ts FROM rb)),
 pk AS (SELECT symbol, ts, CASE WHEN k<=2 THEN 0.25 WHEN k>n-2 THEN -0.25 END AS state FROM rk WHERE n>=4),
 xs AS (SELECT mo.*, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY mo.symbol ORDER BY mo.ts),0)::DOUBLE AS weight FROM mo LEFT JOIN pk USING (symbol, ts))"""


def xs_weights(spark, sf):
    from tidemark.session import staged_once

    aligned = staged_once(spark, (sf, "orders-aligned"), lambda: align_ffill(bars(spark, sf, "orders")))
    return sig.xs_momentum(aligned, top_k=2, bottom_k=2)


@query("op_F27_xs_momentum", B("orders") + XS_SQL + f" SELECT symbol, {ISO('ts')} AS ts, weight FROM xs")
def _(spark, sf):
    return out(xs_weights(spark, sf), "symbol", "ts", "weight")


@query(
    "op_F28_session_time",
    B("market") + f" SELECT {KEYED}, strftime(((ts - INTERVAL 3 HOUR)::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS local FROM b",
)
def _(spark, sf):
    return out(bars(spark, sf, "market").withColumn("local", ny_time("ts")), "symbol", "ts", "local")


_SESS = ", t AS (SELECT *, strftime(ts,'%Y-%m-%d') AS day, strftime(ts,'%H:%M') AS hm FROM b)"


def session(spark, sf, kind="events"):
    return orb.session_bars(bars(spark, sf, kind), "08:00", "11:00", None)


@query("op_B9_session_bar_counts", B("events") + _SESS + ", c AS (SELECT symbol, day, count(*) AS bars FROM t WHERE hm>='08:00' AND hm<'11:00' GROUP BY symbol, day) SELECT symbol, bars, count(*) AS days, bars=6 AS valid FROM c GROUP BY symbol, bars")
def _(spark, sf):
    return orb.session_bar_counts(session(spark, sf))


@query(
    "op_B10_first_breaks",
    B("events") + ORB_CTE + f" SELECT symbol, day, {ISO('min(ts) FILTER (close>oh)')} AS long_ts, {ISO('min(ts) FILTER (close<ol)')} AS short_ts FROM po GROUP BY symbol, day",
)
def _(spark, sf):
    d = session(spark, sf)
    return out(orb.both_side_breaks(d, orb.opening_ranges(d, 6, 30)), "symbol", "day", "long_ts", "short_ts")


@query(
    "op_B11_signal_profile",
    GOLD_SQL.replace("f>s THEN 1.0", "f>s THEN 1.0 WHEN f<s AND close<s THEN -1.0") + f""", pv AS (SELECT *, coalesce(lag(weight) OVER w,0) AS p FROM sig {W_SQL})
 SELECT symbol, count(*) FILTER (weight>0) AS long_bars, count(*) FILTER (weight<0) AS short_bars, count(*) FILTER (weight=0) AS flat_bars, count(*) FILTER (weight<>p) AS changes,
 count(*) FILTER (weight<>0 AND sign(weight)<>sign(p)) AS entries, count(DISTINCT CASE WHEN weight<>0 AND sign(weight)<>sign(p) THEN ts::DATE END) AS entry_days FROM pv GROUP BY symbol""",
)
def _(spark, sf):
    from tidemark.functions import indicators as ind
    from tidemark.plans.series import on_chunks

    def build(d, c):
        d = ind.add_moments(d, c, {"f": ("close", 50, "mean"), "s": ("close", 200, "mean")})
        d = d.withColumn("weight", F.when(C("f") > C("s"), 1.0).when((C("f") < C("s")) & (C("close") < C("s")), -1.0).otherwise(0.0))
        return qa.with_previous_weight(d, c)

    return qa.profile_changes(on_chunks(bars(spark, sf), build, back=201))


_AUDIT = ORB_CTE + """, e AS (SELECT symbol, ts, dir AS expected FROM br), f AS (SELECT symbol, ts + CASE WHEN day LIKE '%5' THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END AS ts, CASE WHEN day LIKE '%7' THEN -dir ELSE dir END AS found FROM br)"""


def orb_events(spark, sf):
    d = session(spark, sf)
    b = orb.first_breakouts(d, orb.opening_ranges(d, 6, 30))
    return b.filter(F.date_format("ts", "HH:mm") <= "15:30")


@query(
    "op_B12_signal_audit",
    B("events") + _AUDIT + f" SELECT symbol, {ISO('ts')} AS ts, CASE WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected' WHEN expected<>found THEN 'direction_mismatch' ELSE 'matched' END AS status FROM e FULL JOIN f USING (symbol, ts)",
)
def _(spark, sf):
    """Breakouts against a copy with shifted times and turned directions on some days."""
    e = orb_events(spark, sf)
    moved = F.when(C("day").endswith("5"), C("ts") + F.expr("interval 30 minutes")).otherwise(C("ts"))
    f = e.select("symbol", moved.alias("ts"), F.when(C("day").endswith("7"), -C("direction")).otherwise(C("direction")).alias("direction"))
    return out(qa.signal_audit(e, f), "symbol", "ts", "status")


@query(
    "op_B13_exact_grid_check",
    B("events") + _SESS + """, d AS (SELECT DISTINCT symbol, day FROM t), gr AS (SELECT symbol, day, (day||' 08:00:00')::TIMESTAMP + to_minutes(30*i) AS ts FROM d, (SELECT unnest(generate_series(0,5)) AS i))
 SELECT symbol, day, count(*) AS expected, count(b.close) AS present, count(*)=count(b.close) AS exact FROM gr LEFT JOIN b USING (symbol, ts) GROUP BY symbol, day""",
)
def _(spark, sf):
    return orb.exact_grid_days(session(spark, sf), "08:00", "11:00", 30)


@query("op_B14_one_per_day", B("events") + _SESS + " SELECT symbol, day, count(*) AS n FROM t WHERE close>101 GROUP BY symbol, day HAVING count(*)>1")
def _(spark, sf):
    s = bars(spark, sf, "events").filter("close > 101")
    return qa.more_than_one_per_day(s, F.date_format("ts", "yyyy-MM-dd"))


@query("op_B15_direction_time", B("events") + ORB_CTE + ", d AS (SELECT CASE dir WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS direction, hm AS hhmm FROM br) SELECT direction, hhmm, count(*) AS n FROM d GROUP BY ROLLUP (direction, hhmm)")
def _(spark, sf):
    e = orb_events(spark, sf).withColumn("direction", F.when(C("direction") == 1, "LONG").otherwise("SHORT"))
    return out(qa.direction_time_distribution(e), "direction", "hhmm", "n")
