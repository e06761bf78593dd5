"""Weights to returns, fills, trades and exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import B, ISO, R, W_SQL, bars, fills, out, query
from catalog.c_predicates import PLAN_SQL, plans
from catalog.d_alignment import ALIGN_SQL, SNAP_SQL
from catalog.e_windows import KEYED
from catalog.f_signals import XS_SQL, xs_weights
from catalog.sqlfrag import SMA
from tidemark.operators import metrics as met
from tidemark.operators import pnl
from tidemark.operators import signals as sig
from tidemark.operators import trades as trd
from tidemark.plans.series import equity_on_chunks, equity_scan
from tidemark.session import once, staged_once

C = F.col


def gold(spark, sf, kind="supp"):
    """Bars with golden-cross 20/60 weights."""
    return sig.golden_cross(bars(spark, sf, kind), 20, 60)


GOLD = f", i AS (SELECT *, {SMA(20)} AS f, {SMA(60)} AS s FROM b), sg AS MATERIALIZED (SELECT symbol, ts, ord, open, high, low, close, volume, CASE WHEN f>s THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM i)"
G1 = f""", p0 AS (SELECT *, coalesce(lag(weight) OVER w,0) AS position, coalesce(lag(weight,2) OVER w,0) AS before, coalesce(close/lag(close) OVER w-1,0) AS r_asset FROM sg {W_SQL}),
 wr AS MATERIALIZED (SELECT *, abs(position-before) AS turnover, position*r_asset-abs(position-before)*0.0006 AS r FROM p0),
 eq0 AS MATERIALIZED (SELECT *, product(1+r) OVER w AS equity FROM wr {W_SQL}),
 eq AS MATERIALIZED (SELECT * EXCLUDE (r), CASE WHEN ord>0 THEN r END AS r, max(equity) OVER w AS peak, equity/max(equity) OVER w-1 AS drawdown FROM eq0 {W_SQL})"""


def gold_equity(spark, sf, kind="supp"):
    """Equity curve of the golden-cross weights, written once: several metrics read it."""

    def build(d, c):
        return pnl.weight_returns_on(sig.golden_cross_on(d, c, 20, 60), c).drop("_f", "_s")

    def make():
        d = equity_on_chunks(bars(spark, sf, kind), build, f"{kind}-gold", back=60 + 2)
        return d.withColumn("r", F.when(C("ord") > 0, C("r")))

    return once(spark, (sf, kind, "gold"), make)


@query(
    "op_flagship_golden_cross",
    B("lines") + GOLD + G1 + f""" SELECT symbol, count(r) AS n_periods, {R("arg_max(equity,ord)/arg_min(equity,ord)-1", 6)} AS total_return, {R("pow(arg_max(equity,ord)/arg_min(equity,ord), 1/(floor((epoch_us(max(ts))-epoch_us(min(ts)))/86400000000)/365.25))-1", 6)} AS cagr,
 {R("stddev_samp(r)*sqrt(252.0)", 6)} AS volatility, {R("avg(r)*252.0/nullif(stddev_samp(r)*sqrt(252.0),0)", 4)} AS sharpe, {R("min(drawdown)", 6)} AS max_drawdown FROM eq GROUP BY symbol""",
)
def _(spark, sf):
    d = equity_scan(pnl.weight_returns(gold(spark, sf, "lines"))).withColumn("r", F.when(C("ord") > 0, C("r")))
    return out(met.core_metrics(d), "symbol", "n_periods", total_return=6, cagr=6, volatility=6, sharpe=4, max_drawdown=6)


@query("op_G1_weight_returns", B() + GOLD + G1 + f" SELECT {KEYED}, {R('wr.r', 8)} AS r, {R('turnover')} AS turnover FROM wr")
def _(spark, sf):
    return out(pnl.weight_returns(gold(spark, sf)), "symbol", "ts", r=8, turnover=4)


def g2_sql(warmup: int = 0, src: str = "sg", rate: str = "0.0006", name: str = "nr", part: str = "symbol") -> str:
    w = f"WINDOW w AS (PARTITION BY {part} ORDER BY ord)"
    return f""", {name}_l AS (SELECT *, CASE WHEN ord>={warmup} THEN weight ELSE 0 END AS live FROM {src}),
 {name}_p AS (SELECT *, coalesce(lag(live) OVER w,0) AS position, coalesce(lag(live,2) OVER w,0) AS old, lag(close) OVER w AS pc FROM {name}_l {w}),
 {name} AS MATERIALIZED (SELECT *, abs(position-old) AS turnover, coalesce((1+old*(open/pc-1))*(1+position*(close/open-1)-abs(position-old)*{rate})-1,0) AS r FROM {name}_p)"""


@query("op_G2_next_open_returns", B() + GOLD + g2_sql(30) + f" SELECT {KEYED}, position::DOUBLE AS position, {R('r', 8)} AS r FROM nr")
def _(spark, sf):
    return out(pnl.next_open_returns(gold(spark, sf), warmup=30), "symbol", "ts", "position", r=8)


@query(
    "op_G3_fill_events",
    B() + GOLD + f""", e AS (SELECT *, coalesce(lag(weight) OVER w,0) AS prev, lead(ts) OVER w AS fill_ts, lead(open) OVER w AS no FROM sg {W_SQL})
 SELECT symbol, {ISO('ts')} AS signal_ts, {ISO('fill_ts')} AS fill_ts, CASE WHEN weight>prev THEN 'BUY' ELSE 'SELL' END AS side, {R('no*(CASE WHEN weight>prev THEN 1.0005 ELSE 0.9995 END)')} AS price, weight AS target_weight FROM e WHERE weight<>prev AND fill_ts IS NOT NULL""",
)
def _(spark, sf):
    return out(pnl.fill_events(gold(spark, sf)), "symbol", "signal_ts", "fill_ts", "side", "target_weight", price=4)


@query(
    "op_G4_portfolio_returns",
    B("orders") + XS_SQL + f""", cl AS (SELECT *, greatest(weight,0) AS wt FROM xs), p AS (SELECT ts, symbol, coalesce(lag(wt) OVER w,0)*coalesce(close/lag(close) OVER w-1,0)-abs(coalesce(lag(wt) OVER w,0)-coalesce(lag(wt,2) OVER w,0))*0.0006 AS r FROM cl WINDOW w AS (PARTITION BY symbol ORDER BY ts))
 SELECT {ISO('ts')} AS ts, {R('sum(r)', 8)} AS r FROM p GROUP BY ts""",
)
def _(spark, sf):
    return out(pnl.portfolio_returns(xs_weights(spark, sf), allow_short=False), "ts", r=8)


FILL_SQL = f"""WITH fl0 AS (SELECT 'S'||l_suppkey AS symbol, l_shipdate AS ts, CASE WHEN l_returnflag='R' THEN -2*l_quantity ELSE l_quantity END AS qty, 500+l_extendedprice/l_quantity/1000 AS price, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
 fl AS MATERIALIZED (SELECT symbol, ts, qty, price, abs(qty)*0.05 AS commission, row_number() OVER (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)-1 AS ord FROM fl0)"""
TRADE_SQL = f""", po AS (SELECT *, sum(qty) OVER w AS pos FROM fl {W_SQL}), kd AS (SELECT *, CASE WHEN abs(pos-qty)<1e-6 AND abs(pos)>=1e-6 THEN 'open' WHEN abs(pos-qty)>=1e-6 AND abs(pos)<1e-6 THEN 'close' WHEN (pos-qty>1e-6 AND pos<-1e-6) OR (pos-qty<-1e-6 AND pos>1e-6) THEN 'flip' WHEN abs(pos-qty)>=1e-6 THEN 'add' END AS kind FROM po),
 tn AS (SELECT *, sum(CASE WHEN kind IN ('open','flip') THEN 1 ELSE 0 END) OVER w AS trade FROM kd WHERE kind IS NOT NULL {W_SQL}),
 pt AS (SELECT symbol, ts, ord, price, trade, kind, qty, commission FROM tn WHERE kind<>'flip' UNION ALL SELECT symbol, ts, ord, price, trade-1, 'close', qty, commission/2 FROM tn WHERE kind='flip' UNION ALL SELECT symbol, ts, ord, price, trade, 'open', pos, commission/2 FROM tn WHERE kind='flip'),
 tr0 AS (SELECT symbol, trade, max(ts) FILTER (kind='open') AS entry_ts, max(ts) FILTER (kind='close') AS exit_ts, max(price) FILTER (kind='open') AS entry_price, max(price) FILTER (kind='close') AS exit_price, max(qty) FILTER (kind='open') AS q, coalesce(max(commission) FILTER (kind='open'),0)+coalesce(max(commission) FILTER (kind='close'),0) AS commission, count(*) FILTER (kind='add') AS scale_ins, max(ord) FILTER (kind='close') AS exit_ord FROM pt GROUP BY symbol, trade),
 tr AS MATERIALIZED (SELECT *, CASE WHEN q>0 THEN 'LONG' ELSE 'SHORT' END AS direction, abs(q) AS qty, (exit_price-entry_price)*q AS gross_pnl, (exit_price-entry_price)*q-commission AS pnl FROM tr0 WHERE exit_ts IS NOT NULL)"""


def trades(spark, sf):
    return staged_once(spark, (sf, "trades"), lambda: trd.extract_trades(fills(spark, sf)))


_TRADE_COLS = f"symbol, {ISO('entry_ts')} AS entry_ts, {ISO('exit_ts')} AS exit_ts, direction, qty, scale_ins, {R('entry_price')} AS entry_price, {R('exit_price')} AS exit_price, {R('gross_pnl')} AS gross_pnl, {R('commission')} AS commission, {R('pnl')} AS pnl FROM tr"
_TRADE_OUT = ("symbol", "entry_ts", "exit_ts", "direction", "qty", "scale_ins")
_TRADE_RND = dict(entry_price=4, exit_price=4, gross_pnl=4, commission=4, pnl=4)


@query("op_G5_fills_to_trades", FILL_SQL + TRADE_SQL + " SELECT " + _TRADE_COLS)
def _(spark, sf):
    return out(trd.extract_trades(fills(spark, sf)), *_TRADE_OUT, **_TRADE_RND)


@query("op_G6_trades_missing_symbol", FILL_SQL.replace("fl AS MATERIALIZED (SELECT symbol,", "fl AS MATERIALIZED (SELECT CASE symbol WHEN 'S7' THEN 'ASSET' ELSE symbol END AS symbol,") + TRADE_SQL + " SELECT " + _TRADE_COLS)
def _(spark, sf):
    f = fills(spark, sf).withColumn("symbol", F.when(C("symbol") != "S7", C("symbol")))
    return out(trd.extract_trades_multi(f), *_TRADE_OUT, **_TRADE_RND)


EXIT_SQL = PLAN_SQL + """, hit AS (SELECT p.symbol, p.ord, min(x.ord) AS hit FROM p JOIN b x ON x.symbol=p.symbol AND x.ord>p.ord AND (least(x.low,x.open)<=least(p.stop_price,p.target_price) OR greatest(x.high,x.open)>=greatest(p.stop_price,p.target_price)) GROUP BY p.symbol, p.ord),
 en AS (SELECT symbol, max(ord) AS last, max_by(ts,ord) AS last_ts, max_by(close,ord) AS last_close FROM b GROUP BY symbol),
 ex AS MATERIALIZED (SELECT p.*, CASE WHEN p.ord>=last THEN p.ts WHEN hit IS NULL THEN last_ts ELSE x.ts END AS exit_ts,
  CASE WHEN p.ord>=last THEN entry_price WHEN hit IS NULL THEN last_close WHEN direction='LONG' THEN CASE WHEN x.open<=stop_price OR x.open>=target_price THEN x.open WHEN x.low<=stop_price THEN stop_price ELSE target_price END
   ELSE CASE WHEN x.open>=stop_price OR x.open<=target_price THEN x.open WHEN x.high>=stop_price THEN stop_price ELSE target_price END END AS exit_price,
  CASE WHEN hit IS NULL THEN 'END_OF_DATA' WHEN direction='LONG' THEN CASE WHEN x.open<=stop_price THEN 'STOP' WHEN x.open>=target_price THEN 'TARGET' WHEN x.low<=stop_price THEN 'STOP' ELSE 'TARGET' END
   ELSE CASE WHEN x.open>=stop_price THEN 'STOP' WHEN x.open<=target_price THEN 'TARGET' WHEN x.high>=stop_price THEN 'STOP' ELSE 'TARGET' END END AS exit_reason, coalesce(hit,last)-p.ord AS bars_held
  FROM p LEFT JOIN hit USING (symbol, ord) LEFT JOIN b x ON x.symbol=p.symbol AND x.ord=hit JOIN en ON en.symbol=p.symbol)"""


def exits(spark, sf, kind):
    b = bars(spark, sf, kind)
    p = plans(b).withColumn("plan_id", F.concat_ws("/", "symbol", C("ord").cast("string")))
    return trd.bracket_exits(p, b)


for _kind, _name in (("orders", "op_D9_first_touch_join"), ("supp", "op_G7_bracket_exit")):
    query(
        _name,
        B(_kind) + EXIT_SQL + f" SELECT symbol, {ISO('ts')} AS ts, direction, {ISO('exit_ts')} AS exit_ts, exit_reason, bars_held, {R('exit_price')} AS exit_price FROM ex",
    )(lambda spark, sf, k=_kind: out(exits(spark, sf, k), "symbol", "ts", "direction", "exit_ts", "exit_reason", "bars_held", exit_price=4))


@query(
    "op_G8_exposure",
    B("orders") + XS_SQL + f""", d AS (SELECT ts, weight, coalesce(abs(weight-lag(weight) OVER (PARTITION BY symbol ORDER BY ts)),0) AS dw FROM xs), t AS (SELECT ts, sum(dw) AS t, sum(abs(weight)) AS g, sum(weight) AS n FROM d GROUP BY ts)
 SELECT {R('avg(t)', 8)} AS turnover, {R('avg(g)', 8)} AS gross_exposure, {R('avg(n)', 8)} AS net_exposure FROM t""",
)
def _(spark, sf):
    return out(pnl.exposure_stats(xs_weights(spark, sf)), turnover=8, gross_exposure=8, net_exposure=8)


SAME_SQL = f""", ra AS (SELECT *, coalesce(close/lag(close) OVER w-1,0) AS ra, abs(weight-lag(weight) OVER w) AS dw FROM sg {W_SQL}), am AS (SELECT symbol, greatest(-1,least(1,avg(weight))) AS aw, coalesce(avg(dw),0)*0.0006 AS cst FROM ra GROUP BY symbol),
 bm AS MATERIALIZED (SELECT ra.symbol, ra.ts, ra.ord, aw, aw*ra-cst AS r FROM ra JOIN am USING (symbol))"""


@query("op_G9_same_exposure", B() + GOLD + SAME_SQL + f" SELECT {KEYED}, {R('aw', 6)} AS avg_weight, {R('r', 8)} AS r, {R('100000*product(1+r) OVER w', 3)} AS equity FROM bm {W_SQL}")
def _(spark, sf):
    d = equity_scan(pnl.same_exposure_benchmark(gold(spark, sf)), start=100_000.0)
    return out(d, "symbol", "ts", avg_weight=6, r=8, equity=3)


@query(
    "op_G10_equal_weight",
    B("orders") + ALIGN_SQL + SNAP_SQL + f""", r0 AS (SELECT ts, coalesce(close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1,0) AS r FROM al), pt AS (SELECT ts, CASE WHEN ts>=(SELECT min(ts) FROM rb) THEN sum(r)/(SELECT count(DISTINCT symbol) FROM b) ELSE 0 END AS r FROM r0 GROUP BY ts)
 SELECT {ISO('ts')} AS ts, {R('r', 8)} AS r, {R('100000*product(1+r) OVER (ORDER BY ts)', 3)} AS equity FROM pt""",
)
def _(spark, sf):
    from tidemark.operators.calendar import align_ffill

    aligned = staged_once(spark, (sf, "orders-aligned"), lambda: align_ffill(bars(spark, sf, "orders")))
    return out(pnl.equal_weight_benchmark(aligned), "ts", r=8, equity=3)


@query("op_G11_buy_hold", B() + f" SELECT {KEYED}, {R('100000*close/first_value(close) OVER w', 3)} AS benchmark FROM b {W_SQL}")
def _(spark, sf):
    return out(pnl.buy_hold_benchmark(bars(spark, sf)), "symbol", "ts", benchmark=3)


@query(
    "op_G12_excess_returns",
    B() + GOLD + g2_sql() + f", av AS (SELECT symbol, avg(weight) AS aw FROM sg GROUP BY symbol) SELECT {KEYED}, {R('r-aw*coalesce(close/lag(close) OVER (PARTITION BY symbol ORDER BY ord)-1,0)', 8)} AS f FROM nr JOIN av USING (symbol)",
)
def _(spark, sf):
    return out(pnl.excess_returns(gold(spark, sf)), "symbol", "ts", f=8)


@query("op_G13_cumulative_excess", B() + GOLD + G1 + f" SELECT {KEYED}, {R('product(1+r-r_asset) OVER w-1', 6)} AS excess FROM wr {W_SQL}")
def _(spark, sf):
    from tidemark.operators.returns import cumulative_excess

    return out(cumulative_excess(pnl.weight_returns(gold(spark, sf)), "r", "r_asset"), "symbol", "ts", excess=6)


@query("op_G14_transitions", B() + GOLD + G1 + f", c AS (SELECT symbol, position IS DISTINCT FROM lag(position) OVER w AS ch FROM wr {W_SQL}) SELECT symbol, count(*) FILTER (ch) AS transitions FROM c GROUP BY symbol")
def _(spark, sf):
    return pnl.transitions(gold(spark, sf))
