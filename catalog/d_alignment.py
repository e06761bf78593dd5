"""Joins, calendars and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import B, ISO, R, W_SQL, bars, ctes, out, query
from tidemark.operators import calendar as cal
from tidemark.session import stage


@query(
    "op_D1_signal_lookup",
    B() + f" SELECT symbol, {ISO('ts')} AS ts, CASE WHEN ord%4<>0 THEN (ord%3-1)::DOUBLE END AS weight FROM b",
)
def _(spark, sf):
    b = bars(spark, sf).select("symbol", "ts", "ord")
    s = b.filter("ord % 4 <> 0").select("symbol", "ts", ((F.col("ord") % 3) - 1).cast("double").alias("weight"))
    return out(b.join(s, ["symbol", "ts"], "left"), "symbol", "ts", "weight")


@query("op_D2_union_calendar", B("orders") + f" SELECT DISTINCT {ISO('ts')} AS ts FROM b")
def _(spark, sf):
    return out(cal.union_calendar(bars(spark, sf, "orders")), "ts")


@query("op_D3_intersect_calendar", B("lines") + f" SELECT {ISO('ts')} AS ts FROM b GROUP BY ts HAVING count(DISTINCT symbol)=(SELECT count(DISTINCT symbol) FROM b)")
def _(spark, sf):
    return out(cal.intersect_calendar(bars(spark, sf, "lines")), "ts")


ALIGN_SQL = """, c AS (SELECT DISTINCT ts FROM b), g AS (SELECT s.symbol, c.ts FROM (SELECT DISTINCT symbol FROM b) s, c),
 al AS (SELECT symbol, ts, row_number() OVER w - 1 AS ord, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low,
 last_value(close IGNORE NULLS) OVER w AS close, coalesce(volume,0) AS volume, b.symbol IS NOT NULL AND close IS NOT NULL AS has_bar FROM g LEFT JOIN b USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query(
    "op_D4_align_ffill",
    B("orders") + ALIGN_SQL + f" SELECT symbol, {ISO('ts')} AS ts, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, volume FROM al",
)
def _(spark, sf):
    return out(cal.align_ffill(bars(spark, sf, "orders")), "symbol", "ts", "volume", open=4, high=4, low=4, close=4)


@query(
    "op_D5_asof_backward",
    B("lines") + f""", q AS (SELECT symbol, ts, close FROM b WHERE ord%5=0)
 SELECT b.symbol, {ISO('b.ts')} AS ts, {R('q.close')} AS price FROM b ASOF LEFT JOIN q ON b.symbol=q.symbol AND b.ts>=q.ts""",
)
def _(spark, sf):
    b = bars(spark, sf, "lines")
    quotes = b.filter("ord % 5 = 0").select("symbol", "ts", F.col("close").alias("price"))
    return out(cal.asof_backward(b.select("symbol", "ts"), quotes, "price"), "symbol", "ts", price=4)


@query(
    "op_D5_ffill_on",
    B("lines") + f""", q AS (SELECT symbol, ts, close AS p FROM b WHERE ord%6=2)
 SELECT b.symbol, {ISO('b.ts')} AS ts, {R('last_value(p IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts)')} AS price FROM b LEFT JOIN q ON b.symbol=q.symbol AND b.ts=q.ts""",
)
def _(spark, sf):
    b = bars(spark, sf, "lines")
    quotes = b.filter("ord % 6 = 2").select("symbol", "ts", F.col("close").alias("price"))
    return out(cal.ffill_on(b.select("symbol", "ts", "ord"), quotes, "price"), "symbol", "ts", price=4)


SNAP_SQL = """, cal AS (SELECT DISTINCT ts FROM b), m AS (SELECT unnest(generate_series(date_trunc('month',(SELECT min(ts) FROM cal)),(SELECT max(ts) FROM cal),INTERVAL 1 MONTH)) AS d),
 rb AS (SELECT d, (SELECT min(ts) FROM cal WHERE ts>=d) AS ts FROM m WHERE d>=(SELECT min(ts) FROM cal))"""


@query("op_D6_month_snap", B("orders") + SNAP_SQL + " SELECT strftime(d,'%Y-%m-%d') AS month_start, strftime(ts,'%Y-%m-%d %H:%M:%S') AS ts FROM rb")
def _(spark, sf):
    m = cal.month_snap(bars(spark, sf, "orders"))
    return out(m.withColumn("month_start", F.date_format("month_start", "yyyy-MM-dd")), "month_start", "ts")


@query(
    "op_D7_inner_join_returns",
    B("orders") + f""", r AS (SELECT symbol, ts, close/lag(close) OVER w-1 AS r FROM b {W_SQL})
, mk AS (SELECT ts, avg(r) AS m FROM r WHERE r IS NOT NULL GROUP BY ts)
 SELECT symbol, {ISO('r.ts')} AS ts, {R('r.r',6)} AS strat, {R('m',6)} AS bench FROM r JOIN mk ON r.ts=mk.ts WHERE r.r IS NOT NULL""",
)
def _(spark, sf):
    from tidemark.operators.returns import asset_returns

    r = asset_returns(bars(spark, sf, "orders"))
    market = r.groupBy("ts").agg(F.avg("r").alias("bench"))
    return out(r.select("symbol", "ts", F.col("r").alias("strat")).join(market, "ts").dropna(), "symbol", "ts", strat=6, bench=6)


@query(
    "op_D8_grid",
    B("lines") + """, g AS (SELECT f AS fast, s AS slow FROM (SELECT unnest([5,20,50,100]) f), (SELECT unnest([20,50,100,200]) s) WHERE f<s)
 SELECT symbol, fast, slow, count(*) AS bars FROM b, g GROUP BY ALL""",
)
def _(spark, sf):
    from tidemark.operators.sweep import with_grid

    g = [{"fast": f, "slow": s} for f in (5, 20, 50, 100) for s in (20, 50, 100, 200) if f < s]
    n = with_grid(bars(spark, sf, "lines").select("symbol"), g).groupBy("symbol", "fast", "slow").agg(F.count(F.lit(1)).alias("bars"))
    return out(n, "symbol", "fast", "slow", "bars")


@query(
    "op_D11_semi_anti",
    B() + ", ex AS (SELECT symbol FROM b GROUP BY symbol HAVING count(*)%2=0) SELECT symbol, count(*) AS n, symbol IN (SELECT symbol FROM ex) AS excluded FROM b GROUP BY symbol",
)
def _(spark, sf):
    # Written first: the optimizer would move the joins below the count, where all bars meet them.
    n = stage(bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol-counts")
    ex = n.filter("n % 2 = 0").select("symbol")
    kept = n.join(ex, "symbol", "left_anti").withColumn("excluded", F.lit(False))
    gone = n.join(ex, "symbol", "left_semi").withColumn("excluded", F.lit(True))
    return kept.union(gone).select("symbol", "excluded", "n")


@query("op_D12_rebalance_membership", B("orders") + SNAP_SQL + f" SELECT symbol, {ISO('ts')} AS ts, ts IN (SELECT ts FROM rb) AS rebalance FROM b")
def _(spark, sf):
    b = bars(spark, sf, "orders")
    flag = cal.rebalance_dates(b).withColumn("rebalance", F.lit(True))
    j = b.join(flag, "ts", "left").withColumn("rebalance", F.coalesce("rebalance", F.lit(False)))
    return out(j, "symbol", "ts", "rebalance")


@query("op_J1_union_all", B("lines") + ", " + ctes("orders", "o") + " SELECT symbol, count(*) AS n FROM (SELECT symbol FROM b UNION ALL SELECT symbol FROM o) GROUP BY symbol")
def _(spark, sf):
    both = bars(spark, sf, "lines").unionByName(bars(spark, sf, "orders"))
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("op_J2_union_distinct", B("lines") + ", " + ctes("orders", "o") + f" SELECT {ISO('ts')} AS ts FROM (SELECT ts FROM b UNION SELECT ts FROM o)")
def _(spark, sf):
    return out(bars(spark, sf, "lines").select("ts").union(bars(spark, sf, "orders").select("ts")).distinct(), "ts")


@query("op_J3_intersect", B("lines") + ", " + ctes("orders", "o") + f" SELECT {ISO('ts')} AS ts FROM (SELECT ts FROM b INTERSECT SELECT ts FROM o)")
def _(spark, sf):
    return out(bars(spark, sf, "lines").select("ts").intersect(bars(spark, sf, "orders").select("ts")), "ts")


@query("op_J4_except", B("lines") + ", " + ctes("orders", "o") + f" SELECT {ISO('ts')} AS ts FROM (SELECT ts FROM b EXCEPT ALL SELECT ts FROM o)")
def _(spark, sf):
    return out(bars(spark, sf, "lines").select("ts").exceptAll(bars(spark, sf, "orders").select("ts")), "ts")


@query(
    "op_J5_keep_first_dedupe",
    B("lines") + f""", u AS (SELECT symbol, ts, close, 1 AS win FROM b WHERE ord<800 UNION ALL SELECT symbol, ts, close+1, 2 FROM b WHERE ord>=600)
 SELECT symbol, {ISO('ts')} AS ts, {R('close')} AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY win) AS rn FROM u) WHERE rn=1""",
)
def _(spark, sf):
    from tidemark.operators.ingest import sort_dedupe

    b = bars(spark, sf, "lines")
    u = b.filter("ord < 800").select("symbol", "ts", "close", F.lit(1).alias("win")).union(
        b.filter("ord >= 600").select("symbol", "ts", F.col("close") + 1, F.lit(2))
    )
    return out(sort_dedupe(u, order="win"), "symbol", "ts", close=4)
