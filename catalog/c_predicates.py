"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import B, ISO, R, W_SQL, bars, out, query
from tidemark.functions import indicators as ind
from tidemark.operators import contracts as con
from tidemark.plans.series import on_chunks

_SIG = """, s AS (SELECT symbol, ts, ord, close, CASE WHEN ord%7=0 THEN NULL ELSE ((ord%5)-2)/2.0 END AS weight FROM b)"""


def _weights(b):
    return b.withColumn("weight", F.when(F.col("ord") % 7 != 0, ((F.col("ord") % 5) - 2) / 2.0))


@query("op_C1_validate_weights", B() + _SIG + f" SELECT symbol, {ISO('ts')} AS ts, coalesce(weight,0.0)::DOUBLE AS weight FROM s")
def _(spark, sf):
    b = bars(spark, sf)
    return out(con.validate_weights(b, _weights(b).select("symbol", "ts", "weight")), "symbol", "ts", "weight")


@query(
    "op_C2_mask_to_weight",
    B() + f" SELECT symbol, {ISO('ts')} AS ts, CASE WHEN close<open THEN -1.0::DOUBLE WHEN close>low THEN 1.0 ELSE 0.0 END AS weight FROM b",
)
def _(spark, sf):
    rules = [(F.col("close") > F.col("low"), 1.0), (F.col("close") < F.col("open"), -1.0)]
    return out(bars(spark, sf).withColumn("weight", con.mask_to_weight(rules)), "symbol", "ts", "weight")


@query("op_C3_clamp", B() + f" SELECT symbol, {ISO('ts')} AS ts, {R('greatest(-1,least(1,(close-502)/5))',6)} AS w FROM b")
def _(spark, sf):
    return out(bars(spark, sf).withColumn("w", ind.clamp((F.col("close") - 502) / 5)), "symbol", "ts", w=6)


PLAN_SQL = """, p AS (SELECT symbol, ts, ord, close AS entry_price, CASE WHEN ord%2=0 THEN 'LONG' ELSE 'SHORT' END AS direction,
 close*CASE WHEN ord%2=0 THEN 0.98 ELSE 1.02 END AS stop_price, close*CASE WHEN ord%2=0 THEN 1.04 ELSE 0.96 END AS target_price FROM b)"""


def plans(b):
    long = F.col("ord") % 2 == 0
    return b.select(
        "symbol",
        "ts",
        "ord",
        F.col("close").alias("entry_price"),
        F.when(long, "LONG").otherwise("SHORT").alias("direction"),
        (F.col("close") * F.when(long, 0.98).otherwise(1.02)).alias("stop_price"),
        (F.col("close") * F.when(long, 1.04).otherwise(0.96)).alias("target_price"),
    )


@query(
    "op_C4_plan_geometry",
    B("orders") + PLAN_SQL + f""", q AS (SELECT symbol, ts, direction, entry_price, CASE WHEN ord%11=0 THEN entry_price ELSE stop_price END AS stop_price, CASE WHEN ord%13=0 THEN stop_price ELSE target_price END AS target_price FROM p)
 SELECT symbol, {ISO('ts')} AS ts, CASE direction WHEN 'LONG' THEN stop_price<entry_price AND entry_price<target_price ELSE stop_price>entry_price AND entry_price>target_price END AS is_valid FROM q""",
)
def _(spark, sf):
    o = F.col("ord")
    p = plans(bars(spark, sf, "orders")).withColumns(
        {
            "stop_price": F.when(o % 11 == 0, F.col("entry_price")).otherwise(F.col("stop_price")),
            "target_price": F.when(o % 13 == 0, F.col("stop_price")).otherwise(F.col("target_price")),
        }
    )
    return out(p.withColumn("is_valid", con.plan_is_valid()), "symbol", "ts", "is_valid")


@query(
    "op_C5_plan_projections",
    B("orders") + PLAN_SQL + f""" SELECT symbol, {ISO('ts')} AS ts, {R('abs(entry_price-stop_price)')} AS risk_points, {R('abs(target_price-entry_price)')} AS reward_points,
 {R('abs(target_price-entry_price)/abs(entry_price-stop_price)')} AS planned_rr FROM p""",
)
def _(spark, sf):
    return out(con.plan_projections(plans(bars(spark, sf, "orders"))), "symbol", "ts", risk_points=4, reward_points=4, planned_rr=4)


@query(
    "op_C6_result_projections",
    B("orders") + PLAN_SQL + f""", e AS (SELECT p.*, lead(entry_price) OVER (PARTITION BY symbol ORDER BY ord) AS exit_price FROM p),
 g AS (SELECT *, CASE direction WHEN 'LONG' THEN exit_price-entry_price ELSE entry_price-exit_price END AS gross_points, abs(entry_price-stop_price) AS risk FROM e WHERE exit_price IS NOT NULL)
 SELECT symbol, {ISO('ts')} AS ts, {R('gross_points')} AS gross_points, {R('CASE WHEN risk<=0 THEN 0 ELSE gross_points/risk END')} AS r_multiple FROM g""",
)
def _(spark, sf):
    p = on_chunks(plans(bars(spark, sf, "orders")), lambda d, c: d.withColumn("exit_price", c.lead("entry_price")), ahead=1)
    p = p.filter(F.col("exit_price").isNotNull()).withColumn("risk_per_unit", F.abs(F.col("entry_price") - F.col("stop_price")))
    return out(con.result_projections(p), "symbol", "ts", gross_points=4, r_multiple=4)


@query(
    "op_C7_candle_shape",
    B() + f""" SELECT symbol, {ISO('ts')} AS ts, {R('CASE WHEN high-low<=0 THEN 0 ELSE abs(close-open)/(high-low) END')} AS body_ratio,
 {R('CASE WHEN high-low<=0 THEN 0.5 ELSE (close-low)/(high-low) END')} AS close_location FROM b""",
)
def _(spark, sf):
    b = bars(spark, sf, "supp").withColumns({"body_ratio": ind.body_ratio(), "close_location": ind.close_location()})
    return out(b, "symbol", "ts", body_ratio=4, close_location=4)


@query(
    "op_C8_rejection_predicate",
    B("lines") + f""", l AS (SELECT *, lag(high) OVER w AS up, lag(low) OVER w AS dn FROM b {W_SQL})
 SELECT symbol, {ISO('ts')} AS ts, low<=up AND close>up AS long_rejects, high>=dn AND close<dn AS short_rejects FROM l WHERE up IS NOT NULL""",
)
def _(spark, sf):
    b = on_chunks(bars(spark, sf, "lines"), lambda d, c: d.withColumns({"up": c.lag("high"), "dn": c.lag("low")}), back=1)
    b = b.filter(F.col("up").isNotNull()).withColumns(
        {"long_rejects": ind.rejects(F.col("up"), 1), "short_rejects": ind.rejects(F.col("dn"), -1)}
    )
    return out(b, "symbol", "ts", "long_rejects", "short_rejects")


@query(
    "op_C9_crossover",
    B() + f""", x AS (SELECT *, (open+low)/2 AS m FROM b)
 SELECT symbol, {ISO('ts')} AS ts, coalesce(close>m AND lag(close) OVER w<=lag(m) OVER w, false) AS over, coalesce(close<m AND lag(close) OVER w>=lag(m) OVER w, false) AS under FROM x {W_SQL}""",
)
def _(spark, sf):
    def build(d, c):
        a, m = F.col("close"), (F.col("open") + F.col("low")) / 2
        f = F.lit(False)
        return d.withColumns({"over": F.coalesce(ind.crossover(c, a, m), f), "under": F.coalesce(ind.crossunder(c, a, m), f)})

    return out(on_chunks(bars(spark, sf), build, back=1), "symbol", "ts", "over", "under")


@query(
    "op_C10_session_filter",
    B("events") + f" SELECT symbol, {ISO('ts')} AS ts, strftime(ts,'%H:%M')>='10:00' AS after_open FROM b WHERE strftime(ts,'%H:%M')>='09:30' AND strftime(ts,'%H:%M')<='15:30'",
)
def _(spark, sf):
    b = bars(spark, sf, "events").filter(con.in_session("ts", "09:30", None, "15:30"))
    return out(b.withColumn("after_open", con.in_session("ts", "10:00")), "symbol", "ts", "after_open")


@query(
    "op_C11_finite_filter",
    B("lines") + f" SELECT symbol, {ISO('ts')} AS ts, {R('close')} AS x FROM b WHERE ord%5 NOT IN (0,1,2)",
)
def _(spark, sf):
    o = F.col("ord") % 5
    x = F.when(o == 0, float("inf")).when(o == 1, float("nan")).when(o == 2, F.lit(None)).otherwise(F.col("close"))
    return out(bars(spark, sf, "lines").withColumn("x", x).filter(ind.finite("x")), "symbol", "ts", x=4)
