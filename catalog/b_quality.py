"""Data-quality and session profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.a_sources import DEFECT_SQL, defects
from catalog.base import B, ISO, R, W_SQL, bars, out, query
from tidemark.operators import quality as qa


@query("op_B1_dup_ts_count", B() + DEFECT_SQL + " SELECT symbol, count(*)-count(DISTINCT ts) AS duplicates FROM raw GROUP BY symbol")
def _(spark, sf):
    return qa.dup_ts_count(defects(spark, sf))




@query(
    "op_B2_out_of_order",
    B() + f""", s AS (SELECT symbol, ts, CASE WHEN ord%40=1 THEN ord-1 WHEN ord%40=0 THEN ord+1 ELSE ord END AS ord FROM b),
 d AS (SELECT symbol, lag(ts) OVER w > ts AS back FROM s {W_SQL})
 SELECT symbol, coalesce(bool_or(back), false) AS out_of_order, count(*) FILTER (back) AS steps_back FROM d GROUP BY symbol""",
)
def _(spark, sf):
    """Every fortieth bar swapped with the one after it."""
    o = F.col("ord")
    swapped = F.when(o % 40 == 1, o - 1).when(o % 40 == 0, o + 1).otherwise(o)
    return qa.out_of_order(bars(spark, sf).select("symbol", "ts", swapped.alias("ord")))


@query(
    "op_B3_null_profile",
    B() + """ SELECT symbol, count(*) FILTER (ord%31=2) AS open_nulls, 0::BIGINT AS high_nulls, 0::BIGINT AS low_nulls,
 count(*) FILTER (ord%37=4) AS close_nulls, count(*) FILTER (ord%41=6) AS volume_nulls FROM b GROUP BY symbol""",
)
def _(spark, sf):
    o = F.col("ord")
    text = lambda c: F.col(c).cast("string")
    b = bars(spark, sf).select(
        "symbol",
        F.when(o % 31 == 2, "n/a").otherwise(text("open")).alias("open"),
        text("high").alias("high"),
        text("low").alias("low"),
        F.when(o % 37 == 4, F.lit(None)).otherwise(text("close")).alias("close"),
        F.when(o % 41 == 6, "NaN").otherwise(text("volume")).alias("volume"),
    )
    return qa.null_profile(b)


@query(
    "op_B4_bad_ohlc_count",
    B() + DEFECT_SQL + " SELECT symbol, count(*) FILTER (low>least(open,close) OR high<greatest(open,close) OR high<low OR close<=0 OR volume<0) AS bad_rows FROM raw GROUP BY symbol",
)
def _(spark, sf):
    from tidemark.operators.ingest import nan_to_null

    return qa.bad_ohlc_count(nan_to_null(defects(spark, sf)))


_DELTA = f""", d AS (SELECT symbol, ts, (epoch_us(ts)-epoch_us(lag(ts) OVER w))/1e6 AS delta_s FROM b {W_SQL}),
 e AS (SELECT * FROM d WHERE delta_s IS NOT NULL)"""


@query(
    "op_B5_spacing_histogram",
    B() + _DELTA + """ SELECT symbol, delta_s, n, rank FROM (SELECT symbol, delta_s, count(*) AS n, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, delta_s) AS rank FROM e GROUP BY symbol, delta_s) WHERE rank<=10""",
)
def _(spark, sf):
    return out(qa.spacing_histogram(bars(spark, sf)), "symbol", "delta_s", "n", "rank")


@query(
    "op_B6_spacing_vs_expected",
    B("events") + _DELTA + " SELECT symbol, count(*) FILTER (delta_s=1800) AS exact, count(*) FILTER (delta_s<1800) AS shorter, count(*) FILTER (delta_s>1800) AS longer FROM e GROUP BY symbol",
)
def _(spark, sf):
    return qa.spacing_vs_expected(bars(spark, sf, "events"), 30)


@query("op_B7_largest_gaps", B() + _DELTA + f" SELECT symbol, {ISO('ts')} AS ts, delta_s FROM e ORDER BY delta_s DESC, symbol, ts LIMIT 10")
def _(spark, sf):
    return out(qa.largest_gaps(bars(spark, sf)), "symbol", "ts", "delta_s")


@query(
    "op_B8_column_diff",
    """WITH h AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM lineitem)), e AS (SELECT unnest(['l_orderkey','l_close','l_shipdate','l_tax']) AS c)
 SELECT c AS "column", 'missing' AS status FROM e WHERE c NOT IN (SELECT c FROM h) UNION ALL SELECT c, 'extra' FROM h WHERE c NOT IN (SELECT c FROM e)""",
)
def _(spark, sf):
    have = spark.read.parquet(f"{sf}/lineitem.parquet").columns
    return qa.column_diff(spark, have, ["l_orderkey", "l_close", "l_shipdate", "l_tax"])


@query("op_B17_load_summary", B() + f" SELECT symbol, count(*) AS bars, {ISO('min(ts)')} AS first_ts, {ISO('max(ts)')} AS last_ts FROM b GROUP BY symbol")
def _(spark, sf):
    return out(qa.load_summary(bars(spark, sf)), "symbol", "bars", "first_ts", "last_ts")


@query(
    "op_B16_next_bar_mapping",
    B() + f" SELECT symbol, {ISO('ts')} AS ts, {ISO('lead(ts) OVER w')} AS next_ts, {R('lead(open) OVER w')} AS next_open FROM b {W_SQL}",
)
def _(spark, sf):
    return out(qa.next_bar_mapping(bars(spark, sf)), "symbol", "ts", "next_ts", next_open=4)
