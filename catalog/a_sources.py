"""Scans, sinks and the cleaning pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import B, ISO, R, bars, iso, out, query, rnd
from tidemark.operators import ingest as ing
from tidemark.plans.series import chunk_rows
from tidemark.session import staged_once, work_root
from tidemark.sources import bar_files as files

DEFECT_SQL = """,
bad AS (SELECT symbol, ts,
  CASE WHEN ord%109=13 THEN NULL ELSE open END AS open,
  CASE WHEN ord%101=7 THEN close-10 ELSE high END AS high,
  CASE WHEN ord%97=5 THEN open+10 ELSE low END AS low,
  CASE WHEN ord%103=9 THEN -1.0 ELSE close END AS close,
  CASE WHEN ord%107=11 THEN NULL ELSE volume END AS volume, ord*2 AS file_ord FROM b),
raw AS (SELECT * FROM bad UNION ALL SELECT symbol, ts, open+1, high+1, low, close, volume, ord*2+1 FROM b WHERE ord%50=3)"""

DEDUPE_SQL = DEFECT_SQL + """,
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY file_ord) AS rn FROM raw) WHERE rn=1),
f AS (SELECT *, coalesce(low>least(open,close) OR high<greatest(open,close) OR high<low OR close<=0 OR volume<0, false) AS bad,
  (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS hasnull FROM u)"""


def defects(spark, sf):
    """Bars with faults placed by position: wrong lows, highs, closes, NaNs and repeats."""
    o, nan = F.col("ord"), F.lit(float("nan"))
    b = bars(spark, sf, "supp")
    bad = b.select(
        "symbol",
        "ts",
        F.when(o % 109 == 13, nan).otherwise(F.col("open")).alias("open"),
        F.when(o % 101 == 7, F.col("close") - 10).otherwise(F.col("high")).alias("high"),
        F.when(o % 97 == 5, F.col("open") + 10).otherwise(F.col("low")).alias("low"),
        F.when(o % 103 == 9, -1.0).otherwise(F.col("close")).alias("close"),
        F.when(o % 107 == 11, nan).otherwise(F.col("volume")).alias("volume"),
        (o * 2).alias("file_ord"),
    )
    again = b.filter(o % 50 == 3).select(
        "symbol", "ts", F.col("open") + 1, F.col("high") + 1, "low", "close", "volume", o * 2 + 1
    )
    return bad.union(again)


def csv_folder(spark, sf):
    """The faulty bars written as CSV, a folder of part files per symbol.

    Rows are gathered by symbol and chunk first, so that the number of files follows the data, not tasks
    times symbols.
    """
    key = f"{work_root(spark)}/{spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex}"

    def make():
        rows = defects(spark, sf).select(
            F.concat("symbol", F.lit("240_comma")).alias("file"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(" Date"),
            *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close")],
            F.col("volume").alias("Vol"),
            F.col("symbol").alias("sym"),
            F.floor(F.col("file_ord") / (2 * chunk_rows())).alias("_chunk"),
        )
        files.sink_csv_files(rows, key, "file", "_chunk")
        return spark.createDataFrame([(key,)], "path string")

    return staged_once(spark, (sf, "csvdir"), make).first()["path"]


@query(
    "op_A1_scan_bars_csv",
    B() + DEDUPE_SQL + f" SELECT count(*) AS bars, {R('sum(close)',2)} AS sum_close, {ISO('min(ts)')} AS first_ts, {ISO('max(ts)')} AS last_ts FROM f WHERE NOT bad AND NOT hasnull",
)
def _(spark, sf):
    """CSV text through the whole pipeline; repeats arrive in file order per symbol."""
    raw = (
        spark.read.option("header", True)
        .schema("Date string, Open string, High string, Low string, Close string, Vol string, symbol string, file string")
        .csv(csv_folder(spark, sf))
    )
    data = ing.parse_ts(ing.normalize_columns(raw))
    data = data.withColumns({c: F.col(c).try_cast("double") for c in ing.FIELDS})
    # Part files have no order of their own here, so the repeat (one higher) comes second.
    data = data.withColumn("file_ord", F.col("open"))
    got = ing.ingest(data.select("symbol", "ts", *ing.FIELDS, "file_ord"))
    s = got.agg(
        F.count(F.lit(1)).alias("bars"), F.sum("close").alias("sum_close"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return out(s, "bars", "first_ts", "last_ts", sum_close=2)


@query("op_A2_discover_universe", "SELECT DISTINCT 'S'||l_suppkey AS symbol FROM lineitem WHERE l_suppkey <> 1")
def _(spark, sf):
    found = files.discover_universe(spark, csv_folder(spark, sf), "*.csv")
    sym = F.regexp_extract("path", r"file=(S\d+)240_comma", 1)
    return found.select(sym.alias("symbol")).distinct().filter(F.col("symbol") != "S1")


@query("op_A3_normalize_columns", B() + f" SELECT symbol, {ISO('ts')} AS date, {R('open')} AS open, {R('close')} AS close, volume FROM b")
def _(spark, sf):
    b = bars(spark, sf).select("symbol", "ts", "open", "high", "low", "close", "volume")
    b = b.toDF("Symbol", " DateTime ", "OPEN", "High", "low ", "Close", "Vol")
    n = ing.normalize_columns(b)
    return out(n, "symbol", "date", "volume", open=4, close=4)


@query(
    "op_A4_parse_ts",
    B() + f" SELECT symbol, ord, {ISO('CASE WHEN ord%10<>0 THEN ts END')} AS ts FROM b",
)
def _(spark, sf):
    text = F.when(F.col("ord") % 10 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    b = bars(spark, sf).select("symbol", "ord", text.alias("date"))
    return out(ing.parse_ts(b, strict=False), "symbol", "ord", "ts")


@query("op_A5_sort_dedupe", B() + DEDUPE_SQL + f" SELECT symbol, {ISO('ts')} AS ts, {R('close')} AS close, file_ord FROM u")
def _(spark, sf):
    return out(ing.sort_dedupe(ing.nan_to_null(defects(spark, sf))), "symbol", "ts", "file_ord", close=4)


@query("op_A6_validate_ohlc", B() + DEDUPE_SQL + f" SELECT symbol, {ISO('ts')} AS ts, {R('high')} AS high, {R('low')} AS low FROM f WHERE NOT bad")
def _(spark, sf):
    return out(ing.validate_ohlc(ing.sort_dedupe(ing.nan_to_null(defects(spark, sf)))), "symbol", "ts", high=4, low=4)


@query("op_A7_drop_nulls", B() + DEDUPE_SQL + f" SELECT symbol, {ISO('ts')} AS ts, {R('open')} AS open, {R('close')} AS close FROM f WHERE NOT bad AND NOT hasnull")
def _(spark, sf):
    return out(ing.ingest(defects(spark, sf)), "symbol", "ts", open=4, close=4)


@query(
    "op_A8_ingest_report",
    B() + DEDUPE_SQL + """ SELECT f.symbol, any_value(t.n) AS rows_read, any_value(t.n)-count(*) AS duplicates, count(*) FILTER (bad) AS bad_ohlc,
  count(*) FILTER (NOT bad AND hasnull) AS null_rows, count(*) FILTER (NOT bad AND NOT hasnull) AS rows_kept
  FROM f JOIN (SELECT symbol, count(*) AS n FROM raw GROUP BY symbol) t USING (symbol) GROUP BY f.symbol""",
)
def _(spark, sf):
    return ing.ingest_report(defects(spark, sf))


@query(
    "op_A9_date_range_filter",
    B("orders") + f" SELECT symbol, {ISO('ts')} AS ts, {R('close')} AS close FROM b WHERE ts BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-02-28'",
)
def _(spark, sf):
    return out(ing.date_range_filter(bars(spark, sf, "orders"), "1996-03-01", "1998-02-28"), "symbol", "ts", close=4)


@query(
    "op_A10_sink_parquet",
    B("lines") + f" SELECT symbol, count(*) AS bars, {R('sum(close)',2)} AS sum_close, {ISO('max(ts)')} AS last_ts FROM b GROUP BY symbol",
)
def _(spark, sf):
    """Bars written by symbol and read back from the partitioned table."""
    path = f"{work_root(spark)}/{spark.sparkContext.applicationId}/cache-{uuid.uuid4().hex}"
    files.sink_bars(bars(spark, sf, "lines"), path)
    s = spark.read.parquet(path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("close").alias("sum_close"), F.max("ts").alias("last_ts")
    )
    return out(s, "symbol", "bars", "last_ts", sum_close=2)


_CENTS = "||'|'||".join(f"(floor({c}*1e6+0.5)::BIGINT)::VARCHAR" for c in ing.FIELDS)
_FP = "||'|'||".join(f"sum(('0x'||substr(h,{1 + 15 * i},15))::BIGINT::HUGEINT)::VARCHAR" for i in range(4))
FINGER_SQL = f""",
h AS (SELECT symbol, sha256(epoch_us(ts)::VARCHAR||'|'||{_CENTS}) AS h FROM b),
fp AS (SELECT symbol, substr(sha256(count(*)::VARCHAR||'|'||{_FP}),1,12) AS fingerprint FROM h GROUP BY symbol)"""


@query("op_A11_series_fingerprint", B() + FINGER_SQL + " SELECT symbol, fingerprint FROM fp")
def _(spark, sf):
    return ing.series_fingerprint(bars(spark, sf))


@query(
    "op_A12_universe_fingerprint",
    B() + FINGER_SQL + f""", s AS (SELECT sha256(symbol||':'||fingerprint) AS h FROM fp)
  SELECT substr(sha256(count(*)::VARCHAR||'|'||{_FP}),1,16) AS fingerprint, count(*) AS n_symbols FROM s""",
)
def _(spark, sf):
    return ing.universe_fingerprint(bars(spark, sf))


@query("op_A13_read_equity_artifact", B("lines") + f" SELECT symbol, {ISO('ts')} AS ts, {R('100*close/first(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)')} AS equity FROM b")
def _(spark, sf):
    """Equity curves written as CSV, a folder per symbol, and read back by their column roles."""
    path = f"{work_root(spark)}/{spark.sparkContext.applicationId}/equity-{uuid.uuid4().hex}"
    b = bars(spark, sf, "lines")
    first = b.filter("ord = 0").select("symbol", F.col("close").alias("c0"))
    eq = b.join(first, "symbol").select(
        "symbol", iso("ts").alias("Date"), F.col("symbol").alias("label"), (100 * F.col("close") / F.col("c0")).alias("equity")
    )
    eq.write.partitionBy("symbol").option("header", True).csv(path)
    return out(files.read_equity_artifact(spark, path, ["symbol"]), "symbol", "ts", equity=4)


def run_folder(spark, sf):
    """One folder per (symbol, half) run with a manifest and a metrics document."""
    root = f"{work_root(spark)}/{spark.sparkContext.applicationId}/runs-{uuid.uuid4().hex}"
    stats = bars(spark, sf, "orders").groupBy("symbol", (F.col("ord") % 2).alias("half")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("close").alias("m")
    )
    run = F.concat(F.regexp_replace("symbol", "[^A-Za-z0-9]+", "-"), F.lit("_"), F.col("half"))
    manifest = stats.select(
        run.alias("run"),
        F.to_json(
            F.struct(
                run.alias("run_id"),
                F.concat(F.lit("2026-01-0"), F.col("half") + 1).alias("started_utc"),
                F.struct(
                    F.struct(F.concat(F.lit("strategies/"), F.regexp_replace("symbol", "[^A-Za-z0-9]+", "-"), F.lit(".py")).alias("path")).alias("strategy")
                ).alias("config"),
            )
        ).alias("value"),
    )
    metrics = stats.select(run.alias("run"), F.to_json(F.struct(F.col("n").alias("num_trades"), rnd("m").alias("sharpe"))).alias("value"))
    return root, manifest, metrics


def catalog_table(spark, sf):
    def make():
        root, manifest, metrics = run_folder(spark, sf)
        for name, table in (("manifest", manifest), ("metrics", metrics)):
            table.repartition("run").write.partitionBy("run").text(f"{root}/{name}")
        return spark.createDataFrame([(root,)], "path string")

    return staged_once(spark, (sf, "runs"), make).first()["path"]


def read_runs(spark, sf):
    root = catalog_table(spark, sf)
    m = spark.read.json(f"{root}/manifest").select(
        "run_id", files.stem_of(F.col("config.strategy.path")).alias("strategy"), F.col("started_utc").alias("modified")
    )
    q = spark.read.json(f"{root}/metrics").select(F.col("run").alias("run_id"), "num_trades", "sharpe")
    return m.join(q, "run_id")


_RUNS_SQL = B("orders") + """, r AS (SELECT regexp_replace(symbol,'[^A-Za-z0-9]+','-','g') AS strategy, ord%2 AS half, count(*) AS num_trades, avg(close) AS m FROM b GROUP BY 1,2)"""


@query("op_A14_read_run_catalog", _RUNS_SQL + f" SELECT strategy||'_'||half AS run_id, strategy, num_trades, {R('m')} AS sharpe FROM r WHERE contains(strategy,'I')")
def _(spark, sf):
    runs = read_runs(spark, sf).filter(F.col("strategy").contains("I"))
    return out(runs, "run_id", "strategy", "num_trades", sharpe=4)


@query("op_A15_latest_run_per_strategy", _RUNS_SQL + " SELECT strategy, strategy||'_'||max(half) AS run_id FROM r GROUP BY strategy")
def _(spark, sf):
    return files.latest_run_per_strategy(read_runs(spark, sf))


@query("op_A16_write_artifacts", B("orders") + f" SELECT symbol AS run_id, count(*) AS n, {R('sum(close)',2)} AS s FROM b GROUP BY symbol")
def _(spark, sf):
    """Two writes to one table: the second replaces only its own run's partition."""
    path = f"{work_root(spark)}/{spark.sparkContext.applicationId}/artifacts-{uuid.uuid4().hex}"
    b = bars(spark, sf, "orders").select(F.col("symbol").alias("run_id"), "ts", "close")
    files.write_artifacts(b.withColumn("close", F.when(F.col("run_id") == "5-LOW", 0.0).otherwise(F.col("close"))), path)
    files.write_artifacts(b.filter("run_id = '5-LOW'"), path)
    s = spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("s"))
    return out(s, "run_id", "n", s=2)


_TF_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '{t}(_|$)') THEN '{v}'" for t, v in ing.TIMEFRAMES) + " ELSE 'na' END"


@query(
    "op_A17_timeframe_from_name",
    f"""WITH n AS (SELECT o_orderkey, 'A'||o_custkey||'_'||(CASE o_orderkey%8 WHEN 0 THEN '1D' WHEN 1 THEN 'daily' WHEN 2 THEN '1440' WHEN 3 THEN '4h' WHEN 4 THEN 'h1' WHEN 5 THEN '15m' WHEN 6 THEN '1h' ELSE '5m' END)||'_comma.csv' AS name FROM orders),
 m AS (SELECT o_orderkey, regexp_replace(lower(regexp_replace(name,'\\.csv$','')),'(_comma|_data)$','') AS s FROM n)
 SELECT o_orderkey, {_TF_SQL} AS timeframe FROM m""",
)
def _(spark, sf):
    tag = F.element_at(
        F.array(*[F.lit(x) for x in ("1D", "daily", "1440", "4h", "h1", "15m", "1h", "5m")]), (F.col("o_orderkey") % 8 + 1).cast("int")
    )
    name = F.concat(F.lit("data/A"), F.col("o_custkey"), F.lit("_"), tag, F.lit("_comma.csv"))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", ing.timeframe_from_name(name).alias("timeframe"))


@query(
    "op_A18_asset_timeframe_catalog",
    """SELECT 'X'||o_custkey AS asset, min(CASE WHEN o_orderkey%2=0 THEN 'daily/X'||o_custkey||'1440_comma.csv' END) AS daily,
 min(CASE WHEN o_orderkey%2=1 THEN 'fourhours/X'||o_custkey||'240_comma.csv' END) AS four_hour FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    path = F.when(
        F.col("o_orderkey") % 2 == 0, F.concat(F.lit("daily/X"), F.col("o_custkey"), F.lit("1440_comma.csv"))
    ).otherwise(F.concat(F.lit("fourhours/X"), F.col("o_custkey"), F.lit("240_comma.csv")))
    return ing.asset_timeframe_catalog(o.select(path.alias("path")))
