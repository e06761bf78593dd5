"""Plans and job shapes that have to hold at size."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals as sig

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_averages_of_several_reaches_share_one_exchange(spark, make_bars):
    """F1, F8: each average dealt the wide rows twice."""
    b = make_bars([100 + i % 7 for i in range(300)])
    from tidemark.functions.ewm import ewm, span_alpha
    from tidemark.plans.series import on_chunks

    d = on_chunks(b, lambda d, c: ewm(d, c, {f"e{n}": ("close", span_alpha(n), n) for n in (5, 20, 50)}), back=1000)
    assert exchanges(d) == 1
    assert exchanges(sig.golden_cross(b, 20, 60)) <= 2


@tables
def test_csv_bars_are_one_file_a_symbol(spark):
    """every task wrote a file for each of its symbols."""
    from catalog.a_sources import csv_folder

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(csv_folder(spark, SF)).select("path")
    folder = F.regexp_extract("path", "file=([^/]+)", 1)
    most = files.groupBy(folder.alias("f")).count().agg(F.max("count")).first()[0]
    assert most == 1


@tables
def test_csv_bars_are_put_in_place_by_the_tasks(spark):
    """Hadoop started several processes for each file, and wrote a checksum file beside it."""
    from catalog.a_sources import csv_folder

    found = [f for _, _, names in os.walk(csv_folder(spark, SF).removeprefix("file:")) for f in names]
    assert found and all(f.startswith("part-") and f.endswith(".csv") for f in found)


def test_numbers_of_a_task_are_those_of_the_plan(spark):
    """the numbers were joined to every series, 2 MB a row."""
    from tidemark.functions.rng import uniform, uniform_rows

    rows = spark.range(300).select((F.col("id") % 3).alias("sim"), F.floor(F.col("id") / 3).alias("k"))
    got = uniform_rows(42, "iid", 3, 100)
    for r in rows.withColumn("u", uniform(42, "iid", "sim", "k")).collect():
        assert got[r["sim"], r["k"]] == r["u"]


@tables
def test_simulations_of_a_short_series_stay_in_its_row(spark):
    """A thousand rows a series were shuffled, and its numbers joined to it."""
    from catalog.g_returns import gold_equity
    from tidemark.operators import blocks
    from tidemark.operators import resample as rs

    e = gold_equity(spark, SF)
    x = rs.indexed_returns(e)
    p = blocks.packed_paths(x, rs.sample_sizes(x), 50, 20)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInPandas")]
    assert all(len(r["dd"]) == 50 for r in p.collect())
    a = rs.marker_percentiles(rs.path_outcomes(e, 50)).toPandas().set_index("symbol").sort_index()
    b = rs.outcome_percentiles(e, 50).toPandas().set_index("symbol").sort_index()
    for c in ("terminal_p05", "maxdd_p95"):
        assert abs(a[c] - b[c]).max() < 1e-12


@tables
def test_bands_of_a_short_series_leave_the_task_alone(spark):
    """whole curves of all simulations were written and shuffled."""
    from catalog.g_returns import gold_equity
    from tidemark.operators import resample as rs

    e = gold_equity(spark, SF)
    got = rs.simulated_bands(e, 20, 20)
    want = rs.path_bands(rs.simulated_paths(e, 20, 20))
    at = lambda d: d.toPandas().set_index(["symbol", "ord"]).sort_index()
    a, b = at(got), at(want)
    assert list(a.index) == list(b.index) and abs(a - b[a.columns]).max().max() < 1e-12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInPandas")]


def test_shuffles_of_short_and_long_series_agree(spark, make_bars, monkeypatch):
    """Every placed block of every shuffle was a row, sorted and joined three times."""
    from tidemark.operators import resample as rs

    b = make_bars([100 + (i * 7) % 13 + i / 50 for i in range(150)]).withColumn("weight", F.expr("CAST((ord div 9) % 3 AS DOUBLE)"))
    b = b.unionByName(make_bars([100.0, 101.0], "TWO").withColumn("weight", F.lit(1.0)))
    run = lambda: {(r["symbol"], r["block"]): list(r)[2:] for r in rs.signal_block_shuffle(b, [2, 20], 9).collect()}
    short = run()
    monkeypatch.setattr(rs, "TILE", 1)
    long = run()
    assert set(short) == set(long)
    for k, v in short.items():
        assert v == pytest.approx(long[k])


@tables
def test_symbols_are_counted_before_they_are_joined(spark):
    """all bars met the excluded symbols."""
    from catalog import QUERIES

    plan = QUERIES["op_D11_semi_anti"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Left") == 2 and "open#" not in plan  # the joins read counts, not bars


@tables
def test_bars_are_dealt_before_they_are_sorted(spark):
    """F24 and all queries on bars: whole input splits were sorted for the first half of the aggregate."""
    from tidemark.sources.derived import ticks, to_bars

    plan = to_bars(ticks(spark, SF, "supp"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan[plan.index("Exchange") :]


def test_rounding_keeps_large_numbers(spark):
    """numbers above 9.2e14 came out as the largest long."""
    from catalog.base import rnd

    row = spark.sql("select 1e28D as a, 1.00005D as b, -3e20D as c, cast(null as double) as d").select(*[rnd(c).alias(c) for c in "abcd"]).first()
    assert tuple(row) == (1e28, 1.0001, -3e20, None)


def test_no_breakouts_have_a_grand_total(spark):
    """where no bar leaves its opening range, the SQL has one row and the query had none."""
    from tidemark.operators.quality import direction_time_distribution

    none = spark.sql("SELECT 'LONG' AS direction, timestamp'2024-01-01 11:00:00' AS ts WHERE false")
    assert [tuple(r) for r in direction_time_distribution(none).collect()] == [(None, None, 0)]
    some = spark.sql("SELECT IF(id < 2, 'LONG', NULL) AS direction, timestamp'2024-01-01 11:00:00' AS ts FROM range(3)")
    got = sorted(map(str, map(tuple, direction_time_distribution(some).collect())))
    assert got == sorted(map(str, [(None, None, 3), (None, None, 1), (None, "11:00", 1), ("LONG", None, 2), ("LONG", "11:00", 2)]))


def test_equity_of_a_rule_needs_one_exchange_of_rows(spark, make_bars):
    """Averages, returns and path each dealt the rows, twice over, and joined them to their carries."""
    from tidemark.operators import pnl
    from tidemark.plans.series import chunks_of, equity_on_chunks, equity_scan

    b = make_bars([100 + (i * 7) % 13 + i / 50 for i in range(300)]).unionByName(make_bars([100.0, 101.0], "TWO"))
    build = lambda d, c: pnl.weight_returns_on(sig.golden_cross_on(d, c, 5, 20), c)
    with chunks_of(32):
        got = equity_on_chunks(b, build, "test-equity", back=22)
        want = equity_scan(pnl.weight_returns(sig.golden_cross(b, 5, 20)))
    at = lambda d: d.select("symbol", "ord", "r", "equity", "peak", "drawdown").toPandas().set_index(["symbol", "ord"]).sort_index()
    x, y = at(got), at(want)
    assert list(x.index) == list(y.index) and len(x) == 302 and abs(x - y).max().max() < 1e-12 and x["equity"].nunique() > 50
    assert exchanges(got) == 0  # only tables that are written


@tables
def test_fills_are_dealt_once_for_trades(spark):
    """both running counts dealt the fills anew, and the second did the first's work again for its totals."""
    from catalog.base import fills
    from tidemark.operators.trades import extract_trades
    from tidemark.plans.series import chunks_of

    f = fills(spark, SF)
    whole = extract_trades(f)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") <= 2  # whole rows, and the quantities for the trade numbers
    with chunks_of(16):
        cut = extract_trades(f)
    rows = lambda d: sorted(map(tuple, d.collect()), key=lambda r: (r[0], r[1]))
    a, b = rows(whole), rows(cut)
    assert a and [r[:2] for r in a] == [r[:2] for r in b] and all(x == pytest.approx(y) if isinstance(x, float) else x == y for r, q in zip(a, b) for x, y in zip(r, q))


@tables
def test_signal_profile_folds_no_long_frames(spark):
    """frames of 50 and 200 rows were folded anew for every row, and rows were dealt twice."""
    from catalog import QUERIES

    plan = QUERIES["op_B11_signal_profile"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, -199, currentrow" not in plan and plan.count("REPARTITION_BY_COL") == 1


@tables
def test_short_symbols_are_dealt_once_for_bars(spark):
    """F23 and all queries on bars: bars were written and dealt a second time for their positions."""
    from tidemark.sources.derived import numbered_bars, ticks

    raw = ticks(spark, SF, "supp")
    assert exchanges(numbered_bars(raw)) == 1
    raw = raw.filter("symbol < 'S5' OR qty < 5")  # some symbols above 200 ticks, some below
    lengths = [r["count"] for r in raw.groupBy("symbol").count().collect()]
    assert min(lengths) <= 200 < max(lengths)
    whole, mixed = numbered_bars(raw), numbered_bars(raw, rows=200)
    assert whole.count() == mixed.count() == raw.select("symbol", "ts").distinct().count()
    assert whole.exceptAll(mixed).isEmpty()
    n = mixed.groupBy("symbol").agg(F.min("ord").alias("a"), F.max("ord").alias("z"), F.countDistinct("ord").alias("n"))
    assert n.filter("a <> 0 OR z <> n - 1").isEmpty()
