import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts as con
from tidemark.operators import metrics as met
from tidemark.operators import pnl
from tidemark.operators import returns as ret
from tidemark.operators import trades as trd
from tidemark.plans.series import chunks_of, equity_scan


def weights(bars, fn):
    return bars.withColumn("weight", fn(F.col("ord")).cast("double"))


UP = [100 * 1.01**i for i in range(20)]


def growth(df):
    return df.agg(F.product(1 + F.col("r")).alias("g")).first()["g"]


def test_costless_buy_hold_is_price_return(make_bars):
    b = make_bars(UP)
    r = pnl.next_open_returns(weights(b, lambda o: F.lit(1)), 0, 0)
    # The first bar only sets the weight; it is bought at the second open.
    assert growth(r) == pytest.approx(UP[-1] / UP[1])


def test_signal_acts_one_bar_later_and_last_never(make_bars):
    b = make_bars(UP)
    r = pnl.next_open_returns(weights(b, lambda o: F.when(o == 5, 1).otherwise(0)), 0, 0)
    active = [x["ord"] for x in r.filter("abs(r) > 1e-12").collect()]
    assert active == [7]  # bought at the open of bar 6 (= its close), sold at the open of bar 7
    r = pnl.next_open_returns(weights(b, lambda o: F.when(o == 19, 1).otherwise(0)), 0, 0)
    assert growth(r) == 1.0


def test_costs_and_warmup(make_bars):
    b = weights(make_bars(UP), lambda o: F.lit(1))
    assert growth(pnl.next_open_returns(b, 1, 5)) < growth(pnl.next_open_returns(b, 0, 0))
    late = pnl.next_open_returns(b, 0, 0, warmup=10)
    assert late.filter("ord <= 10 and r <> 0").count() == 0 and growth(late) > 1
    flat = pnl.next_open_returns(weights(make_bars(UP), lambda o: F.when(o < 5, 1).otherwise(0)), 0, 0)
    assert flat.filter("ord > 6 and r <> 0").count() == 0


def test_no_short_clamp(make_bars):
    b = weights(make_bars(UP), lambda o: F.lit(-1))
    assert pnl.portfolio_returns(b, 0).filter("r < 0").count() > 0
    assert pnl.portfolio_returns(b, 0, allow_short=False).filter("r <> 0").count() == 0


def test_benchmark_with_costs_is_lower(make_bars):
    b = weights(make_bars(UP), lambda o: o % 2)
    dear = pnl.same_exposure_benchmark(b, 10, 10)
    assert growth(dear) < growth(pnl.same_exposure_benchmark(b, costs=False))


def test_weight_contract(make_bars):
    b = make_bars(UP)
    ok = weights(b, lambda o: F.when(o > 3, 1)).select("symbol", "ts", "weight")
    assert con.validate_weights(b, ok).filter("weight is null").count() == 0
    for bad, text in (
        (ok.withColumn("weight", F.lit(1.5)), "must lie"),
        (ok.withColumn("weight", F.lit(None).cast("double")), "all weights"),
        (ok.filter("ts > timestamp_ntz'2020-01-05'"), "aligned"),
    ):
        with pytest.raises(Exception, match=text):
            con.validate_weights(b, bad).collect()
    with pytest.raises(ValueError, match="numeric"):
        con.validate_weights(b, ok.withColumn("weight", F.lit("x")))


def fills(spark, rows):
    t0 = dt.datetime(2020, 1, 1)
    data = [("AAA", t0 + dt.timedelta(days=i), i, float(q), float(p), float(c)) for i, (q, p, c) in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, ord long, qty double, price double, commission double")


def test_round_trips(spark):
    t = trd.extract_trades(fills(spark, [(100, 50, 1), (-100, 55, 1)])).first()
    assert (t["direction"], t["gross_pnl"], t["pnl"]) == ("LONG", 500.0, 498.0)
    t = trd.extract_trades(fills(spark, [(-100, 50, 1), (100, 45, 1)])).first()
    assert (t["direction"], t["gross_pnl"]) == ("SHORT", 500.0)
    assert trd.extract_trades(fills(spark, [(100, 50, 1)])).count() == 0
    flip = trd.extract_trades(fills(spark, [(10, 50, 1), (5, 51, 1), (-20, 55, 2), (5, 50, 1)])).orderBy("trade").collect()
    assert [(x["direction"], x["qty"], x["scale_ins"], x["commission"]) for x in flip] == [("LONG", 10.0, 1, 2.0), ("SHORT", 5.0, 0, 2.0)]


CASES = [
    # later bars (open, high, low, close), direction, expected price, reason, bars held
    ([(101, 105, 100, 104)], "LONG", 104.0, "TARGET", 1),
    ([(99, 101, 97, 98)], "LONG", 98.0, "STOP", 1),
    ([(100, 105, 97, 100)], "LONG", 98.0, "STOP", 1),
    ([(96, 97, 95, 96)], "LONG", 96.0, "STOP", 1),
    ([(106, 107, 105, 106)], "LONG", 106.0, "TARGET", 1),
    ([(99, 100, 95, 96)], "SHORT", 96.0, "TARGET", 1),
    ([(101, 103, 100, 102)], "SHORT", 102.0, "STOP", 1),
    ([(104, 105, 103, 104)], "SHORT", 104.0, "STOP", 1),
    ([(100, 101, 99, 100), (100, 101, 99, 101)], "LONG", 101.0, "END_OF_DATA", 2),
    ([], "LONG", 100.0, "END_OF_DATA", 0),
    ([(100, 101, 99, 100)] * 40 + [(101, 105, 100, 104)], "LONG", 104.0, "TARGET", 41),
]


@pytest.mark.parametrize("later,direction,price,reason,held", CASES)
def test_bracket_exits(spark, later, direction, price, reason, held):
    t0 = dt.datetime(2025, 1, 1, 10)
    ohlc = [(100, 110, 90, 100), *later]  # the entry bar itself is never looked at
    rows = [("AAA", t0 + dt.timedelta(minutes=5 * i), i, *map(float, x)) for i, x in enumerate(ohlc)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ord long, open double, high double, low double, close double")
    stop, target = (98.0, 104.0) if direction == "LONG" else (102.0, 96.0)
    plan = spark.createDataFrame(
        [("p", "AAA", t0, 0, direction, 100.0, stop, target)],
        "plan_id string, symbol string, ts timestamp_ntz, ord long, direction string, entry_price double, stop_price double, target_price double",
    )
    got = trd.bracket_exits(plan, bars, fan=3).first()
    assert (got["exit_price"], got["exit_reason"], got["bars_held"]) == (price, reason, held)


def curve(make_bars, values):
    b = make_bars(values).withColumn("equity", F.col("close"))
    return met.equity_returns(b)


def test_metrics_of_known_series(make_bars):
    e = curve(make_bars, [100, 110, 121])
    d = equity_scan(e).withColumn("equity", F.col("close"))
    assert met.core_metrics(d).first()["total_return"] == pytest.approx(0.21)
    rets = [0.01, -0.005, 0.008, -0.003, 0.012, 0.002, -0.006, 0.009, 0.001, -0.004]
    d = equity_scan(curve(make_bars, 100 * np.cumprod([1, *(1 + np.array(rets))])))
    m = met.metric_set(d).first()
    assert m["sharpe"] == pytest.approx(np.mean(rets) / np.std(rets, ddof=1) * 252**0.5)
    assert m["var_95"] == pytest.approx(np.percentile(rets, 5))
    d = equity_scan(curve(make_bars, [100, 120, 90, 95, 130]))
    m = met.metric_set(d).first()
    assert m["max_drawdown"] == pytest.approx(-0.25)
    assert (m["max_drawdown_duration_bars"], m["max_drawdown_duration_days"]) == (2, 2.0)


def test_trade_metrics(spark):
    rows = [("AAA", float(p), 10.0, 50.0) for p in (100, 200, 300)]
    t = met.trade_metrics(spark.createDataFrame(rows, "symbol string, pnl double, qty double, entry_price double")).first()
    assert (t["win_rate"], t["num_trades"], t["profit_factor"]) == (1.0, 3, float("inf"))
    rows = [("AAA", float(p), 10.0, 50.0) for p in (100, -50, 200, -30)]
    t = met.trade_metrics(spark.createDataFrame(rows, "symbol string, pnl double, qty double, entry_price double")).first()
    assert t["win_rate"] == 0.5 and t["profit_factor"] == pytest.approx(300 / 80)


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [0.001, 0.02, 0.3, 0.5, 0.77, 0.99]
    got = [r["z"] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(met.normal_quantile(F.col("p")).alias("z")).collect()]
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(p) for p in ps], rtol=1e-8, atol=1e-9)


def test_growth_does_not_depend_on_chunks(make_bars):
    """a product rounded at every row and every cut, so its last digits were those of the chunks."""
    x = make_bars([1.0] * 3000).select("symbol", "ord", (F.pmod(F.hash("ord"), F.lit(1000)) / 1e4).alias("h"))
    got = []
    for rows in (64, 1000, 100_000):
        with chunks_of(rows):
            got.append(ret.compounded_growth(x, "h").orderBy("ord").toPandas())
    logs = np.log(1 + got[0].h.to_numpy()).astype(np.longdouble).cumsum()
    np.testing.assert_allclose(got[0].growth, np.exp(logs).astype(float), rtol=1e-13)
    for g in got[1:]:
        assert (g.growth == got[0].growth).all()


def test_growth_without_a_logarithm_is_an_error(make_bars):
    b = make_bars([1, 2, 3]).withColumn("h", F.when(F.col("ord") == 1, -1.0))
    with pytest.raises(Exception, match="no logarithm"):
        ret.compounded_growth(b, "h").collect()


def test_growth_comes_back_from_beyond_the_largest_double(spark, tmp_path):
    """a product stayed at infinity where the SQL's sum of logarithms was finite again."""
    from catalog import ORACLE, QUERIES
    from tests.compare import duck

    up_and_down = [500.0 * 1e6 ** (i % 2) for i in range(108)]
    halved = [1.6e27 / 2**i for i in range(60)]
    lines = [
        (i, 1, 1, 1, 1.0, (px - 500) * 1000, "A", dt.datetime(2020, 1, 1) + dt.timedelta(days=i))
        for i, px in enumerate(up_and_down + halved)
    ]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(f"{tmp_path}/spark")
    next((tmp_path / "spark").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    for name in ("op_E20_compounding", "op_E20_compounding_ticks"):
        got = QUERIES[name](spark, str(tmp_path)).toPandas().sort_values("ts").growth.to_numpy()
        want = duck(str(tmp_path)).execute(ORACLE[name]).df().sort_values("ts").growth.to_numpy()
        assert np.isinf(want).any() and np.isfinite(want[-1])
        np.testing.assert_allclose(got, want, rtol=1e-12)
