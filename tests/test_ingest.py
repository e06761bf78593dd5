import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest as ing
from tidemark.sources import bar_files as files

HEAD = "date,open,high,low,close,volume\n"


#: Ways to break a bar of open o: (high, low, close).
BROKEN = {
    "low above high": lambda o: (o - 3, o + 3, o),
    "close above high": lambda o: (o + 1, o - 1, o + 4),
    "open below low": lambda o: (o + 5, o + 2, o + 3),
    "zero close": lambda o: (o + 1, o - 1, 0),
}


def lines(n=20, broken=()):
    """n daily bars; the last ones are broken in the ways named."""
    out = []
    for i in range(n):
        o = 50 + 2 * i
        at = i - (n - len(broken))
        h, l, c = BROKEN[broken[at]](o) if at >= 0 else (o + 2, o - 2, o + 1)
        out.append(f"2020-01-{i + 1:02d},{o},{h},{l},{c},{700 + i}\n")
    return out


def write(folder, name, rows, head=HEAD):
    (folder / name).write_text(head + "".join(rows))


def test_scan_cleans_and_names_by_file(spark, tmp_path):
    write(tmp_path, "GOOD.csv", lines())
    write(tmp_path, "BAD.csv", lines(24, tuple(BROKEN)))
    rows = lines(10)
    write(tmp_path, "DUPES.csv", rows[:3] + [rows[2].replace(",54,", ",54.5,", 1)] + rows[3:])
    df = files.scan_bars_csv(spark, str(tmp_path))
    got = {r["symbol"]: r["count"] for r in df.groupBy("symbol").count().collect()}
    assert got == {"GOOD": 20, "BAD": 20, "DUPES": 10}
    third = df.filter("symbol = 'DUPES' and ts = timestamp_ntz'2020-01-03'").first()
    assert third["open"] == 54.0  # the first of two equal times is kept


def test_missing_column_is_named(spark, tmp_path):
    write(tmp_path, "X.csv", ["2020-01-01,1,2,0.5,1\n"], "date,open,high,low,close\n")
    with pytest.raises(ValueError, match="volume"):
        files.read_raw_csv(spark, str(tmp_path))
    assert files.read_raw_csv(spark, str(tmp_path), volume_required=False).first()["volume"] == 0.0


def test_discovery_excludes_and_fails_when_empty(spark, tmp_path):
    for n in ("AAA", "BBB", "CCC"):
        write(tmp_path, f"{n}.csv", lines(3))
    got = {r["symbol"] for r in files.discover_universe(spark, str(tmp_path), exclude=["BBB", "CCC.csv"]).collect()}
    assert got == {"AAA"}
    with pytest.raises(ValueError, match="no files"):
        files.discover_universe(spark, str(tmp_path), "*.txt")


def test_strict_parse_fails_and_lenient_gives_null(spark):
    df = spark.createDataFrame([("2020-01-01",), ("soon",)], "date string")
    with pytest.raises(Exception):
        ing.parse_ts(df).collect()
    assert [r["ts"] is None for r in ing.parse_ts(df, strict=False).collect()] == [False, True]


def test_date_range_needs_two_bars(make_bars):
    b = make_bars([1, 2, 3, 4])
    assert ing.date_range_filter(b, "2020-01-02", "2020-01-03").count() == 2
    with pytest.raises(Exception, match="fewer than 2 bars"):
        ing.date_range_filter(b, "2020-01-04").collect()


def test_fingerprints(make_bars):
    a, b = make_bars([100, 101]), make_bars([200, 201], "BBB")
    one = ing.universe_fingerprint(a.union(b)).first()["fingerprint"]
    assert one == ing.universe_fingerprint(b.union(a)).first()["fingerprint"] and len(one) == 16
    assert one != ing.universe_fingerprint(a.union(make_bars([200, 202], "BBB"))).first()["fingerprint"]
    assert len(ing.series_fingerprint(a).first()["fingerprint"]) == 12


@pytest.mark.parametrize(
    "name,expected",
    [
        ("wheat_15m.csv", "15m"),
        ("CORN240_comma.csv", "4h"),
        ("oats_1h_comma.csv", "1h"),
        ("notes.csv", "na"),
        ("RICE_daily.csv", "1d"),
        ("SOY1440_comma.csv", "1d"),
        ("cocoa_1D_comma.csv", "1d"),
    ],
)
def test_timeframe(spark, name, expected):
    assert spark.range(1).select(ing.timeframe_from_name(F.lit(name)).alias("t")).first()["t"] == expected


def test_equity_column_is_chosen_over_all_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,label,equity,cash\n2020-01-01,7,,5.5\n2020-01-02,x,101.5,5.5\n")
    (tmp_path / "b.csv").write_text("Date,label,equity,cash\n2020-01-03,8,,5.5\n2020-01-04,9,99.0,5.5\n")
    got = [r["equity"] for r in files.read_equity_artifact(spark, str(tmp_path)).orderBy("ts").collect()]
    assert got == [None, 101.5, None, 99.0]
    with pytest.raises(ValueError, match="all numbers"):
        (tmp_path / "text").mkdir()
        (tmp_path / "text" / "c.csv").write_text("Date,label,equity\n2020-01-01,7,\n2020-01-02,x,\n")
        files.read_equity_artifact(spark, str(tmp_path / "text"))


def test_run_catalog(spark, tmp_path):
    import json
    import os

    for i, strat in enumerate(["alpha", "beta", "alpha"]):
        d = tmp_path / f"run{i}"
        d.mkdir()
        (d / "manifest.json").write_text(
            json.dumps({"run_id": f"run{i}", "started_utc": "t", "config": {"strategy": {"path": f"s/{strat}.py"}}}, indent=1)
        )
        (d / "metrics.json").write_text(json.dumps({"sharpe": i / 2}, indent=1))
        for f in d.iterdir():
            os.utime(f, (1_700_000_000 + i * 100,) * 2)
    runs = files.read_run_catalog(spark, str(tmp_path))
    assert runs.count() == 3
    assert {r["run_id"] for r in files.read_run_catalog(spark, str(tmp_path), newest=1, pattern="alp").collect()} == {"run2"}
    assert {(r["strategy"], r["run_id"]) for r in files.latest_run_per_strategy(runs).collect()} == {("alpha", "run2"), ("beta", "run1")}


def test_csv_files_are_those_of_the_writer(spark, tmp_path):
    """Hadoop's local file system started several processes for each file it created, and a checksum file beside it."""
    rows = [(s, i % 2, f"a,{i}", i / 3 if i % 5 else None, float("nan")) for i, s in enumerate(["S1", "S2", "x/y=%", "", None] * 4)]
    df = spark.createDataFrame(rows, "name string, part int, ` text` string, x double, y double").repartition(3)
    files.sink_csv_files(df, f"{tmp_path}/own", "name", "part")
    df.drop("part").write.partitionBy("name").option("header", True).csv(f"{tmp_path}/spark")
    at = lambda d: spark.read.option("header", True).csv(f"{tmp_path}/{d}").select("text", "x", "y", "name")
    key = lambda r: tuple(map(str, r))
    assert sorted(at("own").collect(), key=key) == sorted(at("spark").collect(), key=key)
    left = sorted(str(p.relative_to(tmp_path / "own")) for p in (tmp_path / "own").rglob("*") if p.is_file())
    names = ("S1", "S2", "__HIVE_DEFAULT_PARTITION__", "x%2Fy%3D%25")
    assert left == [f"name={n}/part-{k}.csv" for n in names for k in (0, 1)]
