"""Cleaning rules for raw bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume")

# Accepted spellings of the canonical column names.
ALIASES = {
    "date": "date",
    "datetime": "date",
    "timestamp": "date",
    "start_time": "date",
    "vol": "volume",
    "adj close": "adj_close",
}

# Timeframe tokens of file stems, first match wins. A token ends the stem
# or is followed by an underscore.
TIMEFRAMES = [
    ("1?440", "1d"),
    ("1d", "1d"),
    ("daily", "1d"),
    ("240", "4h"),
    ("4h", "4h"),
    ("60", "1h"),
    ("1h", "1h"),
    ("30m?", "30m"),
    ("15m?", "15m"),
    ("5m?", "5m"),
    ("1m", "1m"),
]


def normalize_columns(df: DataFrame, volume_required: bool = True) -> DataFrame:
    """Trim and lower-case the names, apply aliases, and require date and OHLC(V)."""
    names = [c.strip().lower() for c in df.columns]
    df = df.toDF(*[ALIASES.get(n, n) for n in names])
    if "volume" not in df.columns and not volume_required:
        df = df.withColumn("volume", F.lit(0.0))
    missing = [c for c in ("date", *FIELDS) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def parse_ts(df: DataFrame, source: str = "date", strict: bool = True) -> DataFrame:
    """Text to `ts`. Strict parsing fails the job on a bad value, else it becomes null."""
    text = F.col(source)
    parsed = text.cast("timestamp_ntz") if strict else text.try_cast("timestamp_ntz")
    return df.withColumn("ts", parsed).drop(*([source] if source != "ts" else []))


def nan_to_null(df: DataFrame, cols=FIELDS) -> DataFrame:
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols})


def sort_dedupe(df: DataFrame, keys=("symbol", "ts"), order="file_ord") -> DataFrame:
    """Keep the row that came first among equal keys.

    `min_by` merges on the map side, so a key repeated many times never meets in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return first.select(*keys, "_r.*")


def bad_ohlc() -> Column:
    lo, hi = F.least("open", "close"), F.greatest("open", "close")
    return (
        (F.col("low") > lo)
        | (F.col("high") < hi)
        | (F.col("high") < F.col("low"))
        | (F.col("close") <= 0)
        | (F.col("volume") < 0)
    )


def validate_ohlc(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(bad_ohlc(), F.lit(False)))


def drop_nulls(df: DataFrame) -> DataFrame:
    return df.dropna(subset=list(FIELDS))


def ingest(df: DataFrame) -> DataFrame:
    """De-duplicate, validate and drop nulls, in that order."""
    return drop_nulls(validate_ohlc(sort_dedupe(nan_to_null(df))))


def ingest_report(df: DataFrame) -> DataFrame:
    """Per symbol: rows read, and rows removed by each rule of `ingest`."""
    has_null = F.lit(False)
    for c in FIELDS:
        has_null = has_null | F.col(c).isNull()
    bad = F.coalesce(bad_ohlc(), F.lit(False))
    raw = nan_to_null(df)
    total = raw.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows_read"))
    kept = sort_dedupe(raw).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_unique"),
        F.count_if(bad).alias("bad_ohlc"),
        F.count_if(~bad & has_null).alias("null_rows"),
    )
    return total.join(kept, "symbol").select(
        "symbol",
        "rows_read",
        (F.col("rows_read") - F.col("_unique")).alias("duplicates"),
        "bad_ohlc",
        "null_rows",
        (F.col("_unique") - F.col("bad_ohlc") - F.col("null_rows")).alias("rows_kept"),
    )


def date_range_filter(df: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive bounds. A symbol left with fewer than two bars fails the job."""
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    enough = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).select(
        "symbol",
        F.when(F.col("_n") < 2, F.raise_error(F.concat(F.lit("fewer than 2 bars: "), "symbol")).cast("boolean"))
        .otherwise(True)
        .alias("_ok"),
    )
    return df.join(enough, "symbol").filter("_ok").drop("_ok")


def series_fingerprint(df: DataFrame) -> DataFrame:
    """12 hex digits per symbol that change with any value, time or row count.

    Row digests are added up in four 60-bit parts, so the sum merges on the map side and
    does not depend on row order; the row's own time is part of its digest.
    """
    cents = [F.floor(F.col(c) * 1e6 + 0.5).cast("string") for c in FIELDS]
    row = F.sha2(F.concat_ws("|", F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), *cents), 256)
    parts = [
        F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(4)
    ]
    return df.groupBy("symbol").agg(
        F.substring(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256), 1, 12).alias(
            "fingerprint"
        )
    )


def universe_fingerprint(df: DataFrame) -> DataFrame:
    """16 hex digits over all symbols; one short text per symbol, independent of order."""
    one = F.sha2(F.concat_ws(":", "symbol", "fingerprint"), 256)
    parts = [
        F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(4)
    ]
    return series_fingerprint(df).agg(
        F.substring(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256), 1, 16).alias(
            "fingerprint"
        ),
        F.count(F.lit(1)).alias("n_symbols"),
    )


def stem_of(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/]+?)(\.[^./]*)?$", 1)


def timeframe_from_name(name: Column) -> Column:
    """Timeframe of a bar file from its name, `na` when nothing matches."""
    stem = F.regexp_replace(F.lower(stem_of(name)), r"(_comma|_data)$", "")
    out = F.lit("na")
    for token, label in reversed(TIMEFRAMES):
        out = F.when(stem.rlike(token + "(_|$)"), F.lit(label)).otherwise(out)
    return F.when(name.isNull(), F.lit("na")).otherwise(out)


def asset_from_name(name: Column) -> Column:
    """Daily and four-hour file stems without their timeframe suffix."""
    return F.regexp_replace(stem_of(name), "(1440_comma|240_comma|_comma)", "")


def asset_timeframe_catalog(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per asset with its daily and four-hour file, either of them null."""
    named = files.select(
        F.col(path).alias("_p"), asset_from_name(F.col(path)).alias("asset"), timeframe_from_name(F.col(path)).alias("tf")
    )
    return (
        named.filter(F.col("tf").isin("1d", "4h"))
        .groupBy("asset")
        .pivot("tf", ["1d", "4h"])
        .agg(F.min("_p"))
        .withColumnsRenamed({"1d": "daily", "4h": "four_hour"})
    )
