"""Ordered-series plans that do not need a whole series in one task.

A plain `Window.partitionBy("symbol")` puts every row of a symbol into one task.
Here each series carries a dense 0-based position `ord` and is cut into chunks of
`rows` consecutive positions, so that the unit of work is (keys, chunk):

* `with_ordinal`  - assigns `ord` from per-bucket counts;
* `on_chunks`     - bounded frames: rows near a chunk edge are copied to the next
                    chunk, evaluated there as context and dropped again;
* `scan`          - unbounded running aggregates: chunk-local result, one total per
                    chunk, running carry over the totals, join back.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import stage

CHUNK_ROWS = 65_536
SERIES = ("symbol",)
_chunk: ContextVar[int] = ContextVar("chunk_rows", default=CHUNK_ROWS)


@contextmanager
def chunks_of(rows: int) -> Iterator[None]:
    """Plans built inside cut series into chunks of so many rows."""
    was = _chunk.set(rows)
    try:
        yield
    finally:
        _chunk.reset(was)


def chunk_rows(rows: int | None = None) -> int:
    return rows or _chunk.get()


def with_ordinal(df: DataFrame, keys, order, bucket: Column, name: str = "ord") -> DataFrame:
    """Add the 0-based position of each row in its series.

    `bucket` must be non-decreasing in `order`; it bounds how many rows one task sorts
    (a span of time holds a bounded number of bars). Positions are the bucket's start,
    taken from running bucket counts, plus the row number inside the bucket.
    """
    keys, df = list(keys), split_series(df)
    tagged = df.withColumn("_bucket", bucket)
    dealt = tagged.repartition(*keys, "_bucket")
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        dealt.withColumn("_rn", F.row_number().over(inside))
        .join(starts, [*keys, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_rn") - 1).cast("long"))
        .drop("_bucket", "_rn", "_start")
    )


def split_series(df: DataFrame) -> DataFrame:
    """Have adaptive execution split a hot symbol in joins, even where an aggregate by symbol follows.

    A join on the symbol leaves rows dealt by symbol, which Spark takes as good enough for windows
    on (symbol, chunk): one symbol would then be one task. The plans here therefore deal rows by
    (symbol, chunk) themselves. Windows on more keys inside a chunk then need no exchange of their
    own, which Spark's setting to deal by all keys of every window would give each of them.
    """
    df.sparkSession.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return df


def time_bucket(ts: str = "ts", days: int = 64) -> Column:
    """Whole number of `days`-long spans since 1970, for `with_ordinal`."""
    return F.floor(F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")) / days)


@dataclass(frozen=True)
class Chunk:
    """What `on_chunks` hands to the expression builder."""

    part: tuple[str, ...]

    @property
    def w(self) -> WindowSpec:
        return W.partitionBy(*self.part).orderBy("ord")

    @property
    def whole(self) -> WindowSpec:
        return W.partitionBy(*self.part)

    def last(self, n: int) -> WindowSpec:
        """The current row and the n-1 before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    def lag(self, col, n: int = 1, default=None) -> Column:
        return F.lag(col, n, default).over(self.w)

    def lead(self, col, n: int = 1) -> Column:
        return F.lead(col, n).over(self.w)


def on_chunks(
    df: DataFrame, build, keys=SERIES, back: int = 0, ahead: int = 0, rows: int | None = None
) -> DataFrame:
    """Apply `build(df, chunk)`, whose frames reach `back` rows back and `ahead` rows on.

    One exchange on (keys, chunk) serves every window of `build`. Copied rows cost
    (back + ahead) / rows of the input.
    """
    df = split_series(df)
    rows = max(chunk_rows(rows), back, ahead, 1)
    home = F.floor(F.col("ord") / F.lit(rows))
    pos = F.pmod(F.col("ord"), F.lit(rows))
    targets = [F.col("_home")]
    if back:
        targets.append(F.when(pos >= rows - back, F.col("_home") + 1))
    if ahead:
        targets.append(F.when((pos < ahead) & (F.col("_home") > 0), F.col("_home") - 1))
    out = df.withColumn("_home", home)
    if len(targets) > 1:
        out = out.withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))
    else:
        out = out.withColumn("_chunk", F.col("_home"))
    out = build(out.repartition(*keys, "_chunk"), Chunk((*keys, "_chunk")))
    return out.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


_TOTAL = {
    "sum": lambda c: F.sum(c),
    "prod": lambda c: F.product(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
    "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("ord"))),
}
_RUNNING = {**_TOTAL, "last": lambda c: F.last(c, ignorenulls=True)}
_MERGE = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "prod": lambda a, b: F.coalesce(a * b, a, b),
    "max": F.greatest,
    "min": F.least,
    "last": lambda a, b: F.coalesce(b, a),
}


def scan(df: DataFrame, specs: dict, keys=SERIES, rows: int | None = None) -> DataFrame:
    """Running aggregates from the start of each series, current row included.

    `specs` maps an output name to (op, column), op one of sum, prod, max, min and
    last (most recent non-null value).
    """
    keys, df = list(keys), split_series(df)
    base = df.withColumn("_chunk", F.floor(F.col("ord") / F.lit(chunk_rows(rows))))
    out = scan_dealt(base.repartition(*keys, "_chunk"), specs, keys, base)
    return out.select(*[c for c in df.columns if c not in specs], *specs)


def scan_dealt(dealt: DataFrame, specs: dict, keys=SERIES, source: DataFrame | None = None) -> DataFrame:
    """`scan` of rows that hold their `_chunk` and are dealt by (keys, _chunk), as the result is again.

    Totals are counted from `source`, the same rows as they lie before they are dealt, if it is given.
    """
    keys = list(keys)
    cols = {n: F.col(c) if isinstance(c, str) else c for n, (_, c) in specs.items()}
    added = lambda d: d.withColumns({f"_x_{n}": c for n, c in cols.items()})
    totals = added(source or dealt).groupBy(*keys, "_chunk").agg(
        *[_TOTAL[op](F.col(f"_x_{n}")).alias(f"_t_{n}") for n, (op, _) in specs.items()]
    )
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(
        *keys,
        "_chunk",
        *[_RUNNING[op](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (op, _) in specs.items()],
    )
    upto = W.partitionBy(*keys, "_chunk").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    local = added(dealt).select(
        *dealt.columns,
        *[_RUNNING[op](F.col(f"_x_{n}")).over(upto).alias(f"_l_{n}") for n, (op, _) in specs.items()],
    )
    return local.join(carries, [*keys, "_chunk"]).select(
        *[c for c in dealt.columns if c not in specs],
        *[_MERGE[op](F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (op, _) in specs.items()],
    )


def equity_scan(
    df: DataFrame, ret: str = "r", keys=SERIES, rows: int | None = None, start: float = 1.0
) -> DataFrame:
    """Add `equity` = start * cumprod(1+r), its running `peak` and `drawdown` in one pass.

    The chunk total is (growth, highest growth inside); peaks of earlier chunks are
    scaled by the growth before them, so no second scan over the rows is needed.
    """
    keys, df = list(keys), split_series(df)
    base = df.withColumn("_chunk", F.floor(F.col("ord") / F.lit(chunk_rows(rows)))).repartition(*keys, "_chunk")
    upto = W.partitionBy(*keys, "_chunk").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    local = base.withColumn("_g", F.product(F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0))).over(upto))
    totals = local.groupBy(*keys, "_chunk").agg(
        F.max_by("_g", "ord").alias("_growth"), F.max("_g").alias("_high")
    )
    carries = _equity_carries(totals, keys)
    local = local.withColumn("_lh", F.max("_g").over(upto))
    return (
        local.join(carries, [*keys, "_chunk"])
        .withColumn("equity", F.lit(start) * F.col("_base") * F.col("_g"))
        .withColumn("peak", F.lit(start) * F.greatest(F.col("_base") * F.col("_lh"), F.col("_top")))
        .withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
        .drop("_chunk", "_g", "_lh", "_base", "_top")
    )


def equity_on_chunks(
    df: DataFrame, build, tag: str, ret: str = "r", keys=SERIES, back: int = 0, rows: int | None = None, start: float = 1.0
) -> DataFrame:
    """`equity_scan` of the returns that `build` adds, behind the one exchange of its frames.

    Rows are written once, with the path inside their chunk. Only chunks after the first of
    a series have a carry, one in `rows` rows, so it is small and its join deals no rows.
    """
    keys, rows = list(keys), max(chunk_rows(rows), back, 1)

    def local(d, c):
        d = build(d, c)
        own, upto = F.col("_home") == F.col("_chunk"), c.w.rowsBetween(W.unboundedPreceding, 0)
        d = d.withColumn("_g", F.product(F.lit(1.0) + F.coalesce(F.when(own, F.col(ret)), F.lit(0.0))).over(upto))
        return d.withColumn("_lh", F.max(F.when(own, F.col("_g"))).over(upto))

    base = stage(on_chunks(df, local, keys, back=back, rows=rows), tag)
    base = base.withColumn("_chunk", F.floor(F.col("ord") / F.lit(rows)))
    totals = base.groupBy(*keys, "_chunk").agg(F.max_by("_g", "ord").alias("_growth"), F.max("_g").alias("_high"))
    carries = stage(_equity_carries(totals, keys).filter("_chunk > 0"), f"{tag}-carries")
    scale = F.coalesce("_base", F.lit(1.0))
    return (
        base.join(carries, [*keys, "_chunk"], "left")
        .withColumn("equity", F.lit(start) * scale * F.col("_g"))
        .withColumn("peak", F.lit(start) * F.greatest(scale * F.col("_lh"), F.col("_top")))
        .withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
        .drop("_chunk", "_g", "_lh", "_base", "_top")
    )


def _equity_carries(totals: DataFrame, keys: list) -> DataFrame:
    """Growth and highest level before each chunk, from the `_growth` and `_high` of every chunk."""
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.product("_growth").over(before), F.lit(1.0)))
    totals = totals.withColumn("_top", F.max(F.col("_base") * F.col("_high")).over(before))
    return totals.select(*keys, "_chunk", "_base", "_top")


SEGMENT = ("n", "s", "q", "growth", "low", "high", "dd")


def merge_segments(df: DataFrame, keys, order: str = "ord") -> DataFrame:
    """Join consecutive path segments of each group of `keys` into one.

    A segment holds the count, sum and sum of squares of its returns, its growth, the
    lowest and highest level relative to its start, and its own deepest drawdown. Growth
    before a segment scales it; its drawdown is its own or its low against earlier peaks.
    """
    keys = list(keys)
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumn("_base", F.coalesce(F.product("growth").over(before), F.lit(1.0)))
    d = d.withColumns({"_low": F.col("_base") * F.col("low"), "_high": F.col("_base") * F.col("high")})
    d = d.withColumn("_peak", F.max("_high").over(before))
    return d.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.product("growth").alias("growth"),
        F.min("_low").alias("low"), F.max("_high").alias("high"),
        F.min(F.least(F.col("dd"), F.col("_low") / F.col("_peak") - 1)).alias("dd"),
    )


def summarize_segments(segments: DataFrame, keys, rows: int | None = None) -> DataFrame:
    """n, mean, sd, growth and max_drawdown per series from its segments, in `ord` order.

    Segments merge by chunks first, so no series has all its segments in one task.
    """
    keys = list(keys)
    chunked = segments.withColumn("_chunk", F.floor(F.col("ord") / F.lit(chunk_rows(rows))))
    chunked = chunked.repartition(*keys, "_chunk")
    g = merge_segments(merge_segments(chunked, [*keys, "_chunk"]), keys, "_chunk")
    mean = F.col("s") / F.nullif("n", F.lit(0))
    var = (F.col("q") - F.col("n") * mean * mean) / F.nullif(F.col("n") - 1, F.lit(0))
    return g.select(
        *keys, "n", "growth", F.col("dd").alias("max_drawdown"), mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), var)).alias("sd"),
    )


def path_summary(df: DataFrame, ret: str = "r", keys=SERIES, rows: int | None = None) -> DataFrame:
    """Summary of the compounded path of `ret`, without building the path.

    Nulls keep the level and do not count. Every row is a segment of its own.
    """
    r = F.col(ret)
    g = 1 + F.coalesce(r, F.lit(0.0))
    one = df.select(
        *keys, "ord", F.when(r.isNull(), 0).otherwise(1).alias("n"), F.coalesce(r, F.lit(0.0)).alias("s"),
        F.coalesce(r * r, F.lit(0.0)).alias("q"), g.alias("growth"), g.alias("low"), g.alias("high"), F.lit(0.0).alias("dd"),
    )
    return summarize_segments(one, keys, rows)


def cumulative_runs(df: DataFrame, starts_new: Column, keys=SERIES, name: str = "run", rows: int | None = None) -> DataFrame:
    """Number the stretches of a series; `starts_new` is true on the first row of each."""
    return scan(df, {name: ("sum", F.when(starts_new, 1).otherwise(0).cast("long"))}, keys, rows)
