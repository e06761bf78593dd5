"""Exact order statistics of large groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.plans.series import chunk_rows, scan, split_series, with_ordinal
from tidemark.session import stage

ACCURACY = 10_000
TILE = 512


def exact_percentiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with exact, linearly interpolated percentiles of `value`.

    The built-in exact percentile holds every distinct value of a group in one buffer.
    Here a mergeable sketch brackets each wanted rank; its rank error is at most
    n/ACCURACY, so the values inside a bracket are a small slice of the group. Rows below
    the bracket are only counted, rows inside are ranked, and the two neighbours of the
    wanted rank are read off; a neighbour just outside is the next value beyond the edge. The result is exact whatever the sketch returns inside its bound.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    names = list(probs)
    eps = 4.0 / ACCURACY
    edges = [x for p in names for x in (max(0.0, probs[p] - eps), min(1.0, probs[p] + eps))]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [float(e) for e in edges], ACCURACY).alias("_q"),
        F.min("_v").alias("_mn"),
        F.max("_v").alias("_mx"),
    )
    brackets = sketch.select(
        *keys,
        "_n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("_p"),
                        F.lit(float(probs[p])).alias("_prob"),
                        (F.lit(float(probs[p])) * (F.col("_n") - 1)).alias("_rank"),
                        (F.col("_mn") if probs[p] - eps <= 0 else F.col("_q")[2 * i]).alias("_lo"),
                        (F.col("_mx") if probs[p] + eps >= 1 else F.col("_q")[2 * i + 1]).alias("_hi"),
                    )
                    for i, p in enumerate(names)
                ]
            )
        ).alias("_b"),
    ).select(*keys, "_n", "_b.*")
    # One row per distinct value first: ties cannot make a bracket large.
    distinct = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    tagged = distinct.join(brackets, keys) if keys else distinct.join(brackets, F.lit(True))
    below = tagged.groupBy(*keys, "_p").agg(
        F.first("_rank").alias("_rank"),
        F.coalesce(F.sum(F.when(F.col("_v") < F.col("_lo"), F.col("_c"))), F.lit(0)).alias("_below"),
        F.max(F.when(F.col("_v") < F.col("_lo"), F.col("_v"))).alias("_prev"),
        F.min(F.when(F.col("_v") > F.col("_hi"), F.col("_v"))).alias("_next"),
    )
    upto = W.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    inside = (
        tagged.filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .select(*keys, "_p", "_v", "_c")
        .withColumn("_cum", F.sum("_c").over(upto))
        .join(below, [*keys, "_p"])
        .withColumn("_last", F.col("_below") + F.col("_cum") - 1)
        .withColumn("_first", F.col("_last") - F.col("_c") + 1)
    )
    lo, hi = F.floor("_rank"), F.ceil("_rank")
    picked = inside.groupBy(*keys, "_p").agg(
        F.coalesce(
            F.max(F.when((F.col("_first") <= lo) & (lo <= F.col("_last")), F.col("_v"))), F.first("_prev")
        ).alias("_a"),
        F.coalesce(
            F.max(F.when((F.col("_first") <= hi) & (hi <= F.col("_last")), F.col("_v"))), F.first("_next")
        ).alias("_z"),
        F.first(F.col("_rank") - lo).alias("_f"),
    )
    value_of = F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_p") == p, value_of)).alias(p) for p in names])


def value_positions(df: DataFrame, keys, value: str, tie, name: str = "pos", spread: int = 64, rows: int | None = None) -> DataFrame:
    """0-based rank of each row by (value, tie) within its group, without one task per group.

    A mergeable sketch gives `spread` cut points per group, so the buckets between them hold
    about equal numbers of rows however the values lie. A value frequent enough to fill a
    bucket is itself a cut point and gets a bucket of its own, which is split further by the
    last column of `tie`, a position or a time.
    """
    keys = list(keys)
    at = [i / spread for i in range(1, spread)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, at, ACCURACY).alias("_cuts"))
    v, c = F.col(value), F.array_distinct("_cuts")
    below = F.size(F.filter("_cuts", lambda x: x < v))
    equal = F.array_contains("_cuts", v)
    last, kind = F.col(tie[-1]), dict(df.dtypes)[tie[-1]]
    day = F.datediff(last.cast("date"), F.lit("1970-01-01").cast("date"))
    stretch = day if kind.startswith(("timestamp", "date")) else F.floor(last / F.lit(chunk_rows(rows)))
    part = F.when(equal, stretch.cast("long")).otherwise(F.lit(0).cast("long"))
    first = [F.when(equal, F.col(t)).alias(f"_{i}") for i, t in enumerate(tie[:-1])]
    bucket = F.struct((2 * below + equal.cast("int")).alias("_b"), *first, part.alias("_p"))
    tagged = df.join(cuts.withColumn("_cuts", c), keys)
    return with_ordinal(tagged, keys, [value, *tie], bucket, name).drop("_cuts")


def ranks_before(values: np.ndarray, upto: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """For each probe, how many of the first `upto` values are <= it; `upto` is non-decreasing.

    Values are met in tiles: those before a tile are kept sorted, those inside compared one by one.
    """
    out = np.zeros(len(upto), np.int64)
    sorted_before = values[:0]
    for start in range(0, int(upto[-1]) + 1, TILE):
        tile = values[start : start + TILE]
        a, z = np.searchsorted(upto, [start, start + TILE])
        if a < z:
            seen = np.arange(len(tile)) < (upto[a:z] - start)[:, None]
            inside = ((tile <= probes[a:z, None]) & seen).sum(1)
            out[a:z] = np.searchsorted(sorted_before, probes[a:z], "right") + inside
        sorted_before = np.sort(np.concatenate([sorted_before, np.sort(tile)]), kind="stable")
    # As in Spark, NaN is above all numbers and equal to itself.
    return np.where(np.isnan(probes), upto, out)


def _ranks_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Event rows with `n` and `rank` inside their block; blocks come whole, in order, `_first` on their first row.

    `_row` is a list of the one event, null on other rows, which then take no room in a batch.
    """

    def ranked(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        numbers = lambda c: c.to_numpy().astype(np.float64)
        known = np.asarray(t["_v"].is_valid())
        before = np.concatenate([[0], np.cumsum(known)])
        values, starts = numbers(t["_v"])[known], np.flatnonzero(np.asarray(t["_first"]))
        at = np.flatnonzero(np.asarray(t["_row"].is_valid()))
        if not len(at):
            return []
        events = pa.table({"_row": pc.list_flatten(t["_row"])})
        probes, block = numbers(pc.struct_field(events["_row"], "probe")), np.searchsorted(starts, at, "right") - 1
        n, rank = before[at] - before[starts[block]], np.zeros(len(at), np.int64)
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=len(starts)))
        for a, z in zip(edges[:-1], edges[1:]):
            base = before[starts[block[a]]]
            rank[a:z] = ranks_before(values[base : base + n[z - 1]], n[a:z], probes[a:z])
        return events.append_column("n", pa.array(n, pa.int64())).append_column("rank", pa.array(rank)).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = np.flatnonzero(np.asarray(batch.column("_first")))
        if len(first) and (held or first[-1] > 0):
            yield from ranked([*held, batch.slice(0, first[-1])])
            held, batch = [], batch.slice(first[-1])
        held.append(batch)
    if held:
        yield from ranked(held)


def prefix_ranks(df: DataFrame, events, keys=("symbol",), value: str = "value", base: int | None = None) -> DataFrame:
    """Event rows with `n`, how many earlier rows of their series have a value, and `rank`, how many of these are <= `probe`.

    `df` holds keys, ord, `value`; the Column `events` marks rows and `probe` is their
    threshold. Earlier rows of the event's own block of `base` positions, a chunk, are counted
    where the block lies. Only series with events beyond their first block go on: earlier blocks
    are met level by level, as in a merge sort over time: on each level a right half counts the
    rows of the left half below its thresholds with a running sum in value order. Every row of
    these takes part in log2(n / base) running sums and no pairs of rows are formed.
    """
    keys, base, df = list(keys), chunk_rows(base), split_series(df)
    blk = F.floor(F.col("ord") / F.lit(base))
    asked = events & F.col("probe").isNotNull()
    order = W.partitionBy(*keys, "_blk").orderBy("ord")
    rows = (
        df.select(
            *keys, "ord", blk.alias("_blk"), F.col(value).alias("_v"),
            F.when(asked, F.array(F.struct(*df.columns, blk.alias("_blk")))).alias("_row"),
        )
        .repartition(*keys, "_blk")
        .withColumn("_first", F.lag("ord").over(order).isNull())
        .sortWithinPartitions(*keys, "_blk", "ord")
        .select("_v", "_row", "_first")
    )
    event = rows.schema["_row"].dataType.elementType
    kinds = T.StructType().add("_row", event).add("n", T.LongType()).add("rank", T.LongType())
    found = stage(rows.mapInArrow(_ranks_in_blocks, kinds).select("_row.*", "n", "rank"), "ranks")
    top = found.agg(F.max("_blk")).first()[0] or 0  # one number, read from file statistics
    if not top:
        return found.drop("_blk")

    # At most one series in `base` rows goes on.
    long = stage(found.filter("_blk > 0").select(*keys).distinct(), "ranks-long")
    rows = stage(df.select(*keys, "ord", F.col(value).alias("_v")).filter(F.col("_v").isNotNull()).join(long, keys, "left_semi"), "ranks-rows")
    later = found.filter("_blk > 0")
    parts = []
    half = base
    while half <= top * base:
        side = F.floor(F.col("ord") / half) % 2
        group = F.floor(F.col("ord") / (2 * half))
        points = rows.filter(side == 0).select(
            *keys, "ord", group.alias("_g"), F.col("_v").alias("_at"), F.lit(0).alias("_side")
        )
        probes = later.filter(side == 1).select(
            *keys, "ord", group.alias("_g"), F.col("probe").alias("_at"), F.lit(1).alias("_side")
        )
        both = value_positions(points.unionByName(probes), [*keys, "_g"], "_at", ["_side", "ord"])
        both = scan(
            both.withColumnsRenamed({"ord": "_t", "pos": "ord"}),
            {"_n": ("sum", F.when(F.col("_side") == 0, 1).otherwise(0).cast("long"))},
            [*keys, "_g"],
        )
        parts.append(both.filter("_side = 1").select(*keys, F.col("_t").alias("ord"), "_n"))
        half *= 2
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    ranks = total.groupBy(*keys, "ord").agg(F.sum("_n").alias("_ranks"))
    # A count and a start for each block: every block up to the last one of an event has a row, also without values.
    counts = rows.groupBy(*keys, blk.alias("_blk")).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counts.unionByName(later.groupBy(*keys, "_blk").agg(F.lit(0).cast("long").alias("_n")))
    upto = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.groupBy(*keys, "_blk").agg(F.sum("_n").alias("_n")).withColumn("_before", F.sum("_n").over(upto)).drop("_n")
    later = later.join(starts, [*keys, "_blk"], "left").join(ranks, [*keys, "ord"], "left").withColumns(
        {"n": F.col("n") + F.coalesce("_before", F.lit(0)), "rank": F.col("rank") + F.coalesce("_ranks", F.lit(0))}
    )
    cols = [*df.columns, "n", "rank"]
    return found.filter("_blk = 0").select(*cols).unionByName(later.select(*cols))
