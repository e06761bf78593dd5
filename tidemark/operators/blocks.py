"""Block bootstraps by start position.

A drawn block is known by its start, so its path segment is the same in all simulations: it is worked out
once for each start and then only looked up. The values of a series are cut into tiles of starts. Where one
tile holds the series, its simulations are put together beside it, as arrays of its row; else draws
are dealt to the tiles of their starts, looked up there and brought back by pack. Only the first block, which
sets the level, and the last one, which is cut, need their values.

Draws are uniform numbers of (seed, stream, simulation, block); series share them, as their coordinates do not
name the series. Blocks of a path are joined in order, so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rng import uniform, uniform_rows
from tidemark.plans.series import SERIES, merge_segments
from tidemark.session import stage

C = F.col
#: Starts of a tile; simulations and blocks of a pack of draws.
TILE, SIMS, BLOCKS = 8192, 256, 1024
FIELDS = ("s", "q", "growth", "low", "high", "dd")


def segments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Path segment of each row of returns."""
    g = np.cumprod(1 + x, axis=1)
    top = np.maximum.accumulate(g, axis=1)
    return {"s": x.sum(axis=1), "q": (x * x).sum(axis=1), "growth": g[:, -1], "low": g.min(axis=1), "high": top[:, -1], "dd": (g / top - 1).min(axis=1)}


def chain(seg: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Segments of each row, joined from left to right."""
    base = np.cumprod(seg["growth"], axis=1)
    base = np.concatenate([np.ones((len(base), 1)), base[:, :-1]], axis=1)
    low, high = base * seg["low"], base * seg["high"]
    peak = np.maximum.accumulate(high, axis=1)
    dd = seg["dd"].min(axis=1)
    if low.shape[1] > 1:
        dd = np.minimum(dd, (low[:, 1:] / peak[:, :-1] - 1).min(axis=1))
    return {"s": seg["s"].sum(axis=1), "q": seg["q"].sum(axis=1), "growth": base[:, -1] * seg["growth"][:, -1], "low": low.min(axis=1), "high": peak[:, -1], "dd": dd}


def _looked_up(row, block: int, start: np.ndarray, k: np.ndarray, blocks: int, cut: int, skip_first: bool) -> dict[str, np.ndarray]:
    """Segments of blocks `k` that begin at `start` of the tile of `row`."""
    out = {f: np.asarray(row[f])[start] for f in FIELDS}
    xs = np.asarray(row["xs"])
    for at, take in ((np.flatnonzero(k == blocks - 1), cut), (np.flatnonzero(k == 0), cut if blocks == 1 else block)):
        zero_first = skip_first and len(at) and k[at[0]] == 0
        if not len(at) or take == block and not zero_first:
            continue
        x = xs[start[at][:, None] + np.arange(take)]
        if zero_first:
            x[:, 0] = 0.0
        for f, v in segments(x).items():
            out[f][at] = v
    return out


def _field(name: str):
    return lambda v: v[name]


def packed_series(df: DataFrame, sizes: DataFrame, values: list[str], keys=SERIES, order: str = "idx") -> DataFrame:
    """keys, n and an array of each of `values`, one row for each series of `sizes`.

    For series short enough for one row; sizes say little about the work on them, hence the plain number of tasks.
    """
    keys, tasks = list(keys), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*keys, order, *values).join(sizes.select(*keys, "n"), keys).repartition(tasks, *keys)
    rows = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(order, *values))).alias("_p"))
    return rows.select(*keys, "n", *[F.transform("_p", _field(c)).alias(c) for c in values])


def _path_arrays(x: np.ndarray, u: np.ndarray, block: int, wholly: bool, skip_first: bool) -> dict[str, np.ndarray]:
    """Segment of the whole path of each row of numbers `u`, a few simulations at a time."""
    n, blocks = len(x), u.shape[1]
    row = {"xs": x} if block == 1 else {"xs": x, **segments(np.lib.stride_tricks.sliding_window_view(x, block))}
    found = []
    some = max(1, 65_536 // blocks)
    for at in range(0, len(u), some):
        start = np.floor(u[at : at + some] * (n - block + wholly)).astype(np.int64)
        if block == 1:
            r = x[start]
            if skip_first:
                r[:, 0] = 0.0
            found.append(segments(r))
        else:
            k = np.tile(np.arange(blocks), len(start))
            seg = _looked_up(row, block, start.ravel(), k, blocks, n - (blocks - 1) * block, skip_first)
            found.append(chain({f: v.reshape(start.shape) for f, v in seg.items()}))
    return {f: np.concatenate([d[f] for d in found]) for f in FIELDS}


def block_paths(returns: DataFrame, sizes: DataFrame, n_sims: int, block: int, seed: int = 42, stream: str = "block", keys=SERIES, skip_first: bool = False, wholly: bool = False) -> DataFrame:
    """keys, sim, n, s, q, growth, low, high, dd: the rows of `packed_paths` by simulation."""
    d = packed_paths(returns, sizes, n_sims, block, seed, stream, keys, skip_first, wholly)
    d = d.select(*keys, "n", F.posexplode(F.arrays_zip(*FIELDS)).alias("sim", "_v"))
    return d.select(*keys, "sim", "n", *[C("_v")[f].alias(f) for f in FIELDS])


def packed_paths(returns: DataFrame, sizes: DataFrame, n_sims: int, block: int, seed: int = 42, stream: str = "block", keys=SERIES, skip_first: bool = False, wholly: bool = False) -> DataFrame:
    """keys, n and arrays s, q, growth, low, high, dd over the simulated paths of series with more than `block` returns.

    `returns` has idx from 0 and x, `sizes` the series to simulate with their n. With `skip_first` the first draw
    only sets the starting level and does not count. Starts are drawn from n - block positions; `wholly` from all
    n - block + 1 of them, so that blocks of one value are draws with replacement. A series of one tile is one row
    all the way: its simulations never move, and the numbers they share are worked out in the task.
    """
    keys = list(keys)
    sizes = stage(sizes.filter(C("n") > block - wholly).select(*keys, "n"), "path-sizes")
    tiles = F.ceil((C("n") - block + int(wholly)) / min(TILE, 2 * BLOCKS * block))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in returns.schema if f.name in keys)
    cols = [*keys, "n", *FIELDS]

    def simulated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                n = int(row["n"])
                u = uniform_rows(seed, stream, n_sims, -(-n // block))
                found = _path_arrays(np.asarray(row["x"]), u, block, wholly, skip_first)
                rows.append({**{c: row[c] for c in keys}, "n": n - skip_first, **found})
                if len(rows) * n_sims >= 65_536:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
            yield pd.DataFrame(rows, columns=cols)

    schema = f"{types}, n bigint, {', '.join(f'{f} array<double>' for f in FIELDS)}"
    short = packed_series(returns, sizes.filter(tiles <= 1), ["x"], keys).mapInPandas(simulated, schema)
    wide = sizes.filter(tiles > 1)
    if wide.isEmpty():
        return short
    rows = _tiled_paths(returns, wide, n_sims, block, seed, stream, keys, skip_first, wholly)
    rows = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("sim", *FIELDS))).alias("_p"))
    return short.unionByName(rows.select(*keys, "n", *[F.transform("_p", _field(f)).alias(f) for f in FIELDS]))


def _tiled_paths(returns: DataFrame, sizes: DataFrame, n_sims: int, block: int, seed: int, stream: str, keys, skip_first: bool, wholly: bool) -> DataFrame:
    """keys, sim, n, s, q, growth, low, high, dd of series of several tiles."""
    spark = returns.sparkSession
    tile_rows = min(TILE, 2 * BLOCKS * block)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in returns.schema if f.name in keys)
    at = F.floor(C("idx") / tile_rows)
    spread = F.when(F.pmod(C("idx"), F.lit(tile_rows)) < block, F.array(at, at - 1)).otherwise(F.array(at))
    packed = returns.join(sizes, keys).withColumn("_tile", F.explode(spread)).filter("_tile >= 0")
    packed = packed.groupBy(*keys, "_tile").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("_p"))
    packed = packed.select(*keys, "_tile", "n", F.transform("_p", lambda v: v["x"]).alias("xs"))

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [segments(np.lib.stride_tricks.sliding_window_view(x, block)) if len(x) >= block else {f: np.zeros(0) for f in FIELDS} for x in pdf["xs"]]
            yield pdf.assign(**{f: [s[f] for s in found] for f in FIELDS})

    arrays = ", ".join(f"{f} array<double>" for f in ("xs", *FIELDS))
    starts = stage(packed.mapInPandas(summarize, f"{types}, _tile bigint, n bigint, {arrays}"), "block-starts")

    most = sizes.agg(F.max(F.ceil(C("n") / block)).alias("m")).first()["m"] or 0
    draws = spark.range(0, n_sims * most).select(F.floor(C("id") / F.lit(max(most, 1))).cast("int").alias("sim"), F.pmod(C("id"), F.lit(max(most, 1))).alias("k"))
    draws = draws.withColumn("u", uniform(seed, stream, "sim", "k"))
    draws = draws.groupBy(F.floor(C("sim") / SIMS).alias("_part"), F.floor(C("k") / BLOCKS).alias("_run")).agg(F.sort_array(F.collect_list(F.struct("sim", "k", "u"))).alias("_u"))
    draws = stage(draws.select("_part", "_run", F.transform("_u", lambda v: v["u"]).alias("u"), F.size(F.array_distinct(F.transform("_u", lambda v: v["sim"]))).alias("_sims")), "draws")

    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.ceil(C("n") / block) - 1) / BLOCKS)))

    def drawn(row, n: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(simulations x blocks) starts of a pack, its first block number, blocks of the path and values of the last one."""
        blocks = -(-n // block)
        first = int(row["_run"]) * BLOCKS
        u = np.asarray(row["u"]).reshape(int(row["_sims"]), -1)[:, : blocks - first]
        return np.floor(u * (n - block + wholly)).astype(np.int64), first, blocks, n - (blocks - 1) * block

    def path_rows(row, seg: dict, shape: tuple[int, int], first: int, blocks: int, n: int) -> pd.DataFrame:
        out = pd.DataFrame(chain({f: v.reshape(shape) for f, v in seg.items()}))
        out["sim"], out["ord"] = int(row["_part"]) * SIMS + np.arange(len(out)), int(row["_run"])
        out["n"] = min(n, (first + shape[1]) * block) - first * block - (skip_first and first == 0)
        for c in keys:
            out[c] = row[c]
        return out[cols]

    cols = [*keys, "sim", "ord", "n", *FIELDS]
    schema = f"{types}, sim int, ord bigint, n bigint, {', '.join(f'{f} double' for f in FIELDS)}"

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Draws of a pack by tile of their start; `_at` is their place in the pack."""
        for pdf in batches:
            for row in pdf.to_dict("records"):
                start = drawn(row, int(row["n"]))[0].ravel()
                tile = start // tile_rows
                order = np.argsort(tile, kind="stable")
                edge = np.flatnonzero(np.diff(tile[order], prepend=-1))
                out = pd.DataFrame({"_tile": tile[order][edge], "_at": np.split(order.astype(np.int64), edge[1:]), "_start": np.split((start % tile_rows)[order], edge[1:])})
                for c in (*keys, "_part", "_run", "_sims"):
                    out[c] = row[c]
                yield out[[*keys, "_tile", "_part", "_run", "_sims", "_at", "_start"]]

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                n = int(row["n"])
                blocks, first = -(-n // block), int(row["_run"]) * BLOCKS
                k = first + np.asarray(row["_at"]) % min(BLOCKS, blocks - first)
                seg = _looked_up(row, block, np.asarray(row["_start"]), k, blocks, n - (blocks - 1) * block, skip_first)
                rows.append({**{c: row[c] for c in (*keys, "_part", "_run", "_sims", "n", "_at")}, **seg})
            yield pd.DataFrame(rows, columns=[*keys, "_part", "_run", "_sims", "n", "_at", *FIELDS])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        n, first = int(row["n"]), int(row["_run"]) * BLOCKS
        blocks = -(-n // block)
        shape = (int(row["_sims"]), min(BLOCKS, blocks - first))
        seg, at = {f: np.zeros(shape[0] * shape[1]) for f in FIELDS}, np.concatenate(pdf["_at"].to_list())
        for f in FIELDS:
            seg[f][at] = np.concatenate(pdf[f].to_list())
        return path_rows(row, seg, shape, first, blocks, n)

    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_sims - 1) // SIMS).cast("long")))
    wide = sizes.withColumn("_run", runs).withColumn("_part", parts)
    long = wide.join(draws, ["_run", "_part"]).mapInPandas(dealt, f"{types}, _tile bigint, _part bigint, _run bigint, _sims int, _at array<bigint>, _start array<bigint>")
    long = long.join(starts, [*keys, "_tile"])
    found = long.mapInPandas(looked_up, f"{types}, _part bigint, _run bigint, _sims int, n bigint, _at array<bigint>, {', '.join(f'{f} array<double>' for f in FIELDS)}")
    found = found.groupBy(*keys, "_part", "_run").applyInPandas(together, schema)
    return merge_segments(stage(found, "block-paths"), [*keys, "sim"])
