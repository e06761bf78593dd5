"""Path segments of many variants over any range of positions, without copying the range.

Bars carry one weight per variant in an array. Each chunk of a series is folded once into a binary
tree: a node of level l covers 2**l positions and holds, per variant, the segment of its next-open
path (as in `series.merge_segments`) and sums over its weights. Nodes of levels below `LEAST` are
left out but for the bars themselves. A range of positions is then a few bars at its ends and
two nodes a level in between, in order, whatever its length and however many ranges overlap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.series import SERIES, chunk_rows

C = F.col
LEAST = 3
PATH = ("s", "q", "growth", "low", "high", "dd")
SUMS = ("weight", "gross", "moved", "changes")
FIELDS = (*PATH, *SUMS)


def bars_as_segments(r: np.ndarray, w: np.ndarray, moved: np.ndarray) -> dict[str, np.ndarray]:
    g = 1 + r
    return {"s": r, "q": r * r, "growth": g, "low": g, "high": g, "dd": np.zeros_like(r), "weight": w, "gross": np.abs(w), "moved": moved, "changes": (moved > 0).astype(float)}


def join_segments(a: dict, b: dict) -> dict:
    """`a`, then `b`."""
    out = {k: a[k] + b[k] for k in ("s", "q", *SUMS)}
    out["growth"] = a["growth"] * b["growth"]
    out["low"], out["high"] = np.minimum(a["low"], a["growth"] * b["low"]), np.maximum(a["high"], a["growth"] * b["high"])
    out["dd"] = np.minimum(np.minimum(a["dd"], b["dd"]), a["growth"] * b["low"] / a["high"] - 1)
    return out


def top_level(rows: int | None = None) -> int:
    return int(math.log2(chunk_rows(rows)))


def cover(lo: int, hi: int, top: int) -> Iterator[tuple[int, int]]:
    """(level, node) of the pieces of positions [lo, hi), in order."""
    while lo < hi:
        level = min((lo & -lo).bit_length() - 1 if lo else top, (hi - lo).bit_length() - 1, top)
        level = level if level >= LEAST else 0
        yield level, lo >> level
        lo += 1 << level


def segment_tree(df: DataFrame, commission_bps: float = 1.0, slippage_bps: float = 5.0, keys=SERIES, rows: int | None = None) -> DataFrame:
    """Nodes (keys, level, node) of bars with ts, ord, open, close and `weights`.

    `body` holds FIELDS one after the other, each with a value per variant; bars (level 0) hold r, weight
    and moved. `asset` holds, for bars, the close-to-close return, the open-to-close return and the time
    in microseconds; for nodes the sum of returns and of their squares.
    """
    keys = list(keys)
    top = top_level(rows)
    size, rate = 1 << top, (commission_bps + slippage_bps) / 1e4
    home, pos = F.floor(C("ord") / size), F.pmod(C("ord"), F.lit(size))
    copies = F.array_compact(F.array(home, F.when(pos >= size - 2, home + 1)))
    copied = df.select(*keys, "ord", F.unix_micros(C("ts").cast("timestamp")).alias("_t"), "open", "close", "weights").withColumn("_chunk", F.explode(copies))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        o, op, x = (pdf[c].to_numpy() for c in ("ord", "open", "close"))
        own = o // size == int(pdf["_chunk"].iloc[0])
        if not own.any():
            return pd.DataFrame(columns=out_cols)
        w = np.stack(pdf["weights"].to_numpy())
        late = lambda a: np.vstack([np.zeros((1, a.shape[1])), a[:-1]])
        before = late(w)
        old = late(before)
        gap, asset = np.zeros(len(x)), np.zeros(len(x))
        gap[1:], asset[1:] = op[1:] / x[:-1] - 1, x[1:] / x[:-1] - 1
        day = x / op - 1
        r = (1 + old * gap[:, None]) * (1 + before * day[:, None] - np.abs(before - old) * rate) - 1
        r[o == 0] = 0.0
        moved = np.abs(w - before)
        o, r, w, moved, asset, day, t = (a[own] for a in (o, r, w, moved, asset, day, pdf["_t"].to_numpy()))
        levels, nodes = [np.zeros(len(o), int)], [o]
        bodies = [np.concatenate([r, w, moved], axis=1)]
        assets = [np.stack([asset, day, t.astype(float)], axis=1)]
        seg, sums, level, first = bars_as_segments(r, w, moved), np.stack([asset, asset * asset], axis=1), 0, int(o[0])
        while len(sums) > 1:
            half = len(sums) // 2 * 2
            seg = join_segments({k: v[0:half:2] for k, v in seg.items()}, {k: v[1:half:2] for k, v in seg.items()})
            sums, level, first = sums[0:half:2] + sums[1:half:2], level + 1, first >> 1
            if level >= LEAST:
                levels.append(np.full(len(sums), level))
                nodes.append(first + np.arange(len(sums)))
                bodies.append(np.concatenate([seg[k] for k in FIELDS], axis=1))
                assets.append(sums)
        out = pd.DataFrame({"level": np.concatenate(levels), "node": np.concatenate(nodes)})
        out["body"], out["asset"] = [b for x in bodies for b in x], [a for x in assets for a in x]
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[out_cols]

    out_cols = [*keys, "level", "node", "body", "asset"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    return copied.groupBy(*keys, "_chunk").applyInPandas(fold, f"{types}, level int, node bigint, body array<double>, asset array<double>")


class Piece:
    """A row of the tree, or several of them joined in order."""

    def __init__(self, level: int, body: np.ndarray, asset: np.ndarray):
        parts = 3 if level == 0 else len(FIELDS)
        rows = np.asarray(body).reshape(parts, -1)
        if level == 0:
            self.r, self.w, self.moved = rows
            self.asset, self.day, self.time = asset
            self.seg, self.sums, self.n = bars_as_segments(*rows), np.array([self.asset, self.asset**2]), 1
        else:
            self.seg, self.sums, self.n = dict(zip(FIELDS, rows)), np.asarray(asset), 1 << level


def joined(pieces: list[Piece], variants: int) -> tuple[dict, np.ndarray, int]:
    """Segment, sums of the asset's returns and number of bars; of nothing: a path that stays where it is."""
    zero = np.zeros(variants)
    if not pieces:
        return {k: zero for k in FIELDS} | {"growth": zero + 1, "low": zero + np.inf, "high": zero}, np.zeros(2), 0
    seg, sums, n = pieces[0].seg, pieces[0].sums, pieces[0].n
    for p in pieces[1:]:
        seg, sums, n = join_segments(seg, p.seg), sums + p.sums, n + p.n
    return seg, sums, n
