"""Exact top-k inner products by a three-phase uniform threshold (operator 4).

Vectors are cut into tiles of rows and queries into blocks; each (tile, block) is one group of
bounded size. Inside a tile the dimensions form `LISTS` lists, each with a local score, and a
total is the sum over the lists.

1. Gather: each list gives its k best rows of the tile; their totals are worked out, and the
   k best of all tiles give a cutoff per query: k rows reach it, so no row below can win.
2. Collect: with the cutoff sent back, only rows that reach cutoff / LISTS in some list can
   reach the cutoff in total; they are taken, and dropped again if the scores known and the
   bound for the others stay below it.
3. Resolve: what is left gets its exact total; totals from the cutoff up, ties included, are
   ranked.

Queries are a stated set, met with all rows in blocks: rows are copied per block of queries and
queries per tile, never row by row. Cutoffs travel with the query blocks, in two steps, since
they grow with the queries. A tile's results are k numbers per query, not pairs.

Components become floor(scale * x). Vectors that are null, empty, or hold null, NaN or infinite
components, and rows with a null id take no part. Vectors of several lengths are dealt by length:
a query meets the rows of its own, since others have no inner product with it. Rows that share an
id count once, with the least vector. Fewer than k candidates: all are returned. No rows: none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage

LISTS = 4
TILE_ROWS = 4096
BLOCK_QUERIES = 512
#: Tiles whose gathered scores are merged by one task before the last merge.
MERGE = 64
SCALE = 64


def usable(vectors: DataFrame, key: str, vec: str, scale: int) -> DataFrame:
    """_id, _v (array of whole numbers)."""
    x = F.transform(F.col(vec), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))
    finite = F.forall(F.col(vec), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return (
        vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & finite)
        .groupBy(F.col(key).alias("_id"))
        .agg(F.min(x).alias("_v"))
    )


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    flat = t.column(column).combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(t.num_rows, -1)


def _parts(rows: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """(queries x rows) local scores of each list of dimensions."""
    cuts = np.array_split(np.arange(rows.shape[1]), min(LISTS, rows.shape[1]))
    return [queries[:, c] @ rows[:, c].T for c in cuts]


def _own(ids: np.ndarray, query_ids: np.ndarray) -> np.ndarray:
    return query_ids[:, None] == ids[None, :]


_GATHERED = "_block bigint, _tile int, _ids array<bigint>, _scores array<double>"
_ARROW = pa.schema([("_block", pa.int64()), ("_tile", pa.int32()), ("_ids", pa.list_(pa.int64())), ("_scores", pa.list_(pa.float64()))])


def _gather(k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _ARROW.empty_table()
        ids, qids = rows.column("_id").to_numpy(), queries.column("_q").to_numpy()
        parts = _parts(_matrix(rows, "_v"), _matrix(queries, "_asked"))
        own, top = _own(ids, qids), min(k + 1, len(ids))
        best = [np.argpartition(-p, top - 1, axis=1)[:, :top] for p in parts]
        chosen = np.zeros(own.shape, bool)
        for b in best:
            np.put_along_axis(chosen, b, True, axis=1)
        total = sum(parts)
        total[~chosen | own] = -np.inf
        take = min(k, len(ids))
        scores = -np.sort(np.partition(-total, take - 1, axis=1)[:, :take], axis=1)
        if take < k:
            scores = np.concatenate([scores, np.full((len(qids), k - take), -np.inf)], axis=1)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([qids], pa.list_(pa.int64())), pa.array([scores.ravel()], pa.list_(pa.float64()))], schema=_ARROW)

    return run


def _merge(k: int):
    """Gathered scores of several tiles of a query block into one row; queries are put in order of id."""

    def run(t: pa.Table) -> pa.Table:
        ids = best = None
        for own, s in zip(t.column("_ids"), t.column("_scores")):
            own, s = own.values.to_numpy(), s.values.to_numpy().reshape(-1, k)
            order = np.argsort(own, kind="stable")
            ids, s = own[order], s[order]
            best = s if best is None else -np.sort(-np.concatenate([best, s], axis=1), axis=1)[:, :k]
        first = t.column("_block")[0].as_py()
        return pa.table([pa.array([first], pa.int64()), pa.array([0], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([best.ravel()], pa.list_(pa.float64()))], schema=_ARROW)

    return run


def _resolve(k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not rows.num_rows or not queries.num_rows:
            return kind.empty_table()
        ids, qids = rows.column("_id").to_numpy(), queries.column("_q").to_numpy()
        cut = queries.column("_cut").to_numpy()[:, None]
        parts = _parts(_matrix(rows, "_v"), _matrix(queries, "_asked"))
        share = cut / len(parts)
        known = np.zeros_like(parts[0])  # scores known, and `share` for those below it
        some = np.zeros(known.shape, bool)
        for p in parts:
            enough = p >= share
            some |= enough
            known += np.where(enough, p, share)
        q, r = np.nonzero(some & (known >= cut - 1e-6) & ~_own(ids, qids))
        total = sum(p[q, r] for p in parts)
        keep = total >= cut[q, 0]
        q, r, total = q[keep], r[keep], total[keep]
        order = np.lexsort((ids[r], -total, q))  # of many ties a tile sends the k of least id
        q, r, total = q[order], r[order], total[order]
        first = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - first < k
        q, r, total = q[keep], r[keep], total[keep]
        return pa.table([pa.array(qids[q], pa.int64()), pa.array(ids[r], pa.int64()), pa.array(total.astype(np.int64), pa.int64())], schema=kind)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query, ties to the smaller id.

    `is_query` is a condition on the key column `_id`.
    """
    all_rows = stage(usable(vectors, key, vec, scale), "vectors")
    tiles = max(1, math.ceil(all_rows.count() / TILE_ROWS))
    queries = all_rows.where(is_query)
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    slot = lambda m, seed: F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # A block holds queries of one length.
    block = lambda i: F.size("_v").cast("long") * blocks + i
    rows = all_rows.select("_id", "_v", slot(tiles, 1).alias("_tile"), spread(blocks).alias("_i")).select("_id", "_v", "_tile", block(F.col("_i")).alias("_block"))
    asked = queries.select(F.col("_id").alias("_q"), F.col("_v").alias("_asked"), block(slot(blocks, 2)).alias("_of"))

    each = asked.withColumn("_in", spread(tiles))
    gathered = rows.groupBy("_block", "_tile").cogroup(each.groupBy("_of", "_in")).applyInArrow(_gather(k), _GATHERED)
    some = gathered.groupBy("_block", (F.col("_tile") / MERGE).cast("int").alias("_run"))
    merged = some.applyInArrow(_merge(k), _GATHERED).groupBy("_block").applyInArrow(_merge(k), _GATHERED)
    cut = merged.select(F.posexplode("_ids").alias("i", "_id"), "_scores").select(F.col("_id").alias("_q"), F.element_at("_scores", (F.col("i") + 1) * k).alias("_cut"))

    each = stage(asked.join(cut, "_q"), "cutoffs").withColumn("_in", spread(tiles))
    found = rows.groupBy("_block", "_tile").cogroup(each.groupBy("_of", "_in")).applyInArrow(_resolve(k), "query_id bigint, vec_id bigint, score bigint")
    ranked = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("i", "x")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
