"""Near-duplicate vectors by collision counting on random projections (operator 11).

Vectors of one label link if their cosine is `similarity` or more, that is, if their unit vectors lie
`reach` = sqrt(2 - 2 * similarity) apart at most. Projected on a random direction, such a pair differs by
about reach / sqrt(d), whatever else it is like, while unrelated vectors spread over the whole axis.

1. Equal vectors of a label are one, with a number of copies.
2. Vectors are sorted by `TABLES` times `AXES` projections: a cell of a table holds those that fall together on
   all of its axes, each cut into widths of `WIDTH` reaches at a random offset. A pair at the threshold meets
   in a given table with probability (1 - E|x| / width) ** AXES; the number of tables follows from `recall`.
3. In a cell each vector is the centre of a window on each of `COUNTED` further projections, and the windows
   that hold a partner are counted for each pair. A pair goes on if the count reaches the least number that a
   pair at the threshold reaches with probability `COUNT_RECALL`. Only a byte per projection travels up to here.
4. Vectors with such a partner are brought to their cells, and cosines of the counted pairs taken in double
   precision. A pair counts in the first table where it meets. Tasks return a row per vector: its links and its
   root in the pairs' spanning forest; components of these give the class.

Cells of many vectors are dealt in pairs of tiles of `TILE` vectors, so that none is held by one task; they cost
the square of their tiles, since links between different vectors are counted exactly. Pairs are never written.

A null, empty or zero vector, or one with null or non-finite components, links with nothing; so does a row
without a label or id. Vectors of different lengths have no cosine and do not link. Rows that repeat an id are
vectors of their own. A row without an id is kept. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.components import components
from tidemark.llm.shared import stage

SIMILARITY = 0.98
#: Of pairs at the threshold, those that meet in some table, and those whose count passes.
RECALL, COUNT_RECALL = 0.995, 0.999
AXES = 10
#: In units of reach / sqrt(d): widths of cells, half widths of windows.
WIDTH, WINDOW = 8.0, 1.5
COUNTED = 24
#: A window reaches so many steps of a counted projection to either side.
STEPS = 8
TILE = 512
PACK = 4096
SEED = 20_011
_KEY = "struct<a: bigint, b: bigint>"


def tables(recall: float = RECALL, axes: int = AXES, width: float = WIDTH) -> int:
    meet = (1 - math.sqrt(2 / math.pi) / width) ** axes
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def least_count(recall: float = COUNT_RECALL, counted: int = COUNTED, window: float = WINDOW) -> int:
    """The highest count that a pair at the threshold reaches with probability `recall`."""
    p, tail = math.erf(window / math.sqrt(2)), 0.0
    for c in range(counted, -1, -1):
        tail += math.comb(counted, c) * p**c * (1 - p) ** (counted - c)
        if tail >= recall:
            return c
    return 0


def directions(d: int, n: int) -> np.ndarray:
    x = np.random.default_rng([SEED, d]).standard_normal((d, n))
    return x / np.linalg.norm(x, axis=0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, also where squares would overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length and their values, nulls left out."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    start = np.cumsum(lengths) - lengths
    flat = np.asarray(vectors.flatten(), np.float64)
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, flat[start[at][:, None] + np.arange(d)]


def _sketch(similarity: float, n_tables: int):
    """(_id, _key, hash of the label, vector) to (_id, _key, _marks, _cells); a null vector has neither marks nor cells."""
    reach = math.sqrt(2 - 2 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            group, vectors = batch.column(2).to_numpy().view(np.uint64), batch.column(3)
            marks = np.full(n, None, object)
            cells, counts = np.zeros((n, n_tables), np.uint64), np.zeros(n, np.int64)
            for at, x in _by_length(vectors):
                d = x.shape[1]
                unit_step = reach / math.sqrt(d)
                p = unit(x) @ directions(d, n_tables * AXES + COUNTED)
                offset = np.random.default_rng([SEED, d, 1]).uniform(0, WIDTH, n_tables * AXES)
                cell = np.floor(p[:, : n_tables * AXES] / unit_step / WIDTH + offset / WIDTH).astype(np.int64).view(np.uint64).reshape(len(at), n_tables, AXES)
                h = W.mix(group[at][:, None] ^ W.mix(np.arange(n_tables, dtype=np.uint64) + np.uint64(d << 16)))
                for a in range(AXES):
                    h = W.mix(h ^ cell[:, :, a]) + np.uint64(a)
                cells[at], counts[at] = h, n_tables
                steps = np.floor(p[:, n_tables * AXES :] / (WINDOW * unit_step / STEPS)).astype(np.int64).astype(np.int8)
                for i, row in zip(at.tolist(), steps):
                    marks[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks, pa.binary()), W.lists(W.signed(cells[counts > 0].ravel()), counts, pa.int64())], names=["_id", "_key", "_marks", "_cells"]
            )

    return run


def colliding(h: np.ndarray, marks: np.ndarray, least: int, tile: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell (rows are sorted by `h`) that share `least` windows or more; with `tile`, of different tiles."""
    for step in range(1, len(h)):
        same = h[step:] == h[:-step]
        if not same.any():
            return
        if tile is not None:
            same &= tile[step:] != tile[:-step]
        i = np.flatnonzero(same)
        near = ((marks[i] - marks[i + step]).view(np.uint8) + np.uint8(STEPS)) <= 2 * STEPS
        i = i[near.sum(axis=1) >= least]
        if len(i):
            yield i, i + step


def _rows(t: pa.Table, across: bool) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray | None]:
    t = t.sort_by("_h")
    marks = np.frombuffer(b"".join(t.column("_marks").to_pylist()), np.int8).reshape(t.num_rows, -1)
    return t, t.column("_h").to_numpy(), marks, t.column("_tile").to_numpy() if across else None


def _partnered(least: int):
    """Members of cells to those that have a partner there."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t, h, marks, tile = _rows(t, key[1].as_py() != key[2].as_py())
        some = np.zeros(len(h), bool)
        for i, j in colliding(h, marks, least, tile):
            some[i] = some[j] = True
        return t.filter(pa.array(some)).select(["_key", "_h"])

    return run


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each row's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_NODE = pa.struct([("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_FOUND = pa.schema([("_node", _NODE), ("_root", _NODE), ("_links", pa.int64())])


def _verified(similarity: float, least: int):
    """Members of cells with their vectors to `_FOUND`, for those that have links."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t, h, marks, tile = _rows(t, key[1].as_py() != key[2].as_py())
        n = t.num_rows
        own, copies = t.column("_table").to_numpy(), t.column("_copies").to_numpy()
        cells = np.asarray(t.column("_cells").combine_chunks().flatten()).reshape(n, -1)
        vectors = t.column("_v").combine_chunks()
        place, blocks = np.zeros((n, 2), np.int64), []
        for at, x in _by_length(vectors):
            place[at, 0], place[at, 1] = len(blocks), np.arange(len(at))
            blocks.append(unit(x))
        linked = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, j in colliding(h, marks, least, tile):
            here = (cells[i] == cells[j]).argmax(axis=1) == own[i]
            i, j = i[here], j[here]
            for b, x in enumerate(blocks):  # rows of one cell have one length
                of = place[i, 0] == b
                a, c = i[of], j[of]
                close = np.einsum("ij,ij->i", x[place[a, 1]], x[place[c, 1]]) >= similarity
                linked.append((a[close], c[close]))
        i, j = (np.concatenate(x) for x in zip(*linked))
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        node = t.column("_node").combine_chunks()
        some = pa.array(np.flatnonzero(links))
        return pa.table([node.take(some), node.take(pa.array(forest(n, i, j)[np.flatnonzero(links)])), pa.array(links[links > 0].astype(np.int64))], schema=_FOUND)

    return run


def _dealt(members: DataFrame, packs: int) -> DataFrame:
    """Members of cells (`_key`, `_h`, `_m` of the cell) by task: small cells together, tiles of large ones in pairs."""
    tiles = F.ceil(F.col("_m") / TILE).cast("int")
    rows = members.withColumns({"_tiles": tiles, "_tile": F.pmod(F.xxhash64("_key"), tiles).cast("int")})
    pack = F.when(F.col("_tiles") == 1, F.pmod(F.xxhash64("_h"), F.lit(packs)) - packs).otherwise(F.col("_h"))
    rows = rows.withColumns({"_pack": pack, "_with": F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))})
    return rows.withColumns({"_lo": F.least("_tile", "_with"), "_hi": F.greatest("_tile", "_with")}).drop("_with", "_tiles", "_m")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """`vec_id`, n_links, component_id and kept, a row per row."""
    n_tables, least = tables(recall), least_count()
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    takes_part = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))
    # 128 bits stand for a vector and its label.
    key = F.struct(F.xxhash64(label, vector).alias("a"), F.xxhash64(F.lit(SEED), vector, label).alias("b"))
    read = rows.select(F.col(vec_id).cast("long").alias("_id"), F.when(takes_part, key).alias("_key"), F.xxhash64(label).alias("_g"), F.when(takes_part, v.cast("array<double>")).alias("_v"))
    sketch = stage(read.mapInArrow(_sketch(similarity, n_tables), f"_id bigint, _key {_KEY}, _marks binary, _cells array<bigint>"), "sketch")
    reps = sketch.where(F.col("_key").isNotNull()).groupBy("_key")
    reps = stage(reps.agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_copies"), F.min("_marks").alias("_marks"), F.min("_cells").alias("_cells")), "vectors")

    each = reps.select("_key", "_marks", F.explode("_cells").alias("_h"))
    crowded = each.groupBy(F.col("_h").alias("_c")).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > 1)
    crowded = stage(crowded, "cells")
    packs = max(1, math.ceil((crowded.agg(F.sum("_m")).first()[0] or 0) / PACK))
    members = each.join(crowded, F.col("_h") == F.col("_c")).drop("_c")
    partnered = _dealt(members, packs).groupBy("_pack", "_lo", "_hi").applyInArrow(_partnered(least), f"_key {_KEY}, _h bigint").distinct()
    partnered = stage(partnered.toDF("_pk", "_h"), "partnered")

    crowded = stage(partnered.groupBy(F.col("_h").alias("_c")).agg(F.count(F.lit(1)).alias("_m")), "cells")
    packs = max(1, math.ceil((crowded.agg(F.sum("_m")).first()[0] or 0) / TILE))
    needed = partnered.select("_pk").distinct().join(reps, F.col("_pk") == F.col("_key")).drop("_pk")
    needed = stage(needed.withColumnRenamed("_key", "_nk"), "needed")
    # Of copies, the row of the least id lends its vector.
    whole = read.where(F.col("_v").isNotNull()).join(needed, (F.col("_id") == F.col("_least")) & (F.col("_key") == F.col("_nk"))).dropDuplicates(["_key"])
    node = F.struct(F.col("_least").alias("id"), F.col("_key.a").alias("a"), F.col("_key.b").alias("b"))
    whole = stage(whole.select("_key", node.alias("_node"), "_marks", "_cells", "_copies", "_v"), "near-vectors")
    members = partnered.join(whole, F.col("_pk") == F.col("_key")).drop("_pk").join(crowded, F.col("_h") == F.col("_c")).drop("_c")
    members = members.withColumn("_table", (F.array_position("_cells", F.col("_h")) - 1).cast("int"))
    kind = "struct<id: bigint, a: bigint, b: bigint>"
    found = stage(_dealt(members, packs).groupBy("_pack", "_lo", "_hi").applyInArrow(_verified(similarity, least), f"_node {kind}, _root {kind}, _links bigint"), "links")

    links = found.groupBy(F.struct("_node.a", "_node.b").alias("_lk")).agg(F.sum("_links").alias("_links"))
    classes = components(found.select(F.col("_node").alias("a"), F.col("_root").alias("b"))).select(F.struct("node.a", "node.b").alias("_ck"), F.col("root.id").alias("_class"))
    known = reps.select("_key", "_least", "_copies").join(links, F.col("_key") == F.col("_lk"), "left").join(classes, F.col("_key") == F.col("_ck"), "left")
    known = known.where((F.col("_copies") > 1) | F.col("_links").isNotNull())
    known = stage(known.select(F.col("_key").alias("_kk"), F.coalesce("_class", "_least").alias("_class"), (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_links")), "known")
    own = F.col("_id")
    component = F.coalesce("_class", own)
    return sketch.select("_id", "_key").join(known, F.col("_key") == F.col("_kk"), "left").select(
        own.alias(vec_id), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(own == component, F.lit(True)).alias("kept")
    )


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a), m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.c, vec_id)) AS component_id, vec_id <= coalesce(m.c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
