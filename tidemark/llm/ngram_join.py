"""Similarity join of documents on word n-gram sets, by MinHash banding (operator 6).

Texts are lower-cased (A-Z) and cut into words; a document's set holds its runs of five words
(of fewer than five words: one run of all). Rows and bands of the signature are chosen from the
target recall at the threshold: a pair of that similarity is missed with probability
(1 - s**rows)**bands.

1. Documents of equal sets are one class: only their representative goes on, under a number of its own.
2. Band hashes are shuffled; members of a bucket are tied to the bucket's least member, which
   needs no pairs, and components of these ties hold every pair that shares a bucket.
3. Full sets of such documents are compared within their component, in tiles of `TILE` documents:
   a task sees two tiles at most and computes all intersections at once, by counting pairs for
   rare n-grams and by a matrix product for common ones. It returns a row per document: its number
   of links and its root in the tiles' spanning forest. Pairs are never written out, and no link
   between different texts is lost.
4. Components of the forests' edges give the class.

A component of many documents costs the square of its tiles, spread over as many tasks; that is
the price of exact link counts. Texts are not shuffled: a bit table of fixed size tells the
scan which documents are in a component, and their sets move.

Null and empty texts have no set and stand alone, as do rows with a null id. Sets, not ids, are
joined, so texts that share an id keep their own links and class. Of each class the row of the
least id is `kept` (of several texts of that id, the one of the least digest); rows that repeat an
id and its text are equal and share their marks.
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
from tidemark.llm.decontaminate import BITS, bit_table, text_key
from tidemark.llm.shared import short_batches, stage

N = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: Hash functions of a signature at most.
HASHES = 200
TILE = 512
#: N-grams in up to so many documents of a task are counted pair by pair.
RARE = 16
COLUMNS = 2048


def banding(similarity: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows, hence fewest false candidates, that reach `recall` with so many hashes."""
    best = None
    for rows in range(1, 33):
        hit = similarity**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def grams(words: W.Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of each n-gram; documents of fewer words have one."""
    at, g = W.ngrams(words, n)
    doc = words.doc[at]
    counts = words.counts
    for k in np.unique(counts[(counts > 0) & (counts < n)]).tolist():
        at, h = W.ngrams(words, k)
        alone = counts[words.doc[at]] == k
        doc, g = np.concatenate([doc, words.doc[at[alone]]]), np.concatenate([g, W.mix(h[alone] ^ np.uint64(k))])
    return doc, g


def sets(words: W.Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """As `grams`, sorted by document and hash, each once."""
    doc, g = grams(words, n)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    first = np.ones(len(g), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    return doc[first], g[first]


def _multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(97)
    return r.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2)


_SKETCH = "_id {}, _text bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>"


def _sketch(bands: int, rows: int):
    a, b = _multipliers(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in W.chunks(batch.column(1)):
                m = len(offsets) - 1
                doc, g = sets(W.split_words(data, offsets, W.ALNUM, lower=True))
                n = np.bincount(doc, minlength=m)
                some = np.flatnonzero(n)
                out = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    start = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                    for i in range(bands):
                        for j in range(i * rows, (i + 1) * rows):
                            out[:, i] = W.mix(out[:, i] ^ np.minimum.reduceat(g * a[j] + b[j], start)) + np.uint64(j)
                lengths = np.where(n > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, m), batch.column(2).slice(row, m), *[pa.array(W.signed(k)) for k in set_keys(g, n)], pa.array(n.astype(np.int64)), W.lists(W.signed(out.ravel()), lengths, pa.int64())],
                    names=["_id", "_text", "k1", "k2", "n", "bands"],
                )

    return run


def set_keys(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128 bits that stand for each document's set; 0 for an empty one."""
    keys, some = np.zeros((2, len(n)), np.uint64), np.flatnonzero(n)
    if len(some):
        start = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        keys[0, some] = np.add.reduceat(W.mix(g), start)
        keys[1, some] = np.add.reduceat(W.mix(g ^ np.uint64(0x5555555555555555)), start)
    return keys


def _full_sets(bits: bytes):
    """(_id, text, h) to (_id, x1, x2, grams) of the documents whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits, np.uint8)
        for batch in batches:
            slot = batch.column(2).to_numpy() & (BITS - 1)
            some = pa.array(((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool))
            batch = batch.filter(some)
            for row, data, offsets in W.chunks(batch.column(1)):
                m = len(offsets) - 1
                doc, g = sets(W.split_words(data, offsets, W.ALNUM, lower=True))
                n = np.bincount(doc, minlength=m)
                keys = [pa.array(W.signed(k)) for k in set_keys(g, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, m), *keys, W.lists(W.signed(g), n, pa.int64())], names=["_id", "x1", "x2", "grams"])

    return run


def intersections(doc: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """(n x n) numbers of shared n-grams; the diagonal is left at 0."""
    _, gram, df = np.unique(gram, return_inverse=True, return_counts=True)
    many = df[gram] > 1
    doc, gram = doc[many], gram[many]
    order = np.lexsort((doc, gram))
    doc, gram = doc[order], gram[order]
    out = np.zeros(n * n)
    rare = df[gram] <= RARE
    d, g = doc[rare], gram[rare]
    for step in range(1, RARE):
        same = g[step:] == g[:-step]
        if not same.any():
            break
        out += np.bincount(d[:-step][same] * n + d[step:][same], minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    d, g = doc[~rare], gram[~rare]
    if len(g):
        _, g = np.unique(g, return_inverse=True)
        edge = np.searchsorted(g, np.arange(0, g[-1] + 1 + COLUMNS, COLUMNS))
        for lo, hi in zip(edge[:-1], edge[1:]):
            x = np.zeros((n, COLUMNS), np.float32)
            x[d[lo:hi], g[lo:hi] % COLUMNS] = 1
            out += x @ x.T
    np.fill_diagonal(out, 0)
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each row's component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(similarity: float):
    kind = pa.schema([("_rep", pa.int64()), ("_root", pa.int64()), ("_links", pa.int64())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rep, comp, tile, copies = (t.column(c).to_numpy() for c in ("_rep", "_comp", "_tile", "_copies"))
        lists = t.column("grams").combine_chunks()
        size = np.asarray(lists.value_lengths())
        doc = np.repeat(np.arange(len(rep)), size)
        shared = intersections(doc, np.asarray(lists.flatten()), len(rep))
        linked = shared * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-9
        linked &= comp[:, None] == comp[None, :]
        np.fill_diagonal(linked, False)
        if key[1].as_py() != key[2].as_py():  # pairs inside one tile are counted where it stands alone
            linked &= tile[:, None] != tile[None, :]
        return pa.table([pa.array(rep), pa.array(rep[roots(linked)]), pa.array((linked @ copies).astype(np.int64))], schema=kind)

    return run


def marked_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """`key` (whole number), class_id (least id of the class), n_links (other documents of that similarity or more), n_grams, text_key and kept, a row per row."""
    spark = docs.sparkSession
    short_batches(spark)
    bands, rows = banding(similarity, recall)
    read = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t"), text_key(F.col(text)).alias("_text"))
    sketch = stage(read.mapInArrow(_sketch(bands, rows), _SKETCH.format("bigint")), "sketch")
    reps = sketch.where((F.col("n") > 0) & F.col("_id").isNotNull()).groupBy("k1", "k2")
    least = F.min(F.struct(F.col("_id").alias("id"), F.col("_text").alias("text")))
    reps = reps.agg(least.alias("_least"), F.count(F.lit(1)).alias("_copies"), F.min("bands").alias("bands"))
    reps = stage(reps.withColumn("_rep", F.monotonically_increasing_id()), "representatives")  # as written, for good

    each = reps.select("_rep", F.posexplode("bands").alias("i", "h"))
    hubs = each.groupBy(F.col("i").alias("j"), F.col("h").alias("g")).agg(F.min("_rep").alias("hub"), F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    ties = each.join(hubs, (F.col("i") == F.col("j")) & (F.col("h") == F.col("g"))).where(F.col("_rep") != F.col("hub"))
    tied = components(ties.select(F.col("_rep").alias("a"), F.col("hub").alias("b")))

    members = tied.union(tied.select("root", "root").distinct()).toDF("_node", "_comp")
    size = members.groupBy(F.col("_comp").alias("_c")).agg(F.count(F.lit(1)).alias("m"))
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    members = members.join(size, F.col("_comp") == F.col("_c")).select("_node", "_comp", tiles.alias("_tiles"), F.pmod(F.xxhash64("_node"), tiles).cast("int").alias("_tile"))
    members = stage(members.join(reps.select("_rep", F.col("_least.id").alias("_own"), "_copies", "k1", "k2"), F.col("_node") == F.col("_rep")).drop("_node"), "members")
    packs = max(1, math.ceil(members.count() / TILE))

    bits = bit_table(members.select(F.xxhash64("_own").alias("h")))
    full = read.where(F.col("_id").isNotNull()).select("_id", "_t", F.xxhash64("_id").alias("h")).mapInArrow(_full_sets(bits), "_id bigint, x1 bigint, x2 bigint, grams array<bigint>")
    full = full.groupBy("_id", "x1", "x2").agg(F.first("grams").alias("grams"))
    full = members.join(full, (F.col("_own") == F.col("_id")) & (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")))
    # Small components share a task; the tiles of a large one meet in pairs.
    pack = F.when(F.col("_tiles") == 1, F.pmod(F.xxhash64("_comp"), F.lit(packs)) - packs).otherwise(F.col("_comp"))
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    pairs = full.select("*", pack.alias("_pack"), other.alias("_with")).select(
        "_rep", "_comp", "_copies", "_tile", "grams", "_pack", F.least("_tile", "_with").alias("_lo"), F.greatest("_tile", "_with").alias("_hi")
    )
    found = stage(pairs.groupBy("_pack", "_lo", "_hi").applyInArrow(_verify(similarity), "_rep bigint, _root bigint, _links bigint"), "links")

    links = found.groupBy("_rep").agg(F.sum("_links").alias("_links")).where(F.col("_links") > 0)
    classes = components(found.select(F.col("_rep").alias("a"), F.col("_root").alias("b"))).toDF("_rep", "_class")
    classes = stage(classes.union(classes.select("_class", "_class").distinct()), "classes")
    firsts = classes.join(reps.select("_rep", "_least"), "_rep").groupBy(F.col("_class").alias("_of")).agg(F.min("_least").alias("_first"))
    known = reps.select("k1", "k2", "_rep", "_copies", "_least").join(links, "_rep", "left").join(classes, "_rep", "left")
    known = known.join(stage(firsts, "class-rows"), F.col("_class") == F.col("_of"), "left")
    n_links = F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))
    known = known.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.coalesce("_first", "_least").alias("_first"), n_links.alias("n_links"))
    same = (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")) & (F.col("n") > 0) & F.col("_id").isNotNull()
    first = (F.col("_id") == F.col("_first.id")) & (F.col("_text") == F.col("_first.text"))
    return sketch.drop("bands").join(known, same, "left").select(
        F.col("_id").alias(key),
        F.coalesce("_first.id", "_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("n").alias("n_grams"),
        F.col("_text").alias("text_key"),
        F.coalesce(first, F.lit(True)).alias("kept"),
    )


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """`key`, class_id and n_links of `marked_copies`."""
    return marked_copies(docs, key, text, similarity, recall).select(key, "class_id", "n_links")
