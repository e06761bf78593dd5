"""Benchmark decontamination by winnowing (operator 2).

Texts are lower-cased (A-Z) and cut into words. Of every `WINDOW - K + 1` consecutive K-grams the
one with the least hash is kept, so any span of WINDOW words that a document shares with an
item yields a fingerprint on both sides. Fingerprints are joined, and each match is extended
word by word, up to WINDOW - K on either side: what reaches WINDOW words is a hit. Items with
fewer words have one fingerprint, their whole word list, probed at every position.

What moves: items give one row per fingerprint. They also set bits in a table of fixed size
(`BITS`), sent to all tasks; document fingerprints whose bit is not set match no item and are
dropped before any shuffle, so document rows are about the true matches, with the few words
around each. Texts stay where they are read. The join is an ordinary one on the fingerprint:
broadcast if the item side is known to be small, else adaptive execution splits a fingerprint
that many documents share. All comparisons end on the words themselves.

Null and empty texts have no words. Items without words are ignored; items with a null id mark
words but are not listed. Each input row gets one row; rows with the same id and text get the
same result. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import short_batches, stage

WINDOW = 13
K = 7
#: Size of the bit table of item fingerprints: one megabyte, whatever the tables' size.
BITS = 1 << 23

_HIT = pa.struct(
    [("h", pa.int64()), ("k", pa.int32()), ("pos", pa.int32()), ("before", pa.list_(pa.string())), ("mid", pa.string()), ("after", pa.list_(pa.string()))]
)
_HIT_SQL = "array<struct<h:bigint,k:int,pos:int,before:array<string>,mid:string,after:array<string>>>"


def _of_length(h: np.ndarray, k: int) -> np.ndarray:
    return W.mix(h ^ np.uint64(k))


def winnow(words: W.Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the fingerprints of each document."""
    at, grams = W.ngrams(words, k)
    run = window - k + 1
    best = W.sliding_argmin(grams, run)
    if not len(best):
        return at[:0], grams[:0]
    whole = words.doc[at[: len(best)]] == words.doc[at[run - 1 :]]
    keep = np.unique(best[whole])
    return at[keep], _of_length(grams[keep], k)


def _fingerprints(short: list[int], bits: bytes | None):
    """(id, text, text key) to (_id, _text, n_words, _hits). Items (no `bits`): all fingerprints, documents: those that pass `bits`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_bits = None if bits is None else np.frombuffer(bits, np.uint8)
        for batch in batches:
            keys, texts, text_keys = batch.columns
            for row, data, offsets in W.chunks(texts):
                words = W.split_words(data, offsets, W.ALNUM, lower=True)
                n = words.counts
                first = np.cumsum(n) - n
                found = [(*winnow(words, K, WINDOW), K)]
                if set_bits is None:  # an item of few words is one window
                    for k in np.unique(n[(n > 0) & (n < WINDOW)]).tolist():
                        at, grams = W.ngrams(words, k)
                        alone = n[words.doc[at]] == k
                        found.append((at[alone], _of_length(grams[alone], k), k))
                else:
                    found += [(at, _of_length(grams, k), k) for k in short for at, grams in [W.ngrams(words, k)]]
                hits: list[list[dict]] = [[] for _ in n]
                for at, h, k in found:
                    if set_bits is not None:
                        slot = (h & np.uint64(BITS - 1)).astype(np.int64)
                        some = np.flatnonzero((set_bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                        at, h = at[some], h[some]
                    reach = WINDOW - K if k == K else 0
                    for p, x in zip(at.tolist(), W.signed(h).tolist()):
                        d = words.doc[p]
                        lo, hi = max(first[d], p - reach), min(first[d] + n[d], p + k + reach)
                        near = words.text(lo, hi).decode().split(" ")
                        hits[d].append(
                            {"h": x, "k": k, "pos": int(p - first[d]), "before": near[: p - lo][::-1], "mid": " ".join(near[p - lo : p - lo + k]), "after": near[p - lo + k :]}
                        )
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(row, len(n)), text_keys.slice(row, len(n)), pa.array(n, pa.int64()), pa.array(hits, pa.list_(_HIT))],
                    names=["_id", "_text", "n_words", "_hits"],
                )

    return run


def _scan(df: DataFrame, key: str, text: str, short: list[int], bits: bytes | None) -> DataFrame:
    short_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    read = df.select(F.col(key).alias("_id"), F.col(text).alias("_t"), text_key(F.col(text)))
    return read.mapInArrow(_fingerprints(short, bits), f"_id {kind}, _text bigint, n_words bigint, _hits {_HIT_SQL}")


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def bit_table(hashes: DataFrame, column: str = "h", bits: int = BITS) -> bytes:
    """A table of `bits` bits, one set for each hash. At most bits / 64 rows come to the driver."""
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = (
        hashes.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.tobytes()


def _same(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays of at most WINDOW - K words."""
    equal = F.transform(F.sequence(F.lit(1), F.lit(WINDOW - K)), lambda i: F.coalesce(F.get(a, i - 1) == F.get(b, i - 1), F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.lit(WINDOW - K)).cast("int")


def covered(spans: Column) -> Column:
    """Number of positions in the union of [s, e) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")
    )
    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: `doc_id`, n_words, n_hit, n_items, items (sorted), spans (hit words), contaminated, text_key."""
    items = stage(_scan(benchmark, item_id, item_text, [], None), "items")
    prints = items.select(F.col("_id").alias("_item"), "n_words", F.explode("_hits").alias("x"))
    prints = stage(
        prints.select("_item", F.least("n_words", F.lit(WINDOW)).cast("int").alias("need"), "x.h", "x.k", *[F.col(f"x.{c}").alias(f"i_{c}") for c in ("before", "mid", "after")]).distinct(),
        "item-prints",
    )
    short = [r["k"] for r in prints.where(F.col("need") < WINDOW).select("k").distinct().collect()]  # twelve at most
    seen = stage(_scan(docs, doc_id, text, short, bit_table(prints)), "document-prints")
    hits = seen.where(F.size("_hits") > 0).select("_id", "_text", F.explode("_hits").alias("x")).select("_id", "_text", "x.*")
    left, right = _same(F.col("before"), F.col("i_before")), _same(F.col("after"), F.col("i_after"))
    # A span of a short item ends with its own words.
    left, right = (F.when(F.col("need") < WINDOW, F.lit(0)).otherwise(c) for c in (left, right))
    spans = (
        hits.join(prints, ["h", "k"])
        .where(F.col("mid") == F.col("i_mid"))
        .select("_id", "_text", "_item", "need", (F.col("pos") - left).alias("s"), (F.col("pos") + F.col("k") + right).alias("e"))
        .where(F.col("e") - F.col("s") >= F.col("need"))
    )
    per_doc = spans.groupBy(F.col("_id").alias("_of"), F.col("_text").alias("_as")).agg(
        F.sort_array(F.collect_set(F.col("_item").cast("string"))).alias("items"), F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans")
    )
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    return (
        seen.select("_id", "_text", "n_words")
        .join(per_doc, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_as")), "left")
        .select(
            F.col("_id").alias(doc_id),
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", none).alias("items"),
            "spans",
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
            F.col("_text").alias("text_key"),
        )
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[p:p + least(len(ws), 13) - 1], ' ') AS w
       FROM i, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) t(p) WHERE len(ws) > 0),
dw AS (SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS w FROM d, (SELECT DISTINCT k FROM iw) ks, unnest(range(1, len(ws) - k + 2)) t(p)),
hits AS MATERIALIZED (SELECT doc_id, item_id, p, k FROM dw JOIN iw USING (k, w)),
hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
