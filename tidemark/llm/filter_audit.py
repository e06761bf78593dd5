"""Interaction audit of document filters, by truth-table survival words (operator 12).

With n filters (five at most) a document is a word of 2**n bits: bit S is set if the document
survives the set S of filters, that is, fails none of them. Survivors of all sets, per part and label,
are then positional popcounts of such words, and every order of the filters reads its figures from
them: what a filter removes after the filters of P is survivors(P) - survivors(P + filter).

1. One pass over the texts measures each document, applies the checks on its own text and takes a
   digest of the text. Texts are not shuffled.
2. Least ids of digests that occur more than once tell the filter of repeated texts; labels join by id.
3. Tasks add their words in a carry-save tree (full adders on whole columns of words) and return one
   row of bit counts per part and label.
4. A row per part, order and step is unfolded from 2**n counts per part.

Null texts are empty texts, a null part is the empty string. A row with a null id has no labels, is
never a repeat and makes no other row one. Rows that share an id and a text are not repeats of each
other. Several labels of an id: one that is good (toxic) is enough. Without documents there are no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import short_batches, stage

_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_SPECIAL = b"#$%&*|"
#: Words kept until they are added up, and (part, label) groups held at most before they are sent on.
HELD = 1 << 16
GROUPS = 512


class Measures(NamedTuple):
    words: int
    distinct: int
    upper: int
    points: int
    special: bool


def measure(text: bytes) -> Measures:
    """Words end at ASCII white space."""
    words = text.split()
    n = len(text)
    return Measures(len(words), len(set(words)), n - len(text.translate(None, _UPPER)), len(text.translate(None, _CONTINUED)), len(text.translate(None, _SPECIAL)) < n)


#: True where a document fails; the filter of repeated texts comes after these.
CHECKS: dict[str, Callable[[Measures], bool]] = {
    "A": lambda m: m.words < 100,
    "B": lambda m: 100 * m.distinct < 80 * m.words,
    "C": lambda m: 100 * m.upper > 10 * m.points,
    "D": lambda m: m.special,
}
REPEATS = "E"


def survival_words(filters: int) -> np.ndarray:
    """For each set of failed filters, the word of the sets of filters that the document survives."""
    sets = np.arange(1 << filters)
    bits = (sets[:, None] & sets[None, :]) == 0
    return (bits.astype(np.uint64) << sets.astype(np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.uint32)


def positional_popcount(words: np.ndarray, bits: int = 32) -> np.ndarray:
    """How many of the 32-bit words have each bit set.

    Three words of weight w are one of weight w (their sum) and one of weight 2w (their carry), for all
    bits at once; a third of the words is left at each level until two remain.
    """
    out, at = np.zeros(bits, np.int64), np.arange(bits, dtype=np.uint32)
    level, weight = np.asarray(words, np.uint32), 1
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            level = np.concatenate([odd ^ c, level[3 * third :]])
        for word in level:
            out += weight * ((word >> at) & 1).astype(np.int64)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return out


def _measured(checks: list[Callable[[Measures], bool]]):
    """(id, part, text) to (_id, _part, _key, _failed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, failed = [], []
            for text in batch.column(2).cast(pa.large_binary()):
                text = text.as_py() or b""
                m = measure(text)
                keys.append(hashlib.md5(text).digest())
                failed.append(sum(1 << i for i, check in enumerate(checks) if check(m)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(failed, pa.int32())], names=["_id", "_part", "_key", "_failed"])

    return run


def _counted(filters: int):
    """(part, failed, label) to (_part, _label, _counts), some rows for each part and label."""
    table, sets = survival_words(filters), 1 << filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        counts: dict[tuple, np.ndarray] = {}
        n = 0

        def add() -> None:
            for group, words in held.items():
                counts[group] = counts.get(group, 0) + positional_popcount(np.concatenate(words), sets)
            held.clear()

        def rows() -> pa.RecordBatch:
            add()
            groups = list(counts)
            out = [pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.int32()), pa.array([counts[g].tolist() for g in groups], pa.list_(pa.int64()))]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, names=["_part", "_label", "_counts"])

        for batch in batches:
            part = batch.column(0).dictionary_encode()
            code = part.indices.to_numpy().astype(np.int64) * 4 + batch.column(2).to_numpy()
            words = table[batch.column(1).to_numpy()]
            for c in np.unique(code).tolist():
                held.setdefault((part.dictionary[c // 4].as_py(), c % 4), []).append(words[code == c])
            n += len(words)
            if n >= HELD or len(held) >= GROUPS:
                add()
                n = 0
            if len(counts) >= GROUPS:
                yield rows()
        if held or counts:
            yield rows()

    return run


def survivors(docs: DataFrame, labels: DataFrame, checks: dict = CHECKS, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, survivors: an array over the sets of filters (bit i: the i-th filter) of structs n, good, toxic."""
    filters = len(checks) + 1
    if filters > 5:
        raise ValueError("five filters fill a word")
    spark = docs.sparkSession
    short_batches(spark)
    read = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), F.col(text).alias("_t"))
    kind = read.schema["_id"].dataType.simpleString()
    seen = stage(read.mapInArrow(_measured(list(checks.values())), f"_id {kind}, _part string, _key binary, _failed int"), "measured")

    least = seen.groupBy(F.col("_key").alias("_same")).agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    least = stage(least.where(F.col("_first") < F.col("_last")).drop("_last"), "repeated-texts")
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}")
    label = labels.groupBy(F.col("doc_id").alias("_of")).agg(one("quality"), one("toxic"))
    label = stage(label.where((F.col("_quality") == 1) | (F.col("_toxic") == 1)), "labels")

    repeat = F.when(F.col("_id") > F.col("_first"), 1 << (filters - 1)).otherwise(0)
    known = seen.join(least, F.col("_key") == F.col("_same"), "left").join(label, F.col("_id") == F.col("_of"), "left")
    coded = known.select(
        "_part", F.col("_failed").bitwiseOR(repeat).alias("_failed"), (F.coalesce("_quality", F.lit(0)) + 2 * F.coalesce("_toxic", F.lit(0))).alias("_label")
    )
    counted = coded.mapInArrow(_counted(filters), "_part string, _label int, _counts array<bigint>")
    if_label = lambda bit: F.sum(F.when(F.col("_label").bitwiseAND(bit) != 0, F.col("c")).otherwise(0))
    sums = (
        counted.select("_part", "_label", F.posexplode("_counts").alias("s", "c"))
        .groupBy("_part", "s")
        .agg(F.sum("c").alias("n"), if_label(1).alias("good"), if_label(2).alias("toxic"))
    )
    each = F.sort_array(F.collect_list(F.struct("s", "n", "good", "toxic")))
    return sums.groupBy(F.col("_part").alias("part")).agg(F.transform(each, lambda x: F.struct(x["n"].alias("n"), x["good"].alias("good"), x["toxic"].alias("toxic"))).alias("survivors"))


def _orders(letters: str) -> Column:
    """All orders and their steps, as one constant."""
    rows = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append({"o": "".join(letters[i] for i in order), "i": step, "f": f, "b": before, "a": before | 1 << f})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<o string, i int, f int, b int, a int>>")


def _shares(filters: int) -> Column:
    """Per filter: in how many orders exactly the filters of s come before it."""
    rows = [
        [{"w": factorial(s.bit_count()) * factorial(filters - 1 - s.bit_count()), "s": s, "t": s | 1 << f} for s in range(1 << filters) if not s >> f & 1]
        for f in range(filters)
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<array<struct<w bigint, s int, t int>>>")


def audit(docs: DataFrame, labels: DataFrame, checks: dict = CHECKS, repeats: str = REPEATS, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    letters = "".join(checks) + repeats
    full = (1 << len(letters)) - 1
    at = lambda s, c="n": F.get("survivors", s)[c]
    steps = survivors(docs, labels, checks, doc_id, text, part).select("part", "survivors", F.explode(_orders(letters)).alias("x"))
    lost = lambda c: at(F.col("x.b"), c) - at(F.col("x.a"), c)
    alone = F.expr("shiftleft(1, x.f)")
    shapley = F.aggregate(F.get(_shares(len(letters)), F.col("x.f")), F.lit(0).cast("long"), lambda acc, y: acc + y["w"] * (at(y["s"]) - at(y["t"])))
    return steps.select(
        "part",
        F.col("x.o").alias("filter_order"),
        F.col("x.i").alias("step"),
        at(F.col("x.a")).alias("kept"),
        lost("n").alias("removed"),
        (at(F.lit(0)) - at(alone) - lost("n")).alias("redundant"),
        (at(F.lit(full).bitwiseXOR(alone)) - at(F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws FROM t),
f AS (SELECT doc_id, part, (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 10 * length(x) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END) AS m FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS b FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
e AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM e a, e b, e c, e d, e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i::INT + 1, 1)), '') AS filter_order, k AS step, 1 << o[k] AS bit,
        list_sum(list_transform(o[:k - 1], lambda i: 1 << i)) AS earlier FROM o, unnest(range(1, 6)) t(k)),
r AS (SELECT part, filter_order, step::INT AS step, bit,
        coalesce(sum(n) FILTER (m & (coalesce(earlier, 0)::BIGINT | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (m & coalesce(earlier, 0)::BIGINT = 0 AND m & bit <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (m & coalesce(earlier, 0)::BIGINT <> 0 AND m & bit <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (m = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(g) FILTER (m & coalesce(earlier, 0)::BIGINT = 0 AND m & bit <> 0), 0)::BIGINT AS good_lost,
        coalesce(sum(b) FILTER (m & coalesce(earlier, 0)::BIGINT = 0 AND m & bit <> 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
