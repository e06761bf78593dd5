"""Quality grades by ordinal cumulative-link regression (operator 1).

Words and runs of symbols are hashed to `BUCKETS` shared weights; a text's value f is the
weighted sum of its log counts at unit length. Ordered thresholds t_1 < ... < t_{K-1} turn it into
P(grade < k) = 1 / (1 + exp(f - t_k)), from which come the expected grade and the probability of
the top grade, by which documents are selected. Weights are the same at every threshold, so the
grades of a text are ordered like its value.

The fit uses a bounded sample: at most `SAMPLE` rated rows of each grade, of at most
`FIT_CHARS` characters, in order of a hash of the id; only their hashed counts reach the driver.
Scoring reads every word of every document, batch by batch, without a shuffle. Ids, language and
source are no inputs.

Null and empty texts have the value 0, that is the grade at the thresholds alone. A grade missing
in the sample gets a share of almost 0; without ratings all grades are equally likely. A document
rated more than once counts with its least grade; null grades are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import short_batches

BUCKETS = 1 << 16
SAMPLE = 3000
FIT_CHARS = 20_000
STEPS, RATE, RIDGE = 250, 0.3, 1e-4

_ascii = np.arange(256)
#: Printable ASCII other than letters, digits and the space.
SYMBOL = (_ascii > 32) & (_ascii < 127) & ~W.ALNUM[W.LOWER]


def counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket, value) of runs of texts; values have unit length per row."""
    for first, data, offsets in W.chunks(column):
        cells = []
        for inside, seed in ((W.ALNUM, 1), (SYMBOL, 2)):
            w = W.split_words(data, offsets, inside, lower=True)
            bucket = (W.mix(w.hash ^ np.uint64(seed)) & np.uint64(BUCKETS - 1)).astype(np.int64)
            cells.append(w.doc * BUCKETS + bucket)
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        row, bucket, rows = cell // BUCKETS, cell % BUCKETS, len(offsets) - 1
        value = np.log1p(n)
        length = np.sqrt(np.bincount(row, value**2, rows))
        yield first, rows, row, bucket, value / length[row]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, value: np.ndarray) -> np.ndarray:
        """(rows x K - 1) probabilities of a grade below 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(value[:, None] - self.thresholds[None, :], -50, 50)))

    def values(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, rows, row, bucket, value in counts(column):
            out[first : first + rows] = np.bincount(row, self.weights[bucket] * value, rows)
        return out


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> Model:
    """Gradient steps (Adam) on the log-likelihood; thresholds stay ordered as a first one and positive gaps."""
    n = len(grade)
    share = (np.cumsum(np.bincount(grade, minlength=grades)) + 0.5)[:-1] / (n + 1)
    t = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(BUCKETS), t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    if not n:
        return Model(np.zeros(BUCKETS), np.log(np.arange(1, grades) / (grades - np.arange(1, grades))))
    first, second = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(n)
    for i in range(1, STEPS + 1):
        gaps = np.exp(p[BUCKETS + 1 :])
        edges = np.concatenate([[-np.inf], p[BUCKETS] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        f = np.bincount(row, p[bucket] * value, n)
        cdf = 1 / (1 + np.exp(-np.clip(edges[None, :] - f[:, None], -50, 50)))
        cdf[:, 0], cdf[:, -1] = 0, 1
        slope = cdf * (1 - cdf)
        mass = np.maximum(cdf[at, grade + 1] - cdf[at, grade], 1e-12)
        df = (slope[at, grade + 1] - slope[at, grade]) / mass  # of minus the log-likelihood
        de = np.bincount(grade, slope[at, grade] / mass, grades)[1:] - np.bincount(grade, slope[at, grade + 1] / mass, grades)[:-1]
        g = np.zeros_like(p)
        g[:BUCKETS] = np.bincount(bucket, df[row] * value, BUCKETS) / n + RIDGE * p[:BUCKETS]
        g[BUCKETS] = de.sum() / n
        g[BUCKETS + 1 :] = np.cumsum(de[::-1])[::-1][1:] * gaps / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p = p - RATE * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    return Model(p[:BUCKETS], p[BUCKETS] + np.concatenate([[0], np.cumsum(np.exp(p[BUCKETS + 1 :]))]))


def train(docs: DataFrame, ratings: DataFrame, grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE) -> Model:
    """`ratings` has `key` and a grade from 0 to grades - 1."""
    known = ratings.where(F.col(key).isNotNull() & F.col(grade).between(0, grades - 1)).groupBy(key).agg(F.min(grade).cast("int").alias("_y"))
    picked = None
    for y in range(grades):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64(key), key).limit(2 * sample)
        picked = some if picked is None else picked.union(some)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows, row, bucket, value in counts(b.column(0)):
                n = np.bincount(row, minlength=rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(first, rows), W.lists(bucket.astype(np.int32), n, pa.int32()), W.lists(value.astype(np.float32), n, pa.float32())], names=["y", "b", "v"]
                )

    short_batches(docs.sparkSession)
    # Rows of two numbers, 2 * grades * sample at most.
    rated = docs.select(F.col(key), F.col(text).alias("_t")).join(F.broadcast(picked), key).where(F.length("_t").between(1, FIT_CHARS))
    b, v, y, n = [], [], [], []
    for k in range(grades):
        some = rated.where(F.col("_y") == k).orderBy(F.xxhash64(key), key, "_t").limit(sample).select("_t", "_y")
        got = some.mapInArrow(hashed, "y int, b array<int>, v array<float>").toArrow()
        for i in range(got.num_rows):
            b.append(got["b"][i].values.to_numpy())
            v.append(got["v"][i].values.to_numpy())
            y.append(got["y"][i].as_py())
            n.append(len(b[-1]))
    none = np.zeros(0, np.int64)
    return fit(np.repeat(np.arange(len(n)), n), np.concatenate([none, *b]), np.concatenate([none, *v]).astype(float), np.array(y, np.int64), grades)


def score(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = (), least: float = 0.5) -> DataFrame:
    """Adds value, expected_grade, top_probability and selected (top_probability >= least)."""
    add = {"value": "double", "expected_grade": "double", "top_probability": "double", "selected": "boolean"}
    keep = [c for c in docs.columns if c not in drop and c not in add]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{k} {v}" for k, v in add.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            value = model.values(col(text))
            below = model.below(value)
            top = 1 - below[:, -1]
            made = [value, (1 - below).sum(axis=1), top]
            yield pa.RecordBatch.from_arrays([*map(col, keep), *map(pa.array, made), pa.array(top >= least)], names=[*keep, *add])

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
