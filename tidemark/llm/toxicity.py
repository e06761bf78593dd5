"""Toxicity by compression distance (operator 10).

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A document is cut
into windows (lower-cased words of letters and digits); each window is compressed with both, and
its advantage is the number of bytes that the toxic dictionary saves over the ordinary one. A
document's features are how many windows reach each of several thresholds, and its largest
advantages; a logistic model calibrated on the sample turns them into a score.

Toxic documents are mostly ordinary text, so the toxic dictionary learns from the windows that
set them apart: those with a run of a few bytes (`GRAMS`) found in far more toxic than ordinary
documents of the sample. Dictionary matches then also cover unseen words with such a run.

The fit uses a bounded sample: at most `SAMPLE` labelled rows of each class, of at most
`FIT_CHARS` characters, taken in order of a hash of the id; it is the only data that reaches the
driver. Scoring covers every word of every document, one Arrow batch at a time, without a
shuffle; windows met lately are remembered in a bounded table. Labels, language, source and id
are no inputs of a score.

Null and empty texts have no windows and get the score of a text without any hit. If the sample
lacks a class, the score is the share of toxic rows in it (0 without labels). A label given twice
counts as toxic if either is; null labels are ignored. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.shared import short_batches

SAMPLE = 3000
FIT_CHARS = 20_000
#: Bytes of the runs looked at; a word's edges are spaces.
GRAMS = (5, 7, 9)
#: A run sets toxic text apart if it is in this share of toxic documents and so many times the share of ordinary ones.
LEAST_SHARE, LEAST_RATIO = 0.01, 8.0
TOXIC_BYTES, ORDINARY_BYTES = 16 << 10, 64 << 10
#: Counters that tell rare runs; 16 MB.
SLOTS = 1 << 22
#: Words of the sample that the ordinary dictionary is trained on.
ORDINARY_WORDS = 400_000
#: Bytes saved that count as a hit, from weak to strong.
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
#: Both dictionaries end with this, and every window stands between its halves: a few bytes alone
#: would be stored as they are, and zstandard starts no match in the last eight.
CARRIER = bytes(range(128, 192))
#: Windows whose advantage a worker remembers.
KEPT = 150_000


#: Lower case for A-Z; other ASCII but digits and letters parts words.
TABLE = np.where(W.ALNUM[W.LOWER], W.LOWER, 32).astype(np.uint8).tobytes()


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def windows(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TABLE).split()


def _dictionary(words: list[bytes], size: int) -> bytes:
    """Trained on lines of eight words; segments of 24 bytes are weighed by their runs of six."""
    lines = [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]
    try:
        return zstandard.train_dictionary(size, lines, k=24, d=6).as_bytes()
    except zstandard.ZstdError:  # too few lines to train on: they are the dictionary
        return b"".join(lines)[-size:]


def _coder(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content + CARRIER)
    how = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=16, hash_log=16, search_log=5, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how)


def _sizes(coder: zstandard.ZstdCompressor, body: list[bytes]) -> np.ndarray:
    return np.array([len(coder.compress(CARRIER[:32] + b + CARRIER[32:])) for b in body])


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    constant: float | None = None

    def __post_init__(self) -> None:
        self._coders = None
        self._known: dict[bytes, int] = {}
        self._older: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return {"toxic": self.toxic, "ordinary": self.ordinary, "weights": self.weights, "constant": self.constant}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def advantages(self, words: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window; negative if the ordinary one is better."""
        if self._coders is None:
            self._coders = (_coder(self.ordinary), _coder(self.toxic))
        some = set(words)
        own = {}
        new = []
        for w in some.difference(self._known):
            if (a := self._older.get(w)) is None:
                new.append(w)
            else:
                own[w] = a
        if new:
            body = [b" " + w + b" " for w in new]
            own.update(zip(new, (_sizes(self._coders[0], body) - _sizes(self._coders[1], body)).tolist()))
        if len(self._known) + len(own) > KEPT:
            own.update((w, self._known[w]) for w in some.intersection(self._known))
            self._older, self._known = self._known, {}
        self._known.update(own)
        return np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))

    def features(self, text: str | None) -> np.ndarray:
        words = windows(text or "")
        a = self.advantages(words) if words else np.zeros(0, np.int64)
        top = np.sort(a[a > 0])[::-1][:3]
        return np.concatenate([np.log1p([(a >= t).sum() for t in THRESHOLDS]), np.pad(top, (0, 3 - len(top))) / 4.0, [np.log1p(len(words)) / 5, 1.0]])

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ np.array(self.weights), -30, 30))))


def _grams(word: bytes) -> set[bytes]:
    x = b" " + word + b" "
    return {x[i : i + n] for n in GRAMS for i in range(len(x) - n + 1)}


def _likeness(words: set[bytes]) -> tuple:
    """Three MinHash values, equal for most copies of a text: copies are counted as one text."""
    h = np.array([crc32(w) for w in words], np.uint64)
    return tuple(int((h * a & np.uint64(0xFFFFFFFF)).min()) for a in (np.uint64(2654435761), np.uint64(2246822519), np.uint64(3266489917))) if len(h) else ()


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Dictionaries and calibration from labelled texts."""
    n = (toxic.count(0), toxic.count(1))
    if not n[0] or not n[1]:
        return Model(b"", b"", (), n[1] / max(1, sum(n)))
    groups: tuple[dict, dict] = ({}, {})
    one: dict[bytes, bytes] = {}
    for text, y in zip(texts, toxic):
        words = {one.setdefault(w, w) for w in windows(text)}
        groups[y].setdefault(_likeness(words), set()).update(words)
    m = tuple(map(len, groups))
    least = max(3, LEAST_SHARE * m[1])
    slots, often, rarely = np.zeros(SLOTS, np.int32), Counter(), Counter()
    for words in groups[1].values():  # most runs are rare: their slots tell so, and they are not counted one by one
        slots[np.unique(np.array([crc32(g) % SLOTS for w in words for g in _grams(w)], np.int64))] += 1
    for words in groups[1].values():
        often.update({g for w in words for g in _grams(w) if slots[crc32(g) % SLOTS] >= least})
    often = {g: a for g, a in often.items() if a >= least}
    for words in groups[0].values():
        rarely.update(set().union(*map(_grams, words)).intersection(often))
    apart = {g for g, a in often.items() if (a + 0.5) / (m[1] + 1) >= LEAST_RATIO * (rarely[g] + 0.5) / (m[0] + 1)}
    parts: tuple[list[bytes], list[bytes]] = ([], [])
    for text, y in zip(texts, toxic):
        if y or len(parts[0]) < ORDINARY_WORDS:
            parts[y].extend(w for w in windows(text) if not y or not apart.isdisjoint(_grams(w)))
    model = Model(_dictionary(parts[1], TOXIC_BYTES), _dictionary(parts[0], ORDINARY_BYTES), ())
    x, y = np.array([model.features(t) for t in texts]), np.array(toxic, float)
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
    for _ in range(50):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple(beta.tolist())
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled documents outside the held-out fold."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_y")).where(~held_out(F.col(key)))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64(key), key).limit(2 * sample)
        picked = some if picked is None else picked.union(some)
    # Four times `sample` rows of two numbers.
    rows = docs.select(F.col(key), F.col(text).alias("_t")).join(F.broadcast(picked), key).where(F.length("_t").between(1, FIT_CHARS))
    got: list = []
    for y in (0, 1):
        got += rows.where(F.col("_y") == y).orderBy(F.xxhash64(key), key, "_t").limit(sample).select("_t", "_y").collect()
    return fit([r["_t"] for r in got], [int(r["_y"]) for r in got])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `score` added or replaced."""
    keep = [c for c in docs.columns if c != "score"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(b.schema.get_field_index(c)) for c in keep}
            scores = [model.score(t) for t in cols[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(scores, pa.float64())], names=[*keep, "score"])

    short_batches(docs.sparkSession)
    return docs.select(*keep).mapInArrow(run, schema)
