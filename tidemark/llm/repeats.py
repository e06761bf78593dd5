"""Repeated passages, by fixed-block anchors (operator 8).

A window of `WINDOW` words of one document that also starts in a document of a smaller id is
removed, word by word. Reference blocks are the non-overlapping runs of `BLOCK` words at
multiples of BLOCK; as 2 * BLOCK - 1 words always hold a whole block, so does every window.

1. Anchors. Every rolling run of BLOCK words of every document probes the blocks. Hashes are
   dealt to as many groups as the text needs, packed: 4 bytes of hash and 1-2 bytes of
   position for a word, documents as runs. A hash that is a block somewhere and found in two
   documents marks its positions. Of a hash that several documents of one chunk share, the chunk
   marks all positions itself and sends one, so neither copies nor a passage on a third of all
   pages fill a group. What a chunk has marked itself meets nothing and is dealt in turn.
2. Extension. Windows that hold a marked run are looked up as a whole: by 64-bit hash, the
   least document id of each is found, again packed, dealt out and first settled inside a chunk.
   Windows of other documents are to be removed; neighbouring ones make up the maximal repeats.
3. Cut. Documents with such windows meet their spans; all others are finished where they are read.

Texts are shuffled only for documents with marks or spans, told apart by a bit table of fixed
size. Windows are judged on the input, never on what is left. Words are runs of anything but
space and \\t to \\r. Null texts have no words; rows with a null id take no part and keep all
words. Rows with one id are one document to the rule (an id is not smaller than itself), and each
gets its own result. Two different windows count as equal if 64-bit hashes of them do.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.decontaminate import BITS, bit_table
from tidemark.llm.shared import short_batches, stage

WINDOW = 50
BLOCK = 25
#: Packed entries of a group, about.
GROUP = 500_000
#: Settled marks that go to one group together.
PIECE = 65_536

_PACKED = pa.schema(
    [("p", pa.int32()), ("done", pa.bool_()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("runs", pa.list_(pa.int32())), ("h", pa.binary()), ("at", pa.binary())]
)
_PACKED_SQL = "p int, done boolean, docs array<bigint>, keys array<bigint>, runs array<int>, h binary, at binary"
_MARKS_SQL = "_id bigint, _key bigint, at array<int>"


def planes(x: np.ndarray) -> bytes:
    """Small numbers byte by byte: the high bytes, mostly zero, stand together and compress away."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _pack(group: np.ndarray, done: bool, doc: np.ndarray, ids: np.ndarray, keys: np.ndarray, pos: np.ndarray, h: np.ndarray, kind: str) -> pa.RecordBatch | None:
    """A row for each group; entries come in order of document and position."""
    if not len(group):
        return None
    order = np.argsort(group, kind="stable")
    group, doc, pos, h = group[order], doc[order], pos[order], h[order].astype(kind)
    new_group = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    new_run = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])]))
    length = np.diff(np.append(new_run, len(doc)))
    gap = np.diff(pos, prepend=0)
    gap[new_run] = pos[new_run]
    of = doc[new_run]
    runs_of = np.diff(np.append(np.searchsorted(new_run, new_group), len(new_run)))
    ends = np.append(new_group[1:], len(doc))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(group[new_group].astype(np.int32)),
            pa.array(np.full(len(new_group), done)),
            W.lists(ids[of], runs_of, pa.int64()),
            W.lists(keys[of], runs_of, pa.int64()),
            W.lists(length.astype(np.int32), runs_of, pa.int32()),
            pa.array([h[a:b].tobytes() for a, b in zip(new_group, ends)], pa.binary()),
            pa.array([planes(gap[a:b]) for a, b in zip(new_group, ends)], pa.binary()),
        ],
        schema=_PACKED,
    )


def _unpack(t: pa.Table, kind: str) -> tuple[np.ndarray, ...]:
    """hash, document id, key, position of all entries of a group."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i in range(t.num_rows):
        length = t["runs"][i].values.to_numpy()
        gap = unplanes(t["at"][i].as_py())
        total = np.cumsum(gap)
        start = np.cumsum(length) - length
        before = np.where(start > 0, total[start - 1], 0)
        out[0].append(np.frombuffer(t["h"][i].as_py(), kind))
        out[1].append(np.repeat(t["docs"][i].values.to_numpy(), length))
        out[2].append(np.repeat(t["keys"][i].values.to_numpy(), length))
        out[3].append(total - np.repeat(before, length))
    if not out[0]:
        return np.zeros(0, kind), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in out)


def _marks(doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((at, key, doc))
    doc, key, at = doc[order], key[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(first, len(doc)))
    return pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64()), pa.array(key[first], pa.int64()), W.lists(at.astype(np.int32), lengths, pa.int32())], names=["_id", "_key", "at"])


def _equal(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, first entry of each hash, and group number of each entry in that order."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[W.Words, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch, int]]:
    """Words of runs of (_id, _t, ...) with ids, text keys and the first word of each document."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for row, data, offsets in W.chunks(batch.column(1)):
            words = W.split_words(data, offsets, W.NON_SPACE, lower=False)
            n = words.counts
            yield words, ids[row : row + len(n)], n, np.cumsum(n) - n, batch, row


def _in_turn(groups: int):
    """Groups for the settled marks of each chunk: piece by piece in turn, from a start of the task's own, never by content."""
    task = TaskContext.get()
    at = zlib.crc32(b"%d" % (task.partitionId() if task else 0))

    def deal(n: int) -> np.ndarray:
        nonlocal at
        group = (at + np.arange(n) // PIECE) % groups
        at += -(-n // PIECE)
        return group

    return deal


def _anchors(groups: int, window: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = _in_turn(groups)
        for words, ids, n, first, _, _ in _read(batches):
            at, g = W.ngrams(words, block)
            long = n[words.doc[at]] >= window
            at, g = at[long], g[long]
            if not len(g):
                continue
            doc = words.doc[at]
            pos = at - first[doc]
            block_here = pos % block == 0
            order, start, number = _equal(g)
            id_of = ids[doc[order]]
            shared = np.minimum.reduceat(id_of, start) != np.maximum.reduceat(id_of, start)
            any_block = np.maximum.reduceat(block_here[order].astype(np.uint8), start)
            mine = np.zeros(len(g), bool)
            mine[order] = shared[number]
            block_here[order[start[shared]]] = any_block[shared].astype(bool)
            send = ~mine
            send[order[start[shared]]] = True
            none = np.zeros(len(ids), np.int64)
            group = ((g >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
            low = (g & np.uint64(0xFFFFFFFE)) | block_here.astype(np.uint64)
            yield from filter(None, [_pack(group[send], False, doc[send], ids, none, pos[send], low[send], "<u4")])
            yield from filter(None, [_pack(deal(int(mine.sum())), True, doc[mine], ids, none, pos[mine], low[mine], "<u4")])

    return run


def _shared(kind: str, judge):
    """Marks of a group: those settled already and those that `judge(hash, id)` finds."""

    def run(t: pa.Table) -> pa.Table:
        done = t["done"].combine_chunks()
        _, doc0, key0, at0 = _unpack(t.filter(done), kind)
        h, doc, key, at = _unpack(t.filter(pc.invert(done)), kind)
        yes = judge(h, doc) if len(h) else np.zeros(0, bool)
        return pa.Table.from_batches([_marks(np.concatenate([doc0, doc[yes]]), np.concatenate([key0, key[yes]]), np.concatenate([at0, at[yes]]))])

    return run


def _anchored(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    order, start, number = _equal(h >> 1)
    block = np.maximum.reduceat((h & 1)[order], start) == 1
    d = doc[order]
    good = block & (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start))
    out = np.zeros(len(h), bool)
    out[order] = good[number]
    return out


def _later(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    order, start, number = _equal(h)
    least = np.minimum.reduceat(doc[order], start)
    out = np.zeros(len(h), bool)
    out[order] = doc[order] > least[number]
    return out


def _extend(groups: int, window: int, block: int):
    """(_id, _t, _key, marks) to packed hashes of the windows that hold a marked run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = _in_turn(groups)
        for words, ids, n, first, batch, row in _read(batches):
            marks = batch.column(3).slice(row, len(n))
            keys = batch.column(2).slice(row, len(n)).to_numpy()
            marked = np.zeros(len(words.hash) + window + 2, np.int64)
            size = np.asarray(marks.value_lengths().fill_null(0))
            pos = np.asarray(marks.flatten(), dtype=np.int64)
            inside = pos < np.repeat(n, size)  # marks of another text of the same id may not fit
            marked[(pos + np.repeat(first, size))[inside]] = 1
            before = np.concatenate([[0], np.cumsum(marked)])
            at, g = W.ngrams(words, window)
            hold = before[at + window - block + 1] > before[at]
            at, g = at[hold], g[hold]
            if not len(g):
                continue
            doc = words.doc[at]
            pos = at - first[doc]
            later = _later(g, ids[doc])
            group = (g % np.uint64(groups)).astype(np.int64)
            yield from filter(None, [_pack(group[~later], False, doc[~later], ids, keys, pos[~later], g[~later], "<u8")])
            yield from filter(None, [_pack(deal(int(later.sum())), True, doc[later], ids, keys, pos[later], g[later], "<u8")])

    return run


def _only(bits: bytes, wanted: bool):
    """Rows (_id, ..., h last) whose bit is as wanted; a null id has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits, np.uint8)
        for b in batches:
            slot = b.column(b.num_columns - 1).to_numpy() & (BITS - 1)
            set_here = ((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool) & np.asarray(b.column(0).is_valid())
            yield b.filter(pa.array(set_here == wanted))

    return run


def _cut(window: int, texts: bool):
    """(_id, _t, starts) to counts, digest and text of the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, starts in zip(b.column(1).to_pylist(), b.column(2)):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                if starts.is_valid and len(starts.values):
                    s = np.unique(starts.values.to_numpy())
                    np.add.at(gone, s, 1)
                    np.add.at(gone, np.minimum(s + window, len(words)), -1)
                    words = [w for w, c in zip(words, np.cumsum(gone)) if not c]
                kept = b" ".join(words)
                out[0].append(len(gone) - 1)
                out[1].append(len(gone) - 1 - len(words))
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(kept.decode() if texts and text is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))]], names=["_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """`key` (whole number), n_words, n_removed, kept_sha256 and, if `texts`, `kept`: the words left, joined by one space."""
    short_batches(docs.sparkSession)
    block = window // 2
    read = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t"))
    known = read.where(F.col("_id").isNotNull() & F.col("_t").isNotNull())
    chars = known.agg(F.sum(F.length("_t"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fewer groups would leave tasks idle
    groups = max(least, math.ceil(chars / 6 / GROUP))
    packed = known.mapInArrow(_anchors(groups, window, block), _PACKED_SQL)
    marks = stage(packed.groupBy("p").applyInArrow(_shared("<u4", _anchored), _MARKS_SQL), "marks")

    bit = lambda df: bit_table(df.select(F.xxhash64("_id").alias("h")))
    n = marks.agg(F.sum(F.size("at"))).first()[0] or 0
    of_doc = marks.groupBy(F.col("_id").alias("_of")).agg(F.flatten(F.collect_list("at")).alias("marks"))
    some = known.withColumn("h", F.xxhash64("_id")).mapInArrow(_only(bit(marks), True), "_id bigint, _t string, h bigint")
    some = some.join(of_doc, F.col("_id") == F.col("_of")).select("_id", "_t", F.xxhash64("_t").alias("_key"), "marks")
    packed = some.mapInArrow(_extend(max(least, math.ceil(n / GROUP)), window, block), _PACKED_SQL)
    spans = stage(packed.groupBy("p").applyInArrow(_shared("<u8", _later), _MARKS_SQL), "repeats")

    bits = bit(spans)
    of_doc = spans.groupBy(F.col("_id").alias("_of"), F.col("_key").alias("_as")).agg(F.flatten(F.collect_list("at")).alias("starts"))
    out = "_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    each = read.withColumn("starts", F.lit(None).cast("array<int>")).withColumn("h", F.xxhash64("_id"))
    kind = "_id bigint, _t string, starts array<int>, h bigint"
    whole = each.mapInArrow(_only(bits, False), kind).select("_id", "_t", "starts")
    cut = each.mapInArrow(_only(bits, True), kind).select("_id", "_t", F.xxhash64("_t").alias("_key"))
    cut = cut.join(of_doc, (F.col("_id") == F.col("_of")) & (F.col("_key") == F.col("_as")), "left").select("_id", "_t", "starts")
    done = whole.mapInArrow(_cut(window, texts), out).union(cut.mapInArrow(_cut(window, texts), out))
    return done.select(F.col("_id").alias(key), "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else []))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 49], ' ')) AS x FROM d, unnest(range(1, len(ws) - 48)) t(p)),
m AS (SELECT x, min(doc_id) AS least FROM w GROUP BY x HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM w JOIN m USING (x) WHERE doc_id > least),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, ws, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda w, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
