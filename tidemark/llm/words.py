"""Words, rolling hashes and sliding minima of Arrow text batches, in NumPy.

A batch is taken as one byte buffer: word edges come from a byte mask and hashes from prefix
sums of a polynomial modulo 2**64 with random byte values, so nothing is done per word in
Python. Word lists never cross a document's edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_ascii = np.arange(256)
LOWER = np.where((_ascii >= 65) & (_ascii <= 90), _ascii + 32, _ascii).astype(np.uint8)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` on lower-cased bytes: digits, a-z and all of UTF-8 beyond ASCII.
ALNUM = ((_ascii >= 48) & (_ascii <= 57)) | ((_ascii >= 97) & (_ascii <= 122)) | (_ascii >= 128)
#: `[^\x20\x09-\x0D]`
NON_SPACE = ~((_ascii == 32) | ((_ascii >= 9) & (_ascii <= 13)))

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        for small in [k for k in _powers if k < size]:
            del _powers[small]
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        both = []
        for b in (BASE, inverse):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of documents: byte span in `data`, document index and hash of each."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j]))


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool) -> Words:
    if lower:
        data = LOWER[data]
    is_word = inside[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none, np.zeros(0, np.uint64))
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(is_word & ~after) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=total[1:])
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, start, end, doc, mix((total[end] - total[start]) * down[start]))


def ngrams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all runs of k words inside one document."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hash * up[:n], out=total[1:])
    at = np.flatnonzero(words.doc[k - 1 :] == words.doc[: n - k + 1])
    return at, mix((total[at + k] - total[at]) * down[at])


def sliding_argmin(values: np.ndarray, window: int) -> np.ndarray:
    """Index of the last least value in every full window, by doubling."""
    n = len(values)
    if n < window:
        return np.zeros(0, np.int64)
    best, width = np.arange(n), 1
    while width < window:
        step = min(width, window - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] <= values[left], right, left)
        width += step
    return best


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
