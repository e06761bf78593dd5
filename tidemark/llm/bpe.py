"""Byte-level BPE with the tokenizers library (operator 9).

Texts come in Arrow batches. The pattern cuts a text into pieces, which the library's model
merges independently; their ids are kept in bounded tables, since pieces repeat far more often
than texts do. The library sees bytes as printable characters; decoding goes back through that
mapping to raw bytes, so ids that end inside a character lose nothing: `decode` returns bytes,
and the text with broken characters replaced, while `Stream` holds back the bytes of an
unfinished character.

Each row is on its own: no shuffle, no state between rows. Null and empty texts have no tokens.
Special tokens in a text are plain text.
"""

from __future__ import annotations

import codecs
import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import short_batches

#: Words, and pieces, whose ids a worker remembers.
KEPT = 150_000
#: Patterns under which a single space between two characters that are no white space starts a piece.
CUT_AT_SPACES = {public_tokenizers.PATTERN}
_loaded: dict[tuple[str, str], "Coder"] = {}


def byte_characters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for
    themselves, the others for the characters from U+0100 on."""
    plain = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def pack(tokens: list) -> bytes:
    return array("I", [t.id for t in tokens]).tobytes()


class Coder:
    def __init__(self, vocabulary: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary)
        self.merge = library.model.tokenize
        self.pieces = regex.compile(pattern).findall
        self.cut_at_spaces = pattern in CUT_AT_SPACES
        known, back = library.get_vocab(with_added_tokens=True), byte_characters()
        self.printable = {b: c for c, b in back.items()}
        self.bytes_of = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {}

    @classmethod
    def get(cls, vocabulary: str, pattern: str) -> "Coder":
        """One per worker process."""
        if (vocabulary, pattern) not in _loaded:
            _loaded[vocabulary, pattern] = cls(vocabulary, pattern)
        return _loaded[vocabulary, pattern]

    def _of_pieces(self, text: str) -> bytes:
        out = []
        for p in self.pieces(text):
            ids = self.known_pieces.get(p)
            if ids is None:
                if p.isascii() and p.isprintable():
                    printable = p.replace(" ", self.printable[32])
                else:
                    printable = p.encode().decode("latin-1").translate(self.printable)
                ids = pack(self.merge(printable))
                if len(self.known_pieces) >= KEPT:
                    self.known_pieces = {}
                self.known_pieces[p] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Where the pattern starts a piece at each single space between two other characters that
        are no white space (`CUT_AT_SPACES`), what lies between such spaces is encoded, and
        remembered, on its own. Texts with any other white space next to a space, and all texts
        under other patterns, are cut by the pattern as a whole.
        """
        if not text:
            return b""
        if not self.cut_at_spaces:
            return self._of_pieces(text)
        first, *rest = text.split(" ")
        if not first or not first[-1:].strip():
            return self._of_pieces(text)
        known, own = self.known, {}
        for w in set(rest).difference(known):
            ids = self.older.get(w)
            if ids is None:
                if not w or w != w.strip():
                    return self._of_pieces(text)
                ids = self._of_pieces(" " + w)
            own[w] = ids
        if len(known) + len(own) > KEPT:  # words not met since the last time are forgotten
            self.older, self.known = known, {}
            for w in set(rest).intersection(known):
                own[w] = known[w]
            known = self.known
        known.update(own)
        return self._of_pieces(first) + b"".join(map(known.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """First byte of each token."""
        lengths = np.array([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4")], np.int64)
        return np.cumsum(lengths) - lengths


class Stream:
    """Decodes ids piece by piece; bytes of a character whose rest is still to come are held back."""

    def __init__(self, coder: Coder):
        self.coder, self.rest = coder, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], final: bool = False) -> str:
        return self.rest.decode(self.coder.decode(np.array(ids, "<u4").tobytes()), final)


def _with(df: DataFrame, add: dict[str, str], drop: tuple[str, ...], make) -> DataFrame:
    """`df` without `drop` and the columns of the same name, plus those that `make(batch)` returns."""
    keep = [c for c in df.columns if c not in drop and c not in add]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{k}` {v}" for k, v in add.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make(b)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + made, names=[*keep, *add])

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds `ids` (array of int) and `offsets` (first byte of each token)."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        coder = Coder.get(vocabulary, pattern)
        ids = [coder.encode(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
        return [
            pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())),
            pa.array([coder.offsets(i) for i in ids], pa.list_(pa.int64())),
        ]

    return _with(df, {"ids": "array<int>", "offsets": "array<bigint>"}, drop, make)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` (binary) and `decoded_text` from an array of ids."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        coder = Coder.get(vocabulary, pattern)
        raw = [coder.decode(np.array(i or [], "<u4").tobytes()) for i in b.column(b.schema.get_field_index(ids)).to_pylist()]
        return [pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())]

    return _with(df, {"decoded": "binary", "decoded_text": "string"}, (), make)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, then decode the ids: n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids instead of the text."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        coder = Coder.get(vocabulary, pattern)
        ids = [coder.encode(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
        return [
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
            pa.array([hashlib.sha256(coder.decode(i)).hexdigest() for i in ids], pa.string()),
        ] + [pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32()))] * with_ids

    add = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {})
    return _with(df, add, (text,), make)
