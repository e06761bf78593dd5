"""Random numbers that depend only on their coordinates.

They do not change with partitioning, retries or engine, unlike a seeded generator.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *coords) -> Column:
    """Number in [0, 1) from the first 32 bits of an MD5 of seed, stream and coordinates."""
    parts = [F.lit(str(seed)), F.lit(stream), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in coords]]
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / float(2**32)


@lru_cache(maxsize=16)
def _uniform_rows(seed: int, prefix: str, rows: int, width: int) -> np.ndarray:
    md5, head = hashlib.md5, f"{seed}|{prefix}|"
    raw = b"".join(md5(f"{head}{i}|{k}".encode()).digest()[:4] for i in range(rows) for k in range(width))
    return np.frombuffer(raw, ">u4").reshape(rows, width).astype(np.uint32)


def uniform_rows(seed: int, stream: str, rows: int, width: int, *coords) -> np.ndarray:
    """(rows x width) numbers of `uniform(seed, stream, *coords, row, column)`, remembered by the worker process."""
    upto = -(-width // 256) * 256
    return _uniform_rows(seed, "|".join([stream, *map(str, coords)]), rows, upto)[:, :width] / 2.0**32
