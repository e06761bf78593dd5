"""Recursive exponential averages as window expressions.

y[0] = x[0], y[t] = a*x[t] + (1-a)*y[t-1]. Windows cannot recurse, but within a block of
B rows the recursion is a weighted running sum, and a value from two blocks ago has
weight below 1e-12 * 1e-12 relative to it. So y = local sum + carry of the two blocks
before. The memory of the average is finite in double precision, which makes it a
bounded frame (`ewm_reach`) that `on_chunks` can evaluate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.plans.series import Chunk

BLOCK_DECAY = 1e12
MEMORY = 1e-17


def span_alpha(n: int) -> float:
    return 2.0 / (n + 1.0)


def wilder_alpha(n: int) -> float:
    return 1.0 / n


def ewm_reach(alpha: float, n: int = 0) -> int:
    """Rows after which an old value no longer moves the average."""
    if alpha >= 1.0:
        return max(n, 1)
    return max(n, math.ceil(math.log(MEMORY) / math.log(1.0 - alpha)))


def ewm(df: DataFrame, c: Chunk, specs: dict[str, tuple]) -> DataFrame:
    """Add one column per spec `name -> (value column, alpha, min_periods)`.

    The value must be non-null from its first non-null row on. Results are null until
    `min_periods` values were seen. Averages of one alpha share their windows, so it pays
    to ask for them together.
    """
    first = lambda n: F.col(f"_f_{n}")
    value = lambda n: F.col(f"_e_{n}")
    df = df.withColumns({f"_e_{n}": F.col(s[0]) if isinstance(s[0], str) else s[0] for n, s in specs.items()})
    df = df.withColumns({f"_f_{n}": F.min(F.when(value(n).isNotNull(), F.col("ord"))).over(c.whole) for n in specs})
    ready = {n: value(n).isNotNull() & (F.col("ord") - first(n) + 1 >= s[2]) for n, s in specs.items()}
    helpers = [f"_{t}_{n}" for n in specs for t in "efxyz"]
    for alpha in dict.fromkeys(s[1] for s in specs.values()):
        names = [n for n, s in specs.items() if s[1] == alpha]
        if alpha >= 1.0:
            df = df.withColumns({n: F.when(ready[n], value(n)) for n in names})
            continue
        q = 1.0 - alpha
        block = max(1, math.floor(math.log(BLOCK_DECAY) / -math.log(q)))
        df = df.withColumn("_blk", F.floor(F.col("ord") / F.lit(block)))
        j = F.pmod(F.col("ord"), F.lit(block)).cast("double")
        inside = W.partitionBy(*c.part, "_blk").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
        ordered = W.partitionBy(*c.part).orderBy("_blk", "ord")
        one_back = ordered.rowsBetween(W.unboundedPreceding, -1)
        two_back = ordered.rowsBetween(W.unboundedPreceding, -block - 1)
        local = {}
        for n in names:
            term = F.when(F.col("ord") == first(n), value(n)).otherwise(F.lit(alpha) * value(n))
            local[f"_x_{n}"] = F.pow(F.lit(q), j) * F.sum(F.coalesce(term, F.lit(0.0)) * F.pow(F.lit(q), -j)).over(inside)
        df = df.withColumns(local)
        # Block ends lie `block` rows apart, so the end before the last one needs no nesting.
        ends = {n: F.when(j == F.lit(float(block - 1)), F.col(f"_x_{n}")) for n in names}
        df = df.withColumns(
            {f"_{t}_{n}": F.last(ends[n], True).over(w) for n in names for t, w in (("y", one_back), ("z", two_back))}
        )
        carry = lambda n: F.coalesce(F.col(f"_y_{n}"), F.lit(0.0)) + F.lit(q**block) * F.coalesce(F.col(f"_z_{n}"), F.lit(0.0))
        df = df.withColumns(
            {n: F.when(ready[n], F.col(f"_x_{n}") + carry(n) * F.pow(F.lit(q), j + 1)) for n in names}
        ).drop("_blk")
    return df.drop(*helpers)
