"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage

#: Rounds grow with the logarithm of the longest path; this many would do for any real table.
ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (its component's least node) for all nodes but roots themselves.

    Each round hangs every node's neighbours on its least neighbour, first the larger ones, then
    the smaller ones, and is written to the shared folder. Edges stay (larger, smaller), and
    distinct, so their number never grows. Least neighbours are written before they are joined,
    so that the join stands on plain shuffles and a hub's edges can be split.
    """
    x, y = F.col(a), F.col(b)
    e = stage(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    last = None
    for _ in range(ROUNDS):
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == last or not mark["n"]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        least = stage(both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("w")).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        low = stage(large.groupBy(F.col("a").alias("w")).agg(F.min("b").alias("m")), "least")
        small = large.join(low, F.col("a") == F.col("w"))
        small = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("w").alias("a"), F.col("m").alias("b")))
        e = stage(small.distinct(), "small-star")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
