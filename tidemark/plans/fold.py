"""Ordered state machines that windows cannot express.

A fold is serial inside a series, so a naive grouped map would send a whole series to
one task. Here every chunk is folded on its own from an assumed start state. Where the
chunk before ends in another state than assumed, the chunk is folded again from that
state; rounds repeat until all start states agree with their predecessor's end. Chunk 0
is right at once, and a machine that is flat between trades settles after a round or two.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.plans.series import SERIES, chunk_rows
from tidemark.session import stage

# fold(columns by name as lists, state as a list of floats) -> (weights, end state)
Fold = Callable[[dict[str, list], list[float]], tuple[list[float], list[float]]]


def keyed_fold(
    df: DataFrame,
    fold: Fold,
    inputs: list[str],
    initial: list[float],
    keys=SERIES,
    name: str = "weight",
    rows: int | None = None,
) -> DataFrame:
    """Add `name` computed by `fold` over each series in `ord` order."""
    keys = list(keys)
    k = len(initial)
    starts = [f"_s{i}" for i in range(k)]
    stops = [f"_z{i}" for i in range(k)]
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    lean = df.select(*keys, "ord", F.floor(F.col("ord") / F.lit(chunk_rows(rows))).alias("_chunk"), *inputs)

    def run(pdf: pd.DataFrame):
        pdf = pdf.sort_values("ord")
        state = [float(v) for v in pdf[starts].iloc[0]]
        return pdf, state, *fold({c: pdf[c].tolist() for c in inputs}, list(state))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, _, stop = run(pdf)
        row = {**{c: pdf[c].iloc[0] for c in keys}, "_chunk": pdf["_chunk"].iloc[0]}
        return pd.DataFrame([{**row, **dict(zip(starts, state)), **dict(zip(stops, stop))}])

    def weights(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, values, _ = run(pdf)
        return pdf[[*keys, "ord"]].assign(**{name: values})

    zero = {s: F.lit(float(v)) for s, v in zip(starts, initial)}
    start_of = lean.withColumns(zero)
    # Plain number of chunks; decides whether states have to travel at all.
    last = lean.agg(F.max("_chunk")).first()[0] or 0
    if last > 0:
        lean = stage(lean, "fold-rows")
        schema = f"{key_types}, _chunk bigint, " + ", ".join(f"{c} double" for c in (*starts, *stops))
        known = stage(lean.withColumns(zero).groupBy(*keys, "_chunk").applyInPandas(ends, schema), "fold-states")
        before = W.partitionBy(*keys).orderBy("_chunk")
        while True:
            linked = known.withColumns(
                {f"_w{i}": F.coalesce(F.lag(stops[i]).over(before), F.lit(float(initial[i]))) for i in range(k)}
            )
            differs = F.lit(False)
            for i in range(k):
                differs = differs | (F.col(f"_w{i}") != F.col(starts[i]))
            wrong = stage(
                linked.filter(differs).select(*keys, "_chunk", *[F.col(f"_w{i}").alias(starts[i]) for i in range(k)]),
                "fold-wrong",
            )
            if wrong.isEmpty():
                break
            again = lean.join(wrong, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(ends, schema)
            known = stage(known.join(wrong, [*keys, "_chunk"], "left_anti").unionByName(again), "fold-states")
        start_of = lean.join(known.select(*keys, "_chunk", *starts), [*keys, "_chunk"])
    out = start_of.groupBy(*keys, "_chunk").applyInPandas(weights, f"{key_types}, ord bigint, {name} double")
    return df.join(out, [*keys, "ord"])
