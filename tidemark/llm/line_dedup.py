"""Boilerplate lines, by their frequency relative to a site (operator 7).

For each host the share of its pages that hold a line is counted; lines above a share are
dropped. A page counts once for a line, however often it repeats there. Only 16-byte keys of
lines are shuffled, summed up before they move, so neither a host with a third of all pages nor
a line on all of them meets in one task. Texts never move: a host has at most
(mean distinct lines of a page) / ratio lines above the ratio, so its dropped keys fit an array,
and pages join one row per host. That small table is written first, hence broadcast only if its
size is known to fit; else the join is a shuffle that adaptive execution can split by pages.

Further columns pass through under any name, also those this module uses itself; only the text, n_lines and
n_dropped are replaced. Null and empty hosts are one site. Null texts stay null and have no lines. Lines of white space
shape the text and are never dropped. Repeated rows count as pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import line_key, stage

#: A line on more than this share of a host's pages is boilerplate ...
RATIO = 0.1
#: ... if it is on at least so many pages, since on a host of a few pages any line has a high share.
MIN_PAGES = 5


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_host, _keys: the keys of each host's boilerplate lines."""
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    pages = docs.groupBy(site.alias("_host")).agg(F.count(F.lit(1)).alias("_pages"))
    held = F.array_distinct(F.filter(lines_of(F.col(text)), lambda x: F.trim(F.translate(x, "\t\r\f\v", "    ")) != ""))
    counts = (
        docs.select(site.alias("_host"), F.explode(F.transform(held, line_key)).alias("_key"))
        .groupBy("_host", "_key")
        .agg(F.count(F.lit(1)).alias("_with"))
        .where(F.col("_with") >= min_pages)
    )
    return (
        counts.join(pages, "_host")
        .where(F.col("_with") > F.lit(ratio) * F.col("_pages"))
        .groupBy("_host")
        .agg(F.collect_list("_key").alias("_keys"))
    )


def _free(taken: list[str], *names: str) -> list[str]:
    """Each name, lengthened until no column has it."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        while n in low:
            n += "_"
        out.append(n)
    return out


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`docs` with boilerplate lines cut out of `text`, and n_lines and n_dropped added or replaced."""
    found = stage(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    site, keys, cut = _free(docs.columns, "_host", "_keys", "_kept")
    found = found.select(F.col("_host").alias(site), F.col("_keys").alias(keys))
    joined = docs.withColumn(site, F.coalesce(F.col(host).cast("string"), F.lit(""))).join(found, site, "left")
    lines = lines_of(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(keys), line_key(x)))
    joined = joined.withColumn(cut, F.when(F.col(keys).isNotNull(), kept))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_kept = F.when(F.col(cut).isNull(), n_lines).otherwise(F.size(cut)).cast("long")
    out = {c: F.col(c) for c in docs.columns}
    out |= {"n_lines": n_lines, "n_dropped": n_lines - n_kept}
    out[text] = F.when(F.col(cut).isNull() | (n_kept == n_lines), F.col(text)).otherwise(F.array_join(cut, "\n"))
    return joined.select(*[v.alias(k) for k, v in out.items()])


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM d),
b AS (SELECT l.host, line FROM l JOIN p ON l.host = p.host WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
      GROUP BY l.host, line, pages HAVING count(*) >= {MIN_PAGES} AND count(*)::DOUBLE > {RATIO}::DOUBLE * pages),
x AS (SELECT doc_id, text, lines, coalesce(list_filter(lines, lambda x: NOT list_contains(coalesce(drop_lines, []), x)), []) AS kept
      FROM d LEFT JOIN (SELECT host, list(line) AS drop_lines FROM b GROUP BY host) USING (host))
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - len(kept))::BIGINT AS n_dropped,
       CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM x
"""
