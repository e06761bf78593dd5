"""Secret scan: fixed patterns, and sliding-window entropy per character class (operator 3).

Base spans are the leftmost matches of three patterns. Besides, candidate strings are cut out of
the text for each character class (hexadecimal, alphanumeric, base64), and a window of `WINDOW`
characters slides over each. With c(x) the count of character x in the window, its Shannon
entropy is log2(W) - sum(c log2 c) / W, and the sum changes by one term for the character that
enters and one for the character that leaves; the two counts come from range frames over the
positions of the same character, so a step costs the same at any window size. Windows above the
class's threshold mark the candidate, which is reported from the first to the last such window.
Terms are whole millionths, so sums are exact in any order. Candidates on the allow list are
suppressed: shapes (`ALLOW`) that are random-looking but public, and known strings.

All work is built-in expressions and windows. Only characters of candidates are shuffled, keyed
by document and candidate start, so a frame holds one candidate and no source or document can
fill a task. Texts stay where they are read; spans return to them as one small row per document.

Positions are code points, ends exclusive. Null texts are empty. A document without any span
returns zero counts, the digest of the empty string and an empty span list. Rows that share an
id are told apart by their text; equal rows get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import stage

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Kind, pattern, least characters, group whose length counts.
BASE = (("assign", ASSIGN, 8, 2), ("access", ACCESS, 16, 0), ("hex", HEX, 32, 0))

WINDOW = 20
#: Class, its characters, least entropy in bits of a window of 20.
CLASSES = (("entropy_hex", "[0-9a-f]", 3.0), ("entropy_alnum", "[A-Za-z0-9]", 3.9), ("entropy_base64", "[A-Za-z0-9+/=_-]", 4.0))
#: A candidate has digits and letters in it; plain words and plain numbers are not secrets.
MIXED = "(?=.*[0-9])(?=.*[A-Za-z])"
#: Public shapes: UUIDs, dates in paths, version strings, data-URI heads, alphabets.
ALLOW = (
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "^[A-Za-z_/-]*[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[A-Za-z_/-]*$",
    "EXAMPLE|example",
    "abcdefghij|ABCDEFGHIJ|0123456789",
)
UNIT = 1_000_000
TERMS = [round(UNIT * n * math.log2(n)) if n else 0 for n in range(WINDOW + 1)]


def patterns() -> dict[str, str]:
    """Column name to pattern of every search. Runs of one class are maximal, so those too short are left out by the pattern."""
    least = {"access": ACCESS[:-1] + "{12,}", "hex": HEX[:-1] + "{32,}"}
    return {f"_{kind}": least.get(kind, p) for kind, p, _, _ in BASE} | {f"_{name}": f"{chars}{{{WINDOW},}}" for name, chars, _ in CLASSES}


def placed(text: Column, found: Column, pattern: str) -> Column:
    """Array of (at, s) of the matches `found`: the pieces between them give the positions."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,s:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["end"] + x["gap"]
        return F.struct((at + F.length(x["s"])).alias("end"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), x["s"].alias("s")))).alias("out"))

    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.filter(F.zip_with(found, gaps, lambda s, g: F.struct(s.alias("s"), g.alias("gap"))), lambda x: x["s"].isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(start["out"])


def _base(rank: int, kind: str, pattern: str, least: int, group: int) -> Column:
    length = lambda s: F.length(F.regexp_extract(s, pattern, group)) if group else F.length(s)
    span = lambda m: F.struct(m["at"].alias("s"), F.lit(rank).alias("r"), F.lit(kind).alias("kind"), (m["at"] + F.length(m["s"])).alias("e"))
    return F.transform(F.filter(F.col(f"_{kind}"), lambda m: length(m["s"]) >= least), span)


def base_spans() -> Column:
    """Array of (s, r, kind, e) from the placed matches."""
    return F.sort_array(F.concat(*[_base(rank, *x) for rank, x in enumerate(BASE)]))


def candidates(allow: tuple[str, ...] = ALLOW, known: tuple[str, ...] = ()) -> Column:
    """Array of (c, at, s): class number, start and string of what is to be measured."""

    def fits(m: Column) -> Column:
        c = F.rlike(m["s"], F.lit(MIXED))
        if allow:
            c = c & ~F.rlike(m["s"], F.lit("|".join(allow)))
        return c & ~m["s"].isin(*known) if known else c

    tagged = lambda c: lambda m: F.struct(F.lit(c).alias("c"), m["at"].alias("at"), m["s"].alias("s"))
    return F.concat(*[F.transform(F.filter(F.col(f"_{name}"), fits), tagged(c)) for c, (name, _, _) in enumerate(CLASSES)])


def entropy_spans(found: DataFrame) -> DataFrame:
    """From rows (_id, _key, c, at, s) to (_id, _key, c, s, e) of candidates with a window above the threshold."""
    chars = found.select("_id", "_key", "c", "at", F.posexplode(F.split("s", "")).alias("p", "x")).where(F.col("x") != "")
    mine = ["_id", "_key", "c", "at"]
    same = Window.partitionBy(*mine, "x").orderBy("p")
    term = F.array(*[F.lit(t).cast("long") for t in TERMS])
    n_in = F.count(F.lit(1)).over(same.rangeBetween(-(WINDOW - 1), 0))
    n_out = F.count(F.lit(1)).over(same.rangeBetween(0, WINDOW - 1))
    counted = chars.withColumn("n_in", n_in.cast("int")).withColumn("n_out", n_out.cast("int"))
    grown = F.get(term, F.col("n_in")) - F.get(term, F.col("n_in") - 1)
    shrunk = F.get(term, F.col("n_out") - 1) - F.get(term, F.col("n_out"))
    order = Window.partitionBy(*mine).orderBy("p")
    # The character WINDOW places back leaves before the next one enters; both counts see the same WINDOW - 1 others.
    steps = counted.withColumn("step", grown + F.coalesce(F.lag(shrunk, WINDOW).over(order), F.lit(0)))
    total = steps.withColumn("total", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    limit = F.get(F.array(*[F.lit(math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT)).cast("long") for _, _, bits in CLASSES]), F.col("c"))
    high = total.where((F.col("p") >= WINDOW - 1) & (F.col("total") <= limit))
    return high.groupBy(*mine).agg((F.min("p") - (WINDOW - 1)).alias("from"), (F.max("p") + 1).alias("to")).select(
        "_id", "_key", "c", (F.col("at") + F.col("from")).cast("int").alias("s"), (F.col("at") + F.col("to")).cast("int").alias("e")
    )


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", allow: tuple[str, ...] = ALLOW, known: tuple[str, ...] = ()) -> DataFrame:
    """`key`, base and entropy (arrays of s, r, kind, e in order of start and kind) per document."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(key).alias("_id"), F.xxhash64(body).alias("_key"), body.alias("_t"))
    found = found.withColumns({c: F.regexp_extract_all("_t", F.lit(p), F.lit(0)) for c, p in patterns().items()})
    found = found.withColumns({c: placed(F.col("_t"), F.col(c), p) for c, p in patterns().items()})
    read = stage(found.select("_id", "_key", base_spans().alias("base"), candidates(allow, known).alias("found")), "secrets")
    high = entropy_spans(read.where(F.size("found") > 0).select("_id", "_key", F.explode("found").alias("f")).select("_id", "_key", "f.*").distinct())
    name = F.get(F.array(*[F.lit(n) for n, _, _ in CLASSES]), F.col("c"))
    high = high.groupBy(F.col("_id").alias("_of"), F.col("_key").alias("_as")).agg(
        F.sort_array(F.collect_list(F.struct("s", (F.col("c") + len(BASE)).alias("r"), name.alias("kind"), "e"))).alias("entropy")
    )
    none = F.array().cast("array<struct<s:int,r:int,kind:string,e:int>>")
    return read.join(high, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_as")), "left").select(
        F.col("_id").alias(key), "base", F.coalesce("entropy", none).alias("entropy")
    )


def _sql_matches(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_extract_all(t, '{quoted}') AS m, list_transform(string_split_regex(t, '{quoted}'), lambda x: len(x)) AS g"


def _sql_positions(source: str, select: str) -> str:
    """All matches of `source` (doc_id, m, g) with their start."""
    return f"SELECT doc_id, {select}, (list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))::BIGINT AS a0, m[i] AS s FROM {source}, unnest(range(1, len(m) + 1)) u(i)"


def oracle() -> str:
    ctes, base, cand = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"], [], []
    for rank, (kind, pattern, least, group) in enumerate(BASE):
        ctes.append(f"m{rank} AS (SELECT doc_id, {_sql_matches(pattern)} FROM d)")
        quoted = pattern.replace("'", "''")
        size = f"len(regexp_extract(s, '{quoted}', {group}))" if group else "len(s)"
        base.append(f"SELECT * FROM ({_sql_positions(f'm{rank}', f"{rank} AS r, '{kind}' AS kind")}) WHERE {size} >= {least}")
    for c, (_, chars, _) in enumerate(CLASSES):
        ctes.append(f"c{c} AS (SELECT doc_id, {_sql_matches(f'{chars}{{{WINDOW},}}')} FROM d)")
        cand.append(_sql_positions(f"c{c}", f"{c} AS c"))
    allow = "|".join(ALLOW).replace("'", "''")
    terms = "([" + ", ".join(map(str, TERMS)) + "]::BIGINT[])"
    names = "([" + ", ".join(f"'{n}'" for n, _, _ in CLASSES) + "])"
    limits = "([" + ", ".join(str(math.floor((math.log2(WINDOW) - b) * WINDOW * UNIT)) for _, _, b in CLASSES) + "]::BIGINT[])"
    ctes += [
        "base AS (SELECT doc_id, r, kind, a0 AS s, a0 + len(s) AS e FROM (" + " UNION ALL ".join(base) + "))",
        f"cand AS (SELECT * FROM ({' UNION ALL '.join(cand)}) WHERE regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '{allow}'))",
        "ch AS (SELECT doc_id, c, a0, p::BIGINT AS p, s[p + 1] AS x FROM cand, unnest(range(0, len(s))) u(p))",
        f"""n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, c, a0, x ORDER BY p RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS n_in,
 count(*) OVER (PARTITION BY doc_id, c, a0, x ORDER BY p RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS n_out FROM ch)""",
        f"st AS (SELECT *, {terms}[n_in + 1] - {terms}[n_in] AS gain, {terms}[n_out] - {terms}[n_out + 1] AS loss FROM n)",
        f"s2 AS (SELECT *, gain + coalesce(lag(loss, {WINDOW}) OVER (PARTITION BY doc_id, c, a0 ORDER BY p), 0) AS step FROM st)",
        "tot AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, c, a0 ORDER BY p ROWS UNBOUNDED PRECEDING) AS total FROM s2)",
        f"""ent AS (SELECT doc_id, c + {len(BASE)} AS r, {names}[c + 1] AS kind, a0 + min(p) - {WINDOW - 1} AS s, a0 + max(p) + 1 AS e
 FROM tot WHERE p >= {WINDOW - 1} AND total <= {limits}[c + 1] GROUP BY doc_id, c, a0)""",
        "sp AS (SELECT * FROM base UNION ALL SELECT * FROM ent)",
        f"""a AS (SELECT doc_id, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r < {len(BASE)}) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans FROM sp GROUP BY doc_id)""",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, "
        "sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"
    )


ORACLE = oracle()
