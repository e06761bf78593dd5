"""URL filter by association rules (operator 5).

A URL becomes a set of tokens of fixed kinds: scheme, each dot-suffix class of the host (whole
host, parent domain, first label), first path segment, shape and extension of the last segment,
the query's keys and the fragment. Spark's FP-growth mines the token sets of labelled URLs, each
with a token for a bad label; rules `tokens => bad` are kept from a least support and confidence
on, and of nested rules only those without a smaller rule inside, which match whatever the larger
one does. A page is blocked if a rule's tokens are all among its own.

Matching goes through an inverted index: each rule is listed once, under its token that is
rarest in the labelled URLs, so a token that all pages hold does not drag in all rules; the other
tokens are then looked up in the page's own set. Rules are written first and broadcast only if
known to fit; otherwise the join on the token is split by adaptive execution. Mining counts with
partial aggregation. A URL has at most `TOKEN_KINDS` tokens, which bounds the sets mined.

A given rule list goes first: rules of (host, path) fit the host and its subdomains and paths
with that prefix, and the longest wins. The list is short and becomes one expression.

Null URLs and URLs without `://` have an empty host and path, no tokens and the verdict allow.
Repeated rows get equal verdicts. With no labelled URLs, or no bad ones, nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage

#: Verdict and (host, path) of the given rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.6
#: A rule also needs so many bad URLs, however few are labelled.
MIN_COUNT = 5
TOKEN_KINDS = 9
BAD = "label=bad"


def lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Sorted set of tokens, empty without a host."""
    h, p = host(url), path(url)
    last = F.regexp_extract(p, r"([^/]*)\z", 1)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    labels = F.split(h, r"\.", -1)
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&", -1), lambda x: F.regexp_extract(x, "^([^=]*)", 1)))), "&")
    made = F.array(
        F.concat(F.lit("scheme="), lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        F.concat(F.lit("host="), h),
        F.concat(F.lit("domain="), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")),
        F.when(F.size(labels) > 2, F.concat(F.lit("sub="), F.get(labels, F.lit(0)))),
        F.concat(F.lit("first="), F.regexp_extract(p, "^/([^/]*)/", 1)),
        F.concat(F.lit("shape="), F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\.[^.]*\z", ""), "[0-9]+", "9"), "[^0-9]+", "a")),
        F.concat(F.lit("ext="), F.regexp_extract(last, r"\.([A-Za-z0-9]+)\z", 1)),
        F.concat(F.lit("keys="), keys),
        F.when(F.contains(url, F.lit("#")), F.lit("fragment")),
    )
    return F.when(h != "", F.array_sort(F.array_distinct(F.array_compact(made)))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, url: str, bad: str, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """tokens (sorted), support, confidence of the rules kept; `bad` is a boolean column, null counts as no label."""
    spark = labelled.sparkSession
    baskets = labelled.where(F.col(bad).isNotNull()).select(tokens(F.col(url)).alias("_t"), F.col(bad).alias("_bad")).where(F.size("_t") > 0)
    baskets = stage(baskets.select(F.when(F.col("_bad"), F.array_append("_t", F.lit(BAD))).otherwise(F.col("_t")).alias("items")), "baskets")
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], "tokens array<string>, support double, confidence double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (MIN_COUNT - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == BAD)
    rules = stage(rules.select(F.array_sort("antecedent").alias("tokens"), "support", "confidence"), "rules")
    smaller = rules.select(F.col("tokens").alias("_small"), F.col("tokens")[0].alias("_x"))
    inner = rules.select("tokens", F.explode("tokens").alias("_x")).join(smaller, "_x")
    nested = inner.where((F.size("_small") < F.size("tokens")) & (F.size(F.array_except("_small", "tokens")) == 0)).select("tokens").distinct()
    return rules.join(nested, "tokens", "left_anti")


def index(rules: DataFrame, labelled: DataFrame, url: str) -> DataFrame:
    """_anchor, _rest: each rule once, under its rarest token."""
    held = labelled.select(F.explode(tokens(F.col(url))).alias("_x")).groupBy("_x").count()
    each = rules.select("tokens", F.explode("tokens").alias("_x")).join(held, "_x")
    return each.groupBy("tokens").agg(F.min_by("_x", F.struct("count", "_x")).alias("_anchor")).withColumnRenamed("tokens", "_rest")


def given_rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, else null."""
    fits = F.array(
        *[
            F.when(
                ((h == d) | F.endswith(h, F.lit("." + d))) & F.startswith(p, F.lit(pre)),
                F.struct(F.lit(-len(d + pre)).alias("n"), F.lit(d + pre).alias("rule"), F.lit(v).alias("verdict")),
            )
            for v, d, pre in rules
        ]
    )
    best = F.get(F.array_sort(F.array_compact(fits)), F.lit(0))
    return best["rule"], best["verdict"]


def judge(pages: DataFrame, labelled: DataFrame, url: str = "url", bad: str = "bad", rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """`pages` with host, path, rule, mined (a rule of tokens fits) and verdict; `labelled` holds `url` and the boolean `bad`."""
    mined = stage(index(mine(labelled, url, bad, min_support, min_confidence), labelled, url), "url-index")
    read = pages.withColumn("_tokens", tokens(F.col(url)))
    # A URL is judged once however many pages hold it.
    distinct = read.select("_tokens").distinct()
    hit = distinct.select("_tokens", F.explode("_tokens").alias("_anchor")).join(mined, "_anchor")
    hit = hit.where(F.forall("_rest", lambda x: F.array_contains(F.col("_tokens"), x))).select("_tokens").distinct().withColumn("_hit", F.lit(True))
    h, p = host(F.col(url)), path(F.col(url))
    out = read.join(hit, "_tokens", "left").withColumns({"_host": h, "_path": p})
    rule, verdict = given_rule(F.col("_host"), F.col("_path"), rules)
    caught = F.coalesce("_hit", F.lit(False))
    made = {"host": F.col("_host"), "path": F.col("_path"), "rule": rule, "mined": caught}
    made["verdict"] = F.coalesce(verdict, F.when(caught, "block").otherwise("allow"))
    return out.select(*[F.col(c) for c in pages.columns if c not in made], *[v.alias(k) for k, v in made.items()])


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_GIVEN = " UNION ALL ".join(f"SELECT '{v}' AS v, '{d}' AS d, '{p}' AS pre" for v, d, p in RULES)
ORACLE = rf"""
WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, translate(regexp_extract(url, '(?s)^(.*?)://', 1), {_AZ}) AS scheme,
 regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query FROM pages),
v AS (SELECT *, regexp_extract(path, '([^/]*)\z', 1) AS last, string_split(host, '.') AS ls FROM u),
t AS (SELECT page_id, host, path, CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_filter([
 'scheme=' || scheme, 'host=' || host, 'domain=' || array_to_string(ls[greatest(len(ls) - 1, 1):len(ls)], '.'), CASE WHEN len(ls) > 2 THEN 'sub=' || ls[1] END,
 'first=' || regexp_extract(path, '^/([^/]*)/', 1),
 'shape=' || regexp_replace(regexp_replace(regexp_replace(last, '\.[^.]*\z', ''), '[0-9]+', '9', 'g'), '[^0-9]+', 'a', 'g'),
 'ext=' || regexp_extract(last, '\.([A-Za-z0-9]+)\z', 1),
 'keys=' || array_to_string(list_sort(list_distinct(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^([^=]*)', 1)))), '&'),
 CASE WHEN contains(url, '#') THEN 'fragment' END], lambda x: x IS NOT NULL))) END AS ts FROM v),
sub AS (SELECT page_id, array_to_string(list_filter(ts, lambda x, i: ((m >> (i - 1)) & 1) = 1), chr(31)) AS s FROM t, unnest(range(1, (1 << len(ts))::BIGINT)) r(m)),
lab AS (SELECT page_id, quality = 0 OR toxic = 1 AS bad FROM t JOIN labels ON page_id = doc_id WHERE len(ts) > 0 AND (quality = 0 OR toxic = 1) IS NOT NULL),
n AS (SELECT ceil(greatest({MIN_SUPPORT}::DOUBLE, ({MIN_COUNT} - 0.5)::DOUBLE / count(*)) * count(*)) AS least FROM lab),
rules AS (SELECT s FROM sub JOIN lab USING (page_id) GROUP BY s
 HAVING count(*) FILTER (bad) >= (SELECT least FROM n) AND count(*) FILTER (bad) >= 1 AND count(*) FILTER (bad)::DOUBLE / count(*) >= {MIN_CONFIDENCE}::DOUBLE),
hit AS (SELECT DISTINCT page_id FROM sub SEMI JOIN rules USING (s)),
g AS (SELECT page_id, first(v ORDER BY length(d || pre) DESC) AS v, first(d || pre ORDER BY length(d || pre) DESC) AS rule
 FROM t JOIN ({_GIVEN}) ON (host = d OR ends_with(host, '.' || d)) AND starts_with(path, pre) GROUP BY page_id)
SELECT t.page_id, host, path, rule, hit.page_id IS NOT NULL AS mined, coalesce(v, CASE WHEN hit.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM t LEFT JOIN hit USING (page_id) LEFT JOIN g USING (page_id)
"""
