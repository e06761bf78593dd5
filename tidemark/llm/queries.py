"""One query for each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, collision, decontaminate, filter_audit, line_dedup, ngram_join, ordinal, repeats, secrets, topk, toxicity, turn_repair, url_rules
from tidemark.llm.shared import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Byte-level vocabulary of operator 9.
VOCABULARY = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op2_winnow_decontamination", decontaminate.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op3_entropy_secrets", secrets.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda r: F.size(F.filter("base", lambda x: x["r"] == r)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.sort_array(F.concat("base", "entropy"))).alias("spans"),
    )


@query("op4_threshold_topk", topk.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("_id") % 20 == 0)


@query("op5_url_rules", url_rules.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_rules.judge(pages, pages.join(labels, "page_id")).select("page_id", "host", "path", "rule", "mined", "verdict")


@query("op7_site_line_dedup", line_dedup.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query("op1_ordinal_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 of low quality, 1 good but toxic, 2 good."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    rated = labels.select("doc_id", grade.alias("grade")).where(~toxicity.held_out(F.col("doc_id")))
    found = ordinal.score(docs, ordinal.train(docs, rated, 3), drop=("text",))
    return found.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "expected_grade", "top_probability", "selected")


@query("op10_compression_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    held = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_ngram_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_block_anchor_dedup", repeats.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), texts=False)


@query("op11_collision_near_dedup", collision.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query("op12_filter_audit", filter_audit.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@query("op13_turn_repair", turn_repair.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
