"""The corpus pipeline: toxicity, line dedup, near copies, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and calls one operator of tidemark.llm on all rows of
`docs`. Stages but the last return the columns of `documents`; `run` writes each result to the
shared folder as Parquet and reads it again.

Rows are never dropped but by a stage's decision: null and empty texts pass all filters, null ids
have no copies, and rows that share an id are told apart by their text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from tidemark.llm.shared import stage

#: A document with this score or more is rejected as toxic.
TOXIC = 0.5
VOCABULARY = "byte_bpe_50k.json"


def _documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels of documents outside the held-out fold train the model."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return _documents(toxicity.score(docs, model).where(F.col("score") < TOXIC), docs)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`n_chars` follows the text where lines were cut."""
    cut = line_dedup.drop_boilerplate(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _documents(cut.withColumn("n_chars", n_chars), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class stays; of rows that are equal in id and text, one."""
    near = stage(ngram_join.marked_copies(docs), "near-copies")
    ids = near.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("all"))
    ids = stage(ids.where(~F.col("all")), "ids-with-copies")
    kept = docs.join(ids.where(~F.col("some")).select("doc_id"), "doc_id", "left_anti")
    same = (F.col("doc_id") == F.col("_of")) & (decontaminate.text_key(F.col("text")) == F.col("_as"))
    # Ids that some texts leave and others keep are told apart by text.
    gone = near.where(~F.col("kept")).join(ids.where("some").select("doc_id"), "doc_id", "left_semi")
    gone = stage(gone.select(F.col("doc_id").alias("_of"), F.col("text_key").alias("_as")).distinct(), "gone")
    if not gone.isEmpty():
        kept = kept.join(gone, same, "left_anti")
    twice = near.where(F.col("kept") & F.col("doc_id").isNotNull() & (F.col("n_grams") > 0)).groupBy(F.col("doc_id").alias("_of"), F.col("text_key").alias("_as")).count()
    twice = stage(twice.where(F.col("count") > 1).drop("count"), "twice")
    if twice.isEmpty():
        return _documents(kept, docs)
    again = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return _documents(kept.join(twice, same, "left_anti"), docs).union(_documents(again, docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = stage(found.where("contaminated").select(F.col("doc_id").alias("_of"), F.col("text_key").alias("_as")).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("_of")) & (decontaminate.text_key(F.col("text")) == F.col("_as"))
    return _documents(docs.join(bad, same, "left_anti"), docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and of the decoded bytes."""
    read = docs.select("doc_id", "text")
    return bpe.round_trip(read, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", to_tokens),
]

#: Models, MinHash and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
