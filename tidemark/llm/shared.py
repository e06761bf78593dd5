"""Staged tables, Arrow batch sizes and table reading for this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stage  # noqa: F401

#: Rows of one Arrow batch; texts may be long, so batches are short.
BATCH_ROWS = 256


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def line_key(line: Column) -> Column:
    """16 bytes that stand for a line of text."""
    return F.unhex(F.md5(line))
