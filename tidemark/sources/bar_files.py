"""Bar files and run artifacts."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ingest import FIELDS, ingest, normalize_columns, parse_ts, stem_of


def discover_universe(spark: SparkSession, directory: str, pattern: str = "*.csv", exclude=()) -> DataFrame:
    """symbol, path for each matching file; only the listing is read, not the content."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(directory)
        .select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file"))
        .withColumn("symbol", stem_of(F.col("file")))
        .filter(~F.col("symbol").isin(*exclude) & ~F.col("file").isin(*exclude) if exclude else F.lit(True))
        .select("symbol", "path")
    )
    if found.isEmpty():
        raise ValueError(f"no files found in {directory} matching {pattern}")
    return found


def read_raw_csv(spark: SparkSession, paths, volume_required: bool = True) -> DataFrame:
    """All files in one scan, symbol from the file name, prices parsed leniently to null.

    Files must agree on their header: a mismatch is an error, not shifted columns.
    """
    raw = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(paths)
    )
    meta = raw.select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
    )
    data = normalize_columns(meta, volume_required).withColumns({c: F.col(c).try_cast("double") for c in FIELDS})
    return data.withColumn("symbol", stem_of(F.col("_file"))).withColumn(
        "file_ord", F.struct("_file", "_start", F.monotonically_increasing_id())
    ).drop("_file", "_start")


def scan_bars_csv(spark: SparkSession, paths, volume_required: bool = True) -> DataFrame:
    """Bars from CSV through the whole cleaning pipeline."""
    raw = parse_ts(read_raw_csv(spark, paths, volume_required))
    return ingest(raw.select("symbol", "ts", *FIELDS, "file_ord")).drop("file_ord")


def sink_bars(df: DataFrame, path: str) -> None:
    """A folder per symbol. Rows are gathered by symbol first, and a hot symbol split by size, so
    that the number of files follows the data, not tasks times symbols."""
    df.hint("rebalance", "symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)


def sink_csv_files(df: DataFrame, path: str, folder: str, number: str) -> None:
    """A folder `folder=value` per value of that column, in it a CSV file with a header per `number` there.

    Rows are gathered by file first, so that the number of files follows the data. In a folder of the file
    system itself tasks put the files in place with plain calls: Hadoop starts several processes for each file
    it creates there. A file appears under its name when it is whole, so a repeated task leaves no half of one.
    """
    spark, cols = df.sparkSession, [c for c in df.columns if c not in (folder, number)]
    dealt = df.repartition(folder, number)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.getUri().getScheme() != "file":
        write = dealt.drop(number).write.partitionBy(folder).option("header", True)
        return write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).csv(path)
    fs.mkdirs(at)
    root = at.toUri().getPath()
    head = spark.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(c) for c in cols]))).first()[0]

    def put(batches):
        name, out, n = None, None, 0

        def close():
            out.close()
            os.replace(out.name, f"{os.path.dirname(out.name)}/part-{name.partition('/')[0]}.csv")

        for b in batches:
            runs, start = pc.run_end_encode(b.column(0)), 0
            for to, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if to != name:
                    if out:
                        close()
                    name, n = to, n + 1
                    # Spark's own names of partition folders, which it undoes when it reads them.
                    value = re.sub("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", name.partition("/")[2])
                    home = f"{root}/{folder}={value or '__HIVE_DEFAULT_PARTITION__'}"
                    os.makedirs(home, exist_ok=True)
                    out = open(f"{home}/.{uuid.uuid4().hex}", "w", encoding="utf-8", newline="")
                    out.write(head + "\n")
                out.write("\n".join(b.column(1).slice(start, end - start).to_pylist()) + "\n")
                start = end
        if out:
            close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    file = F.concat_ws("/", F.col(number).cast("string"), F.coalesce(F.col(folder).cast("string"), F.lit("")))
    lines = dealt.select(file.alias("file"), F.to_csv(F.struct(*cols)).alias("line")).sortWithinPartitions("file")
    lines.mapInArrow(put, "files long").agg(F.sum("files")).first()


def read_equity_artifact(spark: SparkSession, path: str, keep=()) -> DataFrame:
    """`keep`, ts and equity: the first time-like column and the first other column that is numeric.

    Columns are read as text. One that parses wherever it is not empty, and somewhere does, is
    numeric; one aggregate over all rows tells, so a warm-up row or a label like "7" decides nothing.
    """
    raw = spark.read.option("header", True).csv(path)
    by_name = {c.lower(): c for c in raw.columns}
    when = next((by_name[n] for n in ("timestamp", "date", "index") if n in by_name), raw.columns[0])
    others = [c for c in raw.columns if c != when and c not in keep]
    parses = lambda c: F.col(c).try_cast("double").isNotNull()
    counts = [x for i, c in enumerate(others) for x in (F.count(c).alias(f"n{i}"), F.count_if(parses(c)).alias(f"p{i}"))]
    seen = raw.agg(*counts).first() if others else None
    numeric = [c for i, c in enumerate(others) if seen[f"p{i}"] and seen[f"p{i}"] == seen[f"n{i}"]]
    if not numeric:
        raise ValueError(f"{path} has no column whose values are all numbers")
    return raw.select(*keep, F.col(when).cast("timestamp_ntz").alias("ts"), F.col(numeric[0]).try_cast("double").alias("equity"))


def write_artifacts(df: DataFrame, path: str) -> None:
    """One table per artifact, partitioned by run; a rerun replaces only its own partitions."""
    df.hint("rebalance", "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def _run_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_run_catalog(spark: SparkSession, root: str, newest: int | None = None, pattern: str | None = None) -> DataFrame:
    """One row per run folder holding manifest.json and metrics.json."""
    read = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    manifests = read.option("pathGlobFilter", "manifest.json").json(root)
    metrics = read.option("pathGlobFilter", "metrics.json").json(root)
    left = manifests.select(
        _run_of(F.col("_metadata.file_path")).alias("run_id"),
        F.col("_metadata.file_modification_time").alias("modified"),
        stem_of(F.col("config.strategy.path")).alias("strategy"),
        "started_utc",
    )
    right = metrics.select(_run_of(F.col("_metadata.file_path")).alias("run_id"), "*")
    runs = left.join(right, "run_id")
    if pattern:
        runs = runs.filter(F.col("strategy").contains(pattern))
    return runs.orderBy(F.desc("modified"), "run_id").limit(newest) if newest else runs


def latest_run_per_strategy(runs: DataFrame) -> DataFrame:
    return runs.groupBy("strategy").agg(F.max_by("run_id", F.struct("modified", "run_id")).alias("run_id"))
