"""Session helpers: the shared work folder and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple, DataFrame] = {}
_LOCAL_ROOT: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """Folder for staged tables: `spark.checkpoint.dir`, which every executor can read.

    Only a local master may fall back to a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = sc.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOT[app]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once as Parquet and read it back, which cuts its lineage.

    Unlike a cached plan the files outlive lost executors, keep column pruning and
    carry true sizes, so that later joins choose broadcast only when it fits.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_once(spark: SparkSession, key: tuple, make) -> DataFrame:
    """`stage(make())` the first time `key` is asked for in this application."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _STAGED:
        _STAGED[full] = stage(make(), "-".join(str(k).strip("/").replace("/", "_") for k in key))
    return _STAGED[full]


def once(spark: SparkSession, key: tuple, make) -> DataFrame:
    """`make()`, which stages what it needs itself, the first time `key` is asked for in this application."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _STAGED:
        _STAGED[full] = make()
    return _STAGED[full]


def release(spark: SparkSession) -> None:
    """Delete all tables this application has staged; frames that still read them can no longer be run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_root(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _STAGED if k[0] == spark.sparkContext.applicationId]:
        del _STAGED[key]
