"""Session-level helpers: shared scratch space and input parallelism."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    missing setting is an error, never a machine-local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    fallback = tempfile.mkdtemp(prefix="quillmark-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def run_dir(spark: SparkSession) -> str:
    """This application's own folder of intermediate tables below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/quillmark/{spark.sparkContext.applicationId}"


def close(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that still read them must be stored first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of tables that are read many times (features ahead of
    iterative fits).  ``close`` removes it.  The columnar copy survives lost executors and still
    allows column pruning and filter pushdown.  ``codec`` replaces the session's
    compression.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give heavy per-row work at least one partition per core.

    A table with enough splits is returned untouched, so large inputs are never
    shuffled; a handful of small files is hash-partitioned by its key.  Meant
    for a freshly read table: asking a plan with shuffles for its partitions
    would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def bounded(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Turn a table of at most ``limit`` rows into a broadcast-ready local one.

    The size is checked by reading at most ``limit + 1`` rows.  A larger table
    comes back as it was, without a hint, and is joined by shuffle.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return df, False
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema)), True
