"""Corpus sources, derived-table cache and the prediction sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_SCHEMA = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("generator", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("label", T.IntegerType()),
])
SUBMISSION_SCHEMA = "ID bigint, label int"


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A parquet split; a missing label, language or generator column reads as null."""
    df = spark.read.parquet(path)
    absent = [f for f in CORPUS_SCHEMA.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else df


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SUBMISSION_SCHEMA)


def write_submission(df: DataFrame, path: str, key: str = "ID", label: str = "label") -> None:
    """CSV with header and the columns ``ID,label``, written in parallel."""
    df.select(F.col(key).alias("ID"), F.col(label).alias("label")).write.mode("overwrite").csv(path, header=True)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, asked of whichever file system the path names."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def cached(spark: SparkSession, path: str, version: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table stored under ``path/version=...``, computed first if needed.

    A new version string (feature set, settings) never sees an old table, and
    ``refresh`` replaces a stale one.  Only a table whose files were all
    committed is served: Spark's marker says so, and next to it a list of the
    files, so that one that lost a part is built anew.
    """
    target = f"{path.rstrip('/')}/version={version}"
    listing = f"{target}.files"
    if not refresh and _exists(spark, f"{target}/_SUCCESS") and _exists(spark, f"{listing}/_SUCCESS"):
        wanted = {r["value"] for r in spark.read.text(listing).collect()}
        try:
            found = spark.read.parquet(target)
            if wanted == {name.rsplit("/", 1)[-1] for name in found.inputFiles()}:
                return found
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").parquet(target)
    stored = spark.read.parquet(target)
    names = [(name.rsplit("/", 1)[-1],) for name in stored.inputFiles()]
    # one short line a file; the list is written last and vouches for the table
    spark.createDataFrame(names, "value string").coalesce(1).write.mode("overwrite").text(listing)
    return stored
