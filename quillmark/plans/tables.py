"""The driver's tables seen as a labelled code corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.session import spread

# Plain text rewritten so that indentation, tabs, blank lines, comments and
# operators occur.  The same expression runs in Spark and in the checking SQL.
CODE_SQL = """
  case doc_id % 4
    when 0 then text
    when 1 then replace(text, '. ', concat(';', chr(10), '    '))
    when 2 then replace(replace(text, '. ', concat(chr(10), chr(10), chr(9), '# ')), ', ', ' = ')
    else replace(replace(text, '. ', concat(' */', chr(10), chr(10), chr(10), '  /* ')), ', ', concat('(', chr(10)))
  end
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, language, generator, code, n_chars; columns that are not read are pruned."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("language"),
        F.col("source").alias("generator"),
        F.expr(CODE_SQL).alias("code"),
        "n_chars",
    )


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and code, spread over the cores when the input is a few small files."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(F.col("doc_id").alias("id"), F.expr(CODE_SQL).alias("code"))


def with_labels(df: DataFrame, spark: SparkSession, sf_dir: str, how: str = "left") -> DataFrame:
    """Join the labels late, onto narrow rows; an unlabelled row gets a null."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return df.join(labels, "id", how)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with three fixed pseudo-scores in [0, 1) that contain ties."""
    base = corpus(spark, sf_dir).select(
        "id",
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"),
        ((F.col("n_chars") * 7 % 500) / F.lit(500.0)).alias("score_b"),
        ((F.col("id") * 37 % 200) / F.lit(200.0)).alias("score_c"),
    )
    return with_labels(base, spark, sf_dir, "inner")
