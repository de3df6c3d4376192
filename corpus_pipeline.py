"""From raw documents to token ids in five stages, each written and read again by the next."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillmark.llm import base, bpe, jaccard, lines, mixing, quality  # noqa: E402
from quillmark.llm.queries import VOCABULARY  # noqa: E402


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, takes for good ones."""
    model = quality.fit(docs, base.read(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("keep").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so do documents of which nothing is left."""
    cut = lines.dedup_lines(docs)
    return cut.where(~((F.col("n_removed") > 0) & (F.regexp_count(F.col("text"), F.lit(base.WORD)) == 0))).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of their decoded text."""
    both = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), VOCABULARY).drop("text"), VOCABULARY)
    return both.select("doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The classifier, the join and the encoder can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = base.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = base.materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
