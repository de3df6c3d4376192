"""Named queries of the training-data operators and, where SQL can say it, their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, collocations, jaccard, langid, lines, merkle, mixing, quality, simhash, suffixes, tokenfile, topk, toxicity
from quillmark.llm.base import read
from quillmark.llm.oracles import ORACLES  # noqa: F401

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_good", 6).alias("p_good"), "keep")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, VOCABULARY).select("doc_id", "n_tokens", "ids"), VOCABULARY)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenfile.round_trip(docs, VOCABULARY).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edit_check(read(spark, sf_dir, "documents"))


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit_text(read(spark, sf_dir, "documents"))
    return langid.identify(read(spark, sf_dir, "pages"), model).withColumn("confidence", F.round("confidence", 6))


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup,
    "op2_quality_classifier": quality_classifier,
    "op3_suffix_array": repeated_strings,
    "op4_top_k_search": top_k_search,
    "op5_bpe": bpe_round_trip,
    "op6_source_mix": source_mix,
    "op7_token_file": token_file,
    "op8_fingerprints": document_fingerprints,
    "op9_jaccard_join": jaccard_join,
    "op10_language_id": language_id,
    "op11_toxicity": toxic_documents,
    "op12_collocations": phrase_collocations,
    "op13_merkle_manifest": merkle_manifest,
}
