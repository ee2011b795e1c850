"""Registered queries of the operators on the driver's tables, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm import exact_dedup, filter_audit, hmm_lm, html_extract, jaccard_join, mixing, packing, quality, spelling, suffix_dedup, toxicity, url_filter, warc
from bizlens.llm.common import id_bucket, table

MAX_PASSES = 2.0


def tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_bucket(F.col("doc_id"), 3) != 1)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_texts(table(spark, sf_dir, "documents"), id_bucket(F.col("doc_id"), 7) != 2)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture reads it: one row per reading."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_count(mixing.text_or_empty()).alias("n_tokens"))
    mixed = mixing.mix_sources(docs, max_passes=MAX_PASSES, n_tokens=F.col("n_tokens"))
    return mixed.select("doc_id", "source", "n_tokens", F.col("_block").alias("block"), F.col("_copy").alias("pass"), F.col("_weight").alias("weight"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(table(spark, sf_dir, "pages"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_suffix_dedup": op1,
    "op2_toxicity": op2,
    "op3_exact_dedup": op3,
    "op4_url_filter": op4,
    "op5_warc_salvage": op5,
    "op6_ngram_join": op6,
    "op7_best_fit_packing": op7,
    "op8_hmm_scoring": op8,
    "op9_quality_rules": op9,
    "op10_source_mixing": op10,
    "op11_html_extraction": op11,
    "op12_spelling_variants": op12,
    "op13_filter_audit": op13,
    "pipeline": pipeline,
}
