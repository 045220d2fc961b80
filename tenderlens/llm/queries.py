"""Queries over whole tables, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm import decontaminate, language_id, line_dedup, mixing, near_join, negatives, pii, quality_model, quality_rules, spelling, substring_dedup, suffix_dedup, warc_audit


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark, sf_dir):
    return near_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_windows_removed(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    return quality_model.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark, sf_dir):
    rows = mixing.training_order(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"), F.size("uses").alias("n_uses"))


def op5_quality_rules(spark, sf_dir):
    rows = quality_rules.judged(quality_rules.rule_ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mask")


def op6_pii(spark, sf_dir):
    rows = pii.sanitised(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.col("base").alias("base_sha256"), "spans")


def op7_merkle_fixity(spark, sf_dir):
    """Audits the pages against a replica that Spark derives from them with known damage."""
    pages = _table(spark, sf_dir, "pages")
    return warc_audit.audit(pages, warc_audit.damaged(pages))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_bytes_removed(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(negatives.relabelled(_table(spark, sf_dir, "embeddings")))


def op12_language_id(spark, sf_dir):
    return language_id.languages(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variant_forms(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_substring_dedup, op3_quality_classifier, op4_mixing, op5_quality_rules, op6_pii, op7_merkle_fixity, op8_suffix_dedup, op9_decontamination, op10_line_dedup, op11_hard_negatives, op12_language_id, op13_spelling_variants)}
ORACLES = {"op2_substring_dedup": substring_dedup.ORACLE, "op4_mixing": mixing.ORACLE, "op5_quality_rules": quality_rules.ORACLE, "op7_merkle_fixity": warc_audit.ORACLE, "op11_hard_negatives": negatives.ORACLE}
