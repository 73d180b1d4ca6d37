"""The subpackage's queries for the driver, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeloom.llm import chat, fim, html_main, license_scan, merkle, mixing, neardup, oracles, packing, passages, pii, rules, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.path_of())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["rank"] < len(pii.BASE))
    kinds = F.transform("pii_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    spans = F.col("pii_spans")
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"), pii.scored(spans).alias("scores"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = merkle.edited(_table(spark, sf_dir, "documents"))
    return of.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        merkle.likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        merkle.likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        merkle.first_edit(F.col("tree"), F.col("edited_tree")).alias("first_edit"),
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.readback(chat.windowed(turns.unionByName(added)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged(rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extracted(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decided(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "fraction", "drawn")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = fim.transformed(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fim.restored(F.col("output"), F.col("form"))
    return of.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_license_scans, op2_pii, op3_best_fit_packing, op4_substring_dedup, op5_document_fingerprints, op6_chat_formatting, op7_quality_rules, op8_html_extraction, op9_mixing, op10_minhash_near_dedup, op11_toxicity, op12_fill_in_middle)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
