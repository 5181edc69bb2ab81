"""One registered query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, filter_audit, line_dedup, mixing, near_dup, packing, pii, quality_pu, quality_rules, toxicity, url_filters
from .samples import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sites share."""
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, and how many it has of each kind."""
    found = pii.surrogates(table(spark, sf_dir, "documents"), PII_KEY)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("kinds") - F.size(F.array_remove("kinds", k))).alias(f"n_{k}") for k in pii.KINDS]
    return found.withColumn("kinds", kinds).select("doc_id", "text", *counts)


#: Key of the registered query; a real one comes from a secret store.
PII_KEY = b"registered-query"
#: Rule to verdict.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; a page's outcome is the quality label of the document that its path's last number names."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    doc_id = F.regexp_extract(url_filters.path_of(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1).try_cast("long")
    outcomes = pages.select("url", doc_id.alias("doc_id")).join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id")
    return url_filters.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each of its speakers; mask as text: length:loss, ..."""
    rows = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    return rows.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["length"], m["loss"])), ","))


def _verdicts(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a chain learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return _verdicts(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a classifier learnt from good labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return _verdicts(quality_pu.score(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark passages."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, its verdict under the latest policy, and that of the first."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base_failed = F.col("failed").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE)).cast("long")) != 0
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        "doc_id", *measures, base_failed.alias("base_failed"), quality_rules.passes(quality_rules.LATEST).alias("kept"), "failed",
        quality_rules.passes(1).alias("kept_v1"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents on two-word shingles at a similarity of 0.8."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=2, similarity=0.8)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op11_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document; sources weigh 1, 2, 3 in turn."""
    return mixing.mix(table(spark, sf_dir, "documents"), (1, 2, 3), 3)


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language."""
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_url_filters": op3_url_filters,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_chat_perspectives": op6_chat_perspectives,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_cube_mixing": op11_cube_mixing,
    "op12_filter_interactions": op12_filter_interactions,
}
