"""Registered queries of the training-data operators, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm import decontaminate, fm_dedup, gumbel_pieces, jaccard_join, ngram_lm, phrases, pii, prefix_trie, quality_classifier, quality_rules, suffix_dedup, url_filters, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    at = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"))
    out = url_filters.temporal_list_join(pages.withColumn("fetched_at", at), url_filters.dated_entries(pages))
    return out.select("page_id", "n_matches", "blocked", F.array_join("matched", ",").alias("matched"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.substring_dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel_pieces.encode(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.dialogues(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_block_heads(turns))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_url_filters": op4_url_filters,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_pii": op7_pii,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_phrases": op12_phrases,
        "op13_warc": op13_warc,
    }


def oracles() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE, "op4_url_filters": url_filters.ORACLE,
            "op11_prefix_trie": prefix_trie.ORACLE, "op12_phrases": phrases.ORACLE, "op13_warc": warc.ORACLE}
