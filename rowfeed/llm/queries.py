"""One query for each training-data operator, over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowfeed.llm import best_fit, chaining, chat_grammar, fm_index, fst_tokens, html_crf, license_digest, pfor_ids, quality_rules, simhash_anchor, toxicity_cnn, turn_repair, whitening
from rowfeed.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_tokens.count_tokens(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.leak_digest(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.score_toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(documents(spark, sf_dir))


def op7_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor_ids.write_and_read(documents(spark, sf_dir))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_text(documents(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan_licenses(documents(spark, sf_dir))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchor.near_duplicates(documents(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_grammar.format_digest(chat_grammar.format_conversations(chat_grammar.with_probe(documents(spark, sf_dir, "conversations"))))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(documents(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_digest(turn_repair.repair_conversations(turn_repair.damage(documents(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_decontamination": op2_decontamination,
        "op3_quality_rules": op3_quality_rules,
        "op4_toxicity": op4_toxicity,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_token_id_files": op7_token_id_files,
        "op8_html_text": op8_html_text,
        "op9_license_scan": op9_license_scan,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_chat_format": op11_chat_format,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": fm_index.leak_sql(),
        "op3_quality_rules": quality_rules.quality_sql(),
        "op9_license_scan": license_digest.scan_sql(),
        "op11_chat_format": chat_grammar.format_sql(),
    }
