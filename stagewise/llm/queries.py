"""Queries of the corpus operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagewise.llm import alignment, chat, decontaminate, ffd_packing, language_id, lm_score, matroska, near_dedup, packing, phrases, pii, site_style, token_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_disclosure_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.stored_text_media(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs, language_id.remainder("doc_id", 4) != 2)
    return language_id.identify(docs, model)


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_snapshots(_table(spark, sf_dir, "conversations"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(_table(spark, sf_dir, "documents"))


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=decontaminate.SLOP)


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract_main_text(_table(spark, sf_dir, "pages"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(_table(spark, sf_dir, "documents"))


def op11_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents"))


def op13_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffd_packing.first_fit_pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_disclosure_sanitising": op1_disclosure_sanitising,
        "op2_matroska": op2_matroska,
        "op3_language_id": op3_language_id,
        "op4_snapshot_collapse": op4_snapshot_collapse,
        "op5_token_store": op5_token_store,
        "op6_positional_index": op6_positional_index,
        "op7_site_style_tree": op7_site_style_tree,
        "op8_sum_of_squares_packing": op8_sum_of_squares_packing,
        "op9_minhash_forest": op9_minhash_forest,
        "op10_log_bilinear": op10_log_bilinear,
        "op11_phrase_growth": op11_phrase_growth,
        "op12_tokenizer_alignment": op12_tokenizer_alignment,
        "op13_first_fit_packing": op13_first_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_snapshot_collapse": chat.ORACLE, "op11_phrase_growth": phrases.ORACLE}
