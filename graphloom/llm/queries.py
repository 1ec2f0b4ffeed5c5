"""The registered queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table
from graphloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontamination import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text", "items")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.substring_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.near_dedup import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.token_count import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), wrapped=True).drop("text")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.lm_score import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.language_id import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.byte_bpe import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("text")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.suffix_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_token_count": op4_token_count,
    "op5_license_scan": op5_license_scan,
    "op6_lm_score": op6_lm_score,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
}
