"""The corpus pipeline: documents through five stages, each written as Parquet and reread as the next one's input.

Language ID drops what has no language; near-duplicate classes keep one document each; repeated passages are cut out
of the texts; documents with benchmark passages are dropped; the rest is encoded as byte-level BPE. Counted as part of
the text operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, decontamination, language_id, near_dedup, substring_dedup
from graphloom.llm.common import table, written

#: Pooled probability of the best language below which a document is rejected.
LEAST_LANGUAGE = 0.3
#: The columns all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or without any likely language, go."""
    found = language_id.identify(docs)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: of the smallest id that has the class's first text. Null texts stay.

    Rows are told apart by id and text; where a row is repeated, one stays. Columns of docs are returned as they are;
    an empty table gives an empty one.
    """
    md5 = F.md5(F.col("text").cast("binary"))
    kept = near_dedup.classes(docs).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__m")).agg(F.count("*").alias("__n"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & md5.eqNullSafe(F.col("__m"))
    found = docs.join(kept, same)
    # only repeated rows are dealt by id once more
    again = found.where("__n > 1").dropDuplicates(["__id", "__m"])
    return found.where("__n = 1").unionByName(again).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that an earlier document has; what loses all its words goes."""
    found = substring_dedup.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    rest = found.where(~changed | (F.col("n_removed") < F.col("n_words"))).withColumn("text", text)
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rest.select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and the hashes of the ids and of the decoded bytes."""
    found = byte_bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True)
    return found.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("byte-level BPE", encoded),
]

#: A recurrent network, consistent sampling and merges are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's rows written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
