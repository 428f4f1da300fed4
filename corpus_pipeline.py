"""The corpus pipeline: five stages over the table documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isochron.llm.common import small_batches, stored, table
from isochron.llm.language_id import keep_identified
from isochron.llm.line_dedup import drop_repeated_lines
from isochron.llm.mixing import mixed_documents
from isochron.llm.pieces import encode
from isochron.llm.simhash import keep_first


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters (null and empty texts too) or with a tie between languages go.

    Rows that repeat an id or a text are judged one by one. Without labels nothing is learned, and nothing stays.
    """
    return keep_identified(docs)  # not stored here: whoever runs the stage writes it, and a second copy would stay on disk through all stages


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are like an earlier one. Null texts stay null; rows with a null or repeated id are documents of their own."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose SimHash fingerprints are linked (4 or fewer differing bits) the row with the smallest id, nulls last; texts without words are alike."""
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as much of the last pass, as their source's target takes, in order of the schedule. Texts without words are never taken."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each row of the mix."""
    with small_batches(spark):
        return stored(encode(docs))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("SentencePiece", tokens),
]

#: Language ID, SimHash and the encoder cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each one keeps is written to the shared checkpoint folder. Empty tables give no rows; columns besides doc_id, text, lang, source and n_chars pass through as far as the mix."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
