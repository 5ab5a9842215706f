"""A corpus through toxicity, line dedup, near-duplicate removal, personal data and packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import lines, near_duplicates, packing, pii, toxicity
from quillspark.llm.common import saved, table
from quillspark.llm.queries import WORD_VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the cut go; labels teach only by documents of this stage's input."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that documents share stay in the one with the smallest id; all rows stay, null texts and null ids as they are."""
    return lines.drop_repeated_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles the smallest id stays; those without words, with null texts or null ids all stay."""
    return near_duplicates.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind in brackets; all rows stay, null texts stay null."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence; null and empty texts are one piece of the end id."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]

#: The trees, the tokenizer and the packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
