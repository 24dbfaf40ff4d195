"""A pipeline over documents: language ID, line dedup, near-duplicates, mixing sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; its result is written as Parquet and
read again. All but the last return the columns of documents, whatever columns there are. Rows with null text are rejected by
the first stage; a null doc_id, source or lang is a value like any other; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import langid, linededup, mixing, neardup, packing
from thalweg.llm.common import Scratch, table
from thalweg.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language: letters, and a code length that fits one of the languages. Null and empty
    texts, symbols without letters and noise go."""
    return langid.accepted(spark, docs, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out; a document of which nothing but white space is left goes. n_chars follows text, where
    there is such a column. Rows equal in doc_id and text count as one document here."""
    out = linededup.dedup_passages(spark, docs)
    out = out.where((F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id; of equal ids one row. Texts without
    words are in no group and stay."""
    return neardup.representatives(spark, docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to twice, or not at all. A document without words is not taken."""
    return mixing.materialise(spark, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece, with its place. Repeated rows are pieces of their own."""
    return packing.pack(spark, packing.pieces(docs, vocabulary("byte_bpe_50k.json"), "byte", 0))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express none of the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
