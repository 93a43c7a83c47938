"""A corpus pipeline in five stages over the documents table: toxicity, lines, near-duplicates, mixing, tokens.

Every stage reads what the one before it kept, as Parquet, and all but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floodlens.llm import line_runs, mixing, pieces, simhash, toxicity
from floodlens.llm.common import table
from floodlens.llm.queries import PIECES
from floodlens.session import materialise


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines and runs of lines are cut out of the texts."""
    return line_runs.drop_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: five-word shingles, fingerprints that agree in 60 of 64 bits or more."""
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated up to three times, in the order of their virtual finish times, up to the budget."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    return pieces.encode_and_decode(docs, pieces.read_model(PIECES))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("simhash_near_dedup", near_duplicate_stage),
          ("source_mixing", mixing_stage), ("sentencepiece", token_stage)]
#: The learned, hashed and tokenising stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
