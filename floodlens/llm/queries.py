"""One registered query for each corpus operator, over its whole table, with the SQL where SQL can state it."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from floodlens.llm import (hard_negatives, language, licences, line_runs, mixing, pieces, quality, shards, simhash, spellings, token_counts, toxicity,
                           winnow)
from floodlens.llm.common import table
from floodlens.session import shared_dir

#: The vocabulary file of the token operators; a parameter of theirs.
PIECES = os.environ.get("FLOODLENS_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_decode(table(spark, sf_dir, "documents"), pieces.read_model(PIECES))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.repeated_line_counts(table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.written_shards(table(spark, sf_dir, "documents"), shared_dir(spark, "shards"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, chain).drop("text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 2 of crc32(doc_id) modulo 4 is held out; the models learn from the others."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    found = language.identify_languages(docs, fold != 2)
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spelling_forms(spellings.word_counts(table(spark, sf_dir, "documents"), delete_every=199))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a new folder of the shared one: every distinct text is a miss, is appended and is then looked up."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.Tokenizer(PIECES), shared_dir(spark, "token_counts"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th vec_id is an anchor; rows whose vec_id 7 divides carry the next label."""
    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_sentencepiece, op3_line_dedup, op4_document_fingerprints, op5_sharding, op6_toxicity,
    op7_license_scan, op8_language_id, op9_source_mixing, op10_quality_rules, op11_spelling_variants,
    op12_token_counts, op13_hard_negatives)}
SQL = {"op9_source_mixing": mixing.SHARES_SQL, "op13_hard_negatives": hard_negatives.SQL}
