"""A pipeline over documents: language, near copies, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir), with docs what the stage before it kept, and returns a DataFrame. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coclave.llm import jaccard, language, mixing, packing, secrets
from coclave.llm.queries import MIX_SEED, domain_of, mix_weights, tokenizer_path
from coclave.runtime import discard, keep, ready, release

#: The least share of a document's words that its language must have.
LEAST_SHARE = 0.4
#: The part of all tokens that the mix takes; no document is taken twice.
SHARE, EPOCHS = 0.8, 1.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language to LEAST_SHARE, go."""
    return language.keep_identified(docs, language.fit(docs), least=LEAST_SHARE)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least doc_id.

    Documents without words link with nothing and stay, and so do those without a doc_id, which cannot be told apart. Of rows
    that share a doc_id only those that link are held against each other: the longest text stays, at a tie the last in order.
    """
    return jaccard.least_of_groups(docs, keep(jaccard.grouped(docs), "groups"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are written over; every document stays, with its null or empty text as it is. n_chars follows the text."""
    return secrets.hide_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights choose; null texts have no token, null languages and sources count as empty names."""
    return mixing.choose(docs, mix_weights(spark), domain_of("source"), SHARE, EPOCHS, MIX_SEED).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences; a null or empty text is a piece of the end id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_copy_stage),
    ("secret_scan", secret_stage),
    ("source_mix", mix_stage),
    ("best_fit_packing", packing_stage),
]
#: Language identification, secret tests and tokens are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
