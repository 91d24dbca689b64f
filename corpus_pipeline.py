"""Stages that turn raw documents into encoded training text.

Every stage works on all that its predecessor kept. The first four return the columns of documents, the last one the
ids of each document that is left (as often as the mix repeats it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildup.llm import bpe, langid, line_chunks, mixing, simhash
from buildup.llm.common import table
from buildup.llm.queries import vocabulary
from buildup.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages stay."""
    labelled = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.train(labelled, vocabulary("piece_bpe_32k.model"))
    return langid.keep_identified(docs, model, least=0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of several lines that occurred before are cut out of the texts; all documents stay."""
    return line_chunks.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return simhash.keep_one(docs, words=4, distance=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, repeat or go so that sources come to their target weights."""
    return mixing.apply_mix(docs, weights=(5, 2, 1), share=1.5, most=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    found = bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"))
    digest = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return found.select("doc_id", "n_tokens", "ids", digest)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

# language models, connected components and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
