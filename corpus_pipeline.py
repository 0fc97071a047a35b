"""The corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns of
docs. run() writes every stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.llm import bpe, langid, linededup, mixing, simhash
from orderlens.llm.common import cut, documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that have no language (no letters, a null text) or none with a posterior of langid.SURE."""
    return langid.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, their texts without repeated runs of lines; n_chars follows."""
    return linededup.dedup(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word Jaccard likeness of minhash.LIKE or more): the one with the smallest doc_id."""
    return simhash.keep_first_copy(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each as often as the mix takes it (0 to 3 times)."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of each row."""
    return bpe.encode(docs)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: Learned language models cannot be said in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
