"""The queries of the training-data operators: production parameters over whole tables, with digests for texts and spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, bpe, fim, langid, licences, linededup, minhash, mixing, quality, runindex, sharding, simhash, toxicity
from .common import documents


def op1_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.dedup(documents(spark, sf_dir), with_text=False)


def op3_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), sharding.tree(16), sharding.tree(17))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.apply(quality.ledger(documents(spark, sf_dir)))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "policy")


def op5_line_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"), linededup.SQL_WORDS)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), with_ids=False)


def op7_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edit_report(documents(spark, sf_dir))


def op10_piece_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_counted_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(documents(spark, sf_dir))
    restored = fim.restore_text(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_space_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(documents(spark, sf_dir), with_groups=False)


def op13_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir)).drop("places")


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of each document, by bands of MinHash signatures and exact likeness (operator 9)."""
    return minhash.near_copies(documents(spark, sf_dir))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy drops, and drops alone (operator 4)."""
    return quality.ablations(quality.ledger(documents(spark, sf_dir)))


QUERIES = (
    op1_anchor_simhash, op2_run_index, op3_hash_tree, op4_rule_ledger, op5_line_suffixes, op6_pair_index_bpe, op7_lexicon_automata,
    op8_fair_queueing, op9_minhash, op10_piece_unigrams, op11_counted_cuts, op12_space_anchors, op13_rare_words, near_copies, rule_ablations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_suffixes": linededup.ORACLE, "op8_fair_queueing": mixing.ORACLE, "op11_counted_cuts": fim.ORACLE}
