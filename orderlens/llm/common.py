"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.sources.shared import cut

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table of a few numbers a row may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (already cut), with a broadcast hint only if its counted rows are at most limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def carried(docs: DataFrame, run: Callable, schema: str, *columns: str) -> DataFrame:
    """doc_id and columns of docs through mapInPandas(run), which yields doc_id and the columns of schema. doc_id passes as a string:
    pandas would round large numbers beside a null."""
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *columns)
    return rows.mapInPandas(run, f"doc_id string, {schema}").withColumn("doc_id", F.col("doc_id").cast("long"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def star_round(edges: DataFrame, larger: bool) -> DataFrame:
    """One large-star (larger) or small-star round over edges (u, v) of connected nodes, each pair once with u < v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not larger:
        both = both.where("v < u")
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    links = both.join(low, "u")
    if larger:
        out = links.where("v > u").select(F.col("low").alias("u"), "v").where("u < v")
    else:
        out = links.where("v != low").select(F.col("low").alias("u"), "v").unionByName(low.select(F.col("low").alias("u"), F.col("u").alias("v")))
    return out.distinct()


def is_starry(edges: DataFrame) -> bool:
    """Whether edges (u, v), each pair once with u < v, are stars: no node is the larger end twice, or the larger and the smaller end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(0).alias("high")), F.struct(F.col("v").alias("n"), F.lit(1).alias("high")))).alias("e"))
    seen = ends.groupBy("e.n").agg(F.sum("e.high").alias("high"), F.min("e.high").alias("low"))
    return seen.where((F.col("high") > 1) | (F.col("high") > 0) & (F.col("low") == 0)).isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v: long): root is the smallest node that links reach.

    Alternating large-star and small-star rounds; each round's edges are written to the shared folder. Self links and repeated
    links are harmless; no links give no rows. Ends when only stars are left, which a round would not change.
    """
    edges = cut(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if is_starry(edges):
            break
        edges = cut(star_round(star_round(edges, True), False))
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
