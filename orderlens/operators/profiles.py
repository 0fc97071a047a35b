"""Header mapping by what columns hold: profiles of values, compared with those of the target's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orderlens.operators.ingest import _candidates, _top
from orderlens.sources.shared import cut

#: Smallest digests of different values that stand for a column's values.
SKETCH = 64
#: Shares of values that a profile has: numbers, dates, with letters, with an at sign, with a space.
KINDS = {"number": r"^-?[0-9]+(\.[0-9]+)?$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "letter": "[A-Za-z]", "at": "@", "space": " "}
#: Weights of shapes, kinds and common values in a score.
WEIGHTS = (0.4, 0.4, 0.2)


def values(table: DataFrame, columns: Sequence[str], **names: Column) -> DataFrame:
    """(the named columns, column, value): the values of columns as strings, one row each; nulls and blanks go."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns]))
    return table.select(*[x.alias(n) for n, x in names.items()], each.alias("x")).select(*names, "x.*").where("value <> ''")


def kinds(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, the share of each of KINDS, and the mean length on a scale of 0 to 1."""
    length = F.avg(F.char_length("value"))
    return rows.groupBy(*by).agg(*[F.avg(F.col("value").rlike(p).cast("int")).alias(f"k_{k}") for k, p in KINDS.items()], (length / (length + 10)).alias("k_length"))


def shapes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, gram, f): pairs of neighbours in the values' shapes (digits as 9, letters as a, ends marked), scaled to length 1."""
    shape = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), "[A-Za-z]", "a"), F.lit("$"))
    pairs = rows.groupBy(*by, shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))  # few shapes, many values
    pairs = pairs.select(*by, "n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("shape") - 1), lambda i: F.substr(F.col("shape"), i, F.lit(2)))).alias("gram"))
    counts = pairs.groupBy(*by, "gram").agg(F.sum("n").cast("double").alias("n"))
    norms = counts.groupBy(*by).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, list(by)).select(*by, "gram", (F.col("n") / F.col("norm")).alias("f"))


def sketches(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, digest): the SKETCH smallest digests of each column's different values. Tasks leave out what cannot be among them first."""
    different = rows.select(*by, F.md5("value").alias("digest")).distinct()
    return different.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("digest"))).where(F.col("_k") <= SKETCH).drop("_k")


def similarity(left: DataFrame, right: DataFrame, by_left: Sequence[str], by_right: Sequence[str]) -> DataFrame:
    """(by_left, by_right, score) of all pairs of columns, whose number is that of headers times that of the target's columns. left
    and right: rows of values().

    The score weighs the cosine of shapes, one less the mean difference of kinds, and the likeness of the sets of values by the
    smallest digests of both.
    """
    pairs = kinds(left, by_left).crossJoin(kinds(right, by_right).withColumnsRenamed({f"k_{k}": f"t_{k}" for k in [*KINDS, "length"]}))  # a row a column
    names = [*by_left, *by_right]
    apart = sum((F.abs(F.col(f"k_{k}") - F.col(f"t_{k}")) for k in [*KINDS, "length"]), F.lit(0.0)) / (len(KINDS) + 1)
    pairs = cut(pairs.select(*names, (1 - apart).alias("kinds")))
    cosine = shapes(left, by_left).join(shapes(right, by_right).withColumnRenamed("f", "g"), "gram").groupBy(*names).agg(F.sum(F.col("f") * F.col("g")).alias("shapes"))
    own, theirs = cut(sketches(left, by_left)), cut(sketches(right, by_right))
    either = pairs.select(*names).join(own, list(by_left)).select(*names, "digest", F.lit(1).alias("side"))
    either = either.unionByName(pairs.select(*names).join(theirs, list(by_right)).select(*names, "digest", F.lit(2).alias("side")))
    both = either.groupBy(*names, "digest").agg(F.sum("side").alias("sides"))
    both = both.withColumn("_k", F.row_number().over(Window.partitionBy(*names).orderBy("digest"))).where(F.col("_k") <= SKETCH)
    common = both.groupBy(*names).agg((F.count_if(F.col("sides") == 3) / F.count(F.lit(1))).alias("common"))
    out = pairs.join(cosine, names, "left").join(common, names, "left")
    parts = [F.coalesce("shapes", F.lit(0.0)), F.col("kinds"), F.coalesce("common", F.lit(0.0))]
    return out.select(*names, F.round(sum((p * w for p, w in zip(parts, WEIGHTS)), F.lit(0.0)), 4).alias("score"))


def map_by_values(uploads: DataFrame, targets: DataFrame) -> DataFrame:
    """The target column whose values are most like a header's. uploads: (upload_job_id, csv_header, value), targets: (mapped_table,
    mapped_column, value). A header without values has no row."""
    scored = similarity(uploads, targets, ["upload_job_id", "csv_header"], ["mapped_table", "mapped_column"])
    return _top(_candidates(scored, "values", F.col("score")))
