"""Stored indexes for screens: trigram postings for searches, page borders for pages by number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from orderlens.operators import views
from orderlens.plans import scale
from orderlens.sources.partitions import BUCKET, bucket

#: Letters of a gram, and partitions that postings lie in.
GRAM, GRAM_BUCKETS = 3, 64


def grams(text: Column) -> Column:
    """The different grams of a text, lower-cased; none for a shorter one."""
    low = F.lower(text.cast("string"))
    last = F.char_length(low) - GRAM + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(low, i, F.lit(GRAM)))))


def write_postings(df: DataFrame, key: str, columns: Sequence[str], path: str) -> None:
    """Postings (gram, key) of the given columns, parted by bucket of the gram and sorted, so that a search reads a few row groups."""
    every = F.flatten(F.array(*[F.coalesce(grams(F.col(c)), F.array().cast("array<string>")) for c in columns]))
    rows = df.select(F.explode(F.array_distinct(every)).alias("gram"), F.col(key).alias("key")).withColumn(BUCKET, bucket("gram", GRAM_BUCKETS))
    rows.repartition(BUCKET, F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions(BUCKET, "gram").write.partitionBy(BUCKET).parquet(path)


def candidates(spark: SparkSession, path: str, text: str, kind: str = "long") -> DataFrame | None:
    """(key) of the rows that have all grams of text; None if it is too short to have one. Only the partitions of its grams are read."""
    low = text.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return None
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("key", T._parse_datatype_string(kind)), T.StructField(BUCKET, T.IntegerType())])
    places = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(bucket("gram", GRAM_BUCKETS)).distinct().collect()]
    found = spark.read.schema(schema).parquet(path).where(F.col(BUCKET).isin(places) & F.col("gram").isin(wanted))
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("key")


def search(df: DataFrame, key: str, text: str, columns: Sequence[str], path: str) -> DataFrame:
    """The rows that views.search finds, by the postings at path; a text under three letters reads the whole table."""
    found = candidates(df.sparkSession, path, text, dict(df.dtypes)[key])
    if found is not None:
        df = df.join(found, df[key] == found["key"], "left_semi")
    return views.search(df, text, list(columns))


def page_borders(df: DataFrame, key: str, tie: str, size: int = 20, descending: bool = True) -> DataFrame:
    """(page, key, tie) of the first row of each page, pages from 1, in the order of views.page. Rows without a key are on no page."""
    ranked = scale.running(df.select(key, tie).where(F.col(key).isNotNull()), key, tie, descending=descending)
    first = ranked.where((F.col("rank_") - 1) % size == 0)
    return first.select(((F.col("rank_") - 1) / size + 1).cast("long").alias("page"), F.col(key).alias("key"), F.col(tie).alias("tie"))


def page_at(df: DataFrame, borders: DataFrame, page: int, key: str, tie: str, size: int = 20, descending: bool = True) -> DataFrame:
    """Page number `page` of df by its stored borders: a range of keys, sorted. A page that is not there has no rows."""
    ends = {r.page: (r.key, r.tie) for r in borders.where(F.col("page").isin(page, page + 1)).collect()}  # two rows
    if page not in ends:
        return df.limit(0)

    def from_on(k: object, t: object) -> Column:
        further = F.col(key) < F.lit(k) if descending else F.col(key) > F.lit(k)
        return further | ((F.col(key) == F.lit(k)) & (F.col(tie) >= F.lit(t)))

    low, high = (F.col(key) <= F.lit(ends[page][0]), F.col(key) >= F.lit(ends[page][0]))
    rows = df.where((low if descending else high) & from_on(*ends[page]))  # the plain bound reaches the scan
    if page + 1 in ends:
        rows = rows.where(~from_on(*ends[page + 1])).where(F.col(key) >= F.lit(ends[page + 1][0]) if descending else F.col(key) <= F.lit(ends[page + 1][0]))
    return rows.orderBy(F.desc(key) if descending else F.asc(key), tie).limit(size)
