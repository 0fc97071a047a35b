"""Tables kept as partitions that are written over one by one: upserts by bucket of the key, snapshots by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from orderlens.sources.shared import cut, small

#: The partition columns of upserted tables and of snapshots.
BUCKET, DAY = "bucket_", "snapshot_date"


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _start(spark: SparkSession, path: str, schema: T.StructType, part: str) -> DataFrame:
    """The table at path, made empty if there is none."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(part).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _write_over(rows: DataFrame, path: str, part: str) -> None:
    """Put rows in place of the partitions they have; others stay. A run that fails before its end changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def upsert_table(path: str, batch: DataFrame, key: str, buckets: int = 64) -> list[int]:
    """Update and insert the rows of batch (one a key) in the table at path, which is parted by bucket of the key; the buckets that
    were written. Take buckets so that one is about a task's share, and always the same number for one table.

    Only buckets that batch has keys of are read and written, and those at most come to the driver as numbers. Where batch is small
    it goes to the rows of these buckets, which stay where they are; else both meet by key. A null key is a key like any other. The
    same batch again changes nothing; all its values count, nulls too.
    """
    spark, names = batch.sparkSession, batch.columns
    batch = cut(batch.withColumn(BUCKET, bucket(key, buckets)))
    touched = [r[0] for r in batch.select(BUCKET).distinct().collect()]
    table = _start(spark, path, batch.schema, BUCKET).where(F.col(BUCKET).isin(touched))
    hinted = small(batch)
    new = hinted.select(F.col(key).alias("_key"), F.struct(*names).alias("_new"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    merged = table.join(new, same, "left").select(*[F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col("_new")[c]).alias(c) for c in names], BUCKET)
    there = table.join(hinted.select(F.col(key).alias("_key")), same, "left_semi").select(F.col(key).alias("_there"))  # as many as batch at most
    added = batch.join(there, F.col(key).eqNullSafe(F.col("_there")), "left_anti")
    _write_over(merged.unionByName(added.select(*names, BUCKET)).repartition(BUCKET), path, BUCKET)
    return sorted(touched)


def upserted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a table of upsert_table; schema: of its batches."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path).drop(BUCKET)


def freeze_day(path: str, daily: DataFrame, day: str, column: str = "day") -> bool:
    """Freeze the rows of one day in the table at path, parted by day: whether they were new. A frozen day is never changed: a second
    run finds its partition, reads no other and writes nothing."""
    rows = daily.withColumn(DAY, F.col(column))
    table = _start(daily.sparkSession, path, rows.schema, DAY)
    that = F.lit(day).cast("date")
    if not table.where(F.col(DAY) == that).isEmpty():
        return False
    _write_over(rows.where(F.col(DAY) == that).coalesce(1), path, DAY)  # a day's snapshot is a few rows
    return True


def snapshots(spark: SparkSession, path: str, schema: T.StructType, first: str | None = None, last: str | None = None) -> DataFrame:
    """The frozen rows, of the days from first to last if given; only their partitions are read."""
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])).parquet(path)
    for bound, keep in ((first, lambda b: F.col(DAY) >= b), (last, lambda b: F.col(DAY) <= b)):
        if bound is not None:
            table = table.where(keep(F.lit(bound).cast("date")))
    return table.drop(DAY)
