"""Sources and sinks: tables, raw CSV uploads, appends, JSON results, CSV exports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orderlens.sources.shared import cut

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables(dict):
    """Tables by name, read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self[name]


def load_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(spark, folder)


def read_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A raw upload: every column a string, rows that do not fit kept whole in _bad. What was parsed is written to the shared folder, so
    that any columns of it can be asked for, _bad alone too, and the files are parsed once."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [*header, "_bad"]])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).csv(path).transform(cut)


def append(df: DataFrame, path: str, date: str = "order_date") -> None:
    """Add rows to a fact table, partitioned by month; one shuffle by month keeps the number of files down."""
    df.withColumn("order_month", F.date_format(date, "yyyy-MM")).repartition("order_month").write.mode("append").partitionBy("order_month").parquet(path)


def result_json(df: DataFrame, analysis: str, job: str, order: list[str]) -> DataFrame:
    """A bounded module output (segments, tiers, months) as one row with a JSON array. Row-level results stay tables."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))
    return df.agg(F.to_json(rows).alias("result_json")).select(F.lit(analysis).alias("analysis_type"), F.lit(job).alias("upload_job_id"), "result_json")


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("analysis_type").parquet(path)


def export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def stream_landing(spark: SparkSession, folder: str, header: list[str]) -> DataFrame:
    """Uploads as a stream of string rows, as their files arrive in folder."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    return spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(os.path.join(folder, ""))
