"""Tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a table of a few numbers a row may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Rows that one task sorts, groups or counts, about.
TASK_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. Where it is unset and Spark is local, as in tests, one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="orderlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/orderlens-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor costs no more than the stages after it."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (already cut), with a broadcast hint only if its counted rows are at most limit; else neither side of the join is broadcast,
    as the few bytes of a compressed file may hold very many rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys over so many tasks that each has about TASK_ROWS of its rows (given), so a task needs no more memory for a larger
    table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-int(rows) // TASK_ROWS)), *keys)
