"""Streaming forms of ingestion and KPIs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orderlens.sources.shared import new_path


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table, a file or a folder of files, as a stream; its time is a timestamp with the session's zone, as watermarks need."""
    path = f"{folder}/events.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if [x.rsplit("/", 1)[-1] for x in table.inputFiles()] == ["events.parquet"]:  # a file: its folder, and no other file of it
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    else:
        stream = reader.option("recursiveFileLookup", True).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def settle(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """What a stream over the files that are there comes to, written to the shared folder (or path, where an earlier call on the same
    source has left off) and read back."""
    spark = stream.sparkSession
    path = path or new_path(spark)
    writer = stream.writeStream.option("checkpointLocation", path + "-state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).outputMode("append").start().awaitTermination()
    else:  # each batch replaces what is there

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        writer.foreachBatch(keep).outputMode(mode).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_kpi(events: DataFrame, late: str = "5 minutes", window: str = "1 day") -> DataFrame:
    """Count, value and approximate users of each tumbling window. In append mode a window comes out when the watermark, `late` behind
    the newest event, has passed its end, and events of it that come after that are dropped. In complete mode all windows come out and
    none is dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"), F.approx_count_distinct("user_id").alias("approx_users")).select(F.col("w.start").alias("window_start"), "events", "value", "approx_users")


def stream_dedup(events: DataFrame, key: list[str], late: str = "5 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


# -- Ingestion -------------------------------------------------------------------------------------------------------------------
ACCEPTED, REJECTED, DUPLICATE = "accepted", "rejected", "duplicate"


#: Groups that keys are dealt into; each has one state, the keys accepted of it. Fixed for the life of a checkpoint.
GROUPS = 2048


def _first_of_keys(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a group of keys with `again`: of each key's valid rows all but the preferred one of the first batch that has the key.
    Invalid rows pass, and claim no key. A new key's best row so far is held, no other."""
    seen = set(json.loads(state.get[0])) if state.exists else set()
    best: dict[str | None, tuple] = {}
    for rows in frames:
        out, again = [], []
        for key, valid, prefer, row in zip(rows["key"], rows["valid"], rows["prefer"], rows["row"]):
            if valid and key not in seen:
                one = (False, 0.0, row) if pd.isna(prefer) else (True, prefer, row)
                last = best.setdefault(key, one)
                if last is one:
                    continue
                best[key], row = (one, last[2]) if one > last else (last, row)
            out.append(row)
            again.append(valid)
        yield pd.DataFrame({"row": out, "again": again}, columns=["row", "again"]).astype({"again": bool})
    if best:
        state.update((json.dumps([*seen, *best]).encode(),))
        yield pd.DataFrame({"row": [one[2] for one in best.values()], "again": False})


def row_schema(stream: DataFrame, clean: Callable[[DataFrame], DataFrame]) -> T.StructType:
    """The columns that stream_ingest writes."""
    return clean(stream.sparkSession.createDataFrame([], stream.schema)).schema


def stream_ingest(stream: DataFrame, clean: Callable[[DataFrame], DataFrame], key: str, target: str, checkpoint: str, prefer: Column | None = None, after_write: Callable[[int], None] | None = None) -> StreamingQuery:
    """Uploads as they arrive, cleaned and judged row by row, each key accepted once; nothing reads what earlier batches wrote.

    clean: raw rows to clean ones with `reasons` (empty: valid), row by row. Which keys were accepted is the query's state, kept with
    its checkpoint: of the valid rows of a key, one of the first batch that has it is accepted (the largest `prefer`, a number, then
    the largest row as JSON), all others are rejected as `duplicate`; a row that fails a rule claims no key. Keys are dealt by hash
    into GROUPS, so that Python is called for a group and not for a key. State grows with the keys: a batch reads and writes the keys
    of the groups that it has rows of, so a cluster with very many keys runs this with the RocksDB state store.

    A batch is one write to its own folder, target/rows/batch_id=N, parted by outcome; a line for each outcome and reason then goes
    to target/ledger/batch_id=N, and readers take the batches that the ledger has. A batch that is run again after a failure, at
    whatever point, starts from the same state and writes over its own folders. after_write is called between the two writes.
    """
    schema = row_schema(stream, clean)
    rows = clean(stream)
    valid = F.size("reasons") == 0
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    claimed = F.when(valid, F.col(key).cast("string"))
    staged = rows.select(claimed.alias("key"), valid.alias("valid"), (F.lit(0.0) if prefer is None else prefer.cast("double")).alias("prefer"), row.alias("row"))
    staged = staged.withColumn("group", F.pmod(F.when(F.col("valid"), F.xxhash64("key")).otherwise(F.xxhash64("row")), F.lit(GROUPS)).cast("int"))
    judged = staged.groupBy("group").applyInPandasWithState(_first_of_keys, "row string, again boolean", "seen binary", "append", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{target}/rows/batch_id={batch_id}"
        out = batch.select(F.from_json("row", schema).alias("r"), "again").select("r.*", "again")
        reasons = F.when(F.col("again"), F.array(F.lit(DUPLICATE))).otherwise(F.col("reasons"))
        out = out.withColumn("reasons", reasons).withColumn("outcome", F.when(F.size("reasons") == 0, ACCEPTED).otherwise(REJECTED))
        out.drop("again").write.mode("overwrite").partitionBy("outcome").parquet(path)
        if after_write is not None:
            after_write(batch_id)
        wrote = spark.read.schema(out.drop("again").schema).parquet(path)
        lines = wrote.select("outcome", F.explode_outer("reasons").alias("reason")).groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("rows"))
        lines.coalesce(1).write.mode("overwrite").parquet(f"{target}/ledger/batch_id={batch_id}")  # a line for each reason

    return judged.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LEDGER = "outcome string, reason string, rows long, batch_id long"


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """(outcome, reason, rows, batch_id) of the batches that are done."""
    return spark.read.schema(LEDGER).parquet(f"{target}/ledger")


def ingested(spark: SparkSession, target: str, schema: T.StructType, outcome: str | None = None) -> DataFrame:
    """The rows of the batches that the ledger has, of one outcome or of all, with outcome and batch_id."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("outcome", T.StringType())])
    rows = spark.read.schema(full).option("basePath", f"{target}/rows").parquet(f"{target}/rows")
    if outcome is not None:
        rows = rows.where(F.col("outcome") == outcome)
    return rows.join(ledger(spark, target).select("batch_id").distinct(), "batch_id", "left_semi")
