"""Which segment a customer was in, and when: a history table with intervals, its upkeep, and joins as of a day."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from orderlens.operators import analytics as an
from orderlens.sources.shared import cut


def segments_on(orders: DataFrame, day: str) -> DataFrame:
    """(customer_id, segment, day): RFM segments from the orders before day, ranked among the customers known then."""
    when = F.lit(day).cast("date")
    found = an.rfm(orders.where(F.col("order_date") < when), day)
    return found.select("customer_id", F.col("rfm_segment").alias("segment"), when.alias("day"))


def history(snapshots: DataFrame) -> DataFrame:
    """(customer_id, segment, valid_from, valid_to) from (customer_id, segment, day): one row for each run of days with the same
    segment, from its first day up to, without it, the first day of the next (null: still held)."""
    by = Window.partitionBy("customer_id").orderBy("day")
    starts = snapshots.withColumn("_before", F.lag("segment").over(by)).where(~F.col("segment").eqNullSafe(F.col("_before")))
    return starts.select("customer_id", "segment", F.col("day").alias("valid_from"), F.lead("day").over(by).alias("valid_to"))


def history_over(orders: DataFrame, days: Sequence[str]) -> DataFrame:
    """The history that the segments on the given days make."""
    orders = cut(orders.select("customer_id", "order_date", "net"))
    return cut(history(reduce(DataFrame.unionByName, [segments_on(orders, d) for d in sorted(set(days))])))


def advance(held: DataFrame, snapshot: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(rows that close, rows held now) when the segments of a new day come in. held: the open rows; closed ones are not read.

    A customer whose segment stays keeps their row; one who moves has it closed on day and another opened; one who is new opens a row.
    One who is not in snapshot keeps their row. The same day twice changes nothing.
    """
    when = F.lit(day).cast("date")
    now = snapshot.select("customer_id", F.col("segment").alias("_now"))
    both = held.where("valid_to is null").join(now, "customer_id", "full_outer")
    moved = F.col("_now").isNotNull() & F.col("segment").isNotNull() & (F.col("_now") != F.col("segment"))
    closed = both.where(moved).select("customer_id", "segment", "valid_from", when.alias("valid_to"))
    fresh = moved | F.col("segment").isNull()
    opened = both.select("customer_id", F.when(fresh, F.col("_now")).otherwise(F.col("segment")).alias("segment"), F.when(fresh, when).otherwise(F.col("valid_from")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return closed, opened


def held_at(past: DataFrame, day: str) -> DataFrame:
    """(customer_id, segment) on a day."""
    when = F.lit(day).cast("date")
    return past.where((F.col("valid_from") <= when) & F.coalesce(F.col("valid_to") > when, F.lit(True))).select("customer_id", "segment")


def as_of(rows: DataFrame, past: DataFrame, day: str) -> DataFrame:
    """rows with the segment that their customer held on the day in column `day` (null: none yet). An equi-join with an interval
    beside it: a customer has few rows in past, and Spark can split one who has many in rows."""
    spans = past.select(F.col("customer_id").alias("_customer"), "segment", "valid_from", "valid_to")
    inside = (F.col("valid_from") <= F.col(day)) & F.coalesce(F.col("valid_to") > F.col(day), F.lit(True))
    return rows.join(spans, (F.col("customer_id") == F.col("_customer")) & inside, "left").drop("_customer", "valid_from", "valid_to")


def moves(past: DataFrame, first: str, last: str) -> DataFrame:
    """(segment_before, segment, customers): who came into a segment after day first, up to day last, and from where (null: new)."""
    by = Window.partitionBy("customer_id").orderBy("valid_from")
    rows = past.withColumn("segment_before", F.lag("segment").over(by)).where((F.col("valid_from") > F.lit(first).cast("date")) & (F.col("valid_from") <= F.lit(last).cast("date")))
    return rows.groupBy("segment_before", "segment").agg(F.count(F.lit(1)).alias("customers"))
