"""Segment history, and tables that are written over by partition."""

import datetime as dt
import os

import duckdb
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from orderlens.operators import history
from orderlens.plans import oracles
from orderlens.sources import partitions

SNAPSHOT = "customer_id long, segment string, day date"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def day(n):
    return dt.date(2000, 1, n)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_history_and_as_of(spark):
    snapshots = spark.createDataFrame([(1, "a", day(1)), (1, "a", day(5)), (1, "b", day(9)), (1, "a", day(12)), (2, "b", day(9)), (2, "b", day(12))], SNAPSHOT)
    past = history.history(snapshots)
    assert rows(past) == [(1, "a", day(1), day(9)), (1, "a", day(12), None), (1, "b", day(9), day(12)), (2, "b", day(9), None)]
    assert rows(history.held_at(past, "2000-01-08")) == [(1, "a")] and rows(history.held_at(past, "2000-01-09")) == [(1, "b"), (2, "b")]
    asked = spark.createDataFrame([(1, day(1)), (1, day(8)), (1, day(9)), (1, day(20)), (2, day(8)), (3, day(9)), (None, day(9))], "customer_id long, on_day date")
    got = sorted(((c, d.day, s) for c, d, s in history.as_of(asked, past, "on_day").collect()), key=lambda r: (r[0] or 9, r[1]))
    assert got == [(1, 1, "a"), (1, 8, "a"), (1, 9, "b"), (1, 20, "a"), (2, 8, None), (3, 9, None), (None, 9, None)]
    assert rows(history.moves(past, "2000-01-05", "2000-01-12")) == [("a", "b", 1), ("b", "a", 1), (None, "b", 1)]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.integers(1, 5), st.sampled_from("abc"), max_size=5), min_size=1, max_size=4))
def test_advancing_day_by_day_makes_the_same_history(spark, days):
    seen, all_rows = {}, []
    for i, own in enumerate(days):
        seen |= own  # a customer once known is in every snapshot
        all_rows += [(c, s, day(i + 1)) for c, s in seen.items()]
    held, closed = spark.createDataFrame([], "customer_id long, segment string, valid_from date, valid_to date"), []
    for i in range(len(days)):
        snapshot = spark.createDataFrame([r for r in all_rows if r[2] == day(i + 1)], SNAPSHOT)
        done, held = history.advance(held, snapshot, str(day(i + 1)))
        closed += done.collect()
        held = spark.createDataFrame(held.collect(), held.schema)
    again, same = history.advance(held, snapshot, str(day(len(days))))
    assert again.count() == 0 and rows(same) == rows(held)
    assert sorted(map(tuple, closed + held.collect()), key=str) == rows(history.history(spark.createDataFrame(all_rows, SNAPSHOT)))


def test_cards_and_changes_are_not_empty():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    sql = oracles.oracle_sql()
    cards = c.execute(sql["cv4_customer_cards"]).df().iloc[0]
    assert cards.new_this_week > 0 and cards.new_vips_this_week > 0 and cards.at_risk > 0 and cards.ltv_change_pct > 0
    change = c.execute(sql["cv5_segment_screen"]).df()
    assert (change.month_change_pct != 0).sum() >= 3 and change.month_change_pct.notna().all()
    held = c.execute(sql["cv5_held_revenue"]).df()
    assert held.segment.nunique() == 6 and held.segment.isna().any()


def files(path):
    return {f"{os.path.basename(d)}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_an_upsert_touches_the_buckets_of_its_keys_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    first = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.col("id").cast("double").alias("x"))
    assert partitions.upsert_table(path, first, "k", 32) == list(range(32))
    before, want = files(path), {r.k: (r.v, r.x) for r in first.collect()}
    for limit in (100_000, 0):  # by a broadcast, and by key
        monkeypatch.setattr("orderlens.sources.shared.BROADCAST_ROWS", limit)
        monkeypatch.setattr(partitions, "small", lambda df, limit=limit: F.broadcast(df) if limit else df)
        batch = [(3, "new", None), (4, None, 1.0), (9999, "more", 2.0), (None, "no key", 3.0)]
        touched = partitions.upsert_table(path, spark.createDataFrame(batch, "k long, v string, x double"), "k", 32)
        want |= {k: (v, x) for k, v, x in batch}
        assert 1 <= len(touched) <= 4
        got = partitions.upserted(spark, path, first.schema).collect()
        assert len(got) == len(want) and {r.k: (r.v, r.x) for r in got} == want
        now = files(path)
        stay = {f: t for f, t in before.items() if int(f.split("/")[0].split("=")[1]) not in touched}
        assert stay.items() <= now.items() and len(stay) >= 28
    plan = partitions.upserted(spark, path, first.schema)
    assert plan.count() == 2002
    assert partitions.upsert_table(path, first.limit(0), "k", 32) == [] and files(path) == now


def test_a_frozen_day_stays(spark, tmp_path):
    path = str(tmp_path / "days")
    daily = spark.createDataFrame([(day(1), 1.0), (day(2), 2.0), (day(3), 3.0)], "day date, revenue double")
    assert partitions.freeze_day(path, daily, "2000-01-01") and partitions.freeze_day(path, daily, "2000-01-02")
    before = files(path)
    assert not partitions.freeze_day(path, daily.withColumn("revenue", F.lit(9.0)), "2000-01-02")
    assert files(path) == before
    assert not files(path).keys() & {"x"} and partitions.freeze_day(path, daily, "2000-01-03")
    assert before.items() <= files(path).items()
    assert rows(partitions.snapshots(spark, path, daily.schema)) == [(day(i), float(i)) for i in (1, 2, 3)]
    some = partitions.snapshots(spark, path, daily.schema, "2000-01-02", "2000-01-02")
    assert rows(some) == [(day(2), 2.0)] and "PartitionFilters: [isnotnull(snapshot_date" in some._jdf.queryExecution().executedPlan().toString()
