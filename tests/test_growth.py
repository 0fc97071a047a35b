"""What must not grow faster than the input: calls of Python, sizes of tasks, what is broadcast or read again."""

import re

import pandas as pd
from pyspark.sql import functions as F

from orderlens.operators import analytics as an, ingest, kpi
from orderlens.plans import registry
from orderlens.plans.canon import Canon
from orderlens.sources.shared import cut
from tests.test_operators import upload_stream


def counted(spark, rows):
    """(rows, passed on one by one, how many passed so far)."""
    passed = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    return rows.mapInPandas(run, rows.schema), passed


def test_a_stream_keeps_a_state_for_a_group_of_keys_not_for_each(spark, tmp_path):
    from orderlens.streaming import stream

    run, rows, _ = upload_stream(spark, tmp_path)
    first = [(k, v) for k in range(3000) for v in (k % 7, k % 5)]
    (tmp_path / "in" / "a.csv").write_text("external_id,total\n" + "".join(f"{k},{v}\n" for k, v in first) + "".join(f"{k},-1\n" for k in range(2990, 3010)))
    run()
    second = [(k, 9) for k in range(2000, 3010)]
    (tmp_path / "in" / "b.csv").write_text("external_id,total\n" + "".join(f"{k},{v}\n" for k, v in second))
    assert run().lastProgress.stateOperators[0].numRowsTotal <= stream.GROUPS
    want = [(str(k), float(max(k % 7, k % 5)), "", 0) for k in range(3000)] + [(str(k), 9.0, "", 1) for k in range(3000, 3010)]
    assert rows(stream.ACCEPTED) == sorted(want)
    lost = [(str(k), float(min(k % 7, k % 5)), "duplicate", 0) for k in range(3000)] + [(str(k), -1.0, "total", 0) for k in range(2990, 3010)] + [(str(k), 9.0, "duplicate", 1) for k in range(2000, 3000)]
    assert rows(stream.REJECTED) == sorted(lost)


def test_segmentation_derives_the_profile_once(spark):
    profile = spark.createDataFrame(pd.DataFrame({"customer_id": range(60), "total_orders": [i % 5 + 1 for i in range(60)], "lifetime_value": [float(i * i) for i in range(60)], "recency": [i % 100 for i in range(60)]}))
    profile = profile.withColumn("first_purchase_date", F.lit("2001-01-01").cast("date")).withColumn("last_order_date", F.date_sub(F.lit("2001-08-02").cast("date"), F.col("recency").cast("int"))).withColumn("recency", F.col("recency").cast("int"))
    rows, passed = counted(spark, profile)
    assert an.segmentation(rows).count() == 60 and passed.value == 60


def test_headers_of_many_uploads_are_mapped_once_a_header_and_not_broadcast(spark):
    heads = cut(spark.range(4000).select(F.col("id").alias("upload_job_id"), F.explode(F.array(*map(F.lit, ["Totl Amount", "Cust_Email", "Zzz"]))).alias("csv_header")))
    aliases = spark.createDataFrame([("orders", "total_amount", "total amount"), ("customers", "email", "customer email")], "mapped_table string, mapped_column string, alias string")
    words = spark.createDataFrame([("orders", "total_amount", ["total", "amount"]), ("customers", "email", ["customer", "email"])], "mapped_table string, mapped_column string, tokens array<string>")
    past = spark.createDataFrame([("zzz ", "products", "name", "2001-01-01")], "csv_header string, mapped_table string, mapped_column string, created_at string")
    found = ingest.resolve_by_name(heads, past, aliases, words)
    got = {(r.csv_header, r.mapped_column, r.match_score, r.match_method, r["count"]) for r in found.drop("upload_job_id").groupBy("csv_header", "mapped_column", "match_score", "match_method").count().collect()}
    assert got == {("Totl Amount", "total_amount", 0.9167, "fuzzy", 4000), ("Cust_Email", "email", 1.0, "exact", 4000), ("Zzz", "name", 1.0, "historical", 4000)}
    for rows in (found, ingest.map_exact(heads, aliases), ingest.map_fuzzy(heads, aliases), ingest.map_semantic(heads, words), ingest.map_historical(heads, past)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan and "Exchange hashpartitioning" not in plan


def test_users_over_spans_are_exact(spark):
    pairs = {(d, u * u * 7919 % 20011) for u in range(6000) for d in ((u * 13) % 17, (u * 5) % 23, (u * 29) % 40)}
    rows = [(d, u) for d, u in pairs if d != 8] + [(8, None), (45, None)]
    events = spark.createDataFrame(rows, "d int, u long").select(F.timestamp_seconds(F.lit(1704067200) + F.col("d") * 86400 + 3600).alias("ts"), F.col("u").alias("user_id"))
    got = {r.day.toordinal() - 738886: (r.users_1, r.users_7, r.users_30) for r in kpi.users_over(kpi.user_days(events), (1, 7, 30)).collect()}
    over = lambda d, n: len({u for e, u in rows if u is not None and d - n < e <= d})
    assert got == {d: (over(d, 1), over(d, 7), over(d, 30)) for d in {d for d, _ in rows}}


def test_churn_risk_derives_its_features_once(spark):
    features = spark.createDataFrame(pd.DataFrame({"customer_id": range(50), "recency": [i % 30 for i in range(50)], "frequency": [i % 5 + 1 for i in range(50)], "monetary": [float(i) for i in range(50)], "mean_gap": [i % 7 + 0.5 for i in range(50)], "tenure": [i * 3 for i in range(50)], "churned": [int(i % 30 > 11) for i in range(50)]}))
    rows, passed = counted(spark, features)
    assert an.churn_risk(rows).count() == 50 and passed.value == 50


def test_header_mapping_by_values_derives_the_orders_once(spark):
    c = Canon(spark, "/root/testdata/sf0.001")
    n = c.orders.count()
    c.__dict__["orders"], passed = counted(spark, c.orders)
    assert registry.by_values(c).count() == 15 and passed.value == n


def test_held_revenue_derives_the_orders_once(spark):
    c = Canon(spark, "/root/testdata/sf0.001")
    n = c.sold.count()
    c.__dict__["sold"], passed = counted(spark, c.sold)
    assert registry.held_revenue(c).count() > 0 and passed.value == n


def test_baskets_read_the_lines_once_and_a_task_counts_so_many_pairs(spark, monkeypatch):
    from orderlens.sources import shared

    monkeypatch.setattr(shared, "TASK_ROWS", 100, raising=False)
    lines = [(o, (o * k * k + k) % 40) for o in range(300) for k in (1, 2, 3, 5, 5, 7)] + [(301, None), (302, 1), (None, 2), (None, 3)]
    rows, passed = counted(spark, spark.createDataFrame(lines, "order_id long, product_id long").coalesce(1))
    found = an.basket_pairs(rows, 2)
    own = {o: sorted({p for q, p in lines if q == o and p is not None}) for o, _ in lines}
    met = [(a, b) for o, ps in own.items() if o is not None for a in ps for b in ps if a < b]
    single = {p: sum(p in ps for ps in own.values()) for p in range(40)}
    assert len(own) == 303  # with none
    want = {(a, b): (met.count((a, b)), round(met.count((a, b)) / single[a], 6), round(met.count((a, b)) * 302 / (single[a] * single[b]), 6)) for a, b in set(met) if met.count((a, b)) > 1}
    assert {(r.a, r.b): (r.support, r.confidence, r.lift) for r in found.collect()} == want
    assert passed.value == len(lines)
    sizes = [int(n) for n in re.findall(r"hashpartitioning\(a#\d+L, b#\d+L, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())]
    assert sizes and min(sizes) >= len(met) // 100
