"""Small literal cases, properties and plans."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from orderlens.functions import derive
from orderlens.operators import analytics as an, ingest, kpi, models, views
from orderlens.plans import scale
from orderlens.plans.canon import Canon
from orderlens.sources import tables

D = dt.date
SF = "/root/testdata/sf0.001"
ORDERS = "order_id long, customer_id long, order_date date, net double, status string, region string"


def test_derived_columns(spark):
    row = spark.range(1).select(
        derive.gross_margin_pct(F.lit(299), F.lit(120)).alias("pct"), derive.gross_margin_pct(F.lit(0), F.lit(1)).alias("zero"), derive.gross_margin_pct(F.lit(5), F.lit(None).cast("int")).alias("none"),
        derive.is_low_stock(F.lit(45), F.lit(10)).alias("low"), derive.is_low_stock(F.lit(10), F.lit(10)).alias("edge"), derive.stock_band(F.lit(19), F.lit(10)).alias("band"),
        derive.cohort_month(F.lit(D(2024, 1, 15))).alias("cohort"), derive.at_risk(F.lit(D(2024, 1, 1)), "2024-03-31").alias("r90"), derive.at_risk(F.lit(D(2024, 1, 1)), "2024-04-01").alias("r91"),
        derive.gross_margin(derive.net_amount(F.lit(299), F.lit(0)), F.lit(120)).alias("margin"),
    ).first()
    assert abs(row.pct - 59.866) < 0.01 and row.zero is None and row.none is None
    assert not row.low and not row.edge and row.band == "orange" and row.cohort == D(2024, 1, 1)
    assert not row.r90 and row.r91 and row.margin == 179


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=60), st.booleans())
def test_rank_equals_plain_window(spark, rows, descending):
    df = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(rows)], "id long, v long, m long")
    order = Window.orderBy(F.desc("v") if descending else F.asc("v"), "id")
    want = df.select("id", F.row_number().over(order).alias("k"), F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.ntile(5).over(order).alias("t"))
    got = scale.running(df, "v", "id", "m", descending, buckets=4).select("id", F.col("rank_").alias("k"), F.col("before_").alias("b"), scale.ntile(5).alias("t"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ranks = {r.id: r.p for r in scale.percent_rank(df, "v", "p", descending).collect()}
    plain = {r.id: r.p for r in df.select("id", F.percent_rank().over(Window.orderBy(F.desc("v") if descending else F.asc("v"))).alias("p")).collect()}
    assert ranks == pytest.approx(plain)


def test_ranks_keep_rows_without_values_and_take_string_ties(spark):
    rows = [("ä", 5, 1), (None, None, 2), ("zz", 7, 3), ("b", None, 4), ("b1", 5, 5), ("", 5, 6), (None, 7, 7)] * 3
    df = spark.createDataFrame([(k, v, m, i) for i, (k, v, m) in enumerate(rows)], "id string, v long, m long, n long")
    for descending in (False, True):
        order = Window.orderBy(-F.col("v") if descending else F.col("v"), "id")
        got = scale.running(df, "v", "id", "m", descending, buckets=3).select("id", "v", "rank_", "rows_", "sum_").collect()
        assert len(got) == len(rows) and {r.rows_ for r in got} == {len(rows)} and {r.sum_ for r in got} == {sum(m for _, _, m in rows)}
        want = df.select("id", "v", F.row_number().over(order).alias("k")).collect()
        assert sorted((r.rank_, r.v or -1, r.id or "") for r in got) == sorted((r.k, r.v or -1, r.id or "") for r in want)
        for name, plain in (("percent_rank", F.percent_rank), ("dense_rank", F.dense_rank)):
            by = Window.orderBy(-F.col("v") if descending else F.col("v"))
            want = {r.n: r.p for r in df.select("n", plain().over(by).alias("p")).collect()}
            assert {r.n: r.p for r in getattr(scale, name)(df, "v", "p", descending).collect()} == pytest.approx(want)
    orders = [("a", D(2001, 1, 1), 5), (None, D(2001, 2, 1), 6), ("b", D(2001, 3, 1), None), ("b", D(2001, 3, 2), None)]
    out = an.rfm(spark.createDataFrame(orders, "customer_id string, order_date date, net long"), "2001-08-02").collect()
    assert {r.customer_id for r in out} == {"a", None, "b"} and len(out) == 3


def test_rank_plan_reads_one_written_table(spark):
    c = Canon(spark, SF)
    text = plan(an.rfm(c.sold, "2001-08-02"))
    assert text.count("FileScan") <= 8 and "lineitem" not in text


def test_upsert_takes_nulls(spark):
    target = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "k int, s string, n int")
    batch = spark.createDataFrame([(2, None, 4), (3, "c", None)], target.schema)
    assert sorted(map(tuple, ingest.upsert(target, batch, "k").collect())) == [(1, "a", 2), (2, None, 4), (3, "c", None)]


def test_activity_gaps(spark):
    start = D(2024, 1, 1)
    rows = [(i, 1, start + dt.timedelta(d), 10.0, "completed", "X") for i, d in enumerate((0, 90, 181, 400))] + [(9, 2, start + dt.timedelta(5), 1.0, "completed", "X")]
    got = {(r.day - start).days: (r.active, r.known) for r in kpi.active_and_churn(spark.createDataFrame(rows, ORDERS)).collect()}
    for day in range(401):
        active = sum(any(0 <= day - d <= 90 for d in own) for own in ((0, 90, 181, 400), (5,)))
        assert got[day] == (active, 1 + (day >= 5))


def test_tiers_and_baskets(spark):
    items = spark.createDataFrame([(0, 0, 60.0)] + [(i, i, 40 / 9) for i in range(1, 10)], "order_id long, product_id long, line_total double")
    tiers = {r.product_id: r.abc_tier for r in an.abc_tier(items, "2024-01-01").collect()}
    assert tiers[0] == "A" and set(list(tiers.values())[1:]) == {"C"}
    baskets = [(1, "abc"), (2, "ab"), (3, "a"), (4, "bc"), (5, "aab")]
    items = spark.createDataFrame([(o, p) for o, ps in baskets for p in ps], "order_id long, product_id string")
    pairs = {(r.a, r.b): r.support for r in an.basket_pairs(items, 2).collect()}
    assert pairs == {("a", "b"): 3, ("b", "c"): 2}
    sets = {tuple(r["items"]): r.support for r in an.basket_itemsets(items, 0.4).collect()}
    assert sets["a", "b"] == 3 and sets["a",] == 4


def test_funnel(spark):
    t = dt.datetime(2024, 1, 1)
    h = lambda n: t + dt.timedelta(hours=n)
    rows = [(1, "view", h(0)), (1, "click", h(1)), (1, "signup", h(2)), (1, "purchase", h(3)), (2, "purchase", h(0)), (2, "view", h(1)), (2, "click", h(1)), (3, "view", h(0)), (3, "click", h(24 * 8)), (4, "click", h(0)), (4, "view", h(1)), (4, "click", h(2))]
    got = [r.users for r in an.funnel(spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp"), ["view", "click", "signup", "purchase"]).orderBy("step").collect()]
    assert got == [4, 2, 1, 1]


def test_short_series(spark):
    for n, value in ((1, 5.0), (13, 5.0), (40, 7.0)):
        rows = [(D(2024, 1, 1) + dt.timedelta(i), value, 1) for i in range(n)]
        out = an.fit_forecast(spark.createDataFrame(rows, "ds date, y double, k int"), ["k"]).collect()
        assert len(out) == n + 30 and all(abs(r.yhat - value) < 0.02 and r.yhat_lower <= r.yhat <= r.yhat_upper for r in out)


def test_sentiment(spark):
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1)], "word string, weight int")
    texts = [(1, "Good, good!"), (2, "bad"), (3, "good and bad"), (4, "nothing"), (5, None)]
    got = {r.id: (r.sentiment_label, r.sentiment_score) for r in an.sentiment(spark.createDataFrame(texts, "id long, text string"), lexicon).collect()}
    assert got == {1: ("POSITIVE", 1.0), 2: ("NEGATIVE", 1.0), 3: ("NEUTRAL", 1.0), 4: ("NEUTRAL", 0.0), 5: ("NEUTRAL", 0.0)}


def test_models(spark):
    c = Canon(spark, SF)
    profile = an.customer_profile(c.sold, "2001-08-02")
    segments = {r.ai_segment for r in an.segmentation(profile).collect()}
    assert segments <= {"vip_champion", "loyalist", "new_potential", "undetermined", "at_risk"} and an.segmentation(profile).count() == profile.count()
    risk = an.churn_risk(an.churn_features(c.sold, "2001-08-02")).collect()
    assert all(0 <= r.churn_risk_score <= 1 for r in risk)
    clv = models.clv(c.sold, "2001-08-02").collect()
    assert len(clv) == profile.count() and all(r.expected_orders >= 0 for r in clv)
    assert models.lgamma(np.array([0.5, 5.0, 30.5])) == pytest.approx([math.lgamma(x) for x in (0.5, 5.0, 30.5)], rel=1e-9)
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(600)] + [(999, 500.0, -300.0)], "id long, a double, b double")
    scored = models.isolation_forest(rows, ["a", "b"], "id", share=0.005).orderBy(F.desc("score")).first()
    assert scored.id == 999 and scored.is_anomaly


def test_empty_tables(spark):
    none = spark.createDataFrame([], ORDERS)
    assert an.rfm(none, "2024-01-01").count() == an.cohort(none).count() == an.revenue(none).count() == kpi.daily_kpi(none).count() == kpi.active_and_churn(none).count() == 0
    items = spark.createDataFrame([], "order_id long, product_id long, line_total decimal(12,2)")
    assert an.abc_tier(items, "2024-01-01").count() == an.basket_pairs(items).count() == 0


def test_upload_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    header = ["Order ID", "Cust_Email", "Sale Amt", "Date", "Qty", "SKU", "Disc"]
    lines = [",".join(header), '1,a@x.com,"$1,299.00",31/12/2023,1,S1,0', "2,b@x.com,N/A,2023-12-30,2,S2,", '2,b@x.com,20,12/31/2023,2,S2,1', "3,c@x.com", "4,d@x.com,-5,2023/01/02,1,S1,0"]
    (tmp_path / "in" / "dirty_upload.csv").write_text("\n".join(lines) + "\n")
    raw = tables.read_csv(spark, str(tmp_path / "in"), header)
    assert sorted(r._bad or "" for r in raw.collect()) == ["", "", "", "", "3,c@x.com"]
    mapping = {"Order ID": "external_id", "Sale Amt": "total_amount", "Date": "order_date", "Qty": "quantity", "Disc": "discount_amount"}
    rows = ingest.clean_missing(ingest.apply_mapping(raw, mapping), {"discount_amount": "0"})
    rows = ingest.coerce_numeric(ingest.standardise_dates(rows, ["order_date"]), ["total_amount", "discount_amount"])
    rows = ingest.drop_duplicates(rows, ["external_id"], ["total_amount"]).withColumn("cost_amount", F.lit(None).cast("decimal(12,2)"))
    valid, rejected = ingest.validate_rows(rows, {"amount": F.col("total_amount") >= 0, "date": F.col("order_date").isNotNull()})
    assert sorted(r.external_id for r in valid.collect()) == ["1", "2"]
    assert {r.external_id: r.reasons for r in rejected.collect()} == {"3": ["amount", "date"], "4": ["amount"]}
    assert {r.order_date for r in valid.collect()} == {D(2023, 12, 31)}
    store = str(tmp_path / "orders")
    first = ingest.insert_orders(valid, valid.limit(0))
    tables.append(first, store)
    again = ingest.insert_orders(valid, spark.read.parquet(store))
    assert spark.read.parquet(store).count() == 2 and again.count() == 0
    tables.export(first, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    tables.write_result(tables.result_json(first.select("external_id", "net_amount"), "orders", "j", ["external_id"]), str(tmp_path / "results"))
    assert "external_id" in spark.read.parquet(str(tmp_path / "results")).first().result_json


def upload_stream(spark, tmp_path):
    from orderlens.streaming import stream

    header = ["external_id", "total"]
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")

    def clean(raw):
        return ingest.upload_rows(raw, {x: x for x in header}, {"total": F.col("total") >= 0, "key": F.col("external_id").isNotNull()}, [], ["total"])

    def run(after_write=None):
        found = tables.stream_landing(spark, str(tmp_path / "in"), header)
        q = stream.stream_ingest(found, clean, "external_id", out, str(tmp_path / "check"), F.col("total"), after_write)
        q.awaitTermination()
        return q

    def rows(outcome=None):
        found = stream.ingested(spark, out, stream.row_schema(tables.stream_landing(spark, str(tmp_path / "in"), header), clean), outcome)
        return sorted((r.external_id or "", None if r.total is None else float(r.total), ",".join(r.reasons), r.batch_id) for r in found.collect())

    return run, rows, out


def test_streams(spark, tmp_path):
    from orderlens.streaming import stream

    run, rows, out = upload_stream(spark, tmp_path)
    (tmp_path / "in" / "a.csv").write_text("external_id,total\n1,5\n2,6\n1,7\n,9\n4,-1\n5,x\n")
    run()
    assert rows(stream.ACCEPTED) == [("1", 7.0, "", 0), ("2", 6.0, "", 0)]
    (tmp_path / "in" / "b.csv").write_text("external_id,total\n2,60\n3,8\n4,2\n")
    run()
    run()
    assert rows(stream.ACCEPTED) == [("1", 7.0, "", 0), ("2", 6.0, "", 0), ("3", 8.0, "", 1), ("4", 2.0, "", 1)]  # a row that failed claimed no key
    assert rows(stream.REJECTED) == [("", 9.0, "key", 0), ("1", 5.0, "duplicate", 0), ("2", 60.0, "duplicate", 1), ("4", -1.0, "total", 0), ("5", None, "total", 0)]
    lines = {(r.batch_id, r.outcome, r.reason): r.rows for r in stream.ledger(spark, out).collect()}
    assert lines == {(0, "accepted", None): 2, (0, "rejected", "key"): 1, (0, "rejected", "duplicate"): 1, (0, "rejected", "total"): 2, (1, "accepted", None): 2, (1, "rejected", "duplicate"): 1}


def test_a_batch_that_failed_between_its_writes_adds_nothing_twice(spark, tmp_path):
    from pyspark.errors import StreamingQueryException
    from orderlens.streaming import stream

    run, rows, out = upload_stream(spark, tmp_path)
    (tmp_path / "in" / "a.csv").write_text("external_id,total\n1,5\n2,6\n")
    run()
    (tmp_path / "in" / "b.csv").write_text("external_id,total\n2,7\n3,8\n3,9\n")

    def fail(batch_id):
        raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        run(fail)
    assert len(list((tmp_path / "out" / "rows").glob("batch_id=1/outcome=*"))) == 2  # written, not in the ledger
    assert rows() == [("1", 5.0, "", 0), ("2", 6.0, "", 0)]
    run()
    want = [("1", 5.0, "", 0), ("2", 6.0, "", 0), ("2", 7.0, "duplicate", 1), ("3", 8.0, "duplicate", 1), ("3", 9.0, "", 1)]
    assert rows() == want
    (tmp_path / "check" / "commits" / "1").unlink()  # the batch was done, but the stream had not noted it
    for noted in (tmp_path / "check" / "commits").glob(".1.crc"):
        noted.unlink()
    run()
    assert rows() == want


def test_a_batch_does_not_read_the_target(spark, tmp_path):
    run, rows, out = upload_stream(spark, tmp_path)
    (tmp_path / "in" / "a.csv").write_text("external_id,total\n1,5\n")
    run()
    (tmp_path / "in" / "b.csv").write_text("external_id,total\n" + "7,1\n" * 500)
    plans = []
    q = run(lambda batch_id: plans.append(batch_id))
    plan = q._jsq.explainInternal(True)
    assert "FlatMapGroupsInPandasWithState" in plan and f"{out}/rows" not in plan and plans == [1]
    assert [r[2] for r in rows() if r[0] == "7"].count("duplicate") == 499


def test_late_events_and_folders_of_files(spark, tmp_path):
    from orderlens.streaming import stream

    events, state, target = str(tmp_path / "events.parquet"), str(tmp_path / "state"), str(tmp_path / "out")
    rows = lambda *xs: spark.createDataFrame([(i, dt.datetime(2024, 1, d, h), 1, float(v)) for i, d, h, v in xs], "event_id long, ts timestamp, user_id long, value double")

    def run():
        found = stream.stream_dedup(stream.stream_events(spark, str(tmp_path)), ["event_id"], "1 hour").select("event_id", "value")
        found.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    rows((1, 1, 1, 5), (2, 1, 2, 6), (2, 1, 2, 6)).write.parquet(events)
    assert stream.settle(stream.stream_kpi(stream.stream_events(spark, str(tmp_path))), "complete").first().events == 3
    run()
    rows((3, 3, 0, 7)).write.mode("append").parquet(events)
    run()
    rows((4, 1, 1, 8), (3, 3, 0, 7), (5, 3, 1, 9)).write.mode("append").parquet(events)  # one long late, one again
    run()
    assert sorted(r.event_id for r in spark.read.parquet(target).collect()) == [1, 2, 3, 5]


def test_constraints_and_references(spark):
    bad = spark.createDataFrame([(0, -1.0, "lost"), (1, 2.0, "completed"), (None, None, None)], "quantity int, price double, status string")
    got = {r.rule: r.violations for r in ingest.check_constraints(bad, {"qty": F.col("quantity") > 0, "price": F.col("price") >= 0, "status": F.col("status").isin("completed")}).collect()}
    assert got == {"qty": 1, "price": 1, "status": 1}
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in ingest.check_references(child, parent, "k", "k").collect()] == [2]
    assert views.search(spark.createDataFrame([("Ann",), ("BOB",)], "n string"), "bo", ["n"]).count() == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    c = Canon(spark, SF)
    filtered = plan(c.t["orders"].where("o_orderstatus = 'F'").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in filtered and "o_totalprice" not in filtered
    assert "o_totalprice" not in plan(an.revenue(c.sold))
    ranked = plan(scale.running(c.orders.select("order_id", "net"), "net", "order_id"))
    assert "Window [row_number" in ranked and ranked.count("FileScan") <= 4
