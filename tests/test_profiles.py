"""Columns found by their values."""

import duckdb
from pyspark.sql import functions as F

from orderlens.operators import profiles
from orderlens.plans import oracles, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_renamed_columns_are_found_by_values_alone():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    found = c.execute(oracles.oracle_sql()["in3_map_by_values"]).fetchall()
    want = ["external_id", "order_date", "total_amount", "email", "country"]
    assert {(j, h): m for j, h, _, m, *_ in found} == {(j, h): m for j, own in enumerate(registry.UPLOADS) for h, m in zip(own, want)}
    by = {(j, h): (m, how) for j, h, _, m, _, how, _ in c.execute(oracles.oracle_sql()["in5_resolve_uploads"]).fetchall()}
    assert len({tuple(own) for own in registry.UPLOADS}) == 3 and {how for _, how in by.values()} >= {"exact", "values"}
    assert all(by[2, h] == (m, "values") for h, m in zip(registry.UPLOADS[2], want))


def test_small_columns_and_edge_cases(spark):
    up = spark.createDataFrame([(1, "x", "12.50"), (1, "x", "3.99"), (1, "y", "a@b.c"), (1, "z", "2001-02-03")], "upload_job_id int, csv_header string, value string")
    to = spark.createDataFrame([("t", "price", "100.00"), ("t", "price", "3.99"), ("t", "mail", "dd@e.f"), ("t", "day", "1999-12-31"), ("t", "empty", None)], "mapped_table string, mapped_column string, value string").where("value is not null")
    got = {r.csv_header: (r.mapped_column, r.match_score) for r in profiles.map_by_values(up, to).collect()}
    assert {h: m for h, (m, _) in got.items()} == {"x": "price", "y": "mail", "z": "day"} and all(0 < s <= 1 for _, s in got.values())
    assert profiles.map_by_values(up.limit(0), to).count() == 0
    same = profiles.similarity(up, up.toDF("a", "b", "value"), ["upload_job_id", "csv_header"], ["a", "b"]).where("csv_header = b").collect()
    assert len(same) == 3 and all(r.score == 1.0 for r in same)
    table = spark.createDataFrame([(1, " a "), (2, None), (3, "")], "k int, v string")
    assert sorted(map(tuple, profiles.values(table, ["k", "v"], job=F.lit(7)).collect())) == [(7, "k", "1"), (7, "k", "2"), (7, "k", "3"), (7, "v", "a")]
