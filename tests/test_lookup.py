"""Searches and pages by stored indexes give what the plain ones give."""

from pyspark.sql import functions as F

from orderlens.operators import lookup, views


def test_search_by_postings(spark, tmp_path):
    rows = [(1, "Anna Ring", "a@x.org"), (2, "ring", None), (3, "Bringer", "b@x.org"), (4, None, "string@x.org"), (5, "rin", "ing"), (6, "", ""), (7, "aaaa", "RİNG x"), (8, "ri ng", "c@x")]
    df = spark.createDataFrame(rows, "k long, name string, mail string")
    path = str(tmp_path / "postings")
    lookup.write_postings(df, "k", ["name", "mail", "k"], path)
    for text in ("ring", "RING", "aaa", "x.o", "rin", "ri", "", "7", "nothing at all", "a@x.org"):
        got = sorted(r.k for r in lookup.search(df, "k", text, ["name", "mail", "k"], path).collect())
        assert got == sorted(r.k for r in views.search(df, text, ["name", "mail", "k"]).collect()), text
    plan = lookup.candidates(spark, path, "ring")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(gram" in plan
    assert lookup.candidates(spark, path, "ri") is None


def test_pages_by_number(spark):
    df = spark.range(103).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("v")).union(spark.createDataFrame([(500, None)], "k long, v int"))
    for descending in (True, False):
        want = sorted(((r.v, r.k) for r in df.where("v is not null").collect()), key=lambda x: (-x[0] if descending else x[0], x[1]))
        borders = lookup.page_borders(df, "v", "k", 10, descending)
        assert sorted(r.page for r in borders.collect()) == list(range(1, 12))
        for page in (1, 2, 7, 11, 12, 0):
            got = [(r.v, r.k) for r in lookup.page_at(df, borders, page, "v", "k", 10, descending).collect()]
            assert got == (want[(page - 1) * 10 : page * 10] if page else [])
