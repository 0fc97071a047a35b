import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from orderlens.llm import fim, queries
from tests.llm import edge

UNITS = {fim.CHARACTER: "(?s:.)", fim.WORD: r"[ \t-\r]*[^ \t-\r]+", fim.LINE: r"[^\n]*\n|[^\n]+"}


def brute(doc_id, text, unit=fim.CHARACTER, plan=fim.Plan()):
    """(n, form, prefix, middle, output) in plain Python."""
    text = text or ""
    ends, find = [0], re.compile(UNITS[unit])
    while m := find.match(text, ends[-1]):
        ends.append(m.end())
    n = len(ends) - 1
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if n == 0 or any(m in text for m in plan.marks) or h[2] % 100 >= plan.cut_percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    P, S, M = plan.marks
    if h[3] % 100 < plan.suffix_first_percent:
        return n, "spm", a, b - a, S + s + P + p + M + m
    return n, "psm", a, b - a, P + p + S + s + M + m


def check(spark, rows, unit=fim.CHARACTER, plan=fim.Plan()):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.transform(docs, unit, plan)
    got = sorted(map(str, map(tuple, out.collect())))
    assert got == sorted(str((i, *brute(i, t, unit, plan))) for i, t in rows)
    assert sorted(map(str, map(tuple, fim.restore(out, plan).collect()))) == sorted(str((i, t or "")) for i, t in rows)


PIECES = st.one_of(st.text(max_size=30), st.sampled_from(["<P>", "<S", "<", "M>", "𝔘é", "\n", "\r\n", " \t", "$1\\", "{2}", "word " * 300, "é" * 256, "𝔘" * 513]))
TEXT = st.lists(PIECES, max_size=8).map("".join).map(lambda t: t.encode("utf-8", "ignore").decode())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 2**62), st.one_of(st.none(), TEXT)), max_size=20))
def test_any_text_equals_brute_force(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize("unit", UNITS)
def test_units_and_plans(spark, unit):
    texts = ["", " ", "one", "one two\nthree", " a  b\n\nc ", "no end\n", "\n\n", "<P> in it", "𝔘 é " * 400, "x" * 700, "line\n" * 600]
    rows = [(i, t) for i, t in enumerate(texts * 9)]
    check(spark, rows, unit)
    check(spark, rows, unit, fim.Plan("<$1>", "\\s", "{m}", 100, 50, "seed"))


def test_every_form_occurs_and_shares_hold(spark):
    rows = fim.transform(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))).groupBy("form").count().collect()
    share = {r["form"]: r["count"] / 20_000 for r in rows}
    assert abs(share["plain"] - 0.1) < 0.01 and abs(share["spm"] - 0.18) < 0.01 and abs(share["psm"] - 0.72) < 0.015


def test_marks_apart(spark):
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "<P>S", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(edge.frame(spark), plan=fim.Plan(*marks))


def test_very_long_text(spark):
    text = "é𝔘 " * 1_500_000
    row = fim.transform(spark.createDataFrame([(3, text)], "doc_id long, text string")).first()
    assert tuple(row)[1:] == brute(3, text)


def test_edge_rows(spark):
    got = sorted(map(str, map(tuple, fim.transform(edge.frame(spark)).collect())))
    assert got == sorted(str((r[0], *brute(r[0], r[1]))) for r in edge.rows())
    assert fim.transform(edge.empty(spark)).count() == 0


def test_given_table_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = queries.op11_counted_cuts(spark, sf)
    want = c.execute(fim.ORACLE)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
