import hashlib

import pytest
import xxhash

from orderlens.llm import minhash
from tests.llm import edge


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def check(rows, docs):
    docs = sorted(((d is not None, d or 0, t or "") for d, t in docs))
    assert len(rows) == len(docs)
    want = []
    for i, (has, d, t) in enumerate(docs):
        new = minhash.edited(t, docs[(i + 1) % len(docs)][2])
        want.append((has, d, len(t), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in rows) == sorted(want)
    return docs


def test_words_are_hashed_as_before_and_copies_signed_once(spark):
    h = minhash.Hasher()
    assert h.words("One  \x1dtwo\nONE \u00c9").tolist() == [xxhash.xxh64_intdigest(w, 1) for w in (b"one", b"\x1dtwo", b"one", "\u00c9".encode())]
    assert h.words("").tolist() == [] and not vars(h)
    texts = spark.createDataFrame([(i % 3, f"some words of text {i % 3}") for i in range(3000)], "id long, text string").coalesce(1)
    found = [(r.id, r.bands) for r in minhash.marks(texts).collect()]
    assert len(found) == 3
    assert dict(found) == {i: minhash.bands(minhash.signature(h.shingles(f"some words of text {i}"))) for i in range(3)}


@pytest.mark.parametrize("parts", [1, 3, 200])
def test_edge_rows(spark, parts):
    check(minhash.edit_report(edge.frame(spark), parts).collect(), [(r[0], r[1]) for r in edge.rows()])
    assert minhash.edit_report(edge.empty(spark), parts).count() == 0
    one = spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    assert [(r.doc_id, r.near_edited < 1, r.near_next) for r in minhash.edit_report(one, parts).collect()] == [(7, True, 1.0)]


def test_given_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = minhash.edit_report(d, 5).collect()
    docs = check(rows, [(r.doc_id, r.text) for r in d.collect()])
    by = {r.doc_id: r for r in rows}
    plain = {r.doc_id: r.fingerprint for r in minhash.fingerprints(d).collect()}
    texts = {}
    off = []
    for i, (_, doc, t) in enumerate(docs):
        assert texts.setdefault(t, by[doc].fingerprint) == by[doc].fingerprint == plain[doc]
        nxt = docs[(i + 1) % len(docs)][2]
        for other, got in ((minhash.edited(t, nxt), by[doc].near_edited), (nxt, by[doc].near_next)):
            a, b = shingles(t), shingles(other)
            off.append(abs(len(a & b) / len(a | b) - got))
    assert max(off) < 0.2 and sum(off) / len(off) < 0.03


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(10_000 + r.doc_id, r.text + " and one more word here") for r in docs.orderBy("doc_id").limit(60).collect()]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    rows = [(r.doc_id, shingles(r.text)) for r in docs.orderBy("doc_id").collect()]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}
    assert sum(d != c for d, c in want.items()) > 30
    assert {r.doc_id: r.class_id for r in minhash.near_copies(docs).collect()} == want
    got = minhash.near_copies(edge.frame(spark)).collect()
    assert len(got) == len(edge.rows()) and len({r.class_id for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert minhash.near_copies(edge.empty(spark)).count() == 0


def test_hot_ids_fill_many_ranges(spark):
    docs = [(None if i % 3 else i, f"text {i} of these") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    runs, n = minhash.in_runs(frame, 12)
    sizes = [r["count"] for r in runs.where("not extra").groupBy("part").count().collect()]
    assert n == 12 and max(sizes) < 600 and sum(sizes) == 3000
    assert sorted(r.n_chars for r in minhash.edit_report(frame, 12).collect()) == sorted(len(t) for _, t in docs)


def test_borders_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(minhash, "COARSE", 4)
    frame = spark.range(1000).selectExpr("id as doc_id", "cast(id as string) as text")
    runs, n = minhash.in_runs(frame, 16)
    sizes = [r["count"] for r in runs.where("not extra").groupBy("part").count().collect()]
    assert n == 16 and max(sizes) < 100
    check(minhash.edit_report(frame, 16).collect(), [(i, str(i)) for i in range(1000)])
