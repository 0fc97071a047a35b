import hashlib
import random

import numpy as np
import pytest

from orderlens.llm import runindex
from tests.llm import edge


def brute(docs, length=100):
    """(kept, spans) of each document; docs: (sortable id, text)."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = kept, int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
    return out


@pytest.mark.parametrize("length", [100, 7, 12, 13])
def test_index_marks_equal_earlier_strings(length):
    rng = random.Random(length)
    for _ in range(12):
        pool = bytes(rng.choice(b"ab") for _ in range(160))
        contents = []
        for _ in range(rng.randint(1, 30)):
            a = rng.randint(0, 60)
            x = bytearray(pool[a : a + rng.randint(1, 140)])
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] ^= 3
            contents.append(bytes(x))
        index = runindex.RunIndex(contents, length)
        seen, want = set(), []
        for c in contents:
            hits = []
            for i in range(len(c) - length + 1):
                hits += [i] if c[i : i + length] in seen else []
                seen.add(c[i : i + length])
            want.append(hits)
        assert [m.tolist() for m in index.marks()] == want
        assert sum(np.diff(np.append(index.run_start, index.size))) == index.size and len(index.run_start) <= index.size


def texts(n=120, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 60)
            parts += [" ".join(word() for _ in range(rng.randint(0, 30))), p[a : a + rng.randint(80, 300)]]
        out.append(" ".join(parts))
    return out + ["xyz" * 300, "a" * 700, "ab" * 90 + "é" * 200, out[0], out[1], out[1]]


@pytest.mark.parametrize("crowd", [runindex.CROWD, 2])
def test_documents_against_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(runindex, "CROWD", crowd)
    monkeypatch.setattr(runindex, "HASH_BYTES", 3000)
    monkeypatch.setattr(runindex, "INDEX_BYTES", 2000)
    docs = list(enumerate(texts()))
    random.Random(1).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in runindex.dedup(frame).collect()}
    assert got == brute(docs)


def test_crowds_and_joined_keys(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    docs = list(enumerate(" ".join(word() for _ in range(rng.randint(0, 40))) + passage + word() * rng.randint(0, 9) for _ in range(90)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    parted = []
    monkeypatch.setattr(runindex, "refined", lambda x, f=runindex.refined: parted.append(1) or f(x))
    for crowd, most in ((8, runindex.occurrences.__defaults__[0]), (3, 10), (10**6, 10)):
        monkeypatch.setattr(runindex, "CROWD", crowd)
        monkeypatch.setattr(runindex.occurrences, "__defaults__", (most,))
        got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in runindex.dedup(frame).collect()}
        assert got == want
    assert len(parted) >= 4  # a passage with ever other surroundings is parted again and again


def test_index_finds_all_marks_but_whole_contents(spark):
    a, b = "x" * 10 + "abcdefghij" * 3 + "0123456789" * 9, "y" * 10 + "abcdefghij" * 3 + "0123456789" * 9
    frame = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    rows = runindex._keyed(frame)
    pieces = runindex.cut(runindex.occurrences(rows))
    assert pieces.where("body is not null").count() >= 2
    tables, rest = runindex.settled(pieces, runindex.CROWD)
    assert rest is None and sum(r.b - r.a for r in tables[1].collect()) > 0


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(runindex, "HASH_BYTES", 257)
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    docs = [(1, body), (2, body[700:1400] + "!" + body[100:1900] + "aaaa" * 90)]
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in runindex.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_edge_rows(spark):
    rows = runindex.dedup(edge.frame(spark)).collect()
    assert len(rows) == len(edge.rows())
    want = brute([(-1 if r[0] is None else r[0], r[1]) for r in edge.rows()[: len(edge.TEXTS) + 1] + edge.rows()[-1:]])
    for r in rows:
        kept, gone, spans = want[-1 if r.doc_id is None else r.doc_id]
        assert (bytes(r.kept), r.n_removed, r.n_spans, r.kept_sha256) == (kept, gone, spans, hashlib.sha256(kept).hexdigest())
    assert runindex.dedup(edge.empty(spark)).count() == 0


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.kept_sha256, r.n_removed, r.n_spans) for r in runindex.dedup(docs, with_text=False).collect()}
    assert got == {d: (hashlib.sha256(k).hexdigest(), n, s) for d, (k, n, s) in want.items()}
