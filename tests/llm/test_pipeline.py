import hashlib
import importlib

from orderlens.llm import langid, linededup
from tests.llm import edge
from tests.llm.test_bpe import library
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages_against_plain_versions(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stages = dict(p.STAGES)
    a = stages["language ID"](spark, docs, d).cache()
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in langid.identify(docs).where("lang_pred != 'und'").where(f"score >= {langid.SURE}").collect()}
    assert a.columns == columns and {r.doc_id for r in a.collect()} == kept and len(kept) >= 0.98 * len(rows)

    b = stages["line dedup"](spark, a, d).cache()
    want, _ = brute_lines([(i, rows[i].text) for i in kept], linededup.LEAST_WORDS)
    got = {r.doc_id: r for r in b.collect()}
    assert b.columns == columns and {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())

    c = stages["SimHash near-dedup"](spark, b, d).cache()
    items = [(i, brute_fingerprint(t)) for i, t in want.items()]
    assert c.columns == columns and sorted(r.doc_id for r in c.collect()) == sorted({x for _, _, x in brute_components(items)})

    e = stages["mixing sources"](spark, c, d).cache()
    sizes = {r.doc_id: (r.source, len(r.text.encode().split())) for r in c.collect()}
    turns = {}
    for r in e.collect():
        turns[r.doc_id] = turns.get(r.doc_id, 0) + 1
    total = sum(n for _, n in sizes.values())
    assert e.columns == columns and set(turns.values()) <= {1, 2, 3} and 0.9 * total <= sum(sizes[i][1] * n for i, n in turns.items()) <= total

    f = stages["BPE encoding"](spark, e, d).collect()
    assert sorted(r.doc_id for r in f) == sorted(i for i, n in turns.items() for _ in range(n))
    for r in f:
        assert r.ids_sha256 == hashlib.sha256(library(want[r.doc_id])).hexdigest() and len(r.ids) == r.n_tokens
    assert sorted((r.doc_id, r.ids_sha256) for r in p.run(spark, d).collect()) == sorted((r.doc_id, r.ids_sha256) for r in f)


def test_edge_rows_pass_every_stage(spark):
    p = importlib.import_module("corpus_pipeline")
    for frame in (edge.frame(spark), edge.empty(spark)):
        docs = frame
        for name, stage in p.STAGES:
            out = stage(spark, docs, None)
            assert out.count() >= 0 and (name == "BPE encoding" or out.columns == docs.columns)
            docs = out if name != "BPE encoding" else docs
