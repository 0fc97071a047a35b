import hashlib

from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from orderlens.llm import bpe
from tests.llm import edge

TOKENIZER = Tokenizer.from_file(bpe.public_path())


def library(text):
    return b"".join(i.to_bytes(4, "little") for i in TOKENIZER.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab 'st\n\x1c\x1f\x85 é×÷²½", max_size=40), st.just("<|endoftext|>"))).map("".join))
def test_any_text_equals_the_library_and_round_trips(text):
    ids = bpe.codec(bpe.public_path()).encode([text])[0]
    assert ids == library(text)
    assert bpe.codec(bpe.public_path()).decode(ids) == text


def test_documents_and_edge_rows(spark):
    docs = edge.frame(spark)
    got = bpe.encode(docs).orderBy("doc_id").collect()
    texts = [r[1] or "" for r in sorted(edge.rows(), key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [r.doc_id for r in got] == sorted((r[0] for r in edge.rows()), key=lambda i: (i is not None, i or 0))
    for r, text in zip(got, texts):
        ids = library(text)
        assert r.n_tokens == len(ids) // 4 and r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(r.text for r in bpe.decode(bpe.encode(docs)).collect()) == sorted(texts)
    assert bpe.encode(edge.empty(spark)).count() == 0


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: hashlib.sha256(library(r.text)).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.ids_sha256 for r in bpe.encode(docs, with_ids=False).collect()} == want
