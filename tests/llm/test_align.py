import hashlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from orderlens.llm import align, bpe, queries
from tests.llm import edge

PATHS = align.public_paths()
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
BACK = {c: b for b, c in bpe.byte_letters().items()}


def a_bytes(i):
    return bytes(BACK[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def tokens(text):
    """(ids, start, end) of both, by the libraries on the whole text."""
    if not text:
        return [], []
    sides = []
    for ids, of in ((A.encode(f" {text}", add_special_tokens=False).ids, a_bytes), (B.encode(text), b_bytes)):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(of(i))))
            at = side[-1][2]
        if b"".join(map(of, ids)) != f" {text}".encode():
            return [], []
        sides.append(side)
    return sides


def brute(texts):
    """The rows of texts, links by comparing the byte ranges of all tokens."""
    sides = [tokens(t) for t in texts]
    links = [[(x, y) for x, s, e in a for y, u, v in b if s < v and u < e] for a, b in sides]
    counts = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (a, b), own in zip(sides, links):
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, last = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, _, e in side if last < e <= end) for side in (a, b)))
            last = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(own), sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), digest))
    return out, counts, most


def check(spark, rows, get=None):
    got = align.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_groups=False)
    want, *_ = brute([t for _, t in rows])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *w)) for (i, _), w in zip(rows, want))


TEXT = st.lists(st.one_of(st.text(max_size=12), st.text("ab 'st\n\x1c\x85\xa0　 é×中𝔘", max_size=30), st.sampled_from(["<|endoftext|>", "<s>", "<0x41>", "▁x", "  ", "\n  a", "unbelievable", " the"]))).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT.map(lambda t: t.encode("utf-8", "ignore").decode()))
def test_ids_equal_the_libraries_on_any_text(text):
    a, _, b, _ = align.tokenizers(*PATHS).tokens([text])
    assert [a.tolist(), b.tolist()] == [[i for i, *_ in side] for side in tokens(text)]


@settings(max_examples=8, deadline=None)
@given(st.lists(TEXT.map(lambda t: t.encode("utf-8", "ignore").decode()), min_size=1, max_size=12))
def test_any_documents_equal_brute_force(spark, texts):
    check(spark, list(enumerate(texts)))


def test_edge_rows(spark):
    rows = [(r[0], r[1] if r[1] != edge.LONG else edge.LONG[:3000]) for r in edge.rows()]
    check(spark, rows)
    full = align.align(edge.frame(spark), with_groups=False).toPandas()
    long = full[full.doc_id == edge.TEXTS.index(edge.LONG)].iloc[0]
    a, b = tokens(edge.LONG)
    assert (long.n_a, long.n_b) == (len(a), len(b)) and len(full) == len(edge.rows())
    assert align.align(edge.empty(spark)).count() == 0
    assert align.id_map(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("block, kept", [(1, 3), (50, 10**6)])
def test_blocks_and_memory_change_nothing(monkeypatch, block, kept):
    """Blocks of one document, and memory that starts anew all the time, number the same windows and pairs."""
    texts = ["the cat sat on the mat", "a cat's unbelievable tale\n\nthe end", "", None, "the cat", "Été à la plage " * 9]
    monkeypatch.setattr(align, "BLOCK_CHARS", block)
    monkeypatch.setattr(align, "REMEMBERED", kept)
    assert [e for _, e in align._blocks(texts)][-1] == len(texts)
    t = align.Tokenizers(*PATHS)
    for start, end in align._blocks(texts):
        windows, count = t.cut_windows(*t.tokens(texts[start:end]))
        got = ["".join(t.texts[w] for w in ws)[:-1] for ws in np.split(windows, np.cumsum(count)[:-1])]
        for text, groups in zip(texts[start:end], got):
            assert (hashlib.sha256(groups.encode()).hexdigest() if groups else "") == brute([text])[0][0][-1]


def test_long_word_goes_through_the_pair_index(spark):
    check(spark, [(1, "x" * 1500 + " end"), (2, "ab" * 700), (3, "the end")])


def test_given_table_and_map(spark):
    sf = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    short = docs[docs.text.str.len() < 4000]
    frame = spark.createDataFrame(short[["doc_id", "text"]].values.tolist(), "doc_id long, text string")
    want, counts, most = brute(short.text.tolist())
    got = sorted(map(tuple, align.align(frame, with_groups=False).collect()))
    assert got == sorted((i, *w) for i, w in zip(short.doc_id, want))
    pairs = {(r.a, r.b): (r.n_docs, r.best) for r in align.id_map(frame).collect()}
    assert pairs == {p: (n, n == most[p[0]]) for p, n in counts.items()}
    whole = {r.doc_id: r for r in queries.op12_space_anchors(spark, sf).collect()}
    assert len(whole) == len(docs)
    for d in docs.itertuples():
        a, b = tokens(d.text)
        assert (whole[d.doc_id].n_a, whole[d.doc_id].n_b) == (len(a), len(b))
