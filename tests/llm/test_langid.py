import itertools
import math

import numpy as np
import pytest

from orderlens.llm import langid
from tests.llm import edge

PIECES = langid.Pieces({"▁": 1, "▁a": 2, "a": 3, "b": 4, "ab": 5, "▁ab": 6, "ba": 7})


def brute(word, p):
    """All segmentations of a word; letters without a piece count as piece 0."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        ids = [PIECES.get(x, 0 if len(x) == 1 else -1) for x in parts]
        total += math.prod(p[i] for i in ids)
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    p = rng.random((9, 2))
    p[-1] = 0
    for word in ("▁a", "▁abab", "▁bxaba", "▁zz"):
        got = langid.forward(langid.lattice([word], PIECES), p)[-1][0]
        assert got == pytest.approx([brute(word, p[:, 0]), brute(word, p[:, 1])])
        assert langid.backward(langid.lattice([word], PIECES), p)[0][0] == pytest.approx(got)
        logs = np.log(p, where=p > 0, out=np.full_like(p, -np.inf))
        assert np.exp(langid.log_forward(langid.lattice([word], PIECES), logs)[-1][0]) == pytest.approx(got)
        assert np.exp(langid.log_backward(langid.lattice([word], PIECES), logs)[0][0]) == pytest.approx(got)
    from collections import Counter

    e = langid.expected(Counter({"▁abab": 3}), PIECES, p[:, :1])
    eps = 1e-6  # the derivative of the log of a sum of products is an expected count
    for i in (2, 5, 6):
        up = p[:, 0].copy()
        up[i] *= 1 + eps
        assert e[i] == pytest.approx(3 * (math.log(brute("▁abab", up)) - math.log(brute("▁abab", p[:, 0]))) / eps, rel=1e-3)


def test_long_words_and_whole_vocabulary(monkeypatch):
    from collections import Counter

    rng = np.random.default_rng(2)
    p = rng.random((9, 1))
    p[-1] = 0
    counts = Counter({"▁" + "ab" * 15: 2, "▁abbaab": 1})
    want = langid.expected(counts, PIECES, p)
    monkeypatch.setattr(langid, "SHORT", 3)
    assert langid.expected(counts, PIECES, p) == pytest.approx(want)
    pieces = langid.vocabulary(langid.public_path())
    assert pieces.longest > 12 and len(pieces) > 23_900
    model = langid.Model(["x", "y"], np.c_[np.full(len(pieces) + 2, 1e-5), np.full(len(pieces) + 2, 2e-5)], langid.public_path())
    langs, scores = model.score(["q" * 3000 + " " + "a" * 500])
    assert langs == ["y"] and np.isfinite(scores[0]) and np.isfinite(model.logs).all()


def test_rare_letters_do_not_underflow():
    pieces = langid.vocabulary(langid.public_path())
    assert "\ua015" not in pieces and "\ua015".isalpha()
    word = "\ua015" * 38 + "a"
    for small in (2e-9, 1e-12, 1e-40):
        p = np.full((len(pieces) + 2, 2), 1e-5)
        p[0], p[-1] = (small, 2 * small), 0
        langs, scores = langid.Model(["x", "y"], p, langid.public_path()).score([word, f"{word} some words of it"])
        assert langs == ["y", "y"] and all(0.99 < s <= 1 for s in scores)
    with np.errstate(divide="ignore"):
        none = langid.Model(["x"], np.zeros((len(pieces) + 2, 1)), langid.public_path())
    assert none.score(["abc"]) == (["und"], [0.0])


def plain_words(text):
    out, run = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            run += c
        elif not (c.isalnum() and run or c.isalnum()):
            if run:
                out.append("\u2581" + run)
            run = ""
    return out


def plain_ways(word, ids, p):
    """(sums up to each letter, sums from each letter on, the pieces' places)."""
    n = len(word)
    at = [[(k, ids.get(word[i : i + k], 0 if k == 1 else -1)) for k in range(1, min(16, n - i) + 1)] for i in range(n)]
    at = [[(k, x) for k, x in own if x >= 0] for own in at]
    a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i in range(n):
        for k, x in at[i]:
            a[i + k] += a[i] * p[x]
    for i in range(n - 1, -1, -1):
        b[i] = sum(p[x] * b[i + k] for k, x in at[i])
    return a, b, at


def test_whole_query_equals_a_plain_version(spark):
    import zlib
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).union(spark.createDataFrame([(9001, None, None, "s", 0), (9002, "12 +", "en", "s", 4), (9003, "\u4e2d\u6587 le", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = docs.collect()
    ids = dict(langid.vocabulary(langid.public_path()))
    assert max(map(len, ids)) == 16
    size = len(ids) + 1
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    sums = defaultdict(lambda: [0.5] * size)
    for r in rows:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            own = sums[r.lang]
            for w, times in Counter(plain_words(r.text)).items():
                a, b, at = plain_ways(w, ids, [1 / size] * size)
                for i, places in enumerate(at):
                    for k, x in places:
                        own[x] += times * a[i] / size * b[i + k] / a[-1]
    langs = sorted(sums)
    p = {lang: [x / sum(own) for x in own] for lang, own in sums.items()}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ws = plain_words(r.text)
        want = ("und", 0.0)
        if ws:
            logs = [sum(math.log(plain_ways(w, ids, p[lang])[0][-1]) for w in ws) for lang in langs]
            odds = [math.exp(x - max(logs)) for x in logs]
            want = langs[odds.index(max(odds))], max(odds) / sum(odds)
        assert got[r.doc_id].held_out == held[r.doc_id] and got[r.doc_id].lang_pred == want[0] and got[r.doc_id].score == pytest.approx(want[1], abs=1e-9)


def test_edge_rows(spark):
    rows = langid.identify(edge.frame(spark)).collect()
    assert len(rows) == len(edge.rows())
    none = {0, 1, 2}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == none
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(edge.empty(spark)).count() == 0
    only = spark.createDataFrame([(1, "abc def", None), (2, "12 34 ²½ _", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(only).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in r) >= 0.98 * len(r) > 100
