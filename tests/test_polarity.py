"""Polarity induced from comments: plain loops, branches that must occur, the scorer hook."""

import math

import duckdb
import pandas as pd
import pytest

from orderlens.operators import polarity
from orderlens.plans import oracles


def plain(comments, rated, rounds=3, seeds=20):
    """Words' polarity and comments' scores by loops over dictionaries."""
    split = lambda t: {w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()}
    own = {i: split(t) for i, t in comments}
    held = {w: sum(w in ws for ws in own.values()) for w in set().union(*own.values())}
    held = {w: n for w, n in held.items() if n >= 2}
    idf = {w: math.log(len(comments) / n) for w, n in held.items()}
    good, bad = ([split(t) for t, g in rated if g == side] for side in (True, False))
    side = lambda w, texts: math.log((sum(w in t for t in texts) + 0.5) / (len(texts) - sum(w in t for t in texts) + 0.5))
    odds = {w: round(side(w, good) - side(w, bad), 9) for w in set().union(*good, *bad) if held.get(w, 0) >= 3}
    seed = dict.fromkeys(sorted((w for w in odds if odds[w] > 0), key=lambda w: (-odds[w], w))[:seeds], 1.0)
    seed |= dict.fromkeys(sorted((w for w in odds if odds[w] < 0), key=lambda w: (odds[w], w))[:seeds], -1.0)
    p = {w: seed.get(w, 0.0) for w in held}

    def scores():
        out = {}
        for i, ws in own.items():
            ws = [w for w in ws if w in held]
            if sum(idf[w] for w in ws):
                out[i] = sum(idf[w] * p[w] for w in ws) / sum(idf[w] for w in ws)
        return out

    for _ in range(rounds):
        s = scores()
        for w in held:
            if w not in seed:
                on = [s[i] for i, ws in own.items() if w in ws and i in s]
                p[w] = sum(on) / len(on) if on else 0.0
    return {w: (x, w in seed) for w, x in p.items()}, scores()


COMMENTS = [
    (1, "lovely box, arrived whole"), (2, "lovely box and a kind note"), (3, "lovely, kind, whole"), (4, "broken box, torn note"), (5, "Broken and torn. Late!"), (6, "late, broken, torn"),
    (7, "the kind that arrived whole"), (8, "late again and torn"), (9, None), (10, ""), (11, "unheard"), (12, "note box"), (13, "box"),
]
RATED = [("lovely lovely", True), ("lovely and kind", True), ("broken", False), ("late and broken", False), (None, True)]


def test_plain_loops(spark):
    comments = spark.createDataFrame(COMMENTS, "id long, text string")
    rated = spark.createDataFrame([(i, *r) for i, r in enumerate(RATED)], "id long, text string, good boolean")
    words, scores = polarity.induce(comments, rated, seeds=2)
    want_words, want_scores = plain(COMMENTS, RATED, seeds=2)
    got = {r.word: (r.polarity, r.is_seed) for r in words.collect()}
    assert got.keys() == want_words.keys() and all(got[w] == (pytest.approx(x), s) for w, (x, s) in want_words.items())
    assert {w for w, (_, s) in got.items() if s} == {"lovely", "kind", "broken", "late"}
    assert {r.id: r.s for r in scores.collect() if r.s is not None} == pytest.approx(want_scores)
    labels = {r.id: (r.sentiment_label, r.sentiment_score) for r in polarity.labelled(comments, scores).collect()}
    assert len(labels) == len(COMMENTS) and {labels[i][0] for i in (1, 2, 3)} == {"POSITIVE"} and {labels[i][0] for i in (5, 6, 8)} == {"NEGATIVE"}
    assert {labels[i] for i in (9, 10, 11)} == {("NEUTRAL", 0.0)}
    none = polarity.induce(comments.limit(0), rated)
    assert none[0].count() == none[1].count() == 0 and polarity.labelled(comments.limit(0), none[1]).count() == 0


def test_rare_words_apart_and_texts_read_once(spark, monkeypatch):
    from tests.test_growth import counted

    comments, read = counted(spark, spark.createDataFrame([(i, t) for i, t in COMMENTS], "id long, text string").coalesce(1))
    rated, read_rated = counted(spark, spark.createDataFrame([(i, *r) for i, r in enumerate(RATED)], "id long, text string, good boolean").coalesce(1))
    want_words, want_scores = plain(COMMENTS, RATED, seeds=2)
    for frequent in (1, 5, 100):
        monkeypatch.setattr(polarity, "FREQUENT", frequent, raising=False)
        words, scores = polarity.induce(comments, rated, seeds=2)
        got = {r.word: (r.polarity, r.is_seed) for r in words.collect()}
        assert got.keys() == want_words.keys() and all(got[w] == (pytest.approx(x), s) for w, (x, s) in want_words.items())
        assert {r.id: r.s for r in scores.collect() if r.s is not None} == pytest.approx(want_scores)
    # comments once for their words and once for their number
    assert read.value == 3 * 2 * len(COMMENTS) and read_rated.value == 3 * len(RATED)
    monkeypatch.setattr(polarity, "FREQUENT", 100, raising=False)
    plan = polarity.induce(comments, rated, seeds=2)[1]._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "hashpartitioning(word" not in plan


def test_both_signs_and_a_fifth_of_the_turns():
    c = duckdb.connect()
    for t in ("conversations", "documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    share = c.execute(oracles.oracle_sql()["a08_induced_sentiment"]).df().sentiment_label.value_counts(normalize=True)
    assert share["POSITIVE"] + share["NEGATIVE"] >= 0.2 and min(share["POSITIVE"], share["NEGATIVE"], share["NEUTRAL"]) >= 0.05


def test_scorer(spark):
    comments = spark.createDataFrame([(1, "good"), (2, None), (3, "bad"), (4, "")], "id long, text string")
    by = lambda texts: pd.DataFrame({"label": ["POSITIVE" if t == "good" else "NEGATIVE" if t == "bad" else "NEUTRAL" for t in texts], "score": [len(t) / 10 for t in texts]})
    assert sorted(map(tuple, polarity.score_by(comments, by).collect())) == [(1, "POSITIVE", 0.4), (2, "NEUTRAL", 0.0), (3, "NEGATIVE", 0.3), (4, "NEUTRAL", 0.0)]
    with pytest.raises(Exception, match="a scorer gives"):
        polarity.score_by(comments, lambda texts: pd.DataFrame({"label": "good", "score": 2.0}, index=texts.index)).collect()
