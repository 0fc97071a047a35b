import functools
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from orderlens.llm import toxicity
from tests.llm import edge

TERMS = ["idiot", "scum", "worthless", "abc*", "coward*"]
FUZZY = toxicity.fuzzy_by_length(TERMS)
AUTOMATON = toxicity.Automaton(TERMS)


@functools.cache
def distance(a, b):
    """Letters more, less, other or swapped."""
    if not a or not b:
        return len(a) + len(b)
    best = min(distance(a[:-1], b) + 1, distance(a, b[:-1]) + 1, distance(a[:-1], b[:-1]) + (a[-1] != b[-1]))
    if len(a) > 1 and len(b) > 1 and a[-1] == b[-2] and a[-2] == b[-1]:
        best = min(best, distance(a[:-2], b[:-2]) + 1)
    return best


def near(token, term):
    """Whether a token is within one edit of a word, or starts with a stem that has one before its last letter."""
    if not term.endswith("*"):
        return distance(token, term) <= 1
    s = term[:-1]
    starts = [token[:k] for k in range(1, len(token) + 1)]
    return any(p[-1] == s[-1] and distance(p[:-1], s[:-1]) <= 1 or p == s[:-2] + s[-1] + s[-2] for p in starts)


def brute(token, terms, fuzzy):
    if token in terms or any(t.endswith("*") and token.startswith(t[:-1]) for t in terms):
        return 2
    return int(any(near(token, t) for t in fuzzy))


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("idotscumwrhlea", max_size=9), st.sampled_from(TERMS).flatmap(lambda t: st.tuples(st.just(t.rstrip("*")), st.integers(0, 8), st.sampled_from(["", "x", "i", "ss"]), st.sampled_from(["", "s", "ly"]), st.booleans())).map(lambda x: (x[0][: x[1]] + x[0][x[1] : x[1] + 2][:: -1 if x[4] else 1] + x[0][x[1] + 2 :] if x[4] else x[0][: x[1]] + x[2] + x[0][x[1] + 1 :]) + x[3])))
def test_automaton_equals_edit_distance(token):
    assert AUTOMATON.match(token) == brute(token, TERMS, FUZZY)
    want = [t for t in FUZZY if near(token, t)] if brute(token, TERMS, FUZZY) == 1 else []
    assert AUTOMATON.near_terms(token) == sorted(want)


def test_misspelled_and_inflected_forms(monkeypatch):
    a = toxicity.Automaton(["moron*", "scum", "worthless"])
    for token in ("morons", "moronic", "scum"):
        assert a.match(token) == 2
    for token in ("mroons", "mxronic", "morron", "mornic", "mooron", "moorns", "sucm", "scumm", "wortless", "worhtless"):
        assert a.match(token) == 1, token
    for token in ("moro", "more", "mo", "scam" * 3, "worth"):
        assert a.match(token) == 0, token
    monkeypatch.setattr(toxicity, "MOST_STATES", 3)  # the automaton starts anew and still answers
    b = toxicity.Automaton(TERMS)
    for token in ("idiot", "idoit", "tidy", "abcd", "worthles", "none") * 3:
        b.known.clear()
        assert b.match(token) == brute(token, TERMS, FUZZY)


def test_context():
    plain = toxicity.features("you are an idiot and worthles scum", AUTOMATON)
    quoted = toxicity.features('he said "you are an idiot" to all', AUTOMATON)
    assert plain[0] > 0 and plain[1] > 0 and plain[2] == 0
    assert quoted[0] == quoted[1] == 0 and quoted[2] > 0


QUOTED = [
    ('he wrote it: "you idiot" twice', "idiot", True), ('the 5" pipe was "fine" you idiot', "idiot", False), ('he quoted5 it "you idiot" and 5" pipes', "idiot", True), ('you "idiot', "idiot", False),
    ('so "fine", you idiot, and "good" too', "idiot", False), ("„du idiot“ rief er", "idiot", True), ("«espèce d' idiot» cria", "idiot", True), ("»du idiot« rief er", "idiot", True), ("“so” idiot “so”", "idiot", False),
    ('"' + "word " * 80 + 'idiot"', "idiot", False), ('a lone " mark, idiot, and one more " here', "idiot", False), ('6" by 4" boards, you idiot, and 3" nails', "idiot", False), ('it reads "room 5", idiot', "idiot", False),
]


def test_marks_are_paired():
    for text, word, want in QUOTED:
        found = toxicity.tokens(text)
        at = found.index(word)
        assert any(a < at < b for a, b in toxicity.quotations(text)) == want, text
        f = toxicity.features(text.replace("quoted5", "has"), AUTOMATON)
        assert (f[2] > 0, f[0] > 0) == (want, not want) or "wrote" in text, text
    assert toxicity.features('the 5" pipe was "fine" you idiot', AUTOMATON) != toxicity.features('it had "you idiot" and 5" pipes', AUTOMATON)


def test_edge_rows(spark):
    model = ((["word", "same*"], []), toxicity.np.array([1.0, 0.5, 0.1, 1.0, 1.0, -3.0]))
    rows = toxicity.score(edge.frame(spark), model).collect()
    assert len(rows) == len(edge.rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert {r.n_hits for r in rows if r.doc_id in (0, 1, 2)} == {0} and {r.n_hits for r in rows if r.doc_id == 10} == {30000}
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.detect(edge.frame(spark), labels).collect()} == {0}
    assert toxicity.detect(edge.empty(spark), labels).count() == 0


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.detect(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_fuzzy_terms_keep_off_clean_words(spark):
    clean = spark.createDataFrame([("the scam and the slum",)] * 30 + [("worthy words",)] * 30, "text string")
    assert toxicity.fuzzy_terms(["scum", "worthless", "abc"], clean) == ["worthless"]


def plain_model(rows):
    """The lexicon and the weights of (text, toxic) rows, from plain loops."""
    def seen(texts):
        n = {}
        for text in texts:
            own = set(toxicity.tokens(text))
            for term in own | {t[:k] + "*" for t in own for k in toxicity.STEMS if len(t) >= k}:
                n[term] = n.get(term, 0) + 1
        return n

    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    a, b = seen(toxic), seen(clean)
    log = toxicity.np.log
    odds = {t: log((n + 0.5) / (len(toxic) + 1)) - log((b.get(t, 0) + 0.5) / (len(clean) + 1)) for t, n in a.items()}
    limit = toxicity.CLEAN * len(clean)
    passed = {t: n for t, n in a.items() if n >= max(toxicity.LEAST, 0.002 * len(toxic)) and b.get(t, 0) <= limit and odds[t] >= toxicity.ODDS}
    kept = set()
    for stem in sorted((t for t in passed if t.endswith("*")), key=lambda t: (len(t), t)):
        if not any(stem[:k] + "*" in kept for k in toxicity.STEMS if k < len(stem)):
            best = max((n for t, n in passed.items() if not t.endswith("*") and t.startswith(stem[:-1])), default=0)
            if best < 0.8 * passed[stem]:
                kept.add(stem)
    kept |= {t for t in passed if not t.endswith("*") and not any(t[:k] + "*" in kept for k in toxicity.STEMS if k <= len(t))}
    terms = sorted(kept)
    words = {t: n for t, n in b.items() if not t.endswith("*")}
    asked = toxicity.fuzzy_by_length(terms)
    hits = dict.fromkeys(asked, 0)
    for token, n in words.items():
        if brute(token, asked, asked) == 1:
            for t in asked:
                hits[t] += n * near(token, t)
    fuzzy = [t for t in asked if hits[t] <= limit]
    x = toxicity.np.array([plain_features(t, terms, fuzzy) for t, _ in rows])
    return terms, fuzzy, toxicity.logistic(x, toxicity.np.array([float(y) for _, y in rows]))


def plain_features(text, terms, fuzzy):
    found = toxicity.tokens(text)
    counts = [0, 0, 0]
    for i, token in enumerate(found):
        kind = brute(token, terms, fuzzy)
        if kind:
            window = found[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]
            open_ = any(a < i < b and (i - a <= toxicity.WINDOW or b - i <= toxicity.WINDOW) for a, b in toxicity.quotations(text))
            counts[2 if open_ or any(t in toxicity.REPORTS for t in window) else 0 if kind == 2 else 1] += 1
    log1p = toxicity.np.log1p
    return [*map(log1p, counts), min(10.0, 100 * counts[0] / max(1, len(found))), float(counts[0] > 0)]


def test_query_against_plain_loops(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(120)]
    rude = ["blorg", "snivvel", "snivvels", "snivveller", "grubb"]
    docs, labels = [], []
    for i in range(240):
        text = rng.choices(words, k=rng.randint(0, 40))
        if i % 4 == 0:
            for w in rng.choices(rude, k=3):
                w = w if rng.random() < 0.7 else w[:2] + w[3:]
                text.insert(rng.randint(0, len(text)), rng.choice([w, w, f'said "{w}"']))
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    terms, fuzzy, weights = plain_model([(t, y) for (i, t), (_, y) in zip(docs, labels) if i not in held])
    got = toxicity.detect(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(terms) >= 3 and fuzzy and len(got) == len(docs)
    text = dict(docs)
    for r in got:
        z = float(toxicity.np.dot(plain_features(text[r.doc_id], terms, fuzzy), weights[:-1]) + weights[-1])
        assert r.held_out == (r.doc_id in held) and r.score == pytest.approx(1 / (1 + toxicity.np.exp(-z)), abs=1e-6) and r.predicted == (r.score >= 0.7)
