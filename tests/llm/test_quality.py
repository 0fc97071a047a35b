import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from orderlens.llm import quality
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(["a", "b", "#é", "\n", " ", "\x0b", " "]), max_size=60).map(" ".join)))
def test_base_measures(text):
    m = quality.measure(text)
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute(text)


def brute_kept(text):
    """The verdict of the current policy, from plain counts."""
    text = text or ""
    w = WORD.findall(text)
    n, _, symbols, _, repeats = brute(text)
    letters, upper = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    solid = sum(not WORD.fullmatch(c) is None for c in text)
    runs = sum(a == b for a, b in zip(w, w[1:]))
    rules = [n >= 20, 100 * repeats <= 30 * n]
    if n:
        rules += [symbols / n <= 0.10, text.count("!") / n <= 0.25, runs / n <= 0.25]
    rules += [upper / max(letters, 1) <= 0.35, not solid or letters / solid >= 0.40]
    return all(rules)


def test_given_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.apply(quality.ledger(docs)).collect()
    kept = [r.kept for r in rows]
    assert len(rows) == len(texts) and 0 < sum(kept) < len(kept)
    for r in rows:
        assert r.kept == brute_kept(texts[r.doc_id]), r.doc_id
        if r.n_words < 3000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "ÄÖ", "#", "!", "12", "ok", "don't"]), min_size=15, max_size=60).map(" ".join))
def test_verdicts(text):
    m = quality.measure(text)
    assert (quality.failures(m) & (quality.BASE | quality.CURRENT.mask) == 0) == brute_kept(text)


def test_edge_rows_policies_and_ablations(spark):
    led = quality.ledger(edge.frame(spark)).cache()
    assert led.count() == len(edge.rows()) and quality.ledger(edge.empty(spark)).count() == 0
    rows = quality.apply(led).collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    for r in quality.ablations(led).collect():
        p = next(p for p in quality.POLICIES if p.version == r.policy)
        bit = quality.BIT[r.rule]
        assert r.n_failed == sum(bool(x.failed & bit) for x in rows)
        assert r.n_only == sum(x.failed & p.mask == bit for x in rows)


def test_labelled_rows(spark):
    d = "/root/testdata/sf0.1"
    rows = quality.apply(quality.ledger(spark.read.parquet(f"{d}/documents.parquet"))).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    kept = {(r.quality, r.kept): r["count"] for r in rows.where("n_words >= 20").groupBy("quality", "kept").count().collect()}
    for good in (0, 1):
        right = kept.get((good, bool(good)), 0)
        assert right >= 0.97 * (right + kept.get((good, not good), 0)) > 0
