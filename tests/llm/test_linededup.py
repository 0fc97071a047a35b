from hypothesis import HealthCheck, Phase, given, settings, strategies as st

from orderlens.llm import linededup
from tests.llm import edge


def brute(docs, least):
    """Places of the lines that go, by looking at every run of every document. docs: (doc_id, text), ids distinct."""
    seqs = {d: [(i, x) for i, x in enumerate(t.split("\n")) if x.encode().split()] if t else [] for d, t in docs}
    seen, gone = {}, {d: set() for d, _ in docs}
    for d in sorted(seqs):
        for s in range(len(seqs[d])):
            words = 0
            for e in range(s, len(seqs[d])):
                words += len(seqs[d][e][1].encode().split())
                run = tuple(x for _, x in seqs[d][s : e + 1])
                if words >= least and seen.setdefault(run, (d, s)) < (d, s):
                    gone[d] |= {i for i, _ in seqs[d][s : e + 1]}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) if t is not None else None for d, t in docs}, {d: len(g) for d, g in gone.items()}


LINES = st.lists(st.sampled_from(["a", "b c", "d e f", "", "  ", "a a a a a a"]), max_size=12).map("\n".join)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.lists(LINES, max_size=6), min_size=3, max_size=3))
def test_any_lines(spark, groups):
    for least, texts in zip((1, 5, 9), groups):
        docs = list(enumerate(texts))
        text, n = brute(docs, least)
        rows = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()
        assert {r.doc_id: r.text for r in rows} == text and {r.doc_id: r.n_removed for r in rows} == n


def test_edge_rows(spark):
    rows = linededup.dedup(edge.frame(spark)).collect()
    assert len(rows) == len(edge.rows())
    assert all(r.text is None and r.n_lines == 0 for r in rows if r.doc_id == 1)
    assert [r.n_removed for r in sorted(rows, key=lambda r: r.doc_id or -1) if r.doc_id in (10, 11)] == [0, 1]
    assert [r.n_removed for r in rows if r.doc_id == 5] == [0, 0]
    assert all(r.n_chars == len(r.text) for r in rows if r.doc_id == 11)
    assert linededup.dedup(edge.empty(spark)).count() == 0


def test_short_hot_lines_go_in_the_pipeline(spark):
    import corpus_pipeline

    docs = [(i, f"All rights reserved.\nown line {i}\nok") for i in range(6)]
    rows = corpus_pipeline.line_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), None).collect()
    assert {r.doc_id: r.text for r in rows} == brute(docs, 1)[0]
    assert sorted(r.text for r in rows)[1:] == [f"own line {i}" for i in range(1, 6)]


def test_a_long_run_is_one_maximal_run_found_by_doubling(spark, monkeypatch):
    run = [f"line {i} of it" for i in range(9)]
    docs = [(1, "\n".join(["own", *run, "end"])), (2, "\n".join([*run[:3], "between", *run, "\n", "end"])), (3, "\n".join(run[2:4] + run[7:]))]
    spans = []
    doubled = linededup.doubled
    monkeypatch.setattr(linededup, "doubled", lambda level, span, width: spans.append(span) or doubled(level, span, width))
    rows = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert spans == [1, 2, 4, 8]  # nothing of 16 lines is tried, as nothing of 8 and 8 more repeats
    assert {d: r.text for d, r in rows.items()} == brute(docs, 1)[0]
    assert [(rows[d].n_removed, rows[d].n_runs) for d in (1, 2, 3)] == [(0, 0), (13, 2), (4, 1)]


def test_merged_stretches(spark):
    rows = [(1, 0, 2, 4), (1, 0, 3, 1), (1, 0, 5, 2), (1, 0, 7, 1), (1, 0, 9, 2), (1, 7, 0, 1), (2, 0, 4, 3), (2, 0, 9, 1)]
    got = linededup.merged(spark.createDataFrame(rows, "id long, row long, seq int, n int")).collect()
    lines = {(i, r, s + k) for i, r, s, n in rows for k in range(n)}
    assert len(got) == len(lines) and {(g.id, g.row, g.seq) for g in got} == lines
    assert {(g.id, g.row, g.seq) for g in got if g.first} == {(1, 0, 2), (1, 0, 9), (1, 7, 0), (2, 0, 4), (2, 0, 9)}
