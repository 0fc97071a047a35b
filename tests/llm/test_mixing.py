import pytest

from orderlens.llm import mixing
from tests.llm import edge


def test_edge_rows(spark):
    rows = mixing.mix(edge.frame(spark)).collect()
    assert len(rows) == len(edge.rows())
    total = sum(r["size"] for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(total)
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert sum(r.taken for r in rows) <= total
    assert mixing.mix(edge.empty(spark)).count() == 0


def test_weights_caps_and_reruns(spark):
    data = [(i, " ".join(["w"] * (1 + i % 7)), "abcde"[min(i % 11, 4)] if i % 50 else "f") for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    size, taken, target = {}, {}, {}
    for r in rows:
        size[r.source], target[r.source] = r.source_size, r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert target["f"] <= 3 * size["f"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 60
    free = [s for s in size if target[s] < 3 * size[s] - 1e-6]
    w = {s: 1 + i % 3 for i, s in enumerate(sorted(size))}
    assert len({round(target[s] / w[s], 3) for s in free}) == 1


def test_repeated_rows_keep_the_budget(spark):
    rows = [(i % 7 if i % 2 else None, "word " * (1 + i % 3), "ab"[i % 2], i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _text int")
    out = mixing.repeat_documents(docs)
    want = sum(r.taken for r in mixing.mix(docs).collect())
    assert out.columns == docs.columns and sum(len(r.text.split()) for r in out.collect()) == want > 0
