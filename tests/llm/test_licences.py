import math
import re

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from orderlens.llm import licences, queries
from orderlens.llm.licences import Template
from tests.llm import edge

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(licences.WORDS, (text or "").translate(LOWER))


def brute(texts, templates=licences.TEMPLATES):
    """The rows of texts: every start of every template is tried; word lists are compared item by item."""
    files = [words_of(t) for t in texts]
    counts = {w: sum(w in set(f) for f in files) for t in templates for w in t.text.split()}
    out = []
    for f in files:
        base, labels, best = [], set(), 0.0
        for t in templates:
            own = t.text.split()
            short = len(own) <= 5
            off = 0 if short else len(own) // 8
            rare = sorted(set(own), key=lambda w: (counts[w], w))[: 1 if short else 6]
            idf = {w: math.log((len(files) + 1) / (counts[w] + 1)) for w in rare}
            looked = [w for w in rare if w in f][:3]

            def near(phrase, at):
                return any(i >= 0 and f[i : i + len(phrase)] == phrase for i in range(at - off, at + off + 1))

            for start in range(-len(own), len(f)):
                if not any(0 <= start + p < len(f) and f[start + p] == w for w in looked for p in range(len(own)) if own[p] == w):
                    continue
                agree = [w for w in rare if any(near([w], start + p) for p in range(len(own)) if own[p] == w)]
                phrases = [p.split() for p in t.phrases or (t.text,)]
                at = [next(i for i in range(len(own)) if own[i : i + len(p)] == p) for p in phrases]
                if 2 * len(agree) < len(rare) or not all(near(p, start + i) for p, i in zip(phrases, at)):
                    continue
                labels.add(t.label)
                best = max(best, min(1.0, sum(idf[w] for w in agree) / sum(idf.values())) if sum(idf.values()) > 0 else 1.0)
                if t.base:
                    base.append((start, t.label))
        starts = [s for s, _ in base]
        out.append((len(f), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(best, 9)))
    return out


def check(spark, rows, templates=licences.TEMPLATES):
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).drop("places").collect()
    want = brute([t for _, t in rows], templates)
    assert sorted(str((*r[:-1], round(r.score, 9))) for r in got) == sorted(str((i, *w)) for (i, _), w in zip(rows, want))
    return want


BY_LABEL = {t.label: t.text for t in licences.TEMPLATES}
LONG = [t for t in licences.TEMPLATES if len(t.words) > licences.SHORT]
PIECE = st.one_of(
    st.sampled_from(["CC BY-NC 4.0", "cc  by", "cc-by", "by cc by cc", "General-Public\nLICENSE", "all rights reserved", "All rights reserved.", "reserved all rights", "the MIT License", "K is kelvin", "éCC BY", "ccby", "the", "software"]),
    st.sampled_from(LONG).map(lambda t: t.text),
    st.tuples(st.sampled_from(LONG), st.integers(0, 30), st.integers(0, 3), st.text("ab ", max_size=8)).map(lambda x: " ".join(x[0].words[: x[1]]) + f" {x[3]} " + " ".join(x[0].words[x[1] + x[2] :])),
)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=4).map("  ".join), min_size=1, max_size=8))
def test_any_documents_equal_brute_force(spark, texts):
    check(spark, list(enumerate(texts)))


def test_known_answers(spark):
    mit = BY_LABEL["mit"]
    rows = [
        (0, "Licensed under CC BY-NC 4.0."), (1, "x (CC BY) y, cc by; All Rights Reserved"), (2, "GNU Lesser General Public License"), (3, "Released under the MIT License."), (4, mit.upper()),
        (5, mit.replace("merge publish distribute", "merge and distribute")), (6, "sublicense and sell"), (7, "nothing"), (8, None), (9, "This work is licensed under the GNU General Public License, version 3."),
        (10, "Copyright (c) A. " + mit.replace("copy of this software", "copy of this very fine software")),
    ]
    want = dict(zip(range(11), check(spark, rows)))
    labels = [want[i][5] for i in range(11)]
    assert labels == ["cc-by,cc-by-nc", "cc-by,reserved", "gpl,lgpl", "mit", "mit", "", "", "", "", "gpl", "mit"]
    assert want[1][1:5] == (3, 1, 6, "cc-by,reserved") and want[8] == (0, 0, None, None, "", "", 0.0) and want[0][6] == 1.0


def test_one_hot_notice_in_every_file_and_one_file_of_notices(spark):
    check(spark, [(i, "All rights reserved. CC BY") for i in range(40)] + [(99, "all rights reserved cc by " * 300)])


def test_own_templates(spark):
    own = (Template("a", "red fish", base=True), Template("b", "one fish two fish red fish blue fish", ("two fish red fish",)))
    check(spark, [(1, "one fish, two fish, red fish, blue fish"), (2, "red fish red fish"), (3, "two fish"), (4, "one fish two red fish blue fish")], own)
    with pytest.raises(ValueError):
        licences.scan(edge.frame(spark), (Template("a", "a b c d e f g", base=True),))


def test_edge_rows(spark):
    check(spark, [r[:2] for r in edge.rows()])
    assert licences.scan(edge.frame(spark)).count() == len(edge.rows())
    assert licences.scan(edge.empty(spark)).count() == 0


def test_given_table_without_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = queries.op13_rare_words(spark, sf)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = brute(docs.text.tolist())
    assert sorted(str((*r[:-1], round(r.score, 9))) for r in got.collect()) == sorted(str((i, *w)) for i, w in zip(docs.doc_id, want))
    assert {"cc-by-nc", "gpl", "mit", "apache", "reserved"} & {x for w in want for x in w[5].split(",")}
