import random

import corpus_pipeline
from orderlens.llm import simhash
from tests.llm import edge


def grams(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, least=0.8):
    """The smallest doc_id of each group that pairs with exact Jaccard connect."""
    sets, root = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(docs[i][0] for i in range(len(docs)) if find(i) == i)


def test_stage_against_exact_jaccard(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs = []
    for _ in range(40):  # copies with 1 to 4 words changed: likeness 0.68 to 0.95, some in chains
        words = [word() for _ in range(100)]
        docs.append(" ".join(words))
        for changed in (1, 2, 3, 4):
            words = list(words)
            for at in rng.sample(range(100), changed):
                words[at] = word()
            docs.append(" ".join(words))
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert 40 < len(want) < 160
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, None).collect()) == want


def test_one_large_group(spark, monkeypatch):
    from orderlens.llm import minhash

    monkeypatch.setattr(minhash.linked, "__defaults__", (5,))
    rng = random.Random(9)
    pool = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(60)]
    base, docs = rng.choices(pool, k=60), []
    for _ in range(110):  # most of them too far from each other, some close to a few
        words = list(rng.choice(docs[-9:]) if docs and rng.random() < 0.4 else base)
        for at in rng.sample(range(len(words)), rng.choice((0, 1, 1, 2, 3))):
            words[at] = rng.choice(pool)
        docs.append(words[: rng.choice((60, 60, 58, 50))])
    docs = list(enumerate(" ".join(w) for w in docs))
    want = brute(docs)
    assert 5 < len(want) < 100
    assert sorted(r.doc_id for r in simhash.keep_first_copy(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == want


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(r.doc_id for r in simhash.keep_first_copy(docs).collect()) == brute(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_edge_rows(spark):
    rows = simhash.keep_first_copy(edge.frame(spark)).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 12, edge.LARGE] and len(rows) == 12
    assert simhash.keep_first_copy(edge.empty(spark)).count() == 0


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    from orderlens.llm import minhash

    texts = ["a b c d e f", "a b c d e g", "a b c d e f", "", None, "x y z"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first_copy(frame).collect()) == [0, 1, 3, 5]
    hashed = minhash.F.xxhash64
    monkeypatch.setattr(minhash.F, "xxhash64", lambda *cols: hashed(*cols) if len(cols) > 1 else minhash.F.lit(7).cast("long"))
    rows = minhash.told_apart(frame.select("doc_id", minhash.F.coalesce("text", minhash.F.lit("")).alias("text"))).collect()
    assert len({r.id for r in rows}) == 4 and len({(r.id, r.text) for r in rows}) == 4
    assert 7 in {r.id for r in rows}
    assert sorted(r.doc_id for r in simhash.keep_first_copy(frame).collect()) == [0, 1, 3, 5]
    classes = {r.doc_id: r.class_id for r in minhash.near_copies(frame).collect()}
    assert classes == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 5}


def test_bounds_leave_no_pair_out(spark):
    from orderlens.llm import minhash

    rng = random.Random(11)
    base, sets = rng.sample(range(1000), 40), []
    for _ in range(60):  # near copies of one set, of several sizes, some with shingles of their own
        one = set(rng.sample(base, rng.randrange(28, 41)))
        sets.append(sorted(one | {1000 + rng.randrange(40) for _ in range(rng.randrange(0, 9))}))
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, grams array<long>")
    own = {r.id: r for r in minhash.bounded(frame, 0.8, 10).collect()}
    assert len(own) == 60 and all(own[i].n == len(s) for i, s in enumerate(sets))
    rare = [{x.g for x in own[i].out or ()} for i in range(60)]
    like = by_size = by_rare = left = 0
    for i in range(60):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            size = own[i].n <= own[j].most and own[j].n <= own[i].most
            if len(a & b) >= 0.8 * len(a | b):
                assert size or rare[i] & rare[j]
                like, by_size, by_rare = like + 1, by_size + size, by_rare + bool(rare[i] & rare[j])
            left += not (size or rare[i] & rare[j])
    assert like and by_size and by_rare and left
