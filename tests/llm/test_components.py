import random

from orderlens.llm import common, minhash


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for links in ([], [(4, 4)], [(7, 3), (3, 7), (2, 7)], [(i, i + 1) for i in range(60)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]):
        root = {x: x for pair in links for x in pair if pair[0] != pair[1]}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in links:
            if u != v:
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
        frame = spark.createDataFrame(links, "u long, v long")
        got = sorted((r.node, r.root) for r in common.components(frame).collect())
        assert got == sorted((x, find(x)) for x in root)


def test_stars_are_told_from_other_links(spark):
    starry = lambda *pairs: common.is_starry(spark.createDataFrame(pairs, "u long, v long"))
    assert starry((1, 2), (1, 3), (4, 5))
    assert not starry((1, 2), (2, 3))
    assert not starry((1, 3), (2, 3))


def test_shingles_outside_the_frequent_ones(spark, monkeypatch):
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4]), (3, [3]), (2**60 + 1, [-5, 2])], "id long, grams array<long>")
    frequent = spark.createDataFrame([(3,), (2,)], "g long")
    for limit in (10, 1):
        monkeypatch.setattr(minhash, "BROADCAST_ROWS", limit)
        got = sorted(tuple(r) for r in minhash.outside(sets, frequent).collect())
        assert got == [(1, 1), (2, 4), (2**60 + 1, -5)]
    assert minhash.outside(sets, frequent.limit(0)).count() == 8
    assert minhash.outside(sets.limit(0), frequent).count() == 0
