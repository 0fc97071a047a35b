from itertools import combinations

from orderlens.operators import analytics


def test_wide_orders_count(spark):
    baskets = {1: range(230), 2: range(3), 3: range(2, 5)}
    items = spark.createDataFrame([(o, p) for o, ps in baskets.items() for p in ps], "order_id long, product_id long")
    support, single = {}, {}
    for ps in baskets.values():
        for p in ps:
            single[p] = single.get(p, 0) + 1
        for pair in combinations(ps, 2):
            support[pair] = support.get(pair, 0) + 1
    for block in (50, 200, 1000):
        rows = analytics.basket_pairs(items, 1, block=block).collect()
        assert len(rows) == len(support)
        assert {(r.a, r.b): (r.support, r.confidence, r.lift) for r in rows} == {(a, b): (n, round(n / single[a], 6), round(n * 3 / (single[a] * single[b]), 6)) for (a, b), n in support.items()}


def test_wide_orders_count_in_itemsets(spark):
    items = spark.createDataFrame([(o, p) for o, ps in {1: range(210), 2: [0, 1]}.items() for p in ps], "order_id long, product_id long")
    assert {tuple(r["items"]): r.support for r in analytics.basket_itemsets(items, 0.9).collect()} == {(0,): 2, (1,): 2, (0, 1): 2}
