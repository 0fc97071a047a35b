import math
import struct
import zlib

import xxhash

from orderlens.llm import sharding
from tests.llm import edge


def test_edge_rows_and_slots(spark):
    rows = sharding.shard_documents(edge.frame(spark), sharding.tree(16), sharding.tree(17)).collect()
    assert len(rows) == len(edge.rows())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and (r.grown_shard in (r.shard, 16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r.size for r in rows if r.doc_id == 1} == {1} and {r.text_crc32 for r in rows if r.doc_id == 1} == {0}
    assert {r.doc_id for r in rows} >= {edge.LARGE, None}
    assert sharding.shard_documents(edge.empty(spark), sharding.tree(16)).count() == 0


def moved(spark, before, after, n=20000):
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    both = sharding.place(sharding.place(ids, before), after, name="grown")
    return {(r.shard, r.grown): r["count"] for r in both.where("shard != grown").groupBy("shard", "grown").count().collect()}


def test_growth_goes_into_the_new_shard_only(spark):
    for n in (1, 3, 16, 17, 21, 24):  # some grow inside a rack or a region that has shards
        found = moved(spark, sharding.tree(n), sharding.tree(n + 1))
        share = 20000 / (n + 1)
        assert {b for _, b in found} == {n} and abs(sum(found.values()) - share) < 5 * math.sqrt(share)


def test_one_changed_weight_moves_keys_of_that_shard_only(spark):
    weights = [1.0, 0.5, 2.0, 1.0, 3.0, 1.0, 0.25, 1.0, 1.0, 1.5, 1.0, 4.0]
    even = sharding.tree(12, 3, 2, weights)  # two regions of two racks of three shards
    for shard in range(12):
        for factor in (0.0, 0.25, 2.0, 8.0):
            found = moved(spark, even, sharding.tree(12, 3, 2, [w * (factor if i == shard else 1) for i, w in enumerate(weights)]), 4000)
            assert found and all((a == shard) if factor < 1 else (b == shard) for a, b in found)
            before, after = weights[shard] / sum(weights), weights[shard] * factor / (sum(weights) + weights[shard] * (factor - 1))
            share = 4000 * abs(after - before)
            assert abs(sum(found.values()) - share) < 6 * math.sqrt(share + 1)


def test_levels_and_weights(spark):
    even = sharding.tree(16)
    found = moved(spark, even, [*even, sharding.Leaf(0, 0, 2, 3.0)])  # more weight for an old shard
    assert {b for _, b in found} == {2} and abs(sum(found.values()) - 20000 * 3 / 19) < 5 * math.sqrt(20000 * 3 / 19)
    found = moved(spark, even, [x for x in even if x.region != 1])  # a whole region goes, no key of another moves
    assert found and all(a >= 8 for a, _ in found)
    found = moved(spark, even, [x for x in even if x.rack != 2])  # a rack: its keys go everywhere, no other moves
    assert {a for a, _ in found} == {8, 9, 10, 11}
    assert moved(spark, even, sharding.tree(16, 16, 1))  # one region of one rack: other draws
    weights = [1.0, 2.0, 3.0, 4.0] * 4
    counts = sharding.place(spark.range(20000).withColumnRenamed("id", "doc_id"), sharding.tree(16, weights=weights)).groupBy("shard").count().collect()
    assert len(counts) == 16 and all(abs(r["count"] - 500 * weights[r["shard"]]) < 5 * math.sqrt(500 * weights[r["shard"]]) for r in counts)


def brute(doc_id, leaves):
    """The shard of the least draw, by the draws of all shards."""

    def draw(x):
        h = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        for n in (x.region, x.rack, x.shard):
            h = xxhash.xxh64_intdigest(struct.pack("<i", n), h)
        return -math.log(((h >> 11) + 0.5) / 2**53) / x.weight, x.region, x.rack, x.shard

    return min(map(draw, leaves))[-1]


def test_given_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in sharding.shard_documents(docs, sharding.tree(16), sharding.tree(17)).collect()}
    place = {}
    for r in docs.collect():
        text, got = (r.text or "").encode(), rows[r.doc_id]
        assert (got["size"], got.text_crc32) == (len(text) + 1, zlib.crc32(text))
        assert (got.shard, got.grown_shard) == (brute(r.doc_id, sharding.tree(16)), brute(r.doc_id, sharding.tree(17)))
        place.setdefault(got.shard, []).append(got.slot)
    assert len(rows) == docs.count() and all(sorted(s) == list(range(len(s))) for s in place.values())


def test_rows_alike_and_code_generation(spark, capfd):
    docs = spark.createDataFrame([(1, "same")] * 9000 + [(i, "x") for i in range(2, 50)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, sharding.tree(64)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 9048 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in sharding.place(spark.range(20000).withColumnRenamed("id", "doc_id"), sharding.tree(512)).collect()}) == 512
    assert "grows beyond 64 KB" not in capfd.readouterr().err
