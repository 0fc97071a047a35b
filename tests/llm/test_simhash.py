import random

import numpy as np
import xxhash

from orderlens.llm import simhash
from tests.llm import edge


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    root = {i: i for i in range(len(items))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted((doc is not None, doc or 0, low.get(find(i)) or 0) for i, (doc, _) in enumerate(items))


def test_covering_code():
    rng = np.random.default_rng(0)
    half = rng.integers(0, 2**32, 500, np.uint64).astype(np.uint32)
    home, reach = simhash.anchors(half)
    assert (np.bitwise_count(home ^ half) <= 1).all() and (np.bitwise_count(reach ^ half[:, None]) <= 2).all()
    assert {len(set(r)) for r in reach.tolist()} <= {2, 17}
    for bit in range(32):  # whatever one bit changes, the other's home is among the anchors
        other, _ = simhash.anchors(half ^ np.uint32(1 << bit))
        assert (reach == other[:, None]).any(axis=1).all()
    quarter = half & np.uint32(0xFFFF)
    home, reach = simhash.anchors(quarter, 4)
    assert (np.bitwise_count(home ^ quarter) <= 1).all() and (reach < 1 << 16).all()
    for bit in range(16):
        other, _ = simhash.anchors(quarter ^ np.uint32(1 << bit), 4)
        assert (reach == other[:, None]).any(axis=1).all()


def test_edge_rows_against_brute_force(spark):
    rows = simhash.near_groups(edge.frame(spark)).collect()
    want = [(r[0], brute_fingerprint(r[1])) for r in edge.rows()]
    assert sorted((r.doc_id is not None, r.doc_id or 0, int(r.fingerprint, 16)) for r in rows) == sorted((d is not None, d or 0, f) for d, f in want)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.component_id or 0) for r in rows) == brute_components(want)
    assert simhash.near_groups(edge.empty(spark)).count() == 0


def test_links_of_crowded_anchors(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(40)]
    near = [base[0] ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))) for _ in range(500)]
    chain = [base[1]]
    for b in range(0, 60, 3):
        chain.append(chain[-1] ^ (7 << b))
    fps = list(dict.fromkeys(base + near + chain))
    frame = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")
    for block in (16, 4096):
        from orderlens.llm.common import components

        roots = {r.node: r.root for r in components(simhash.links(frame, block=block)).collect()}
        signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
        got = {}
        for i, f in enumerate(signed):
            got.setdefault(roots.get(f, f), set()).add(i)
        want = {}
        for d, low in ((i, c) for i, (_, _, c) in enumerate(brute_components(list(enumerate(fps))))):
            want.setdefault(low, set()).add(d)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    rows = simhash.near_groups(docs).collect()
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in rows} == set(want)
    assert sorted((True, r.doc_id, r.component_id) for r in rows) == brute_components(want)
