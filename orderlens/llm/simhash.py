"""Operator 1: SimHash near-dedup with anchor points of a covering code.

A 64-bit fingerprint is two halves; if two fingerprints differ in at most three bits, one half differs in at most one. Halves are
covered by the code C x {0, 1}, C the perfect Hamming code of length 31: every half lies within radius 1 of an anchor. With
threshold 1 on a half, a fingerprint is replicated to all anchors within distance 2 (17 or fewer a half), and one of them is the
nearest anchor ("home") of its partner. Each anchor then compares homes with all fingerprints it got. Equal fingerprints are one
row from the start, so copies of a text cost nothing here. Where an anchor has many fingerprints, their other halves are two quarters
of which one differs in at most one bit: the same code, of length 15, spreads them over anchors of quarters. What is still crowded
is cut into slices, and every pair of slices is compared in a task's stream of its own. An anchor returns a star for each group that
its links connect, not all links. Replicas are eighteen rows a fingerprint; they are counted first and made again to be compared,
which costs less than writing them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import minhash
from .common import carried, components, cut, small

#: Fingerprints of one anchor that are compared in one block; larger anchors are split.
BLOCK = 2048

NEAR = 3


def fingerprint(text: str | None, width: int = 3, chunk: int = 1 << 15) -> int:
    """The unsigned fingerprint of one text: A-Z lower-cased, shingles of `width` words joined by spaces (fewer words: all of them),
    hashed by XXH64 with seed 42; a bit is 1 if set in over half of the hashes. No words: 0."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() touch ASCII only
    if not words:
        return 0
    width = min(width, len(words))
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[width - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), chunk):
        h = np.array([digest(joined[i:j], 42) for i, j in zip(first[at : at + chunk], last[at : at + chunk])], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for each row; fp is the fingerprint as a signed number. A null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "fp": np.array([fingerprint(t) for t in batch.text], np.uint64).view(np.int64)})

    return carried(docs, run, "fp long", "text")


def syndrome(part: np.ndarray, r: int) -> np.ndarray:
    """Of the low 2^r - 1 bits under the Hamming code whose column for bit i is i + 1; 0 for code words, else the bit to flip + 1."""
    out = np.zeros(part.shape, np.uint32)
    for k in range(r):
        mask = np.uint32(sum(1 << i for i in range(2**r - 1) if (i + 1) >> k & 1))
        out |= (np.bitwise_count(part & mask) & 1).astype(np.uint32) << np.uint32(k)
    return out


def anchors(part: np.ndarray, r: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The home of each part of 2^r bits (uint32), and all anchors within distance 2 of it in rows; columns that repeat an anchor
    repeat the home. Flipping bits i and j moves the syndrome by (i + 1) xor (j + 1)."""
    one, n = np.uint32(1), 2**r - 1
    s = syndrome(part, r)
    flip = lambda at: np.where(at > 0, one << (at - (at > 0)), 0).astype(np.uint32)
    home = part ^ flip(s)
    reach = [home, home ^ np.uint32(1 << n)]  # distance 0 or 1; 1 or 2 with the free bit
    for i in range(1, n + 1):  # flips of two bits i < j, i xor j = s
        j = s ^ np.uint32(i)
        ok = (s > 0) & (j > i) & (j <= n)
        reach.append(np.where(ok, part ^ (one << np.uint32(i - 1)) ^ flip(np.where(ok, j, 0)), home))
    return home, np.stack(reach, 1)


def spread(part: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, anchor, whether it is the home) of all different anchors of parts."""
    home, reach = anchors(part, r)
    keep = np.ones(reach.shape, bool)
    keep[:, 1:] = reach[:, 1:] != home[:, None]
    row, col = np.nonzero(keep)
    return row, reach[row, col].astype(np.int64), col == 0


def replicate(fps: DataFrame) -> DataFrame:
    """fps (fp long) -> (anchor long, fp, home boolean): each fingerprint at all its anchors of both halves, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch.fp.to_numpy(np.int64)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                for side in (0, 1):
                    row, anchor, home = spread((part.view(np.uint64) >> np.uint64(32 * side)).astype(np.uint32), 5)
                    yield pd.DataFrame({"anchor": anchor | side << 32, "fp": part[row], "home": home})

    return fps.mapInPandas(run, "anchor long, fp long, home boolean")


def quartered(rows: DataFrame) -> DataFrame:
    """rows (anchor, fp, home) -> (anchor, cell, fp, home): each at the anchors of both quarters of the half that anchor is not of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            anchor, fp, home = batch.anchor.to_numpy(np.int64), batch.fp.to_numpy(np.int64), batch.home.to_numpy(bool)
            half = (fp.view(np.uint64) >> np.where(anchor >> 32 == 0, 32, 0).astype(np.uint64)).astype(np.uint32)
            for side in (0, 1):
                row, cell, near = spread((half >> np.uint32(16 * side)) & np.uint32(0xFFFF), 4)
                yield pd.DataFrame({"anchor": anchor[row], "cell": cell | side << 16, "fp": fp[row], "home": home[row] & near})

    return rows.mapInPandas(run, "anchor long, cell long, fp long, home boolean")


def block_links(fp: np.ndarray, home: np.ndarray, near: int) -> list[tuple[int, int]]:
    """Star links that connect what the links of homes with all rows of one block connect."""
    label = np.arange(len(fp))
    out = []
    bits = fp.view(np.uint64)
    for i in np.flatnonzero(home):
        close = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= near)
        roots = np.unique(label[close])
        if len(roots) > 1:
            out += [(int(fp[roots[0]]), int(fp[r])) for r in roots[1:]]
            label[np.isin(label, roots)] = roots[0]
    return out


def compare(rows: DataFrame, keys: list[str], near: int = NEAR) -> DataFrame:
    """rows (keys, fp, home), sorted by keys in each partition and with all rows of a key together -> links (u, v)."""

    def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pd.DataFrame:
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        start = np.concatenate(([0], change))
        size = np.diff(np.concatenate((start, [len(key)])))
        bits = fp.view(np.uint64)
        us, vs = [], []
        left = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(start, size))  # rows from here to the group's end
        left[np.repeat(size > 32, size)] = 0
        for step in range(1, 32):
            at = np.flatnonzero(left > step)
            if not len(at):
                break
            ok = (home[at] | home[at + step]) & (np.bitwise_count(bits[at] ^ bits[at + step]) <= near)
            us.append(fp[at[ok]])
            vs.append(fp[at[ok] + step])
        for s, n in zip(start[size > 32], size[size > 32]):
            found = block_links(fp[s : s + n], home[s : s + n], near)
            us.append(np.array([a for a, _ in found], np.int64))
            vs.append(np.array([b for _, b in found], np.int64))
        return pd.DataFrame({"u": np.concatenate([*us, np.empty(0, np.int64)]), "v": np.concatenate([*vs, np.empty(0, np.int64)])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            if rest is not None:
                batch = pd.concat([rest, batch])
            key = batch[keys].to_numpy(np.int64)
            same = (key == key[-1]).all(axis=1)
            done = len(key) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = batch.iloc[done:]
            if done:
                yield links(key[:done], batch.fp.to_numpy(np.int64)[:done], batch.home.to_numpy(bool)[:done])
        if rest is not None and len(rest):
            yield links(rest[keys].to_numpy(np.int64), rest.fp.to_numpy(np.int64), rest.home.to_numpy(bool))

    return rows.mapInPandas(run, "u long, v long")


def grouped_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def links(fps: DataFrame, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """Links (u, v) over distinct fingerprints fps (fp long) that connect exactly what pairs at `near` or fewer bits connect."""
    if not 0 <= near <= 3:
        raise ValueError("two halves with threshold 1 each cover distances up to 3")

    def crowded(rows: DataFrame, keys: list[str]) -> DataFrame:
        return cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block))

    rows = replicate(fps)
    heavy = crowded(rows, ["anchor"])
    if heavy.isEmpty():
        return compare(grouped_by(rows, ["anchor"]), ["anchor"], near)
    heavy = small(heavy)
    found = compare(grouped_by(rows.join(heavy, "anchor", "left_anti"), ["anchor"]), ["anchor"], near)

    keys = ["anchor", "cell"]
    cells = quartered(rows.join(heavy, "anchor").select("anchor", "fp", "home"))
    full = crowded(cells, keys)
    if full.isEmpty():
        return found.unionByName(compare(grouped_by(cells, keys), keys, near))
    full = small(full)
    found = found.unionByName(compare(grouped_by(cells.join(full, keys, "left_anti"), keys), keys, near))
    parts = F.ceil(F.col("_n") / (block // 2))
    slices = cells.join(full, keys).withColumn("_mine", F.pmod(F.xxhash64("fp"), parts))
    slices = slices.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    slices = slices.select(*keys, F.least("_mine", "_other").alias("_a"), F.greatest("_mine", "_other").alias("_b"), "fp", "home")
    keys = [*keys, "_a", "_b"]
    return found.unionByName(compare(grouped_by(slices, keys), keys, near))


def fingerprint_column(text="text"):
    """The signed fingerprint of a text column."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))

    return of(F.col(text))


def grouped(found: DataFrame, near: int = NEAR) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of found (doc_id, fp)."""
    classes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), near))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = cut(named.groupBy("root").agg(F.min("first").alias("component_id")))
    return named.join(linked, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """One row per row of docs: doc_id, fp, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach.

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows give repeated rows with the same
    component; rows without a doc_id take part, and count as no smallest id (a group of such rows alone has a null component).
    An empty table gives no rows; other columns are ignored. Only distinct fingerprints are compared.
    """
    found = cut(fingerprints(docs))
    table = grouped(found, near).select("fp", "component_id")
    return found.join(table, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def told(docs: DataFrame) -> DataFrame:
    """(row, doc, text, id) for each row of docs: all its columns, its doc_id, its text (a null one is empty) and what stands for it."""
    return minhash.told_apart(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")))


def one_of_each(marked: DataFrame, roots: DataFrame) -> DataFrame:
    """One row, all columns, of each group of roots (id, root; texts that are not there stand alone) of marked (see told()): that of
    the smallest doc_id, a null one last. If several rows have it, the one with the smallest id stays; rows alike in both are told
    apart by nothing, and one of them stays."""
    marked = marked.select("row", "doc", "id")
    found = cut(marked.select("doc", "id"))
    named = found.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("late"), "doc", "id")).alias("m"))
    first = cut(first.select(F.col("m.doc").alias("a"), F.col("m.id").alias("b")))
    kept = marked.join(first, F.col("doc").eqNullSafe(F.col("a")) & (F.col("id") == F.col("b")), "left_semi")
    if not found.groupBy("doc", "id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc", "id"])
    return kept.select("row.*")


def keep_first(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """One row of docs, all columns, of each group of near_groups(); see one_of_each()."""
    marked = told(docs)
    found = cut(marked.select("id", fingerprint_column().alias("fp")).dropDuplicates(["id"]))
    table = grouped(found.select(F.col("id").alias("doc_id"), "fp"), near)
    return one_of_each(marked, found.join(table.select("fp", "root"), "fp").select("id", "root"))


def marks(texts: DataFrame) -> DataFrame:
    """(id, fp, bands) for each row of texts (id, text): the fingerprint over shingles of minhash.WIDTH words, and MinHash bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = minhash.Hasher()
        for batch in batches:
            fps = np.array([fingerprint(t, minhash.WIDTH) for t in batch.text], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch.id, "fp": fps, "bands": [minhash.bands(minhash.signature(h.shingles(t))) for t in batch.text]})

    return texts.mapInPandas(run, "id long, fp long, bands array<long>")


def copy_links(texts: DataFrame, least: float = minhash.LIKE) -> DataFrame:
    """Links (u, v) that connect what pairs of texts (id, text; equal texts have equal ids) with a Jaccard likeness of `least` or
    more connect: fingerprints linked by anchors propose pairs, and so do MinHash bands; every link is verified (minhash.near_links)."""
    found = cut(marks(texts).dropDuplicates(["id"]))
    heads = cut(found.groupBy("fp").agg(F.min("id").alias("head")))
    u, v = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"_{x}")) for x in "uv")
    near = links(heads.select("fp")).join(u, "u").join(v, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    same = found.join(heads, "fp").select(F.col("head").alias("u"), F.col("id").alias("v"))
    return minhash.near_links(texts, found.select("id", "bands"), near.unionByName(same), least)


def keep_first_copy(docs: DataFrame, least: float = minhash.LIKE) -> DataFrame:
    """One row of docs, all columns, of each group that copy_links() connects; see one_of_each(). A null text counts as empty; texts
    without words are copies of each other."""
    marked = told(docs)
    return one_of_each(marked, components(copy_links(marked.select("id", "text"), least)).withColumnRenamed("node", "id"))
