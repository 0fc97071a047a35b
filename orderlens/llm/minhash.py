"""Operator 9: document fingerprints by MinHash.

Shingles of five words become 64-bit numbers; PERMUTATIONS universal hash functions (multiply-add-shift) run over all of them in
numpy, and each keeps its smallest value. A fingerprint is the low 16 bits of each minimum, in hex. Two fingerprints agree in a
place with a probability that is the Jaccard likeness of their shingle sets. Bands of a signature are joined in Spark, and every link
that comes of them is verified by the exact Jaccard likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, carried, components, cut, small

PERMUTATIONS, WIDTH, SEED = 128, 5, 20240607
#: Ids that a task keeps to know copies by; beyond it that memory starts anew.
SEEN = 200_000
#: Bytes of texts in one range of doc_id, about; ranges that one pass finds the borders of.
RANGE_BYTES, COARSE = 64 << 20, 1000
#: Shingles that a task counts at once.
COUNTED = 1 << 20
#: Jaccard likeness of shingle sets from which two texts are near copies.
LIKE = 0.8
#: Texts of a band that all meet; in larger bands, texts that have a shingle for it to tell pairs apart.
FEW = 32

_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 2**63, PERMUTATIONS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, np.uint64)[:, None] * np.uint64(2)
_C = np.uint64(0x9E3779B97F4A7C15)  # odd: mixes word hashes into shingles


class Hasher:
    """Hashes of words, each hashed anew: that takes half the time of looking it up among those remembered."""

    def words(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(1)), np.uint64, len(words))

    def shingles(self, text: str) -> np.ndarray:
        """One number for each run of WIDTH words (fewer words: one for all of them, none: one for the empty text)."""
        w = self.words(text)
        n = min(WIDTH, len(w))
        out = np.full(max(1, len(w) - n + 1), n, np.uint64)
        for i in range(n):
            out = (out ^ w[i : i + len(out)]) * _C
            out ^= out >> np.uint64(29)
        return out


def signature(shingles: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """The PERMUTATIONS minima (uint32)."""
    least = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), chunk):
        least = np.minimum(least, (_A * shingles[None, at : at + chunk] + _B).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray, rows: int = 5) -> list[int]:
    """One signed number for each run of `rows` minima."""
    return [xxhash.xxh64_intdigest(sig[at : at + rows].tobytes(), i) - (1 << 63) for i, at in enumerate(range(0, PERMUTATIONS - rows + 1, rows))]


def written(sig: np.ndarray) -> str:
    return (sig & np.uint32(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero((a & 0xFFFF) == (b & 0xFFFF))) / PERMUTATIONS


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row; a null text counts as empty. Equal texts have equal fingerprints."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "fingerprint": [written(signature(h.shingles(t or ""))) for t in batch.text]})

    return carried(docs, run, "fingerprint string", "text")


def placed(borders: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The range of each (id, hash) under sorted borders; an id that is r borders at once fills r + 1 ranges, evenly by its hash."""
    low, high = np.searchsorted(borders, ids, "left"), np.searchsorted(borders, ids, "right")
    share = (hashes.view(np.uint64) >> np.uint64(11)) / 2.0**53
    return low + np.floor(share * (high - low + 1)).astype(np.int64)


def borders(rows: DataFrame, parts: int) -> np.ndarray:
    """The borders of about `parts` even ranges of rows (id, h), by approximate quantiles; over COARSE ranges, by quantiles of each of
    COARSE ranges, so no sketch grows with their number."""
    coarse = min(parts, COARSE)
    cuts = lambda n: F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("b")
    found = rows.agg(cuts(coarse)).first().b if coarse > 1 else None
    out = np.sort(np.array(found or [], np.int64))
    fine = -(-parts // coarse)
    if fine > 1 and len(out):
        known = out

        @F.pandas_udf("long")
        def part(ids: pd.Series, hashes: pd.Series) -> pd.Series:
            return pd.Series(placed(known, ids.to_numpy(np.int64), hashes.to_numpy(np.int64)))

        more = rows.groupBy(part("id", "h")).agg(cuts(fine)).select(F.explode("b").alias("b")).toPandas()
        out = np.sort(np.concatenate((out, more.b.to_numpy(np.int64))))
    return out


def in_runs(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(docs as (part, extra, id, h, doc_id, text), the number of parts): ranges of doc_id, each with the first row of the next range as
    an extra row. Borders and the first row of each range are a few numbers a range."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    low = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(doc, low).alias("id"), F.xxhash64(text).alias("h"), doc.cast("string").alias("doc_id"), text.alias("text"))
    known = borders(rows.select("id", "h"), parts)

    @F.pandas_udf("long")
    def part(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(placed(known, ids.to_numpy(np.int64), hashes.to_numpy(np.int64)))

    firsts = rows.select("id", "h").groupBy(part("id", "h").alias("part")).agg(F.min(F.struct("id", "h")).alias("f"))
    firsts = firsts.select("part", "f.*").toPandas().sort_values("part")
    of, first_id, first_h = (firsts[c].to_numpy(np.int64) for c in ("part", "id", "h"))

    @F.pandas_udf("array<long>")
    def targets(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """Twice the part, and for first rows of a part also twice the part before plus 1; the first part follows the last."""
        i, h = ids.to_numpy(np.int64), hashes.to_numpy(np.int64)
        at = placed(known, i, h)
        k = np.searchsorted(of, at)
        is_first = (first_id[k] == i) & (first_h[k] == h)
        return pd.Series([[2 * a, 2 * b + 1] if f else [2 * a] for a, b, f in zip(at.tolist(), of[k - 1].tolist(), is_first.tolist())])

    to = rows.select(F.explode(targets("id", "h")).alias("to"), "id", "h", "doc_id", "text")
    to = to.select((F.col("to") / 2).cast("int").alias("part"), (F.col("to") % 2 == 1).alias("extra"), "id", "h", "doc_id", "text")
    return to, len(known) + 1


def ranges(docs: DataFrame) -> int:
    """Ranges of RANGE_BYTES for the texts of docs; fewer bytes in a range while executors would be idle, 1 MB at least."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    busy = min(-(-size // (1 << 20)), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    return max(1, busy, -(-size // RANGE_BYTES))


def edit_report(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next larger doc_id, after the last one the first; a single document follows itself. Rows
    without a doc_id come first, rows of one doc_id stand in the order of a hash of their texts. A null text counts as empty. An
    empty table gives no rows; other columns are ignored. Texts are shuffled once, into ranges of doc_id, and streamed in order.
    """
    runs, n = in_runs(docs, parts or ranges(docs))
    runs = runs.repartitionById(n, "part").sortWithinPartitions("extra", "id", "h", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher()

        def row(at, following):
            doc, text, sig = at
            new = edited(text, following[1])
            sig_new = signature(h.shingles(new))
            digest = hashlib.sha256(new.encode()).hexdigest()
            return doc, len(text), digest, written(sig), written(sig_new), likeness(sig, sig_new), likeness(sig, following[2])

        last = None  # waits for the one after it
        for batch in batches:
            out = []
            for extra, doc, text in zip(batch.extra, batch.doc_id, batch.text):
                if extra and last is None:
                    continue  # a row like the first one
                this = (doc, text, signature(h.shingles(text)))
                if last is not None:
                    out.append(row(last, this))
                last = None if extra else this
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pd.DataFrame(out, columns=names).astype({"n_chars": "int64", "near_edited": float, "near_next": float})

    schema = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return carried(runs, run, schema, "extra", "text")


def told_apart(rows: DataFrame) -> DataFrame:
    """rows (text, not null, and other columns) with id (long), which stands for the text: its hash. Where different texts have one
    hash, all but one of them take a hash of another seed, so no two texts are one. (A chained hash would repeat the clash.)"""
    first, second = F.xxhash64("text"), F.xxhash64(F.lit("second"), F.col("text"))
    seen = rows.groupBy(first.alias("id")).agg(F.min(second).alias("_least"), F.max(second).alias("_most"))
    shared = cut(seen.where("_least != _most").select("id", "_least"))
    named = rows.withColumn("id", first)
    if shared.isEmpty():
        return named
    named = named.join(small(shared), "id", "left")
    return named.withColumn("id", F.when(F.col("_least") != second, second).otherwise(F.col("id"))).drop("_least")


def marks(texts: DataFrame) -> DataFrame:
    """(id, bands) for each id of texts (id, text), more than once at times: the numbers of its signature's bands. A task passes over
    an id that it has seen, so copies that it reads are signed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, seen = Hasher(), set()
        for batch in batches:
            if len(seen) > SEEN:
                seen = set()
            new = batch[[not (i in seen or seen.add(i)) for i in batch.id]]
            yield pd.DataFrame({"id": new.id, "bands": [bands(signature(h.shingles(t))) for t in new.text]})

    return texts.mapInPandas(run, "id long, bands array<long>")


def gram_sets(texts: DataFrame) -> DataFrame:
    """(id, grams) for each row of texts (id, text): its different shingles of WIDTH words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher()
        for batch in batches:
            yield pd.DataFrame({"id": batch.id, "grams": [np.unique(h.shingles(t)).view(np.int64) for t in batch.text]})

    return texts.mapInPandas(run, "id long, grams array<long>")


def gram_counts(sets: DataFrame) -> DataFrame:
    """(g, df): of sets (id, grams), how many have each shingle. Tasks add up about COUNTED of them before they are shuffled: near
    copies have most of theirs in common."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def summed() -> pd.DataFrame:
            g, df = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"g": g, "df": df})

        for batch in batches:
            for grams in batch.grams:
                held.append(np.asarray(grams, np.int64))
                n += len(grams)
                if n >= COUNTED:
                    yield summed()
                    held, n = [], 0
        if held:
            yield summed()

    return sets.select("grams").mapInPandas(run, "g long, df long").groupBy("g").agg(F.sum("df").alias("df"))


def outside(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, g) for the shingles of sets (id, grams) but those of frequent (g). Up to BROADCAST_ROWS frequent ones are left out inside
    tasks, before rows are made of shingles; with more of them, all rows are made and those are joined away."""
    if frequent.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return sets.select("id", F.explode("grams").alias("g")).join(frequent, "g", "left_anti").select("id", "g")
    known = sets.sparkSession.sparkContext.broadcast(np.sort(frequent.toPandas().g.to_numpy(np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, grams in zip(batch.id, batch.grams):
                g = np.setdiff1d(np.asarray(grams, np.int64), known.value, assume_unique=True)
                yield pd.DataFrame({"id": np.full(len(g), doc, np.int64), "g": g})

    return sets.mapInPandas(run, "id long, g long")


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v), each once with u < v."""
    return pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def verified(pairs: DataFrame, grams: DataFrame, least: float) -> DataFrame:
    """Those of pairs (u, v) whose sets have a Jaccard likeness of `least` or more."""
    a = grams.select(F.col("id").alias("u"), F.col("grams").alias("_a"))
    b = grams.select(F.col("id").alias("v"), F.col("grams").alias("_b"))
    both, m, n = F.size(F.array_intersect("_a", "_b")), F.size("_a"), F.size("_b")
    sized = pairs.join(b, "v").join(a, "u").where(F.least(m, n) >= F.floor(least * F.greatest(m, n)))
    return sized.where(both / (m + n - both) >= least).select("u", "v")


def unresolved(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """groups (band, id) with root and main, the commonest root of the band, for bands whose texts are not yet one component."""
    placed = groups.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    kinds = placed.groupBy("band").agg(F.mode("root").alias("main"), F.min("root").alias("_a"), F.max("root").alias("_b"))
    return cut(placed.join(kinds.where("_a != _b").select("band", "main"), "band"))


def met(rows: DataFrame, grams: DataFrame, least: float, head) -> DataFrame:
    """Verified links of the texts of each band of rows (band, id, root) to the one that `head` (an aggregate of id) names."""
    heads = rows.groupBy("band").agg(head.alias("u"))
    star = rows.join(heads, "band").select("u", F.col("id").alias("v"))
    return cut(verified(ordered(star), grams, least))


def pairs_of(rows: DataFrame, fits=None) -> DataFrame:
    """Pairs (u, v) of texts of a band that are in different components: those outside its main one with all others. fits: a condition
    on the columns of both, with _u and _v before their names."""
    side = lambda x, df: df.select("band", *[F.col(c).alias(f"_{x}{c}") for c in df.columns if c != "band"])
    pairs = side("u", rows.where("root != main")).join(side("v", rows), "band").where("_uroot != _vroot")
    return (pairs if fits is None else pairs.where(fits)).select(F.col("_uid").alias("u"), F.col("_vid").alias("v"))


def stars(roots: DataFrame) -> DataFrame:
    """A link (u, v) from the root of each text of roots (id, root) to it."""
    return roots.select(F.col("root").alias("u"), F.col("id").alias("v"))


def rooted(links: DataFrame) -> DataFrame:
    """(id, root) of all that links (u, v) connect."""
    return components(links).withColumnRenamed("node", "id")


def bounded(sets: DataFrame, least: float, few: int = FEW) -> DataFrame:
    """(id, n, most, out) for each text of sets (id, grams). Let H be the shingles that over `few` of the sets have.

    n counts the shingles of a text. A pair without a common shingle outside H shares no more than either has in H, so it reaches
    `least` only if n of each is at most `most` of the other. A pair with a common shingle outside H has one that is in `out` of both:
    the rarest ones of a text, as (df, g). So each pair of `least` or more is within both bounds or shares a shingle of `out`.
    """
    times = cut(gram_counts(sets))
    # only what is outside H is joined: no shingle there has over `few` texts
    shingles = outside(sets, times.where(F.col("df") > few).select("g"))
    out = shingles.join(times.where(F.col("df") <= few), "g").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("out"))
    own = sets.select("id", F.size("grams").alias("n")).join(out, "id", "left").withColumn("_k", F.coalesce(F.size("out"), F.lit(0)))
    inside = F.col("n") - F.greatest("_k", F.lit(0))
    # a pair that is no pair by its part in H has so many shingles outside H in common, so one of the first ones of each
    firsts = F.col("_k") - F.greatest(F.ceil(F.col("n") * least - inside - 1e-6), F.lit(1)) + 1
    own = own.withColumn("most", inside * (1 + least) / least - F.col("n") + 1e-6)
    return cut(own.withColumn("out", F.slice("out", F.lit(1), F.greatest(firsts, F.lit(0)).cast("int"))).drop("_k"))


def within_bounds(groups: DataFrame, own: DataFrame) -> DataFrame:
    """(band, id, n, most) for the texts of groups (band, id) whose `most` allows the smallest text of the band; own: see bounded()."""
    placed = groups.join(own.select("id", "n", "most"), "id")
    low = placed.groupBy("band").agg(F.min("n").alias("_low"))
    return cut(placed.join(low, "band").where("most >= _low").select("band", "id", "n", "most"))


def pairs_of_large(groups: DataFrame, grams: DataFrame, roots: DataFrame, least: float, few: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, roots) for large bands, groups (band, id): pairs (u, v) to verify, by both ways of bounded(), and roots with what the
    texts that have a partner by size and the most central one of their band connect."""
    own = bounded(cut(grams.join(groups.select("id").distinct(), "id", "left_semi")), least, few)
    live = within_bounds(groups, own)
    roots = rooted(stars(roots).unionByName(met(live, grams, least, F.max_by("id", F.struct("most", "id")))))
    by_size = pairs_of(unresolved(live.select("band", "id"), roots).join(live, ["band", "id"]), F.expr("_un <= _vmost and _vn <= _umost"))
    rare = own.select(F.explode(F.filter("out", lambda x: x["df"] > 1)["g"]).alias("band"), "id")
    return by_size.unionByName(pairs_of(unresolved(rare, roots))), roots


def linked(groups: DataFrame, grams: DataFrame, known: DataFrame, least: float, few: int = FEW) -> DataFrame:
    """Links (u, v) that connect what known (u, v) and pairs of a band of groups (band, id) with a likeness of `least` or more connect:
    what was connected on the way is a star from its smallest id.

    First each text meets the smallest id of its bands. In bands of up to `few` texts that are not one component then, those outside
    the main component meet all others; in larger ones, only pairs that bounded() leaves.
    """
    roots = rooted(known)
    rows = unresolved(groups, roots)
    if rows.isEmpty():
        return stars(roots)
    roots = rooted(stars(roots).unionByName(met(rows, grams, least, F.min("id"))))
    rows = unresolved(groups, roots)
    if rows.isEmpty():
        return stars(roots)
    large = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > few).select("band"))
    pairs = pairs_of(rows.join(large, "band", "left_anti"))
    if not large.isEmpty():
        more, roots = pairs_of_large(cut(rows.join(large, "band").select("band", "id")), grams, roots, least, few)
        pairs = pairs.unionByName(more)
    return stars(roots).unionByName(cut(verified(ordered(pairs), grams, least)))


def near_links(texts: DataFrame, found: DataFrame, more: DataFrame | None = None, least: float = LIKE) -> DataFrame:
    """Links (u, v) that connect what pairs of texts (id, text; equal texts have equal ids) with a Jaccard likeness of `least` or
    more connect. All come of pairs verified from the sets of WIDTH-word shingles.

    Candidates are pairs that share a band (found: id, bands), see linked(), and the pairs `more` (u, v). No pair of a band is left
    out. At 0.8 and 25 bands of 5 rows, a pair shares no band with a chance of about 5 in 100,000.
    """
    band = Window.partitionBy("band")
    shared = found.select("id", F.explode("bands").alias("band")).withColumn("_a", F.min("id").over(band)).withColumn("_b", F.max("id").over(band))
    shared = cut(shared.where("_a < _b").select("band", "id"))
    asked = shared.select("id")
    none = shared.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    if more is not None:
        more = cut(ordered(more))
        asked = asked.union(more.select("u")).union(more.select("v"))
    grams = cut(gram_sets(texts.join(asked.distinct(), "id", "left_semi").dropDuplicates(["id"])))
    known = none if more is None else cut(verified(more, grams, least))
    return linked(shared, grams, known, least)


def near_copies(docs: DataFrame, least: float = LIKE) -> DataFrame:
    """One row per row of docs: doc_id, class_id: the smallest doc_id that links of near copies reach (null if none has one).

    A null text counts as empty; texts of under WIDTH words are one shingle, texts without words are copies of each other. Copies
    are one text from the start and never become pairs. An empty table gives no rows; other columns are ignored.
    """
    rows = told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    found = cut(marks(rows.select("id", "text")).dropDuplicates(["id"]))
    roots = components(near_links(rows.select("id", "text"), found, None, least))
    named = cut(rows.select("doc_id", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    return named.join(named.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("doc_id", "class_id")
