"""Operator 12: alignment of two tokenizers, byte-level BPE (A) and pieces with byte fallback (B), over the same bytes.

Both tokenise a whole text. A place where both have a token end and the next token of both begins with a space is an anchor; texts whose
bytes either tokenizer changes are left out before, so an anchor's place is the same for both. Anchors split a document into windows
of token ids. What is inside a window, its groups between shared ends and its links of overlapping tokens, depends on the two tuples
of ids alone, so a task remembers it by these.

A link counts in how many documents of the corpus its id pair is linked. Tasks cut their rows into blocks; a block lists its different
pairs once, with the documents of the block that hold them, and each document names its windows by their place in the block. So
what is shuffled is a row for each pair and block, not one for each link, and a document's windows once, when they meet the counts.
No pair has more rows than there are blocks, and no block is larger than its bound of characters or one document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import bpe
from .common import cut

#: Characters of a block, if it is not one document.
BLOCK_CHARS = 1_000_000
#: Segments whose ids, and windows whose alignment, a task keeps; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Segments over this length are merged by the pair index of operator 6, whose time does not grow with the square of a word.
LONG_SEGMENT = 400
#: What tells B's ids from A's in a window's key.
SIDE = 1 << 30

#: Both tokenizers have a boundary wherever a space follows what is no white space.
_segments = re.compile(r"(?<=\S)(?= )")


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ..., counts[i] of them, for every i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


class Lists:
    """Lists of numbers that are added and gathered many at a time."""

    def __init__(self, kind: str):
        self.flat, self.start, self.size = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, flat.astype(self.flat.dtype)]), np.concatenate([self.size, size])

    def gather(self, lists: np.ndarray) -> np.ndarray:
        return self.flat[_spread(self.start[lists], self.size[lists])]


def _laid_out(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All entries, and the number of each list's."""
    return np.array([x for own in lists for x in own], np.int64), np.array([len(own) for own in lists], np.int64)


def _ends(size: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])


class Tokenizers:
    """Both tokenizers and what they have met."""

    def __init__(self, byte_path: str, piece_path: str):
        self.index = bpe.Codec(byte_path)
        self.a_bytes = [b"" if i in self.index.specials.values() else x for i, x in enumerate(self.index.bytes_of)]
        ranks = {x: i for i, x in enumerate(self.a_bytes) if x}
        self.ranks = tiktoken.Encoding("a", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.index.specials, self.index.split_specials = {}, None  # their strings are plain text here
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece with a space inside crosses segments")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.space = self.pieces.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_space, self.b_space = (np.array([x.startswith(b" ") for x in t]) for t in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.written = np.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], object)
        self.most = most
        self.forget_segments()
        self.forget_windows()

    def forget_segments(self) -> None:
        self.known: dict[str, int] = {}
        self.a, self.b, self.same = Lists("<i4"), Lists("<i4"), np.zeros(0, bool)

    def forget_windows(self) -> None:
        self.windows: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.groups = np.zeros(0, np.int64)
        self.links = Lists("<i8")

    def learn(self, segments: list[str]) -> None:
        """Tokenise segments, and see whether both give their bytes back."""
        short = self.ranks.encode_ordinary
        a = [short(s) if len(s) <= LONG_SEGMENT else np.frombuffer(self.index.encode([s])[0], "<i4").tolist() for s in segments]
        self.index.known = {}
        rest = [s[1:] for s in segments]  # the tokenizer adds the first space
        b = [ids if r else [self.space] for r, ids in zip(rest, self.pieces.encode(rest, num_threads=1))]
        wanted = [s.encode("utf-8", "replace") for s in segments]
        bytes_a, bytes_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        same = [b"".join(map(bytes_a, x)) == b"".join(map(bytes_b, y)) == w for x, y, w in zip(a, b, wanted)]
        self.known.update(zip(segments, range(len(self.known), len(self.known) + len(segments))))
        self.a.add(*_laid_out(a))
        self.b.add(*_laid_out(b))
        self.same = np.concatenate([self.same, np.array(same, bool)])

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids of all texts, the number of each text's, B's, theirs); none for texts that either does not give back byte by byte."""
        parts = [_segments.split(f" {t}") if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget_segments()
        if new := list({s for p in parts for s in p}.difference(self.known)):
            self.learn(new)
        met = np.fromiter(map(self.known.__getitem__, (s for p in parts for s in p)), np.int64)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        bad = np.zeros(len(parts), bool)
        bad[of[~self.same[met]]] = True
        met, of = met[~bad[of]], of[~bad[of]]
        counts = [np.bincount(of, weights=side.size[met], minlength=len(parts)).astype(np.int64) for side in (self.a, self.b)]
        return self.a.gather(met), counts[0], self.b.gather(met), counts[1]

    def align(self, keys: list[bytes]) -> None:
        """The groups and links of windows that were not met before, of all of them at once."""
        ids = np.frombuffer(b"".join(keys), "<i4")
        right = ids >= SIDE
        a, b = ids[~right], ids[right] - SIDE
        n = np.array([len(k) // 4 for k in keys], np.int64)
        count_b = np.diff(_ends(right)[_ends(n)])
        count_a = n - count_b
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        shared_a, shared_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        ends = np.union1d(end_a, end_b)  # between two of these lies one link: the tokens that overlap there
        links = a[np.searchsorted(end_a, ends)].astype(np.int64) << 32 | b[np.searchsorted(end_b, ends)]
        first_a, first_b = _ends(count_a), _ends(count_b)
        size = np.diff(np.searchsorted(ends, _ends(self.a_size[a])[first_a], side="right"))
        # A's tokens of a group are written before B's: each stands after those of the other side in the groups before it
        group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        written = np.empty(len(a) + len(b), object)
        written[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = self.written[a + shared_a * self.most]
        written[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = self.written[b + shared_b * (2 * self.most)]
        at = (first_a + first_b).tolist()
        written = written.tolist()
        self.texts += ["".join(written[s:e]) for s, e in zip(at, at[1:])]
        shared = _ends(shared_a)
        self.windows.update(zip(keys, range(len(self.groups), len(self.groups) + len(keys))))
        self.groups = np.concatenate([self.groups, np.diff(shared[first_a])])
        self.links.add(links, size)

    def cut_windows(self, a: np.ndarray, count_a: np.ndarray, b: np.ndarray, count_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the windows of all documents, the number of each one's)."""
        if len(self.windows) > REMEMBERED:
            self.forget_windows()
        start_a, start_b = _ends(self.a_size[a])[:-1], _ends(self.b_size[b])[:-1]
        first_a = _ends(count_a)
        near = np.minimum(np.searchsorted(start_b, start_a), max(0, len(b) - 1))
        meet = start_b[near] == start_a
        at_a, at_b = np.flatnonzero(meet), near[meet]
        first = np.zeros(len(a) + 1, bool)
        first[first_a] = True  # a document's start is an anchor, whatever it begins with
        anchors = first[at_a] | (self.a_space[a[at_a]] & self.b_space[b[at_b]])
        at_a, at_b = at_a[anchors], at_b[anchors]
        edges_a, edges_b = np.append(at_a, len(a)), np.append(at_b, len(b))  # both sides' ids of a window, A's before B's
        both = np.empty(len(a) + len(b), "<i4")
        both[np.arange(len(a)) + np.repeat(edges_b[:-1], np.diff(edges_a))] = a
        both[np.arange(len(b)) + np.repeat(edges_a[1:], np.diff(edges_b))] = b | SIDE
        laid, edges = both.tobytes(), ((edges_a + edges_b) * 4).tolist()
        keys = [laid[s:e] for s, e in zip(edges, edges[1:])]
        found = list(map(self.windows.get, keys))
        if new := list({k for k, n in zip(keys, found) if n is None}):
            self.align(new)
            found = map(self.windows.__getitem__, keys)
        return np.fromiter(found, np.int64, len(keys)), np.diff(np.searchsorted(at_a, first_a))


@lru_cache(2)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    """One for each Python worker."""
    return Tokenizers(byte_path, piece_path)


def public_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and chars + n > BLOCK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += n
    if texts:
        yield start, len(texts)


BLOCK_SCHEMA = (
    "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, windows binary, "
    "pairs array<long>, holders array<int>, inside binary, sizes binary"
)


def align_blocks(docs: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """A row for each document, with its counts, its groups (if with_groups), their digest and its windows; and one for each block with
    tokens, with its different pairs (A id << 32 | B id), how many of its documents hold each, and for its windows the pairs inside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizers(*(paths or public_paths()))
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        for batch in batches:
            ids, texts = batch.doc_id.tolist(), batch.text.tolist()
            for start, end in _blocks(texts):
                block += 1
                yield pd.DataFrame(list(one_block(t, block, ids[start:end], texts[start:end])), columns=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

    def one_block(t: Tokenizers, block: int, ids: list, texts: list) -> Iterator[tuple]:
        a, count_a, b, count_b = t.tokens(texts)
        every, count = t.cut_windows(a, count_a, b, count_b)
        kinds, places = np.unique(every, return_inverse=True)  # the block's windows
        names, inside = np.unique(t.links.gather(kinds), return_inverse=True)  # the block's pairs
        sizes = t.links.size[kinds]
        doc = np.repeat(np.arange(len(ids)), count)
        seen = np.unique(doc * max(1, len(kinds)) + places)  # each window once a document
        kind = seen % max(1, len(kinds))
        pairs = inside[_spread((np.cumsum(sizes) - sizes)[kind], sizes[kind])]
        held = np.unique(np.repeat(seen // max(1, len(kinds)), sizes[kind]) * max(1, len(names)) + pairs)
        n_groups, n_links = (np.bincount(doc, weights=x[every], minlength=len(ids)).astype(np.int64).tolist() for x in (t.groups, t.links.size))
        written, here, at = list(map(t.texts.__getitem__, every.tolist())), places.astype("<i4"), _ends(count).tolist()
        for i in range(len(ids)):
            groups = "".join(written[at[i] : at[i + 1]])[:-1]
            digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
            yield block, ids[i], int(count_a[i]), int(count_b[i]), n_groups[i], n_links[i], groups if with_groups else None, digest, here[at[i] : at[i + 1]].tobytes(), None, None, None, None
        if len(names):
            yield block, None, None, None, None, None, None, None, None, names, np.bincount(held % len(names), minlength=len(names)).astype("i4"), inside.astype("<i4").tobytes(), sizes.astype("<i4").tobytes()

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, BLOCK_SCHEMA)


def _block_pairs(aligned: DataFrame) -> DataFrame:
    held = aligned.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "x"))
    return held.select("block", "place", F.col("x.pairs").alias("pair"), "x.holders")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best) of the rows of align_blocks: in how many documents a pair is linked, and whether that is its A id's most.
    An A id has no more rows than B has ids."""
    counts = _block_pairs(aligned).groupBy("pair").agg(F.sum("holders").alias("n_docs"))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 32))))


def id_map(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(a, b, n_docs, best): all linked id pairs of the corpus."""
    counts = pair_counts(cut(align_blocks(docs, paths)))
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.expr("pair & 4294967295").cast("int").alias("b"), "n_docs", "best")


def align(docs: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if with_groups.

    paths: files of A (byte-level BPE, JSON) and B (pieces), readable at the same place on every worker; by default the public ones
    installed there. Null and empty texts, and texts that A or B does not give back byte by byte, have no tokens: zeros, and empty
    groups and digest. Repeated rows are documents of their own, in counts too; a null doc_id stays null; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    aligned = cut(align_blocks(docs, paths, with_groups))
    counts = cut(pair_counts(aligned))
    named = _block_pairs(aligned).select("block", "place", "pair").join(counts, "pair").select(F.col("block").alias("of_block"), "place", "n_docs", "best")
    more = ["groups"] if with_groups else []
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *more]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("place")
        block = left[left.inside.notna()].iloc[0]
        inside, sizes = np.frombuffer(block.inside, "<i4"), np.frombuffer(block.sizes, "<i4")
        of = np.repeat(np.arange(len(sizes)), sizes)
        n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)  # of a window
        np.add.at(n_best, of, right.best.to_numpy().astype(np.int64)[inside])
        np.add.at(count_sum, of, right.n_docs.to_numpy().astype(np.int64)[inside])
        out = left[left.inside.isna()].copy()
        places = [np.frombuffer(w, "<i4") for w in out.windows]
        out["n_best"], out["count_sum"] = [int(n_best[p].sum()) for p in places], [int(count_sum[p].sum()) for p in places]
        return out[columns]

    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if with_groups else "")
    kept = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *more, "windows", "inside", "sizes"]
    met = aligned.where("n_a > 0 or inside is not null").select(*kept).groupBy("block").cogroup(named.groupBy("of_block")).applyInPandas(meet, schema)
    none = aligned.where("n_a = 0").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).select(*columns)
    return met.unionByName(none).withColumn("doc_id", F.col("doc_id").cast("long"))
