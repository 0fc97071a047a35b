"""Operator 2: exact removal of repeated byte strings with run-length indexes of a Burrows-Wheeler transform.

A string of LENGTH bytes is removed where it also starts earlier. To bring equal strings together without comparing every document
with every other, each window of LENGTH bytes belongs to the place of its minimizer, the first smallest hash of the GRAM-byte strings
in it; neighbouring windows of one place form a segment. Equal windows have their minimizer at the same distance, so two windows of
one segment are never equal. A window reaches at least SIDE bytes beyond its minimizer to the left or to the right: each segment has
a key for either side, the hash of minimizer and SIDE bytes. A key met once needs no further look, and segments that are equal
throughout are one content with a first copy (the later ones go whole). Contents of one minimizer that share a key but differ are
indexed:

- the suffixes of the contents, in the order of their first copies, are sorted by prefix doubling;
- the Burrows-Wheeler transform is cut into runs, and suffix positions are sampled at both ends of each run. Where a run starts, the
  sample and the one at the end of the run before it are neighbours in the order; their bytes are compared;
- the contents are streamed: from a sampled position on, the length that matches the neighbour falls by one a byte, up to the next
  sample. These matching statistics cut the order into classes that agree in LENGTH bytes; all but the earliest of a class are marked.

Texts that are equal throughout are told apart by their digests first: only those of the smallest doc_id are looked at, the others go
whole. Where more than CROWD different contents share a minimizer, their segments are cut in two by longer keys, which hold half of
what was left of the window, until they part; at the length of a window there is one content only. So no index grows with a hot
passage, and all go through one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import carried, cut, small

LENGTH, GRAM = 100, 32
#: Places of a minimizer in a window; bytes beside it that a window has at least on one side.
SPAN, SIDE = LENGTH - GRAM + 1, (LENGTH + 1 - GRAM) // 2
#: Different contents of a key that go into one index; more are parted by longer keys first.
CROWD = 256
#: Bytes of contents in one index, and of texts hashed at once, about.
INDEX_BYTES, HASH_BYTES = 400_000, 400_000
#: Bits of a filter that tells tasks which keys repeat, at most: 2^27 bits are 16 MB. Other keys that share a bit are let through and
#: sorted out later. Beyond 2^24 repeated keys there is no filter: keys meet in a join.
FILTER_BITS = 27

_U = np.uint64
_rng = np.random.default_rng(77)
_TABLE = _rng.integers(0, 2**63, 256, np.uint64) * _U(2) + _U(1)
_STEP = [int(x) * 2 + 1 for x in _rng.integers(0, 2**62, 8)]
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray, odd: int) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(odd)
    return h ^ (h >> _U(29))


def gram_hashes(values: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed hash of the gram bytes from each place on; gram is a power of two. values: one random number for each byte."""
    h, span, level = values, 1, 0
    while span < gram:
        h = h[:-span] * _U(_STEP[level]) + h[span:]
        span, level = 2 * span, level + 1
    return _mixed(h, 0xBF58476D1CE4E5B9)


def first_least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest of each `width` neighbours."""
    at = np.arange(len(h), dtype=np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        later = h[step:] < h[:-step]
        at = np.where(later, at[step:], at[:-step])
        h = np.where(later, h[step:], h[:-step])
        span += step
    return at


class Segments:
    """The segments of some texts, as arrays: text (its number), start, count (windows), place (of the minimizer), m (its hash), left
    and right (keys; 0 where no window reaches so far), content (a hash of all bytes; equal contents have equal hashes)."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        long = np.flatnonzero(sizes >= LENGTH)
        if not len(long):
            self.text = self.start = self.count = self.place = self.m = self.left = self.right = self.content = np.empty(0, np.int64)
            return
        blob = np.frombuffer(b"".join(texts), np.uint8)
        values = _TABLE[blob]
        h = gram_hashes(values)
        place = first_least(h, SPAN)
        edge = np.zeros(len(place) + 1, np.int8)
        edge[offsets[long]] += 1
        edge[offsets[long] + sizes[long] - LENGTH + 1] -= 1
        valid = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        begins, closes = valid.copy(), valid.copy()
        begins[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
        closes[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
        start = np.flatnonzero(begins)
        count = np.flatnonzero(closes) - start + 1
        at = place[start].astype(np.int64)
        n = 1 << int(len(blob)).bit_length()
        sums = np.zeros(len(blob) + 1, np.uint64)
        np.cumsum(values * _powers(_BACK, n)[: len(blob)], out=sums[1:])

        def hashed(a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
            """Of the bytes from a up to b, where that is a string of the text."""
            a, b = np.clip(a, 0, len(blob)), np.clip(b, 0, len(blob))
            return _mixed(_mixed((sums[b] - sums[a]) * _powers(_BASE, n)[np.minimum(a, n - 1)] ^ (b - a).astype(np.uint64), 0x94D049BB133111EB), odd).view(np.int64)

        border = at - SIDE  # windows up to here hold the left key, later ones the right key
        self.text = np.searchsorted(offsets, start, "right") - 1
        self.m = h[at].view(np.int64)
        self.left = np.where(start <= border, hashed(at - SIDE, at + GRAM, 0xD6E8FEB86659FD93), 0)
        self.right = np.where(start + count - 1 > border, hashed(at, at + GRAM + SIDE, 0xA0761D6478BD642F), 0)
        self.content = hashed(start, start + count + LENGTH - 1, 0xE7037ED1A0B428DB)
        own = offsets[self.text]
        self.start, self.count, self.place = start - own, count, at - own


class RunIndex:
    """The index of some contents (bytes). Earlier contents and smaller offsets count as earlier."""

    def __init__(self, contents: list[bytes], length: int = LENGTH):
        if length < 6:
            raise ValueError("strings of 6 bytes or more")
        self.length, self.count = length, len(contents)
        sizes = np.fromiter(map(len, contents), np.int64, len(contents))
        self.ends = np.cumsum(sizes + 1) - 1  # the places of the end marks
        self.starts = self.ends - sizes
        n = self.size = int(self.ends[-1]) + 1
        inside = np.ones(n, bool)
        inside[self.ends] = False
        text = np.zeros(n, np.int16)
        text[inside] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int16) + 1
        order, left = self._sorted(text, sizes)

        last = text[order - 1]  # before the first suffix stands an end mark, as text[-1] is one
        starts = np.flatnonzero(np.concatenate(([True], (last[1:] != last[:-1]) | (last[1:] == 0))))  # no two end marks are equal
        self.run_start, self.run_head = starts, last[starts]
        # samples at the ends of runs: where each starts, and where the one before it ends
        self.run_first, before = order[starts], order[starts - 1]
        self.run_last = np.concatenate((before[1:], order[-1:]))
        match = np.zeros(len(starts), np.int32)
        limit = np.minimum(left[self.run_first], left[before])
        limit[0] = 0
        live = np.flatnonzero(limit > 0)
        while len(live):
            k = match[live]
            live = live[text[self.run_first[live] + k] == text[before[live] + k]]
            match[live] += 1
            live = live[match[live] < limit[live]]
        self.run_match = match

        border = self.matching()[order] < length
        border[0] = True
        self.class_start = np.flatnonzero(border)
        self.class_first = np.minimum.reduceat(order, self.class_start)
        first = np.empty(n, np.int32)
        first[order] = np.repeat(self.class_first, np.diff(np.append(self.class_start, n)))
        self.earliest = first  # of each position, the earliest that agrees with it in `length` bytes, itself included

    def _sorted(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the positions in the order of their suffixes, the bytes from each position to its end mark)."""
        n = len(text)
        own = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        place = np.arange(n, dtype=np.int32)
        left = self.ends[own].astype(np.int32) - place
        key = np.zeros(n, np.int64)
        for i in range(6):
            key = key << 9 | np.where(left >= i, text[np.minimum(place + i, n - 1)], 0)
        rank, order = self._ranked(key, np.where(left < 6, own, 0))
        span, longest = 6, int(sizes.max()) + 1
        while span < longest:
            ahead = np.where(left < span, own, len(sizes) + rank[np.minimum(place + span, n - 1)])
            rank, order = self._ranked(rank, ahead)
            span *= 2
        return order, left

    @staticmethod
    def _ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dense ranks of pairs, and an order by them."""
        wide = int(second.max()) + 1
        if int(first.max()) < 2**62 // wide:
            key = first.astype(np.int64) * wide + second
            order = np.argsort(key).astype(np.int32)
            new = key[order][1:] != key[order][:-1]
        else:
            order = np.lexsort((second, first)).astype(np.int32)
            new = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty(len(first), np.int32)
        rank[order] = np.concatenate(([0], np.cumsum(new)))
        return rank, order

    def matching(self) -> np.ndarray:
        """Matching statistics: the bytes in which each position agrees with the suffix before it in the order. Within a run the two
        neighbours go on together, so the match of a sampled position falls by one a byte until the next one."""
        by_place = np.argsort(self.run_first)
        at = self.run_first[by_place]
        steps = np.diff(np.append(at, self.size))
        falling = np.arange(self.size, dtype=np.int32) - np.repeat(at, steps)
        return np.maximum(np.repeat(self.run_match[by_place], steps) - falling, 0)

    def marks(self) -> list[np.ndarray]:
        """For each content, the offsets at which `length` bytes match that also start earlier."""
        hit = np.flatnonzero(self.earliest < np.arange(self.size))
        which = np.searchsorted(self.ends, hit)
        return np.split(hit - self.starts[which], np.searchsorted(which, np.arange(1, self.count)))


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, row, doc_id, text): id orders documents, a missing one first; row orders rows of one id, and is 0 if ids are unique."""
    doc = F.col("doc_id").cast("long")
    key = F.coalesce(doc, F.lit(-(2**63)))
    unique = docs.select(key.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    row = F.lit(0).cast("long") if unique else F.xxhash64("text")
    return docs.select(key.alias("id"), row.alias("row"), doc.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def whole_copies(rows: DataFrame) -> DataFrame:
    """(id, row, doc_id, n_bytes) of the rows whose whole text, of LENGTH bytes or more, also stands in a smaller doc_id."""
    digest = F.unhex(F.sha2("text", 256))
    names = rows.select("id", "row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("h"))
    names = cut(names.where(F.col("n_bytes") >= LENGTH))
    first = cut(names.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return cut(names.join(first, "h").where(F.col("id") > F.col("first")).select("id", "row", "doc_id", "n_bytes"))


def _blocks(texts) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(numbers, offsets, pieces) of texts in blocks of about HASH_BYTES; a longer text comes in pieces that hold each window once."""
    number, offset, pieces, total = [], [], [], 0
    for i, text in enumerate(texts):
        text = text.encode()
        for at in range(0, max(1, len(text) - LENGTH + 1), HASH_BYTES):
            piece = text[at : at + HASH_BYTES + LENGTH - 1]
            if total and total + len(piece) > HASH_BYTES:
                yield np.array(number), np.array(offset), pieces
                number, offset, pieces, total = [], [], [], 0
            number.append(i)
            offset.append(at)
            pieces.append(piece)
            total += len(piece)
    if pieces:
        yield np.array(number), np.array(offset), pieces


def _bit(value, bits: int):
    return F.shiftrightunsigned(value, 64 - bits)


def filter_bits(n: int) -> int:
    """Bits (as a power of two) of a filter for n keys: about sixteen a key, FILTER_BITS at most."""
    return min(FILTER_BITS, max(15, (16 * n).bit_length()))


def bit_filter(keys: DataFrame, bits: int) -> bytes:
    """2^bits bits, those of the keys (m) set; made by tasks in pieces of 4 KB."""
    pieces = keys.select((_bit(F.col("m"), bits) + 1).alias("b"))  # buckets and positions count from 1
    pieces = pieces.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros(2**bits // 8, np.uint8)
    for r in pieces.toLocalIterator():
        at = (r.k - 1) * 4096
        piece = np.frombuffer(bytes(r.bits), np.uint8)
        out[at : at + len(piece)] = piece[: len(out) - at]
    return out


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) >> _U(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


PIECES = "id long, row long, start long, n int, c binary, m long, place int, width int, body binary"


def occurrences(rows: DataFrame, most: int = 1 << (FILTER_BITS - 3)) -> DataFrame:
    """The segments with a key that may repeat (columns as in PIECES): windows from start on, n of them, without those whose key is
    met once; c digests their bytes. m, place and width tell the minimizer; body, the bytes, is there only where a key has
    different contents. Up to `most` repeated keys tasks look them up in filters; more meet the documents in a join."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, _, pieces in _blocks(batch.text):
                s = Segments(pieces)
                low = (s.content >> 32).astype(np.int32)
                key, c = np.concatenate((s.left, s.right)), np.concatenate((low, low))
                yield pd.DataFrame({"m": key[key != 0], "c": c[key != 0]})

    kinds = rows.select("text").mapInPandas(hashes, "m long, c int").groupBy("m")
    kinds = kinds.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    repeated = cut(kinds.where("n > 1").select("m", (F.col("low") != F.col("high")).alias("differ")))
    n = repeated.count()
    if n <= most:
        bits = filter_bits(n)
        sent = rows.sparkSession.sparkContext.broadcast((bit_filter(repeated, bits), bit_filter(repeated.where("differ"), bits)))
        source = rows.select("id", "row", "text")
    else:
        sent = None

        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for number, _, pieces in _blocks(batch.text):
                    s = Segments(pieces)
                    key, at = np.concatenate((s.left, s.right)), np.tile(number[s.text], 2)
                    own = pd.DataFrame({"id": batch.id.to_numpy(np.int64)[at], "row": batch.row.to_numpy(np.int64)[at], "m": key})
                    yield own[own.m != 0].drop_duplicates()

        own = rows.select("id", "row", "text").mapInPandas(keys, "id long, row long, m long").join(repeated, "m")
        own = own.groupBy("id", "row").agg(F.collect_list("m").alias("again"), F.collect_list(F.when(F.col("differ"), F.col("m"))).alias("differ"))
        source = rows.select("id", "row", "text").join(own, ["id", "row"])

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, own = batch.id.to_numpy(np.int64), batch.row.to_numpy(np.int64)
            for number, offset, pieces in _blocks(batch.text):
                s = Segments(pieces)
                if sent is not None:
                    again, differ = (lambda key, f=f: has_bit(f, key) for f in sent.value)
                else:
                    known = [np.unique(np.concatenate([*batch[c].iloc[np.unique(number)], np.empty(0, np.int64)])).astype(np.int64) for c in ("again", "differ")]
                    again, differ = (lambda key, f=f: np.isin(key, f) for f in known)
                has_left, has_right = (s.left != 0) & again(s.left), (s.right != 0) & again(s.right)
                body = has_left & differ(s.left) | has_right & differ(s.right)
                border = s.place - SIDE + 1
                a = np.where(has_left, s.start, np.maximum(s.start, border))
                b = np.where(has_right, s.start + s.count, np.minimum(s.start + s.count, border))
                keep = np.flatnonzero(has_left | has_right)
                text, a, b = s.text[keep], a[keep], b[keep]
                strings = [pieces[t][i : j + LENGTH - 1] for t, i, j in zip(text.tolist(), a.tolist(), b.tolist())]
                yield pd.DataFrame({
                    "id": ids[number[text]], "row": own[number[text]], "start": a + offset[text], "n": (b - a).astype(np.int32),
                    "c": pd.Series([xxhash.xxh3_128_digest(x) for x in strings], dtype=object),
                    "m": s.m[keep], "place": (s.place[keep] - a).astype(np.int32), "width": np.int32(GRAM),
                    "body": pd.Series([x if d else None for x, d in zip(strings, body[keep].tolist())], dtype=object),
                })

    return source.mapInPandas(found, PIECES)


def parted(body: bytes, place: int, width: int) -> list[tuple[int, int, int, bytes]]:
    """(offset, place, width, bytes) of the two parts of a piece by keys that are longer by half of what its windows have left."""
    more, n = (LENGTH + 1 - width) // 2, len(body) - LENGTH + 1
    border, out = place - more, []
    if border >= 0:
        out.append((0, border, width + more, body[: min(n - 1, border) + LENGTH]))
    if n - 1 > border:
        a = max(0, border + 1)
        out.append((a, place - a, width + more, body[a:]))
    return out


def refined(pieces: DataFrame) -> DataFrame:
    """The parts of pieces (columns as in PIECES)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, row, start, place, width, body in zip(batch.id, batch.row, batch.start, batch.place, batch.width, batch.body):
                for a, p, w, part in parted(body, place, width):
                    out.append((doc, row, start + a, len(part) - LENGTH + 1, xxhash.xxh3_128_digest(part), xxhash.xxh3_64_intdigest(part[p : p + w], w) - (1 << 63), p, w, part))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PIECES.split(", ")])

    return pieces.mapInPandas(run, PIECES)


def indexed_marks(contents: DataFrame) -> DataFrame:
    """contents (m, id, row, start, body), all of a minimizer m together and sorted by m in each partition -> (id, row, a, b): starts
    of marked windows from a up to, without, b."""

    def marks(block: pd.DataFrame) -> pd.DataFrame:
        block = block[block.m.duplicated(keep=False)].sort_values(["id", "row", "start"], kind="stable")  # one content repeats nothing
        out = []
        if not len(block):
            return pd.DataFrame(columns=["id", "row", "a", "b"]).astype(np.int64)
        found = RunIndex(list(block.body)).marks()
        for doc, row, start, offsets in zip(block.id.to_numpy(), block.row.to_numpy(), block.start.to_numpy(), found):
            if len(offsets):
                breaks = np.flatnonzero(np.diff(offsets) > 1) + 1
                for run in np.split(offsets, breaks):
                    out.append((doc, row, start + run[0], start + run[-1] + 1))
        return pd.DataFrame(out, columns=["id", "row", "a", "b"]).astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0  # slices of whole minimizers, but for the last one, which may go on
        for batch in batches:
            m = batch.m.to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
            for a, b in zip(cuts, cuts[1:]):
                if size >= INDEX_BYTES and waiting[-1].m.iloc[0] != m[a]:
                    yield marks(pd.concat(waiting))
                    waiting, size = [], 0
                waiting.append(batch.iloc[a:b])
                size += sum(map(len, batch.body.iloc[a:b]))
        if waiting:
            yield marks(pd.concat(waiting))

    return contents.mapInPandas(run, "id long, row long, a long, b long")


def settled(pieces: DataFrame, crowd: int) -> tuple[list[DataFrame], DataFrame | None]:
    """(tables of marks (id, row, a, b) of pieces, the parts of those with over `crowd` different contents of a key or None)."""
    origin = F.struct("id", "row", "start")
    window = F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")
    firsts = cut(pieces.groupBy("c").agg(F.min(origin).alias("f"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    later = pieces.select("id", "row", "start", "n", "c").join(firsts, "c").where(origin != F.col("f")).select("id", "row", *window)

    of_all = F.min(F.struct("id", "row", "start", "place", "width", "body")).alias("f")
    contents = cut(pieces.where("body is not null").groupBy("m", "c").agg(of_all).select("m", "c", "f.*"))
    kinds = cut(contents.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > crowd))
    if kinds.isEmpty():
        return [later, indexed_marks(contents.repartition("m").sortWithinPartitions("m"))], None
    kinds = small(kinds)
    apart = contents.join(kinds, "m", "left_anti")
    crowded = contents.join(kinds.select("m"), "m")
    return [later, indexed_marks(apart.repartition("m").sortWithinPartitions("m"))], cut(refined(crowded))


def copied(rows: DataFrame, crowd: int | None = None) -> DataFrame:
    """(id, row, spans) of rows (id, row, text): for each with copies, starts of marked windows as sorted (a, b) pairs."""
    pieces, tables = cut(occurrences(rows)), []
    for _ in range(LENGTH):
        found, pieces = settled(pieces, crowd or CROWD)
        tables += found
        if pieces is None:
            break
    marks = tables[0]
    for t in tables[1:]:
        marks = marks.unionByName(t)
    return marks.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def kept_parts(text: bytes, spans) -> tuple[list[bytes], int]:
    """(what stays of a text, maximal removed runs) for its marked windows."""
    out, runs, end = [], 0, 0
    at = None  # of the removed run that is open
    for a, b in spans:
        stop = b + LENGTH - 1
        if at is None or a > end:
            if at is not None:
                runs += 1
            out.append(text[end:a])
            at = a
        end = max(end, stop)
    runs += at is not None
    out.append(text[end:])
    return out, runs


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary: a cut may fall inside a
    character) if with_text.

    A null text counts as empty; texts under LENGTH bytes are whole, very long ones are looked at in pieces. Strings are judged on
    the input: of equal strings the one in the smallest doc_id, then with the smallest start, stays. A missing doc_id is smaller
    than all; rows of one doc_id with different texts are ordered by a hash of them, rows alike in both stand at the same place and
    fare alike. An empty table gives no rows; other columns are ignored.
    """
    every = _keyed(docs)
    whole = whole_copies(every)
    rows = every.join(small(whole.select("id", "row").distinct()), ["id", "row"], "left_anti")
    spans = cut(copied(rows))
    # only texts that may have spans are shuffled to them
    bits = filter_bits(spans.count())
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(spans.select(F.xxhash64("id", "row").alias("m")), bits))

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(has_bit(sent.value, keys.to_numpy(np.int64)))

    marked = rows.withColumn("_may", may(F.xxhash64("id", "row")))
    with_spans = marked.where("_may").join(spans, ["id", "row"], "left")
    with_spans = with_spans.select("doc_id", "text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))
    zero, size = F.lit(0).cast("long"), F.octet_length("text").cast("long")
    plain = marked.where("not _may").select(
        "doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "utf-8").alias("kept"),
    )
    nothing = F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"), F.encode(F.lit(""), "utf-8").alias("kept")
    gone = whole.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), *nothing)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, a, b in zip(batch.doc_id, batch.text, batch.a, batch.b):
                text = text.encode()
                parts, n = kept_parts(text, zip(a.tolist(), b.tolist())) if a is not None else ([text], 0)
                kept = b"".join(parts)
                out.append((doc, len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield frame if with_text else frame.drop(columns="kept")

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut_out = carried(with_spans, run, schema + (", kept binary" if with_text else ""), "text", "a", "b")
    others = plain.unionByName(gone)
    return cut_out.unionByName(others if with_text else others.drop("kept"))
