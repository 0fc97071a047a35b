"""Operator 6: byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a batch that were not met before are laid out in one array. An index maps each adjacent pair of symbols
to all its positions; pairs that can merge wait in a heap by rank. The lowest rank is applied at all its positions, left to
right, and the lists of the pairs that this creates are updated. A merge never creates a pair of a lower rank, as a merged symbol
can only be part of later merges, so one ascending pass is exact.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import carried

#: Fixed value: the pattern that splits text before merges, as the vocabulary's publisher gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens whose ids a task keeps; beyond it the memory starts anew.
REMEMBERED = 250_000

#: Characters of text laid out at once.
BATCH_CHARS = 1_000_000
#: Rows encoded and returned at once.
ROWS = 512

#: Texts of these characters alone (ASCII but for the separators 1C to 1F, Latin letters) are split by the faster of two engines.
_plain = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ɏ]")
_letter = "A-Za-zÀ-ÖØ-öø-ɏ"
_fast = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_letter}]+| ?[0-9]+| ?[^\x09-\x0d\x20{_letter}0-9]+|[\x09-\x0d\x20]+(?![^\x09-\x0d\x20])|[\x09-\x0d\x20]+")
_full = regex.compile(PATTERN)


def pretokens(text: str) -> list[str]:
    return (_full if _plain.search(text) else _fast).findall(text)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself if it is visible, else the next one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        names = vocab | self.specials
        self.bytes_of = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_of[i] = name.encode() if i in self.specials.values() else bytes(back[c] for c in name)
        #: pair (left << 32 | right): rank << 32 | merged id
        self.merges = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encode words and remember them."""
        merges, byte_id = self.merges, self.byte_id
        symbols: list[int] = []
        starts = []
        for w in words:  # -1 stands between words
            starts.append(len(symbols))
            symbols.extend([byte_id[b] for b in w.encode()])
            symbols.append(-1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        heap: list[tuple[int, int]] = []

        flat = np.array(symbols, np.int64)
        keys = np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] << 32 | flat[1:], -1)
        order = np.argsort(keys, kind="stable")
        kinds, firsts = np.unique(keys[order], return_index=True)
        for key, at in zip(kinds.tolist(), np.split(order, firsts[1:])):
            if key in merges:
                index[key] = at.tolist()
                heap.append((merges[key], key))
        heapq.heapify(heap)

        while heap:
            merged, key = heapq.heappop(heap)
            left, right, new = key >> 32, key & 0xFFFFFFFF, merged & 0xFFFFFFFF
            for p in sorted(index.pop(key)):
                q = after[p]
                if symbols[p] != left or symbols[q] != right:
                    continue  # a merge of lower rank took part of it
                symbols[p], symbols[q] = new, -2
                r = after[p] = after[q]
                before[r] = p
                o = before[p]
                if o >= 0 and symbols[o] >= 0:
                    pair = symbols[o] << 32 | new
                    if pair in merges:
                        if pair in index:
                            index[pair].append(o)
                        else:
                            index[pair] = [o]
                            heapq.heappush(heap, (merges[pair], pair))
                if symbols[r] >= 0:
                    pair = new << 32 | symbols[r]
                    if pair in merges:
                        if pair in index:
                            index[pair].append(p)
                        else:
                            index[pair] = [p]
                            heapq.heappush(heap, (merges[pair], pair))

        done = np.array(symbols, np.int64)
        live = done[done != -2]
        data = live.astype("<u4").tobytes()
        ends = (np.flatnonzero(live == -1) * 4).tolist()
        known, start = self.known, 0
        for w, end in zip(words, ends):
            known[w] = data[start:end]
            start = end + 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers. Special tokens in a text become their ids."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            parts = [[(s, None) if s in self.specials else (None, pretokens(s)) for s in (self.split_specials.split(t) if any(x in t for x in self.specials) else [t]) if s] for t in texts[start:end]]
            if len(self.known) > REMEMBERED:
                self.known = {}
            new: set[str] = set()
            for part in parts:
                for _, tokens in part:
                    if tokens:
                        new.update(tokens)
            new.difference_update(self.known)
            if new:
                self.learn(list(new))
            get = self.known.__getitem__
            for part in parts:
                out.append(b"".join(self.specials[s].to_bytes(4, "little") if s is not None else b"".join(map(get, tokens)) for s, tokens in part))
            start = end
        return out

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; special tokens stay."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array<int>) if with_ids.

    path: a tokenizers file of kind byte-level BPE, readable at the same place on every worker; by default the public one that is
    installed there. A null text counts as empty and has no ids. Repeated rows give repeated rows, an empty table none; other
    columns are ignored. ids_sha256 digests the ids as little-endian unsigned 32-bit numbers, decoded_sha256 the decoded text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path or public_path())
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.iloc[at : at + ROWS]
                ids = c.encode([t or "" for t in batch.text])
                out = {
                    "doc_id": batch.doc_id,
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids],
                }
                if with_ids:
                    out["ids"] = [np.frombuffer(x, "<i4") for x in ids]
                yield pd.DataFrame(out)

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return carried(docs, run, schema, "text")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path or public_path())
        for batch in batches:
            texts = [c.decode(b"" if x is None else np.asarray(x, "<i4").tobytes()) for x in batch.ids]
            yield pd.DataFrame({"doc_id": batch.doc_id, "text": texts})

    return carried(encoded, run, "text string", "ids")
