"""Operator 10: language ID with segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; every language has a probability for each. A word's likelihood in a language is the
sum over all ways to segment it into pieces (forward algorithm), a text's the product over its words. Probabilities are expected
piece counts (forward-backward) over labelled rows, starting from equal probabilities; the counts are made by tasks and summed by
Spark, so the driver gets at most languages x vocabulary numbers.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import carried

#: Labelled rows that a model is fitted on, at most; which ones a hash of doc_id decides.
FIT_ROWS = 40_000
#: Words of more letters are summed in logarithms, and shorter ones too whose probability may be under e to the power of DEEP: floating
#: point would make them 0.
SHORT, DEEP = 40, -600.0
#: Words whose scores a task keeps, letters of them in all; letters of words looked at in one block.
REMEMBERED, REMEMBERED_LETTERS, BLOCK_LETTERS = 400_000, 8_000_000, 60_000
SMOOTHING = 0.5
#: Texts whose best language has a posterior under this are rejected by keep().
SURE = 0.6

_word = re.compile(r"[^\W\d_]+")


class Pieces(dict):
    """Numbers of pieces."""

    @cached_property
    def longest(self) -> int:
        return max(map(len, self), default=1)

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node of a first letter by its code point, column of a later letter by its code point, next node by [node, column], piece that
        a node ends or -1). Node 0 and column 0 stand for none. Nodes that lead on have the lowest numbers; the others have no row."""
        inner = sorted({p[:k] for p in self for k in range(1, len(p))})
        leaves = sorted(set(self).difference(inner))
        nodes = {x: i + 1 for i, x in enumerate(inner + leaves)}
        letters = {c: i + 1 for i, c in enumerate(sorted({x[-1] for x in nodes if len(x) > 1}))}
        first, column = np.zeros(sys.maxunicode + 1, np.int32), np.zeros(sys.maxunicode + 1, np.int16)
        for c, i in letters.items():
            column[ord(c)] = i
        following = np.zeros((len(inner) + 1, len(letters) + 1), np.int32)
        ends = np.full(len(nodes) + 1, -1, np.int32)
        for x, node in nodes.items():
            ends[node] = self.get(x, -1)
            if len(x) == 1:
                first[ord(x)] = node
            else:
                following[nodes[x[:-1]], letters[x[-1]]] = node
        return first, column, following, ends


@lru_cache(2)
def vocabulary(path: str) -> Pieces:
    """Pieces made of letters alone (a leading mark for the word's start apart), numbered from 1; 0 is any other letter."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    kept = dict.fromkeys(p.lower() for p in pieces if p.replace("▁", "", 1).isalpha() or p == "▁")
    return Pieces((p, i + 1) for i, p in enumerate(kept))


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased, with the mark of a word's start."""
    found = _word.findall(text.lower())
    if found and not "".join(found).isalpha():  # numerals like ² are no letters
        found = filter(None, ("".join(filter(str.isalpha, w)) for w in found))
    return ["▁" + w for w in found]


def lattice(group: list[str], pieces: Pieces) -> np.ndarray:
    """For words of one length n: piece ids [word, start, length - 1]; -1 where there is no piece. A letter without a piece is 0."""
    n, most = len(group[0]), min(pieces.longest, len(group[0]))
    ids = np.full((len(group), n, most), -1, np.int32)
    first, column, following, ends = pieces.trie
    letters = np.array(group, f"<U{n}").view(np.uint32).reshape(len(group), n)
    columns = column[letters]
    for i in range(n):
        node, at = first[letters[:, i]], np.arange(len(group))
        for k in range(1, min(most, n - i) + 1):
            ids[at, i, k - 1] = ends[node]
            on = np.flatnonzero((node > 0) & (node < len(following)))  # the words in which a longer piece may start here
            if not len(on) or i + k == n:
                break
            at = at[on]
            node = following[node[on], columns[at, i + k]]
    single = ids[:, :, 0]
    single[single < 0] = 0
    return ids


def steps(ids: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, words, pieces): the pieces that start at i, by length, and the words that have them."""
    for k in range(1, min(ids.shape[2], ids.shape[1] - i) + 1):
        at = ids[:, i, k - 1]
        on = np.flatnonzero(at >= 0)
        if len(on):
            yield k, on, at[on]


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of the starts' prefixes: [position, word, language]; p is [piece, language], last row 0."""
    m, n, _ = ids.shape
    a = np.zeros((n + 1, m, p.shape[1]))
    a[0] = 1
    for i in range(n):
        for k, on, at in steps(ids, i):
            a[i + k, on] += a[i, on] * p[at]
    return a


def backward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    m, n, _ = ids.shape
    b = np.zeros((n + 1, m, p.shape[1]))
    b[n] = 1
    for i in range(n - 1, -1, -1):
        for k, on, at in steps(ids, i):
            b[i, on] += b[i + k, on] * p[at]
    return b


def log_forward(ids: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The logarithms of forward(), from those of p, for words of any length."""
    m, n, _ = ids.shape
    a = np.full((n + 1, m, logs.shape[1]), -np.inf)
    a[0] = 0
    for i in range(n):
        for k, on, at in steps(ids, i):
            a[i + k, on] = np.logaddexp(a[i + k, on], a[i, on] + logs[at])
    return a


def log_backward(ids: np.ndarray, logs: np.ndarray) -> np.ndarray:
    m, n, _ = ids.shape
    b = np.full((n + 1, m, logs.shape[1]), -np.inf)
    b[n] = 0
    for i in range(n - 1, -1, -1):
        for k, on, at in steps(ids, i):
            b[i, on] = np.logaddexp(b[i, on], b[i + k, on] + logs[at])
    return b


def by_length(found) -> Iterator[list[str]]:
    """Groups of words of one length, of about BLOCK_LETTERS letters."""
    kinds: dict[int, list[str]] = {}
    for w in found:
        kinds.setdefault(len(w), []).append(w)
    for n, group in kinds.items():
        most = max(1, BLOCK_LETTERS // n)
        for i in range(0, len(group), most):
            yield group[i : i + most]


def most_letters(logs: np.ndarray) -> int:
    """The letters up to which no word's probability is too small for floating point; logs: of probabilities, without the last row."""
    least = logs.min(initial=-1e-9)
    return SHORT if least * SHORT >= DEEP else int(DEEP / least)


def word_logs(group: list[str], pieces: Pieces, p: np.ndarray, logs: np.ndarray, most: int) -> np.ndarray:
    """The logarithm of the sum over all segmentations: [word, language] for words of one length; logs: of p, most: most_letters()."""
    ids = lattice(group, pieces)
    if ids.shape[1] > most:
        return log_forward(ids, logs)[-1]
    return np.log(forward(ids, p)[-1])


def expected(counts: Counter, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected counts of pieces over all segmentations of counted words, under p ([piece, 1], last row 0)."""
    out = np.zeros(len(p) - 1)
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    most = most_letters(logs[:-1])
    for group in by_length(counts):
        ids = lattice(group, pieces)
        times = np.array([counts[w] for w in group], float)
        n = ids.shape[1]
        if n > most:
            a, b = log_forward(ids, logs)[:, :, 0], log_backward(ids, logs)[:, :, 0]
            share = lambda i, k, on, at: times[on] * np.exp(a[i, on] + logs[at, 0] + b[i + k, on] - a[-1, on])
        else:
            a, b = forward(ids, p)[:, :, 0], backward(ids, p)[:, :, 0]
            each = times / a[-1]
            share = lambda i, k, on, at: each[on] * a[i, on] * p[at, 0] * b[i + k, on]
        for i in range(n):
            for k, on, at in steps(ids, i):
                np.add.at(out, at, share(i, k, on, at))
    return out


class Model:
    """langs, and log-free piece probabilities [piece, language] (an added last row of zeros stands for no piece)."""

    def __init__(self, langs: list[str], p: np.ndarray, path: str):
        self.langs, self.p, self.path = langs, p, path
        with np.errstate(divide="ignore"):
            self.log_p = np.log(p)
        self.most = most_letters(self.log_p[:-1])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters, self.logs = 0, np.zeros((0, len(self.langs)))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text; `und` and 0 for one without letters, or if no language was learned."""
        pieces = vocabulary(self.path)
        if len(self.known) > REMEMBERED or self.letters > REMEMBERED_LETTERS:
            self.forget()
        found = [words(t) for t in texts]
        new = list(set().union(*found).difference(self.known)) if self.langs else []
        more = [self.logs]
        for group in by_length(new):
            at = len(self.known)
            self.known.update((w, at + i) for i, w in enumerate(group))
            self.letters += len(group) * len(group[0])
            more.append(word_logs(group, pieces, self.p, self.log_p, self.most))
        if new:
            self.logs = np.concatenate(more)
        get = self.known.__getitem__
        langs, scores = [], []
        for ws in found:
            if not ws or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.logs[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0)
            if not np.isfinite(total.max()):  # a given model in which no language can make the text
                langs.append("und")
                scores.append(0.0)
                continue
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            langs.append(self.langs[best])
            scores.append(float(odds[best] / odds.sum()))
        return langs, scores


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, rows: int = FIT_ROWS, path: str | None = None) -> Model:
    """A model from the text and lang of at most about `rows` rows that are not held out and have both."""
    pieces = vocabulary(path or public_path())
    size = len(pieces) + 1
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = usable.select("lang").count()
    if n > rows:
        usable = usable.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
    start = np.full((size + 1, 1), 1.0 / size)
    start[-1] = 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = vocabulary(path or public_path())
        seen: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in seen.items():
                sums[lang] = sums.get(lang, 0) + expected(counts, pieces, start)
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.lang, batch.text):
                seen.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, seen.values())) > REMEMBERED:
                flush()
        flush()
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "piece": at.astype(np.int32), "n": c[at]})

    counts = usable.select("lang", "text").mapInPandas(run, "lang string, piece int, n double")
    counts = counts.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts.lang.unique())
    p = np.full((size + 1, len(langs)), SMOOTHING)
    for i, lang in enumerate(langs):
        own = counts[counts.lang == lang]
        p[own.piece.to_numpy(), i] += own.n.to_numpy()
    p[-1] = 0
    return Model(langs, p / np.maximum(p.sum(axis=0), 1e-9), path or public_path())


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the posterior of lang_pred among the learned languages).

    The model is fitted on docs unless one is given. A text that is null or has no letter is `und` with score 0; so are all if no
    labelled row was learned from. Words of any length count whole; a letter that is no piece counts as the piece of all unknown
    letters, so a word without known pieces has a probability too. Repeated rows give repeated rows, an empty table none. A prediction looks at the text alone,
    the whole of it; other columns are ignored.
    """
    model = model or fit(docs)
    bare = (model.langs, model.p, model.path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*bare)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                langs, scores = m.score([t or "" for t in part.text])
                yield pd.DataFrame({"doc_id": part.doc_id, "held_out": part.held_out, "lang_pred": langs, "score": scores})

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return carried(rows, run, "held_out boolean, lang_pred string, score double", "held_out", "text")


def keep_documents(docs: DataFrame, model: Model | None = None, sure: float = SURE) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with a posterior of `sure` or more; no row is moved for it."""
    model = model or fit(docs)
    bare = (model.langs, model.p, model.path)

    @F.pandas_udf("boolean")
    def has_language(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*bare)
        for batch in texts:
            out = []
            for at in range(0, len(batch), 256):
                langs, scores = m.score([t or "" for t in batch.iloc[at : at + 256]])
                out += [lang != "und" and score >= sure for lang, score in zip(langs, scores)]
            yield pd.Series(out, dtype=bool)

    return docs.where(has_language(F.col("text")))
