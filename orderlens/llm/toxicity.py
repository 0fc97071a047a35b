"""Operator 7: toxicity by Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labelled rows: whole words, and stems that stand at the start of many words, which labelled texts have
far oftener than others. A trie holds it. The automata of all its terms run over a token at once, as one automaton whose states
are sets of (trie node, edits) and are built when first met; most tokens die after three or four letters. An edit is a letter more,
a letter less, another letter or two letters swapped; a stem may have one before its last letter. Terms of FUZZY letters or more
take one edit, unless words that clean texts have lie so near to them. Each hit is then seen in its window of tokens: within a pair of
quotation marks, or beside words of reporting, it counts as quotation. A single mark, or one of inches, quotes nothing. A logistic model of the counts gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import carried, cut

#: Labelled rows that lexicon and model are fitted on, at most; which ones a hash of doc_id decides.
FIT_ROWS = 20_000
#: Toxic texts that must have a term; how much oftener (log) they must; clean texts that may have it, and that may have its neighbours.
LEAST, ODDS, CLEAN = 4, 3.0, 0.0005
#: Stems have these lengths; terms of FUZZY letters or more may match at one edit.
STEMS, FUZZY = range(3, 9), 4
#: Tokens to each side of a hit that its context is made of.
WINDOW = 6
#: Tokens that a quotation has at most; marks further apart are no pair.
QUOTED = 60
THRESHOLD = 0.7
#: Tokens whose matches a task keeps, and states of its automaton.
REMEMBERED, MOST_STATES = 400_000, 200_000

#: Quotation marks, and words of reporting in four languages.
QUOTES = "\"“”„«»‹›"
#: Which marks close a quotation that each mark opens, as languages have them.
CLOSES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "”": "”"}
REPORTS = frozenset(
    "said says say wrote quote quoted quotes called sagte sagt schrieb zitat nannte "
    "dit disait citation cité appelé dijo dice escribió cita citado llamó".split()
)

_token = re.compile(rf"[^\W_]+|[{QUOTES}]")


def tokens(text: str) -> list[str]:
    return _token.findall(text.lower())


def quotations(text: str) -> list[tuple[int, int]]:
    """(token of the opening mark, token of the closing mark) of a text's quotations, none within another.

    A mark opens if what stands before it is no letter, digit or closing punctuation and what follows is no space; it closes if what
    stands before it is no space and no letter or digit follows. A straight mark after a digit is of inches unless it closes what is open. A mark that
    opens takes the place of one that has not been closed.
    """
    low, open_, out = text.lower(), None, []
    for i, m in enumerate(_token.finditer(low)):
        mark = m[0]
        if mark not in CLOSES:
            continue
        before, after = low[m.start() - 1] if m.start() else " ", low[m.end()] if m.end() < len(low) else " "
        if open_ and mark in CLOSES[open_[1]] and i - open_[0] <= QUOTED and not before.isspace() and not after.isalnum():
            out.append((open_[0], i))
            open_ = None
        elif not after.isspace() and not before.isalnum() and before not in ".,;!?":
            open_ = i, mark
    return out


def fuzzy_by_length(terms: list[str]) -> list[str]:
    return [t for t in terms if len(t.rstrip("*")) >= FUZZY]


class Automaton:
    """Finds lexicon terms in tokens. terms: words, and stems written with a trailing *; fuzzy: those that match at one edit, too.

    A state is a set of (node, e): e = 0 or 1 edits, 2: a fuzzy stem is complete; or a letter, which must come next to complete a swap.
    """

    def __init__(self, terms: list[str], fuzzy: list[str] | None = None):
        fuzzy = set(fuzzy_by_length(terms) if fuzzy is None else fuzzy)
        self.child: list[dict[str, int]] = [{}]
        self.term: dict[int, list[str]] = {}
        self.word: list[int] = [0]  # what ends at a node: 0 nothing, 1 a term as it is written, 2 also at one edit
        self.stem: list[int] = [0]
        for term in terms:
            node = 0
            for c in term.rstrip("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word.append(0)
                    self.stem.append(0)
                node = self.child[node][c]
            (self.stem if term.endswith("*") else self.word)[node] = 1 + (term in fuzzy)
            self.term.setdefault(node, []).append(term)
        self._forget()
        self.known: dict[str, int] = {}

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._skip({(0, 0)}))

    def _skip(self, pairs: set) -> frozenset:
        """With what deleting one letter of a term reaches."""
        return frozenset(pairs | {(n, 1) for at, e in pairs if e == 0 for n in self.child[at].values()})

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            exact = any(e == 0 and (self.word[at] or self.stem[at]) for at, e in pairs)
            self.ends.append(2 if exact else int(any(e == 2 or e == 1 and self.word[at] == 2 for at, e in pairs)))
        return self.states[pairs]

    def _move(self, state: int, c: str) -> int:
        pairs = set()

        def edited(node: int) -> None:
            """The letter c, as it is written or swapped, led to node with one edit in all."""
            pairs.add((node, 1))
            if self.stem[node] == 2:
                pairs.add((node, 2))

        for at, e in self.sets[state]:
            if e == 2:
                pairs.add((at, 2))  # a stem takes any ending
            elif isinstance(e, str):
                if e == c:
                    edited(at)
            elif e == 1:
                if c in self.child[at]:
                    edited(self.child[at][c])
            else:
                if self.stem[at]:
                    pairs.add((at, 0))
                if c in self.child[at]:
                    pairs.add((self.child[at][c], 0))
                pairs.add((at, 1))
                for x, n in self.child[at].items():
                    pairs.add((n, 1))
                    if x != c and c in self.child[n]:
                        pairs.add((self.child[n][c], x))
        self.moves[state][c] = to = self._state(self._skip(pairs))
        return to

    def _run(self, token: str) -> int:
        if len(self.sets) > MOST_STATES:
            self._forget()
        state, dead = self.start, self.dead
        for c in token:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == dead:
                break
        return state

    def match(self, token: str) -> int:
        """2: a term as it is written; 1: a fuzzy term with one edit; 0: none."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known = {}
            state = self._run(token)  # may renew self.ends
            found = self.known[token] = self.ends[state]
        return found

    def near_terms(self, token: str) -> list[str]:
        """The fuzzy terms that a token matches at one edit, if it is none as it is written."""
        state = self._run(token)
        out = set()
        for at, e in self.sets[state] if self.ends[state] == 1 else ():
            if e == 2 or e == 1 and self.word[at] == 2:
                out.update(t for t in self.term[at] if t.endswith("*") == (e == 2))
        return sorted(out)


FEATURES = 5


def features(text: str, automaton: Automaton) -> list[float]:
    """Of one whole text: log counts of abuse as written, abuse with an edit, quotation; abuse to 100 tokens; any abuse."""
    found = tokens(text)
    kinds = {t: k for t in set(found) if (k := automaton.match(t))}
    plain = fuzzy = quoted = 0
    if kinds:
        spans = quotations(text) if any(t in CLOSES for t in found) else []
        for i, t in enumerate(found):
            if k := kinds.get(t):
                near = found[max(0, i - WINDOW) : i + WINDOW + 1]
                inside = any(a < i < b and min(i - a, b - i) <= WINDOW for a, b in spans)
                if inside or REPORTS.intersection(near):
                    quoted += 1
                elif k == 2:
                    plain += 1
                else:
                    fuzzy += 1
    return [np.log1p(plain), np.log1p(fuzzy), np.log1p(quoted), min(10.0, 100 * plain / max(1, len(found))), float(plain > 0)]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, n): texts of rows that have each term, words and stems alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            for text in batch.text:
                own = set(tokens(text))
                own |= {t[:k] + "*" for t in own for k in STEMS if len(t) >= k}
                n.update(own)
            yield pd.DataFrame({"term": list(n), "n": list(n.values())})

    return rows.select("text").mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(toxic: DataFrame, clean: DataFrame) -> list[str]:
    """Terms that toxic texts have far oftener than clean ones, without those that a stem among them covers. They come from a bounded
    sample, so they are bounded, too."""
    n1, n0 = toxic.count(), clean.count()
    if not n1:
        return []
    asked = term_counts(toxic).where(F.col("n") >= max(LEAST, 0.002 * n1))
    both = asked.join(term_counts(clean).withColumnRenamed("n", "n0"), "term", "left").fillna(0, ["n0"])
    odds = F.log((F.col("n") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    passed = both.where((F.col("n0") <= CLEAN * n0) & (odds >= ODDS)).select("term", "n").toPandas()
    count1 = dict(zip(passed.term, passed.n))
    most: dict[str, int] = {}  # texts of the commonest passed word that starts so
    for term, n in count1.items():
        if not term.endswith("*"):
            for k in STEMS:
                most[term[:k]] = max(n, most.get(term[:k], 0))
    kept: set[str] = set()
    for term in sorted(count1, key=lambda t: (not t.endswith("*"), len(t), t)):
        bare = term.rstrip("*")
        if any(bare[:k] + "*" in kept for k in STEMS if k <= len(bare)):
            continue
        if term.endswith("*"):  # a stem of one word's endings only is better had as the word
            if most.get(bare, 0) >= 0.8 * count1[term]:
                continue
        kept.add(term)
    return sorted(kept)


def fuzzy_terms(terms: list[str], clean: DataFrame) -> list[str]:
    """The terms of FUZZY letters or more to which words that clean texts have do not lie within an edit."""
    asked = fuzzy_by_length(terms)
    if not asked:
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = Automaton(asked)
        for batch in batches:
            found = [(term, n) for token, n in zip(batch.term, batch.n) for term in a.near_terms(token)]
            yield pd.DataFrame(found, columns=["term", "n"])

    words = term_counts(clean).where(~F.col("term").endswith("*"))
    near = words.mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    common = {r.term for r in near.where(F.col("n") > CLEAN * clean.count()).select("term").collect()}  # some of the terms
    return [t for t in asked if t not in common]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Weights, the last one for a constant, by Newton's steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


Lexicon = tuple[list[str], list[str]]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[Lexicon, np.ndarray]:
    """((terms, those that take an edit), weights) from at most about `rows` labelled rows that are not held out. Without labels: no
    terms, score 0."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    n = known.count()
    if not n:
        return ([], []), np.array([0.0] * FEATURES + [-30.0])
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
    # at most about FIT_ROWS pairs of numbers
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(cut(known)), "doc_id")
    sample = cut(sample.select("text", "toxic"))
    clean = sample.where("toxic = 0")
    terms = lexicon(sample.where("toxic = 1"), clean)
    fuzzy = fuzzy_terms(terms, clean)
    names = [f"f{i}" for i in range(FEATURES)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = Automaton(terms, fuzzy)
        for batch in batches:
            yield pd.DataFrame([[*features(t, a), y] for t, y in zip(batch.text, batch.toxic)], columns=[*names, "y"])

    got = sample.mapInPandas(run, ", ".join(f"{x} double" for x in (*names, "y"))).orderBy(*names, "y").toPandas().to_numpy()
    return (terms, fuzzy), logistic(got[:, :-1], got[:, -1])


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray]) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from THRESHOLD on), n_hits.

    A null text counts as empty; it and any text without a hit get the score of no hits. Repeated rows give repeated rows, an
    empty table none. A score looks at the whole text alone; other columns are ignored.
    """
    (terms, fuzzy), weights = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = Automaton(terms, fuzzy)
        for batch in batches:
            x = np.array([features(t or "", a) for t in batch.text]).reshape(-1, FEATURES)
            s = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            hits = np.rint(np.expm1(x[:, :3]).sum(axis=1)).astype(np.int64)
            predicted = (s >= THRESHOLD).astype(np.int32)
            yield pd.DataFrame({"doc_id": batch.doc_id, "held_out": batch.held_out, "score": s, "predicted": predicted, "n_hits": hits})

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return carried(rows, run, "held_out boolean, score double, predicted int, n_hits long", "held_out", "text")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
