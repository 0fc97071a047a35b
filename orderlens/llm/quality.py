"""Operator 4: quality rules as a bitmask ledger.

Every rule is measured and evaluated once; the ledger keeps the measurements and one bit for each rule that failed. Policies are
versioned sets of rules, applied later with bitwise and; ablations of any number of policies come from one grouping by mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import carried

#: Symbol characters that the base counts.
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits: name, measurement, fails above (else below) the limit.
RULES = (
    ("few_words", "n_words", False, 20),
    ("repeated_windows", "repeat_share", True, 0.30),
    ("symbols", "symbols_per_word", True, 0.10),
    ("exclamations", "exclamations_per_word", True, 0.25),
    ("upper_case", "upper_share", True, 0.35),
    ("word_runs", "run_share", True, 0.25),
    ("duplicate_lines", "duplicate_line_share", True, 0.50),
    ("few_letters", "letter_share", False, 0.40),
)
BIT = {name: 1 << i for i, (name, *_) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force; a document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


POLICIES = (
    Policy("v1", ("few_words", "repeated_windows")),
    Policy("v2", ("few_words", "repeated_windows", "symbols", "exclamations", "upper_case", "word_runs", "few_letters")),
)
CURRENT = POLICIES[-1]

#: Columns of the ledger beside doc_id: base measurements, those of the other rules, and the bits.
LEDGER = ", ".join([
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long",
    *(f"{m} double" for m in dict.fromkeys(m for _, m, _, _ in RULES) if m != "n_words"), "failed long",
])


def repeat_words(ids: np.ndarray, width: int = 8) -> int:
    """Words in windows of `width` words found twice or more; ids: one number for each word. Windows are compared exactly, by
    numbering pairs of words, pairs of pairs and so on."""
    if len(ids) <= width:
        return 0
    span = 1
    while span < width:  # width is a power of two
        _, ids = np.unique(ids[:-span] * (int(ids.max()) + 1) + ids[span:], return_inverse=True)
        span *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(ids) + width, np.int64)
    edges[: len(ids)] += again
    edges[width:] -= again
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: str | None) -> dict[str, float]:
    """All measurements of one text (null: empty). Shares of an empty text are 0; its letter share is 1."""
    text = text or ""
    words = text.encode().split()  # bytes.split() splits at exactly the six ASCII white-space characters
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [x for x in text.split("\n") if x.encode().split()] if "\n" in text else [text] if n else []
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    chars = len(text) - blanks
    runs = int(np.count_nonzero(ids[1:] == ids[:-1]))
    symbols, repeats = sum(map(text.count, SYMBOLS)), repeat_words(ids)
    upper, letters = 0, 0
    if text:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ascii_upper, ascii_lower = np.count_nonzero((codes >= 65) & (codes <= 90)), np.count_nonzero((codes >= 97) & (codes <= 122))
        other = codes[codes > 127]
        if len(other):
            kinds, counts = np.unique(other, return_counts=True)
            of = [chr(k) for k in kinds]
            upper = int(sum(c for k, c in zip(of, counts) if k.isupper()))
            letters = int(sum(c for k, c in zip(of, counts) if k.isalpha()))
        upper, letters = upper + int(ascii_upper), letters + int(ascii_upper + ascii_lower)
    dup = len(lines) - len(set(lines))
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats,
        "repeat_share": repeats / n if n else 0.0, "symbols_per_word": symbols / n if n else 0.0, "exclamations_per_word": text.count("!") / n if n else 0.0,
        "upper_share": upper / max(letters, 1), "run_share": runs / n if n else 0.0, "duplicate_line_share": dup / max(len(lines), 1), "letter_share": letters / chars if chars else 1.0,
    }


def failures(m: dict[str, float]) -> int:
    """The bits of the rules that measurements fail. The base's window rule compares whole numbers."""
    bits = 0
    for name, by, above, limit in RULES:
        if name == "repeated_windows":
            failed = 100 * m["n_repeat_words"] > 30 * m["n_words"]
        else:
            failed = m[by] > limit if above else m[by] < limit
        bits |= BIT[name] * failed
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, all measurements and `failed`, the bits of all failed rules.

    A null or empty text has no words, lines or symbols and fails few_words alone. Repeated rows give repeated rows, an empty
    table gives none, other columns are ignored. Texts are measured whole, one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.doc_id, batch.text):
                m = measure(text)
                rows.append({"doc_id": doc, **m, "failed": failures(m)})
            yield pd.DataFrame(rows, columns=["doc_id", *(c.split()[0] for c in LEDGER.split(", "))])

    return carried(docs, run, LEDGER, "text")


def apply(led: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with base_failed, kept and policy."""
    fails = lambda mask: F.col("failed").bitwiseAND(mask) != 0
    return led.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(BASE | policy.mask)).withColumn("policy", F.lit(policy.version))


def ablations(led: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """(policy, rule, n_failed, n_only): documents that fail a rule, and those that would be kept without it. At most 2^rules
    masks are counted first; the texts are not looked at again."""
    masks = led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    asked = [(p.version, name, p.mask, BIT[name]) for p in policies for name in p.rules]
    rules = led.sparkSession.createDataFrame(asked, "policy string, rule string, mask long, bit long")
    pairs = masks.crossJoin(F.broadcast(rules))  # at most 2^rules masks, a few rules a policy
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    only = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    counted = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    return pairs.groupBy("policy", "rule").agg(counted(hit).alias("n_failed"), counted(only).alias("n_only"))
