"""Operator 13: licence scans by a positional index of rare words, in DataFrame functions only.

Templates are short notices and the telling sentences of licences. How many documents hold each of their words is counted over the
corpus; a template is indexed under its rarest words, with their places in it. In a file, the words that any template is indexed
under are found in one pass over its words. For each template the file's rarest of these are looked up: a place in the file less the
place in the template is where the template would start. There the places of its other indexed words must agree, within a tolerance
for words put in or left out, and last its mandatory phrases must stand at their places. What is in a file is decided within its row;
only the counts of words are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Words: runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z are lower-cased before.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words a long template is indexed under, and how many of those that a file holds are looked up in it.
INDEXED, LOOKED_UP = 6, 3
#: Templates up to this many words must stand word by word.
SHORT = 5


@dataclass(frozen=True)
class Template:
    """A label, the words that show it, and phrases of them that must be there (by default, for short ones: all of it)."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def tolerance(self) -> int:
        """Words by which a place may be off."""
        return 0 if len(self.words) <= SHORT else len(self.words) // 8

    def must(self) -> list[tuple[list[str], int]]:
        """The mandatory phrases with their places."""
        words, out = self.words, []
        for phrase in self.phrases or (self.text,):
            p = phrase.split()
            out.append((p, next(i for i in range(len(words)) if words[i : i + len(p)] == p)))
        return out


#: Labels, and words of well-known public licences and notices.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0"),
    Template("mit", "mit license"),
    Template("apache", "apache license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("boost", "boost software license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("hereby granted free of charge", "merge publish distribute sublicense")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    Template("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "specific prior written permission")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0", "except in compliance with the license")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it", "gnu general public license")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("subject to the terms of the mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("unencumbered software released into the public domain",)),
    Template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("plainly marked as such", "misrepresented as being the original software")),
)


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))


def document_counts(docs: DataFrame, templates: Sequence[Template]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each word of the templates. As many rows as the templates have words come to
    the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = docs.select(F.array_append(F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(F.col("text"))), F.lit("")).alias("_held"))
    counts = {r["_word"]: r["_n"] for r in held.select(F.explode("_held").alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n")).collect()}
    return counts.get("", 0), {w: counts.get(w, 0) for w in vocabulary}


def index(templates: Sequence[Template], n_docs: int, counts: dict[str, int]) -> list[list[tuple[str, float, list[int]]]]:
    """For each template its rarest words (those in fewer documents first, then by name; a short one has one), their inverse document
    frequency, and their places in it."""
    out = []
    for t in templates:
        rare = sorted(set(t.words), key=lambda w: (counts[w], w))[: 1 if len(t.words) <= SHORT else INDEXED]
        out.append([(w, math.log((n_docs + 1) / (counts[w] + 1)), [i for i, x in enumerate(t.words) if x == w]) for w in rare])
    return out


def _literal(templates: Sequence[Template], own: list[list[tuple[str, float, list[int]]]]) -> Column:
    """The index as one constant."""

    def one(t: Template, words: list[tuple[str, float, list[int]]]) -> Column:
        entries = [F.struct(F.lit(w).alias("word"), F.lit(idf).alias("idf"), F.array(*map(F.lit, at)).alias("at")) for w, idf, at in words]
        phrases = [F.struct(F.lit(" ".join(p)).alias("text"), F.lit(len(p)).alias("n"), F.lit(at).alias("at")) for p, at in t.must()]
        return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.tolerance).alias("off"), F.array(*entries).alias("words"), F.array(*phrases).alias("phrases"))

    return F.array(*map(one, templates, own))


def _stands(words: Column, phrase: Column, n: Column | int, at: Column, off: Column) -> Column:
    """Whether phrase, of n words, starts in words at `at` or up to `off` words before or after it."""
    first = F.greatest(F.lit(0), at - off)
    window = F.slice(words, first + 1, F.greatest(F.lit(0), at + off + n - first))
    return F.contains(F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def _starts(template: Column, hits: Column) -> Column:
    """Where the template would start by the file's rarest words of it."""
    held = F.filter(template["words"], lambda w: F.exists(hits, lambda h: h["word"] == w["word"]))
    looked = F.slice(held, 1, LOOKED_UP)

    def by_word(w: Column) -> Column:
        return F.flatten(F.transform(F.filter(hits, lambda h: h["word"] == w["word"]), lambda h: F.transform(w["at"], lambda p: h["place"] - p)))

    return F.flatten(F.transform(looked, by_word))


def _places(template: Column, words: Column, hits: Column) -> Column:
    """(label, base, start, score) of each start at which half of the indexed words agree and all mandatory phrases stand."""

    def weighed(start: Column) -> Column:
        agree = F.filter(template["words"], lambda w: F.exists(w["at"], lambda p: _stands(words, w["word"], 1, start + p, template["off"])))
        whole = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, w: s + w["idf"])
        every = whole(template["words"])
        score = F.when(every > 0, F.least(F.lit(1.0), whole(agree) / every)).otherwise(1.0)
        return F.struct(template["label"].alias("label"), template["base"].alias("base"), start.alias("start"), score.alias("score"), F.size(agree).alias("agree"))

    def stand(x: Column) -> Column:
        return F.forall(template["phrases"], lambda p: _stands(words, p["text"], p["n"], x["start"] + p["at"], template["off"]))

    likely = F.filter(F.transform(_starts(template, hits), weighed), lambda x: x["agree"] * 2 >= F.size(template["words"]))
    return F.filter(likely, stand)


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and places: an array of
    (label, base, start, score), a template found more than once at a place as often as it was.

    n_base counts the places of base templates, first_word and last_word are the least and the greatest of them (null: none), from
    0. score is the best of all places: the share of a template's indexed words that agree, by inverse document frequency; 0 without
    a place. A null text counts as empty. Repeated rows give repeated rows and are counted as documents, a null doc_id stays null; an
    empty table gives no rows; other columns are ignored, whatever their names. Base templates must be short.
    """
    if any(t.base and len(t.words) > SHORT for t in templates):
        raise ValueError("base templates stand word by word")
    own = index(templates, *document_counts(docs, templates))
    indexed = sorted({w for words in own for w, *_ in words})
    rows = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    hit = F.transform("_words", lambda w, i: F.when(w.isin(indexed), F.struct(i.alias("place"), w.alias("word"))))
    rows = rows.select("doc_id", "_words", F.array_compact(hit).alias("_hits"))
    found = F.flatten(F.transform(_literal(templates, own), lambda t: _places(t, F.col("_words"), F.col("_hits"))))
    kind = "array<struct<label:string,base:boolean,start:int,score:double>>"
    light = F.transform(found, lambda x: F.struct(x["label"].alias("label"), x["base"].alias("base"), x["start"].alias("start"), x["score"].alias("score")))
    places = F.when(F.size("_hits") > 0, light).otherwise(F.array().cast(kind)).cast(kind)
    rows = rows.select("doc_id", F.size("_words").cast("long").alias("n_words"), places.alias("places"))
    base = F.filter("places", lambda x: x["base"])
    labels = lambda xs: F.array_join(F.sort_array(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    starts = F.transform("_base", lambda x: x["start"].cast("long"))
    return rows.withColumn("_base", base).select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("_base")).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"), "places",
    )
