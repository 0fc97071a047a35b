"""Sentiment without a ready lexicon: seed words from rated texts, polarity spread over words and comments that share them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orderlens.sources.shared import cut, small

#: Comments a word must be in to have a polarity, and to be a seed.
LEAST, LEAST_SEED = 2, 3
#: Words, the most frequent, whose polarity is broadcast in each round, about; fewer than BROADCAST_ROWS.
FREQUENT = 90_000
#: Standard deviations from the mean beyond which a comment is positive or negative.
APART = 0.5
LABELS = ("POSITIVE", "NEGATIVE", "NEUTRAL")


def word_sets(comments: DataFrame, *more: str) -> DataFrame:
    """(id, ws) and the columns `more`: the different words of each comment (id, text), lower-cased runs of letters."""
    return comments.select("id", *more, F.array_remove(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), "").alias("ws"))


def words(sets: DataFrame, *columns: str) -> DataFrame:
    """A row with columns and word for each word of sets (ws)."""
    return sets.select(*columns, F.explode("ws").alias("word"))


def seed_words(rated: DataFrame, held: DataFrame, most: int = 20) -> DataFrame:
    """(word, weight): the `most` words whose log odds speak most for good texts (1) and as many for bad ones (-1).

    rated: (id, text, good boolean); held: (word, n), the comments each word is in, of which those with LEAST_SEED or more count. Log
    odds have half a text added everywhere; ties go by word. A word that speaks for neither side is no seed.
    """
    sets = cut(word_sets(rated, "good"))
    totals = sets.agg(F.count_if("good").alias("_good"), F.count_if(~F.col("good")).alias("_bad"))  # one row
    by = words(sets, "good").groupBy("word").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    by = by.join(held.where(F.col("n") >= LEAST_SEED), "word").crossJoin(F.broadcast(totals))
    side = lambda n, all_: F.ln((F.col(n) + 0.5) / (F.col(all_) - F.col(n) + 0.5))
    odds = cut(by.select("word", F.round(side("g", "_good") - side("b", "_bad"), 9).alias("odds")))
    best = odds.where("odds > 0").orderBy(F.desc("odds"), "word").limit(most).select("word", F.lit(1.0).alias("weight"))
    return best.unionByName(odds.where("odds < 0").orderBy("odds", "word").limit(most).select("word", F.lit(-1.0).alias("weight")))


def _of_comments(sets: DataFrame, rare: DataFrame | None, polarity: DataFrame) -> DataFrame:
    """(id, s): the mean polarity of each comment's words, by their inverse document frequency."""
    worth = [F.col("idf"), (F.col("idf") * F.col("p")).alias("_ip")]
    met = words(sets, "id").join(small(polarity.where("often")), "word").select("id", *worth)
    if rare is not None:
        met = met.unionByName(rare.join(polarity.where("not often"), "word").select("id", *worth))
    return met.groupBy("id").agg(F.try_divide(F.sum("_ip"), F.sum("idf")).alias("s"))


def _of_words(sets: DataFrame, rare: DataFrame | None, polarity: DataFrame) -> DataFrame:
    """(word, _s): the mean of the comments that have a word."""
    scores = _of_comments(sets, rare, polarity)
    scores = scores if rare is None else cut(scores)
    met = words(sets.join(scores, "id"), "s").join(small(polarity.where("often").select("word")), "word").select("word", "s")
    if rare is not None:
        met = met.unionByName(rare.join(scores, "id").select("word", "s"))
    return met.groupBy("word").agg(F.avg("s").alias("_s"))


def induce(comments: DataFrame, rated: DataFrame, rounds: int = 3, seeds: int = 20) -> tuple[DataFrame, DataFrame]:
    """((word, polarity, is_seed), (id, s)): polarity of words and comments (id, text).

    A comment is worth the mean of its words, weighted by inverse document frequency; a word the mean of the comments that have it; seeds
    keep 1 or -1. That is a walk over words that share comments without a pair of words ever being made: each round passes twice over
    the words of the comments, whose number is that of the text. The FREQUENT most frequent words meet their polarity where the
    comments lie, and only what is summed is shuffled; the other words, few of a text, are joined. Words in fewer than LEAST
    comments have no polarity.
    """
    sets = cut(word_sets(comments))
    held = cut(words(sets, "id").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST))
    known = held.count()
    # more comments than this: a frequent word
    most = held.agg(F.percentile_approx("n", 1 - FREQUENT / known, 10_000)).first()[0] if known > FREQUENT else 0
    total = comments.agg(F.count(F.lit(1)).alias("_all"))  # one row
    seeded = cut(seed_words(rated, held, seeds))
    start = held.join(small(seeded), "word", "left").crossJoin(F.broadcast(total))
    idf, weight = F.ln(F.col("_all") / F.col("n")).alias("idf"), F.coalesce("weight", F.lit(0.0)).alias("p")
    polarity = cut(start.select("word", idf, (F.col("n") > most).alias("often"), weight, F.col("weight").isNotNull().alias("is_seed")))
    rare = None
    if known > FREQUENT:
        left = words(sets, "id").join(small(polarity.where("often").select("word")), "word", "left_anti")
        rare = cut(left.join(polarity.where("not often").select("word"), "word").select("id", "word"))
    for _ in range(rounds):
        moved = polarity.join(_of_words(sets, rare, polarity), "word", "left")
        p = F.when(F.col("is_seed"), F.col("p")).otherwise(F.coalesce("_s", F.lit(0.0))).alias("p")
        polarity = cut(moved.select("word", "idf", "often", p, "is_seed"))
    return polarity.select("word", F.col("p").alias("polarity"), "is_seed"), _of_comments(sets, rare, polarity)


def labelled(comments: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, sentiment_label, sentiment_score) of all comments from (id, s): positive or negative where s is APART standard deviations or
    more from the mean of all, with a confidence that grows with the distance z, 1 - e^-|z|, and falls with it for neutral ones. A
    comment without a score is neutral with 0."""
    scores = cut(scores)
    whole = scores.agg(F.avg("s").alias("_m"), F.stddev_pop("s").alias("_d"))  # one row
    rows = comments.select("id").join(scores, "id", "left").crossJoin(F.broadcast(whole))
    rows = rows.select("id", F.round(F.coalesce(F.try_divide(F.col("s") - F.col("_m"), F.col("_d")), F.lit(0.0)), 6).alias("z"), F.col("s").isNull().alias("_none"))
    label = F.when(F.col("z") >= APART, "POSITIVE").when(F.col("z") <= -APART, "NEGATIVE").otherwise("NEUTRAL")
    sure = F.exp(-F.abs("z"))
    score = F.when(F.col("_none"), 0.0).when(F.abs("z") >= APART, 1 - sure).otherwise(sure)
    return rows.select("id", label.alias("sentiment_label"), F.round(score, 4).alias("sentiment_score"))


def score_by(comments: DataFrame, scorer: Callable[[pd.Series], pd.DataFrame], id_type: str = "long") -> DataFrame:
    """(id, sentiment_label, sentiment_score) by any scorer: of a series of texts it makes a frame with label and score, in its order.
    A null text is neutral with 0 and not shown to it; a label that is none of LABELS, or a score that is not from 0 to 1, fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"id": batch.id, "sentiment_label": "NEUTRAL", "sentiment_score": 0.0})
            some = batch.text.notna().to_numpy()
            if some.any():
                found = scorer(batch.text[some].reset_index(drop=True))
                if len(found) != some.sum() or not found.label.isin(LABELS).all() or not found.score.between(0, 1).all():
                    raise ValueError("a scorer gives each text one of the labels and a score from 0 to 1")
                out.loc[some, "sentiment_label"], out.loc[some, "sentiment_score"] = found.label.to_numpy(), found.score.to_numpy(float)
            yield out

    return comments.select("id", "text").mapInPandas(run, f"id {id_type}, sentiment_label string, sentiment_score double")
