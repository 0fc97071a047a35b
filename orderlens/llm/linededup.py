"""Operator 5: line dedup by a suffix array over line-ID sequences, with distributed prefix doubling, in DataFrame functions only.

A document is the sequence of its lines that have words. Level k of the doubling sorts the suffixes by their first 2^k lines: every
class of equal ones is an interval of the suffix array whose longest common prefix is 2^k lines or more, and its rank is the place
where the interval starts. Level k + 1 ranks the pairs of ranks at a start and 2^k lines later, inside the interval of the first.
Starts that are alone in their class leave, as nothing longer from them can repeat, so places count repeating suffixes only.

Levels are doubled until no class of two is left. Two suffixes of one interval share a prefix of its length, so a start that is not the
first of its interval begins a run that also starts earlier (smaller doc_id, or same document, earlier line). Any repeated run is the
union of two such stretches of the largest power of two in it, one at its start, one at its end: the lines that repeated runs cover,
and the maximal runs they make, are those of the longest stretch at each start, merged. Later copies go.

With a floor of `least` words for a run, length in lines is not enough. Every line of a copy then lies in a shortest run of `least` words
that starts at it or ends at the copy's end, so it is enough to look at the shortest runs from each line on and up to each line. Such
a run has at most `least` lines, which is as far as levels are doubled; the intervals of the level below its length, at its start and
at its end, name its content exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, cut

#: Words that a repeated run must have: one, that is no floor, so every later copy of a run of lines with words goes.
LEAST_WORDS = 1
#: The floor of op5_line_suffixes, as its SQL has it.
SQL_WORDS = 20


def _own():
    return Window.partitionBy("id", "row").orderBy("seq")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with id (a null one before all others) and row, which tells rows of one doc_id apart."""
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("row", F.xxhash64("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """(id, row, seq, pos, words, line): the lines with words; line is the md5 of the line, pos its place among all lines."""

    def described(x: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), F.unhex(F.md5(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))

    some = F.filter(F.transform(F.split("text", "\n", -1), described), lambda x: x["words"] > 0)
    rows = _keyed(docs.select("doc_id", "text")).select("id", "row", F.posexplode(some).alias("seq", "x"))
    return rows.select("id", "row", "seq", "x.*")


def first_members(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with c, the first member of the rows that agree in keys; rows that are alone leave. The first members are written out,
    so that the join has plain shuffles on both sides, of which Spark can split a hot key's."""
    kinds = rows.groupBy(*keys).agg(F.min(F.struct("id", "seq", "row")).alias("c"), F.count(F.lit(1)).alias("_n"))
    return rows.join(cut(kinds.where("_n > 1").drop("_n")), keys)


def ranked(rows: DataFrame, keys: list[str], outer: Column, bucket: Column) -> DataFrame:
    """rows with c, the place where the interval of the rows that agree in keys starts; rows that are alone leave.

    Intervals are sorted by outer, where those of one outer interval start, and by the last of keys. They are counted in buckets of
    the last key first, so that no task sorts all of a hot outer interval. What a task adds up of buckets is small: 2^16 at the first
    level, then the square root of all lines at most."""
    kinds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_o", outer).withColumn("_b", bucket)
    kinds = cut(kinds)
    earlier = lambda *order: F.coalesce(F.sum("_n").over(Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = kinds.groupBy("_o", "_b").agg(F.sum("_n").alias("_n")).select("_o", "_b", earlier("_o", "_b").alias("_before"))
    inside = kinds.withColumn("_own", earlier("_o", "_b", keys[-1])).join(totals, ["_o", "_b"])
    return rows.join(cut(inside.select(*keys, (F.col("_o") + F.col("_before") + F.col("_own")).alias("c"))), keys)


def doubled(level: DataFrame, span: int, width: int) -> DataFrame:
    """From the ranks of `span` lines to those of 2 x span lines; width: places in a bucket."""
    ahead = level.withColumn("b", F.lead("c", span).over(_own())).withColumn("_at", F.lead("seq", span).over(_own()))
    ahead = ahead.where(F.col("_at") == F.col("seq") + span).select("id", "row", "seq", F.col("c").alias("a"), "b")
    return ranked(ahead, ["a", "b"], F.col("a"), F.floor(F.col("b") / width)).select("id", "row", "seq", "c")


def shortest_runs(lines: DataFrame, least: int) -> DataFrame:
    """(id, row, seq, n): the shortest runs of `least` words from each line on and up to each line, with n lines from seq.

    Lines that do not repeat are not there; a run must not step over one."""

    def reach(frame: Column, forward: bool) -> Column:
        """Lines of the shortest run in a list of (seq, words) from the line on; null if there is none."""
        sign = 1 if forward else -1
        start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"))
        step = F.aggregate(frame, start, lambda s, x: F.when((s["sum"] >= least) | (x["seq"] != F.col("seq") + s["n"] * sign), s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["sum"] + x["words"]).alias("sum"))))
        return F.when(step["sum"] >= least, step["n"])

    pair = F.struct("seq", "words")
    on = F.collect_list(pair).over(_own().rowsBetween(0, least - 1))
    back = F.reverse(F.collect_list(pair).over(_own().rowsBetween(1 - least, 0)))
    found = lines.select("id", "row", "seq", on.alias("_on"), back.alias("_back")).select("id", "row", "seq", reach(F.col("_on"), True).alias("_f"), reach(F.col("_back"), False).alias("_b"))
    ways = F.array(F.struct(F.col("seq").alias("seq"), F.col("_f").alias("n")), F.struct((F.col("seq") - F.col("_b") + 1).alias("seq"), F.col("_b").alias("n")))
    return found.select("id", "row", F.explode(F.array_distinct(ways)).alias("_w")).select("id", "row", "_w.*").where("n is not null").distinct()


def merged(stretches: DataFrame) -> DataFrame:
    """(id, row, seq, first) of the lines that stretches (id, row, seq, n: lines from seq on) cover; first: whether a maximal run starts.
    Each line looks at the furthest end so far in its document."""
    so_far = _own().rowsBetween(Window.unboundedPreceding, 0)
    reach = stretches.withColumn("_end", F.max(F.col("seq") + F.col("n")).over(so_far))
    spans = reach.withColumn("_last", F.lag("_end").over(_own())).withColumn("_from", F.greatest(F.col("seq"), F.coalesce("_last", F.col("seq"))))
    lines = spans.where("_from < _end").select("id", "row", F.coalesce(F.col("seq") > F.col("_last"), F.lit(True)).alias("_apart"), "_from", F.explode(F.sequence("_from", F.col("_end") - 1)).alias("seq"), "_end")
    return lines.select("id", "row", "seq", (F.col("_apart") & (F.col("seq") == F.col("_from"))).alias("first"))


def longest_stretches(lines: DataFrame, width: int) -> DataFrame:
    """(id, row, seq, n): for each start of a run that also starts earlier, the longest power of two of lines that does."""
    level, span, found = lines.select("id", "row", "seq", "c"), 1, None
    while not level.isEmpty():
        first = level.groupBy("c").agg(F.min(F.struct("id", "seq")).alias("_f"))
        later = level.join(cut(first), "c").where((F.col("_f.id") < F.col("id")) | ((F.col("_f.id") == F.col("id")) & (F.col("_f.seq") < F.col("seq"))))
        own = cut(later.select("id", "row", "seq", F.lit(span).alias("n")))  # written, so that no plan holds all levels' joins
        found = own if found is None else found.unionByName(own)
        level = cut(doubled(level, span, width))
        span *= 2
    return lines.sparkSession.createDataFrame([], "id long, row long, seq int, n int") if found is None else found.groupBy("id", "row", "seq").agg(F.max("n").alias("n"))


def repeated_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(id, row, gone, n_runs): for each document with copies, the places of their lines, and the number of maximal runs."""
    every = cut(line_table(docs))
    width = max(1, int(every.count() ** 0.5))
    start = F.conv(F.hex(F.substring("line", 1, 2)), 16, 10).cast("int")  # md5s are even
    lines = ranked(every, ["line"], F.lit(0).cast("long"), start).select("id", "row", "seq", "pos", "words", "c")
    lines = cut(lines.dropDuplicates(["id", "row", "seq"]))
    if least <= 1:
        gone = merged(longest_stretches(lines, width)).join(lines.select("id", "row", "seq", "pos"), ["id", "row", "seq"])
        return gone.groupBy("id", "row").agg(F.sort_array(F.collect_list("pos")).alias("gone"), F.count_if("first").alias("n_runs"))
    level, span, levels = lines.select("id", "row", "seq", "c"), 1, []
    while span <= least:
        levels.append(level.withColumn("span", F.lit(span)))
        if 2 * span > least:
            break
        level = cut(doubled(level, span, width))
        span *= 2
    table = levels[0]
    for x in levels[1:]:
        table = table.unionByName(x)

    runs = shortest_runs(lines, least)
    span_of = F.lit(1)
    for k in range(1, len(levels)):
        span_of = F.when(F.col("n") >= 2**k, 2**k).otherwise(span_of)
    runs = runs.withColumn("span", span_of.cast("int"))
    head = table.select("id", "row", "seq", "span", F.col("c").alias("a"))
    tail = table.select("id", "row", F.col("seq").alias("_end"), "span", F.col("c").alias("b"))
    named = runs.join(head, ["id", "row", "seq", "span"]).withColumn("_end", F.col("seq") + F.col("n") - F.col("span"))
    named = named.join(tail, ["id", "row", "_end", "span"])
    named = first_members(named.select("id", "row", "seq", "n", "a", "b"), ["n", "a", "b"])
    copies = named.where((F.col("c.id") < F.col("id")) | ((F.col("c.id") == F.col("id")) & (F.col("c.seq") < F.col("seq"))))
    gone = copies.select("id", "row", F.explode(F.sequence("seq", F.col("seq") + F.col("n") - 1)).alias("seq")).distinct()
    gone = gone.join(lines.select("id", "row", "seq", "pos"), ["id", "row", "seq"])
    starts = F.when(F.lag("seq").over(_own()) == F.col("seq") - 1, 0).otherwise(1)
    return gone.withColumn("_start", starts).groupBy("id", "row").agg(F.sort_array(F.collect_list("pos")).alias("gone"), F.sum("_start").alias("n_runs"))


def dedup(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs with text freed of copies, and n_lines, n_removed, n_runs (columns of these names are replaced). n_chars, if there is
    one, follows the text.

    A null text stays null with no lines; an empty one has one line. Lines without words are no part of runs and stay. Rows of one
    doc_id stand at the same place, so none is earlier than the other; rows without one come before all. A document that is a
    copy throughout keeps its row with what has no words. An empty table gives no rows; other columns stay as they are, whatever
    their names.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("row")
    base = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("d"), *own)
    found = base.join(repeated_lines(docs, least), ["id", "row"], "left")
    parts = F.split(F.col("d")["text"], "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    was = lambda now, before: F.when(F.col("gone").isNull(), before).otherwise(now)
    text = was(kept, F.col("d")["text"])

    def column(c: str) -> Column:
        if c == "text":
            return text.alias(c)
        if c == "n_chars":
            return was(F.char_length(kept), F.col("d")[c]).cast(docs.schema[c].dataType).alias(c)
        return F.col("d")[c].alias(c)

    counts = [
        F.when(F.col("d")["text"].isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        was(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
    ]
    return found.select(*map(column, names), *counts)


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS cum FROM w WHERE n > 0),
r AS (SELECT a.doc_id, a.seq AS s, min(b.seq) AS e FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + 19 AND b.cum - a.cum + a.n >= 20 GROUP BY a.doc_id, a.seq
UNION SELECT b.doc_id, max(a.seq), b.seq FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + 19 AND b.cum - a.cum + a.n >= 20 GROUP BY b.doc_id, b.seq),
t AS (SELECT r.doc_id, r.s, r.e, string_agg(line, chr(10) ORDER BY seq) AS run FROM r JOIN s ON s.doc_id = r.doc_id AND s.seq BETWEEN r.s AND r.e GROUP BY r.doc_id, r.s, r.e),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS place FROM t),
g AS (SELECT DISTINCT s.doc_id, s.pos, s.seq FROM f JOIN s ON s.doc_id = f.doc_id AND s.seq BETWEEN f.s AND f.e WHERE place > 1),
m AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (seq - coalesce(before, -1) <> 1) AS n_runs FROM (SELECT *, lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM g) GROUP BY doc_id),
k AS (SELECT l.doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT k.doc_id, k.n_lines::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(k.text, '')) AS kept_sha256 FROM k LEFT JOIN m USING (doc_id)
"""
