"""Operator 8: mixing sources to target weights by weighted fair queueing.

Every document waits in its source's shuffled queue; its virtual finish time is the source's words up to and including it, divided
by the source's target. Queues repeat up to three times. All documents are then range-sorted by finish time and taken until the
budget is spent. Neither the running sums nor the cut need a task that holds a source or the whole corpus: words are summed by
bucket first, and only the bucket in which the budget ends is looked at row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, cut, small

REPEATS = 3
#: Buckets of finish time to one virtual second, and of the shuffled order to a source.
FINE, QUEUE_BUCKETS = 4096, 4096


def weights(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with sid and weight: by code point, null last, they weigh 1, 2, 3, 1, ..."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("sid", rank).withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double"))


def fill(sources: DataFrame, budget: float, repeats: int = REPEATS) -> DataFrame:
    """sources with `target`: weight x level, at most repeats x source_size, the level such that targets sum to the budget.

    Sources in the order of their cap divided by weight: the first k are full for the smallest k at which the level of the rest
    overfills none. The level is the same for all others.
    """
    cap = F.col("source_size") * F.lit(float(repeats))
    order = Window.orderBy(cap / F.col("weight"), "sid")
    full = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    found = sources.withColumn("_level", (F.lit(float(budget)) - full) / rest).withColumn("_fits", F.col("_level") * F.col("weight") <= cap)
    first = F.min(F.when(F.col("_fits"), F.struct(cap / F.col("weight"), "sid", "_level"))).over(Window.partitionBy())
    return found.withColumn("target", F.least(F.coalesce(F.col("weight") * first["_level"], cap), cap)).drop("_level", "_fits")


def mix(docs: DataFrame, budget_share: float = 1.0, repeats: int = REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, times, taken (= times x size), and the columns `carry`.

    size counts words; a null or blank text has 0 and is never taken. The budget is budget_share of all sizes. A null source is a
    source of its own, last in order. The shuffled order is that of md5(doc_id), so reruns agree; repeated rows and null ids are
    rows like others. An empty table gives no rows. Other columns are ignored.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select("doc_id", *carry, "source", words.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_key")))
    sums = cut(weights(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    budget = (sums.agg(F.sum("source_size").alias("n")).first().n or 0) * budget_share
    sources = small(cut(fill(sums, budget, repeats)))

    rows = rows.join(sources, rows.source.eqNullSafe(sources.source)).drop(sources.source)
    rows = rows.withColumn("_q", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * QUEUE_BUCKETS / 2**32).cast("int"))
    queues = rows.groupBy("sid", "_q").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("sid").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    offsets = queues.select("sid", "_q", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum("size").over(Window.partitionBy("sid", "_q").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    rows = cut(rows.withColumn("_own", own).join(offsets, ["sid", "_q"]).withColumn("_sum", F.col("_before") + F.col("_own")).drop("_own", "_before", "_q", "_key"))

    def finish(turn):
        return (F.col("_sum") + F.col("source_size") * turn) / F.col("target")

    def slice_of(time):
        """Fine buckets up to two virtual seconds, then ever wider ones."""
        return F.when(time < 2, F.floor(time * FINE)).otherwise(F.floor(FINE * (F.log2(time) + 1))).cast("long")

    turns = rows.where("size > 0 and target > 0").select("sid", "_sum", "size", F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), finish(i).alias("time")) for i in range(repeats)])).alias("_t")).select("sid", "_sum", "size", "_t.*").withColumn("_slice", slice_of(F.col("time")))
    by_slice = turns.groupBy("_slice").agg(F.sum("size").alias("_n"))
    running = F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    last = by_slice.withColumn("_all", running).where(F.col("_all") > budget).orderBy("_slice").limit(1).first()
    if last is None:  # the budget takes everything
        end = None
    else:
        order = Window.orderBy("time", "sid", "_sum", "turn").rowsBetween(Window.unboundedPreceding, 0)
        inside = turns.where(F.col("_slice") == last._slice).withColumn("_all", F.sum("size").over(order) + F.lit(last._all - last._n))
        end = inside.where(F.col("_all") > budget).select("time", "sid", "_sum", "turn").orderBy("time", "sid", "_sum", "turn").first()
    times = F.lit(0)
    for i in range(repeats):
        is_in = F.lit(True) if end is None else F.struct(finish(i), F.col("sid").cast("int"), F.col("_sum").cast("long"), F.lit(i).cast("int")) < F.struct(F.lit(end.time).cast("double"), F.lit(end.sid).cast("int"), F.lit(end._sum).cast("long"), F.lit(end.turn).cast("int"))
        times = times + F.when((F.col("size") > 0) & (F.col("target") > 0) & is_in, 1).otherwise(0)
    return rows.withColumn("times", times).select("doc_id", *carry, "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, budget_share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """The rows of docs, all columns, each as often as mix() takes it. Rows alike in doc_id, source and text share their turns: each
    gets as many as all can have, and one of them what is left over. An empty table gives no rows."""
    keys = ["a", "b", "c"]
    own = F.col("doc_id").alias("a"), F.col("source").alias("b"), F.xxhash64("text").alias("c")
    marked = docs.select(F.struct("*").alias("row"), *own)
    slim = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("c"))
    turns = mix(slim, budget_share, repeats, ("c",)).groupBy(F.col("doc_id").alias("a"), F.col("source").alias("b"), "c")
    turns = turns.agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("n")).where("`all` > 0")
    turns = cut(turns.select(*keys, F.floor(F.col("all") / F.col("n")).cast("int").alias("each"), (F.col("all") % F.col("n")).cast("int").alias("rest")))
    like = turns.select(*[F.col(k).alias(f"{k}2") for k in keys], "each", "rest")
    same = F.col("a").eqNullSafe(F.col("a2")) & F.col("b").eqNullSafe(F.col("b2")) & (F.col("c") == F.col("c2"))
    found = marked.join(like, same)
    times = lambda df, n: df.where(F.col(n) > 0).select("row", F.explode(F.sequence(F.lit(1), F.col(n)))).select("row.*")
    out = times(found, "each")
    if not turns.where("rest > 0").isEmpty():
        out = out.unionByName(times(found.where("rest > 0").dropDuplicates(keys), "rest"))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS k FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS budget FROM g),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
f AS (SELECT arg_min(level, (cap / weight, sid)) AS level FROM l WHERE level * weight <= cap),
s AS (SELECT source, source_size, sid, budget, least(weight * f.level, cap) AS target FROM l, f),
q AS (SELECT doc_id, size, source_size, target, sid, budget, sum(size) OVER (PARTITION BY sid ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t AS (SELECT q.*, turn, (cum + source_size * turn)::DOUBLE / target AS finish FROM q, range(3) r(turn) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, sid, cum, turn ROWS UNBOUNDED PRECEDING) AS total FROM t),
x AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM o WHERE total <= budget GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN x USING (doc_id)
"""
