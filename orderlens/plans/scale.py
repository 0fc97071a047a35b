"""Global ranks and running sums without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orderlens.sources.shared import cut

BUCKETS = 64


def _number(column: Column, kind: str) -> Column:
    """A number in the order of the column; of strings, their first six bytes."""
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "utf-8") if kind == "string" else column, 1, 6)), 12, "0"), 16, 10).cast("long")
    return F.unix_date(column) if kind == "date" else column


def _position(number: Column, bounds: list | None, kind: str) -> Column:
    """How many bounds are smaller, twice, plus 1 if the value is a bound: a value that fills whole buckets has one of its own. A
    missing value stands before all."""
    if not bounds:
        return F.when(number.isNull(), -1).otherwise(0)
    array = F.array(*[F.lit(b).cast(kind) for b in sorted(set(bounds))])
    place = F.size(F.filter(array, lambda b: b < number)) * 2 + F.array_contains(array, number).cast("int")
    return F.when(number.isNull(), -1).otherwise(place)


def ranked(df: DataFrame, axes: dict[str, tuple[str, bool]], tie: str, measure: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """df with {name}_rank (1, 2, ... by value, then by tie ascending) and {name}_before (sum of measure before the row) for each axis
    name: (value, descending), and with rows_ (count) and sum_ (of measure). Missing values stand first, descending or not.

    df is written once. Rows are cut into buckets by approximate quantiles of each value, all from one pass; buckets of a single value
    are cut again by quantiles of the tie. Any bounds give exact results. Only bucket totals (about 2 x buckets x buckets at most) are
    summed in one task.
    """
    key = df
    for i, (value, descending) in enumerate(axes.values()):
        key = key.withColumn(f"_v{i}", -F.col(value) if descending else F.col(value))
    key = cut(key.withColumn("_t", _number(F.col(tie), dict(df.dtypes)[tie])).withColumn("_m", F.col(measure) if measure else F.lit(1)))
    kinds = dict(key.dtypes)
    asked = ["_t", *(f"_v{i}" for i in range(len(axes)))]
    cuts = [F.percentile_approx(c, [i / buckets for i in range(1, buckets)], 10 * buckets).alias(c) for c in asked]
    bounds = key.agg(*cuts).first()
    inner = _position(F.col("_t"), bounds["_t"], kinds["_t"])
    out = key.crossJoin(F.broadcast(key.agg(F.count(F.lit(1)).alias("rows_"), F.sum("_m").alias("sum_"))))  # one row
    for i, name in enumerate(axes):
        part = _position(F.col(f"_v{i}"), bounds[f"_v{i}"], kinds[f"_v{i}"])
        whole = (part % 2 == 1) | (part == -1)
        place = F.struct(part.alias("p"), F.when(whole, inner).otherwise(0).alias("i"))
        totals = key.groupBy(place.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_m").alias("_s"))
        earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
        before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
        totals = totals.select("_b", before("_n", earlier).alias("_n0"), before("_s", earlier).alias("_s0"))
        order = Window.partitionBy("_b").orderBy(f"_v{i}", tie)
        out = out.withColumn("_b", place).withColumn("_k", F.row_number().over(order))
        out = out.withColumn("_w", before("_m", order.rowsBetween(Window.unboundedPreceding, -1))).join(F.broadcast(totals), "_b")
        out = out.withColumn(f"{name}_rank", F.col("_n0") + F.col("_k")).withColumn(f"{name}_before", F.col("_s0") + F.col("_w"))
        out = out.drop("_b", "_k", "_w", "_n0", "_s0")
    return out.drop(*asked, "_m")


def running(df: DataFrame, value: str, tie: str, measure: str | None = None, descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """df with rank_, before_, rows_ and sum_ for one axis; see ranked()."""
    out = ranked(df, {"_": (value, descending)}, tie, measure, buckets)
    return out.withColumnRenamed("__rank", "rank_").withColumnRenamed("__before", "before_")


def ntile(tiles: int, rank: str = "rank_") -> Column:
    """The tile of a rank among rows_, as the window function has it."""
    k, q, r = F.col(rank), F.floor(F.col("rows_") / tiles), F.col("rows_") % tiles
    big = r * (q + 1)
    return F.when(k <= big, F.ceil(k / (q + 1))).otherwise(r + F.ceil((k - big) / F.greatest(q, F.lit(1)))).cast("int")


def _by_value(df: DataFrame, value: str, descending: bool) -> DataFrame:
    """(_value, rank_ among different values, before_: rows of df before it, sum_: rows) of each value of df."""
    counts = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_one", F.lit(0))
    return running(counts, "_value", "_one", "_c", descending).drop("_one", "_c", "rows_")


def percent_rank(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """df with the percent_rank of value, missing ones first: values with their counts are ranked, and joined back."""
    out = df.join(_by_value(df, value, descending), F.col(value).eqNullSafe(F.col("_value")))
    rank = F.when(F.col("sum_") > 1, F.col("before_") / (F.col("sum_") - 1)).otherwise(0.0)
    return out.withColumn(name, rank).drop("_value", "rank_", "before_", "sum_")


def dense_rank(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """df with the dense_rank of value, missing ones first."""
    out = df.join(_by_value(df, value, descending), F.col(value).eqNullSafe(F.col("_value")))
    return out.withColumn(name, F.col("rank_").cast("int")).drop("_value", "rank_", "before_", "sum_")


def calendar(df: DataFrame, column: str) -> DataFrame:
    """One row for each day from the first to the last."""
    return df.agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias(column))
