"""Customer, product and segment views, the result table and insight bullets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orderlens.operators.analytics import dbl, ratio
from orderlens.plans import scale
from orderlens.sources.shared import cut

SORTS = {"highest_ltv": ("lifetime_value", True), "lowest_ltv": ("lifetime_value", False), "newest": ("first_purchase_date", True), "most_orders": ("total_orders", True)}


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with text in any of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c).cast("string")).contains(text.lower())
    return df.where(hit)


def page(df: DataFrame, key: str, tie: str, size: int = 20, descending: bool = True, after: tuple | None = None) -> DataFrame:
    """The next `size` rows by key, then tie; after: key and tie of the last row of the page before. No offset is counted."""
    if after is not None:
        k, t = F.lit(after[0]), F.lit(after[1])
        further = F.col(key) < k if descending else F.col(key) > k
        df = df.where(further | ((F.col(key) == k) & (F.col(tie) > t)))
    return df.orderBy(F.desc(key) if descending else F.asc(key), tie).limit(size)


def customer_list(customers: DataFrame, sort: str = "highest_ltv", where: Column | None = None, size: int = 20, after: tuple | None = None) -> DataFrame:
    key, descending = SORTS[sort]
    return page(customers if where is None else customers.where(where), key, "customer_id", size, descending, after)


def customer_cards(orders: DataFrame, as_of: str, past: DataFrame, vip: str = "vip_champion", days: int = 7) -> DataFrame:
    """On day as_of: average value, its change against the customers of a month before, customers at risk, customers new within
    `days`, and those who came into the segment `vip` within `days`, be they new or not. past: their segment history up to as_of."""
    day = F.lit(as_of).cast("date")
    known = orders.where(F.col("order_date") < day)
    before = known.where(F.col("order_date") < F.add_months(day, -1)).groupBy("customer_id").agg(F.sum("net").alias("v"))
    before = before.agg(F.avg(F.col("v").cast("double")).alias("_past"))
    now = known.groupBy("customer_id").agg(F.sum("net").alias("v"), F.datediff(day, F.min("order_date")).alias("age"), F.datediff(day, F.max("order_date")).alias("recency"))
    now = now.agg(F.avg(F.col("v").cast("double")).alias("_now"), F.count_if(F.col("recency") > 90).alias("at_risk"), F.count_if(F.col("age") <= days).alias("new_this_week"))
    held = (F.col("valid_from") <= day) & F.coalesce(F.col("valid_to") > day, F.lit(True))
    came = past.where(held & (F.col("segment") == vip)).agg(F.count_if(F.col("valid_from") > F.date_sub(day, days)).alias("new_vips_this_week"))
    change = F.round((F.col("_now") / F.col("_past") - 1) * 100, 4).alias("ltv_change_pct")
    return now.crossJoin(before).crossJoin(came).select(F.round("_now", 2).alias("average_ltv"), change, "at_risk", "new_this_week", "new_vips_this_week")  # one row each


def segment_summary(profile: DataFrame, segment: str = "region", before: DataFrame | None = None) -> DataFrame:
    """Customers, average value, ARR and orders of each segment, with a total row; the average engagement if profile has
    engagement_score; with before, the customers of a month ago under the segment they held then, the change of customers in %."""
    more = [F.avg("engagement_score").alias("_e")] if "engagement_score" in profile.columns else []
    by = profile.groupingSets([[segment], []], segment).agg(
        F.count(F.lit(1)).alias("customers"), F.avg(F.col("lifetime_value").cast("double")).alias("_l"), F.sum("arr").alias("_a"),
        F.avg("total_orders").alias("_o"), F.grouping_id().cast("int").alias("is_total"), *more,
    )
    columns = [F.round("_l", 2).alias("average_ltv"), dbl(F.coalesce("_a", F.lit(0))).alias("arr"), F.round("_o", 4).alias("average_orders")]
    if more:
        columns.append(F.round("_e", 2).alias("average_engagement"))
    if before is not None:
        past = before.groupingSets([[segment], []], segment).agg(F.count(F.lit(1)).alias("_past"), F.grouping_id().cast("int").alias("_total"))
        past = past.withColumnRenamed(segment, "_segment")
        by = by.join(past, F.col(segment).eqNullSafe(F.col("_segment")) & (F.col("is_total") == F.col("_total")), "left")
        columns.append(F.round((F.try_divide("customers", "_past") - 1) * 100, 4).alias("month_change_pct"))
    return by.select(segment, "is_total", "customers", *columns)


def engagement_score(profile: DataFrame) -> DataFrame:
    """100 x the mean of the percent ranks of recency (fewest days best) and frequency."""
    profile = cut(profile.select("customer_id", "recency", "total_orders"))
    rows = scale.percent_rank(scale.percent_rank(profile, "recency", "_r", descending=True), "total_orders", "_f")
    return rows.select("customer_id", F.round(50 * (F.col("_r") + F.col("_f")), 2).alias("engagement_score"))


def engagement_with_activity(profile: DataFrame, events: DataFrame, user: str = "user_id") -> DataFrame:
    """100 x the mean of the percent ranks of recency, frequency and activity, the events of the customer (none: 0)."""
    acts = events.groupBy(F.col(user).alias("customer_id")).agg(F.count(F.lit(1)).alias("activity"))
    rows = cut(profile.select("customer_id", "recency", "total_orders").join(acts, "customer_id", "left").withColumn("activity", F.coalesce("activity", F.lit(0))))
    for value, name, descending in (("recency", "_r", True), ("total_orders", "_f", False), ("activity", "_a", False)):
        rows = scale.percent_rank(rows, value, name, descending)
    return rows.select("customer_id", "activity", F.round(100 * (F.col("_r") + F.col("_f") + F.col("_a")) / 3, 2).alias("engagement_score"))


def product_list(products: DataFrame, category: str | None = None, active: bool | None = None, size: int = 20, after: tuple | None = None) -> DataFrame:
    """The next `size` products by name, of a category, active or not."""
    if category is not None:
        products = products.where(F.col("category") == category)
    if active is not None:
        products = products.where(F.col("is_active") == active)
    return page(products, "name", "product_id", size, False, after)


def inventory_cards(products: DataFrame) -> DataFrame:
    value = F.sum(F.col("stock_qty") * F.col("unit_price"))
    return products.agg(F.countDistinct("sku").alias("skus"), dbl(value, 2).alias("inventory_value"), F.count_if(F.col("stock_qty") < F.col("low_stock_threshold")).alias("low_stock"), F.countDistinct("category").alias("categories"))


def tier_summary(tiers: DataFrame) -> DataFrame:
    by = tiers.groupBy("abc_tier").agg(F.count(F.lit(1)).alias("skus"), F.sum(F.col("revenue").cast("decimal(20,4)")).alias("_r"))
    return by.select("abc_tier", "skus", dbl("_r", 2).alias("revenue"), ratio("_r", F.sum("_r").over(Window.partitionBy())).alias("share"))


def latest_result(results: DataFrame) -> DataFrame:
    """The newest row of each module that is not stale."""
    w = Window.partitionBy("analysis_type").orderBy(F.desc("computed_at"), F.desc("upload_job_id"))
    return results.where("not is_stale").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def insight_top3(kpis: DataFrame, group: str) -> DataFrame:
    """kpis (group, name, value, previous): the three largest relative moves of each group as bullets 1 to 3."""
    move = kpis.where("previous <> 0").withColumn("_m", (F.col("value") - F.col("previous")) / F.abs("previous") * 100)
    w = Window.partitionBy(group).orderBy(F.desc(F.abs(F.round("_m", 6))), "name")
    top = move.withColumn("bullet_index", F.row_number().over(w)).where("bullet_index <= 3")
    text = F.concat(F.col("name"), F.when(F.col("_m") >= 0, F.lit(" rose by ")).otherwise(F.lit(" fell by ")), F.round(F.abs("_m")).cast("long").cast("string"), F.lit(" %"))
    return top.select(group, "bullet_index", text.alias("bullet_text"))
