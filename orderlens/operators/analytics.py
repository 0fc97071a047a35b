"""The 22 analytics modules. Each takes and returns DataFrames; `as_of` is always given."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from orderlens.plans import scale
from orderlens.sources.shared import cut, dealt, small


def dbl(column, digits: int = 4) -> Column:
    return F.round((F.col(column) if isinstance(column, str) else column).cast("double"), digits)


def ratio(a, b, digits: int = 6) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


# -- A01 ------------------------------------------------------------------------------------------------------------------------
def rfm(orders: DataFrame, as_of: str, tiles: int = 5) -> DataFrame:
    """Recency, frequency and monetary tiles (the best = tiles; ties by customer id) and the named segment of each customer."""
    base = orders.groupBy("customer_id").agg(F.datediff(F.lit(as_of).cast("date"), F.max("order_date")).alias("recency"), F.count(F.lit(1)).alias("frequency"), F.sum("net").alias("monetary"))

    axes = {"r": ("recency", True), "f": ("frequency", False), "m": ("monetary", False)}
    out = scale.ranked(base, axes, "customer_id")
    for name in axes:
        out = out.withColumn(name, scale.ntile(tiles, f"{name}_rank"))
    segment = (
        F.when((F.col("r") >= 4) & (F.col("f") >= 4) & (F.col("m") == 5), "Champions").when((F.col("r") >= 3) & (F.col("f") >= 4), "Loyal Customers")
        .when((F.col("r") <= 2) & (F.col("f") >= 3), "At Risk").when((F.col("r") >= 4) & (F.col("f") <= 2), "New Customers")
        .when((F.col("r") <= 2) & (F.col("f") <= 2), "Hibernating").otherwise("Potential")
    )
    return out.select("customer_id", "recency", "frequency", dbl("monetary").alias("monetary"), F.concat("r", "f", "m").alias("rfm_score"), segment.alias("rfm_segment"))


def rfm_segments(scored: DataFrame) -> DataFrame:
    return scored.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customers"), dbl(F.sum(F.col("monetary").cast("decimal(20,4)"))).alias("monetary"))


# -- A02 ------------------------------------------------------------------------------------------------------------------------
def cohort(orders: DataFrame) -> DataFrame:
    """(cohort_month, months_since, customers, retention)."""
    first = orders.groupBy("customer_id").agg(F.trunc(F.min("order_date"), "MM").alias("cohort_month"))
    since = (F.year("order_date") - F.year("cohort_month")) * 12 + F.month("order_date") - F.month("cohort_month")
    active = orders.join(first, "customer_id").withColumn("months_since", since).groupBy("cohort_month", "months_since").agg(F.countDistinct("customer_id").alias("customers"))
    size = first.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("_size"))
    return active.join(size, "cohort_month").select("cohort_month", "months_since", "customers", ratio("customers", "_size").alias("retention"))


def cohort_matrix(orders: DataFrame, months: int = 12) -> DataFrame:
    wide = cohort(orders).where(F.col("months_since") < months).groupBy("cohort_month").pivot("months_since", list(range(months))).agg(F.first("retention"))
    return wide.select("cohort_month", *[F.col(str(i)).alias(f"m{i}") for i in range(months)])


# -- A03 ------------------------------------------------------------------------------------------------------------------------
def revenue(orders: DataFrame, grain: str = "month") -> DataFrame:
    by = orders.groupBy(F.date_trunc(grain, "order_date").cast("date").alias("period")).agg(F.sum("net").alias("_net"), F.count(F.lit(1)).alias("orders"))
    before = F.lag("_net").over(Window.orderBy("period"))  # one row a period
    return by.select("period", dbl("_net").alias("revenue"), "orders", ratio("_net", "orders", 8).alias("aov"), ratio(F.col("_net") - before, before).alias("growth"))


# -- A04 ------------------------------------------------------------------------------------------------------------------------
#: Products of an order that meet each other in one group; those of wider orders are dealt into blocks.
BLOCK = 200


def baskets(items: DataFrame, min_support: int, most_items: int | None = None) -> tuple[DataFrame, DataFrame, Row]:
    """(order, product) without repeats, rare products dropped; product counts; and of all orders (before most_items) their number and
    of the others the number of pairs and the most products. most_items: leave wider orders out. items is read once."""
    lines = cut(items.select("order_id", "product_id"))
    distinct = cut(dealt(lines, lines.count(), "order_id").distinct())
    widths = distinct.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"))
    fits = F.lit(True) if most_items is None else F.col("_n") <= most_items
    pairs = F.sum(F.when(fits, F.col("_n") * (F.col("_n") - 1) / 2)).cast("long")
    of = widths.agg(F.count("order_id").alias("orders"), F.coalesce(pairs, F.lit(0)).alias("pairs"), F.max(F.when(fits, F.col("_n"))).alias("widest")).first()
    distinct = distinct.where("product_id is not null")
    if most_items is not None:
        distinct = distinct.join(widths.where(fits).select("order_id"), "order_id")
    counts = cut(distinct.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support))
    # the products are put into a hash table, so the rows are not sorted
    rows = distinct if min_support <= 1 else distinct.join(counts.select("product_id").hint("shuffle_hash"), "product_id")
    return rows, counts, of


def basket_pairs(items: DataFrame, min_support: int = 2, most_items: int | None = None, min_confidence: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Pairs of products bought together: support (orders), confidence of b given a, lift. The products of an order with over
    `block` of them are dealt into blocks, and every pair of blocks is a group of its own, a list that is paired row by row."""
    rows, counts, of = baskets(items, min_support, most_items)
    rows = rows.where("order_id is not null").withColumn("_parts", F.lit(1).cast("long"))
    if (of.widest or 0) > block:
        wide = cut(rows.groupBy("order_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("_parts")).where(F.col("_parts") > 1))
        rows = rows.drop("_parts").join(small(wide), "order_id", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    rows = rows.withColumn("_mine", F.pmod(F.xxhash64("product_id"), F.col("_parts")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    rows = rows.select("order_id", F.least("_mine", "_other").alias("_a"), F.greatest("_mine", "_other").alias("_b"), F.struct(F.col("product_id").alias("p"), F.col("_mine").alias("m")).alias("_x"))
    lists = dealt(rows, of.pairs, "order_id", "_a", "_b").groupBy("order_id", "_a", "_b").agg(F.sort_array(F.collect_list("_x")).alias("_l"))
    firsts = lists.select("_a", "_b", "_l", F.posexplode("_l").alias("_i", "_u"))
    met = firsts.select("_a", "_b", "_u", F.explode(F.slice("_l", F.col("_i") + 2, F.size("_l"))).alias("_v"))
    met = met.where((F.col("_a") == F.col("_b")) | (F.col("_u.m") != F.col("_v.m"))).select(F.col("_u.p").alias("a"), F.col("_v.p").alias("b"))
    pairs = dealt(met, of.pairs, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    out = pairs.join(counts.select(F.col("product_id").alias("a"), F.col("n").alias("_na")), "a").join(counts.select(F.col("product_id").alias("b"), F.col("n").alias("_nb")), "b")
    out = out.select("a", "b", "support", ratio("support", "_na").alias("confidence"), F.round(F.col("support") * F.lit(of.orders) / (F.col("_na") * F.col("_nb")), 6).alias("lift"))
    return out.where(F.col("confidence") >= min_confidence)


def basket_itemsets(items: DataFrame, min_support: float, most_items: int | None = None) -> DataFrame:
    """Frequent itemsets of any size by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    rows, _, of = baskets(items, 1, most_items)
    lists = dealt(rows, of.orders + of.pairs, "order_id").groupBy("order_id").agg(F.array_sort(F.collect_set("product_id")).alias("items"))
    return FPGrowth(itemsCol="items", minSupport=min_support).fit(lists).freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))


# -- A06 ------------------------------------------------------------------------------------------------------------------------
def anomaly_z(daily: DataFrame, value: str = "value", rows: int = 30, limit: float = 3.0) -> DataFrame:
    """z-score of each day against the `rows` days before it (one row a day in all)."""
    w = Window.orderBy("day").rowsBetween(-rows, -1)
    z = F.when((F.count(value).over(w) >= 2) & (F.stddev_samp(value).over(w) > 1e-9), (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w))
    return daily.select("day", F.round(value, 4).alias("value"), F.round(z, 4).alias("z")).withColumn("is_anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))


def anomaly_iqr(daily: DataFrame, value: str = "value", fence: float = 1.5) -> DataFrame:
    q = daily.agg(F.percentile(value, 0.25).alias("_q1"), F.percentile(value, 0.75).alias("_q3"))
    out = daily.join(F.broadcast(q))  # one row
    gap = F.col("_q3") - F.col("_q1")
    odd = (F.col(value) < F.col("_q1") - fence * gap) | (F.col(value) > F.col("_q3") + fence * gap)
    return out.select("day", F.round(value, 4).alias("value"), odd.alias("is_anomaly"))


# -- A08 ------------------------------------------------------------------------------------------------------------------------
def sentiment(comments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, sentiment_label, sentiment_score) of comments (id, text) by a lexicon (word, weight +1/-1), which is small and fixed."""
    words = comments.select("id", F.explode_outer(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    hits = words.join(F.broadcast(lexicon), "word", "left").groupBy("id").agg(F.count_if(F.col("weight") > 0).alias("p"), F.count_if(F.col("weight") < 0).alias("n"))
    s = F.try_divide(F.col("p") - F.col("n"), F.col("p") + F.col("n"))
    label = F.when(s >= 0.2, "POSITIVE").when(s <= -0.2, "NEGATIVE").otherwise("NEUTRAL")
    score = F.when(s.isNull(), 0.0).when(F.abs(s) >= 0.2, F.abs(s)).otherwise(1 - F.abs(s))
    return hits.select("id", label.alias("sentiment_label"), F.round(score, 4).alias("sentiment_score"))


# -- A09 ------------------------------------------------------------------------------------------------------------------------
def customer_profile(orders: DataFrame, as_of: str) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"), F.sum("net").alias("lifetime_value"), F.min("order_date").alias("first_purchase_date"), F.max("order_date").alias("last_order_date"),
        F.sum(F.when(F.datediff(day, "order_date") <= 365, F.col("net"))).alias("arr"),
    ).withColumn("recency", F.datediff(day, "last_order_date"))


def segmentation(profile: DataFrame, k: int = 3, seed: int = 7) -> DataFrame:
    """(customer_id, ai_segment): rules first, then K-Means on value, engagement (if profile has engagement_score, else orders) and
    recency, clusters named by mean value."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    names = {1: ["loyalist"], 2: ["new_potential", "vip_champion"], 3: ["new_potential", "loyalist", "vip_champion"]}[k]
    fixed = F.when(F.col("recency") > 90, "at_risk").when((F.col("total_orders") == 1) & (F.datediff(F.date_add("last_order_date", F.col("recency")), "first_purchase_date") > 30), "undetermined")
    rows = cut(profile.withColumn("_fixed", fixed).withColumn("_value", F.col("lifetime_value").cast("double")))  # read for every round below
    rest = rows.where("_fixed is null")
    if rest.isEmpty():
        return rows.select("customer_id", F.col("_fixed").alias("ai_segment"))
    vectors = VectorAssembler(inputCols=["_value", "engagement_score" if "engagement_score" in profile.columns else "total_orders", "recency"], outputCol="_raw").transform(rest)
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(vectors).transform(vectors)
    scaled = cut(scaled.select("customer_id", "_value", "features"))
    found = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="_cluster").fit(scaled).transform(scaled)
    order = [r._cluster for r in found.groupBy("_cluster").agg(F.avg("_value").alias("v")).orderBy("v").collect()]  # k rows
    label = F.coalesce(*[F.when(F.col("_cluster") == c, names[i]) for i, c in enumerate(order)])
    return rows.where("_fixed is not null").select("customer_id", F.col("_fixed").alias("ai_segment")).unionByName(found.select("customer_id", label.alias("ai_segment")))


# -- A10 ------------------------------------------------------------------------------------------------------------------------
def abc_tier(items: DataFrame, as_of: str, a: float = 0.20, b: float = 0.50, basis: str = "revenue") -> DataFrame:
    """Tiers by the share of revenue (or of products: basis 'rank') before each product, best sellers first."""
    sums = items.groupBy("product_id").agg(F.sum("line_total").alias("revenue"))
    ranked = scale.running(sums, "revenue", "product_id", "revenue", descending=True)
    share = (F.col("rank_") - 1) / F.col("rows_") if basis == "rank" else F.col("before_").cast("double") / F.col("sum_").cast("double")
    out = ranked.withColumn("_share", share)
    tier = F.when(F.col("_share") < a, "A").when(F.col("_share") < b, "B").otherwise("C")
    return out.select("product_id", dbl("revenue").alias("revenue"), F.round("_share", 6).alias("share_before"), tier.alias("abc_tier"), F.lit(as_of).cast("date").alias("abc_computed_at"))


# -- A11 ------------------------------------------------------------------------------------------------------------------------
def margin(lines: DataFrame, by: list[str]) -> DataFrame:
    """Gross margin and its share of net by any columns of lines (line_total, line_discount, line_cost)."""
    sums = lines.groupBy(*by).agg(F.sum(F.col("line_total") - F.col("line_discount")).alias("_net"), F.sum("line_cost").alias("_cost"))
    return sums.select(*by, dbl("_net").alias("net"), dbl(F.col("_net") - F.col("_cost")).alias("gross_margin"), ratio((F.col("_net") - F.col("_cost")) * 100, "_net", 4).alias("gross_margin_pct"))


# -- A12 ------------------------------------------------------------------------------------------------------------------------
def churn_features(orders: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Features from orders before as_of - days; label 1 if none follows in those days."""
    cut = F.date_sub(F.lit(as_of).cast("date"), days)
    past = orders.where(F.col("order_date") < cut)
    base = past.groupBy("customer_id").agg(
        F.datediff(cut, F.max("order_date")).alias("recency"), F.count(F.lit(1)).alias("frequency"), F.sum("net").alias("_net"),
        F.datediff(F.max("order_date"), F.min("order_date")).alias("_span"), F.datediff(cut, F.min("order_date")).alias("tenure"),
    )
    later = orders.where((F.col("order_date") >= cut) & (F.col("order_date") < F.lit(as_of).cast("date"))).select("customer_id").distinct().withColumn("_came", F.lit(1))
    gap = F.coalesce(F.try_divide(F.col("_span").cast("double"), F.col("frequency") - 1), F.col("tenure").cast("double"))
    return base.join(later, "customer_id", "left").select("customer_id", "recency", "frequency", dbl("_net").alias("monetary"), F.round(gap, 4).alias("mean_gap"), "tenure", F.when(F.col("_came").isNull(), 1).otherwise(0).alias("churned"))


def churn_risk(features: DataFrame) -> DataFrame:
    """(customer_id, churned, churn_risk_score) by logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=["recency", "frequency", "monetary", "mean_gap", "tenure"], outputCol="_raw").transform(cut(features))  # read for each fit
    rows = cut(StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(rows).transform(rows).select("customer_id", "churned", "features"))
    fitted = LogisticRegression(labelCol="churned", regParam=0.01).fit(rows).transform(rows)
    return fitted.select("customer_id", "churned", F.round(vector_to_array("probability")[1], 2).alias("churn_risk_score"))


# -- A13 ------------------------------------------------------------------------------------------------------------------------
def geo(orders: DataFrame) -> DataFrame:
    """Revenue, orders and customers by region and country, with region totals and a grand total; share of all revenue."""
    by = orders.groupingSets([["region", "country"], ["region"], []], "region", "country").agg(F.sum("net").alias("_net"), F.count(F.lit(1)).alias("orders"), F.countDistinct("customer_id").alias("customers"), F.grouping_id().cast("int").alias("level"))
    total = F.max(F.when(F.col("level") == 3, F.col("_net"))).over(Window.partitionBy())
    return by.select("region", "country", "level", dbl("_net").alias("revenue"), "orders", "customers", ratio("_net", total).alias("share"))


def geo_features(orders: DataFrame) -> DataFrame:
    """GeoJSON-style features (without geometry), one a country."""
    props = F.struct("region", "country", F.col("revenue").cast("decimal(20,4)").alias("revenue"), "orders", "customers")
    return geo(orders).where("level = 0").select("country", F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"))).alias("feature"))


# -- A14 ------------------------------------------------------------------------------------------------------------------------
def seasonality(orders: DataFrame) -> DataFrame:
    """(kind, part, index): mean daily revenue of each month and weekday (1 = Sunday) over the mean of all days."""
    daily = orders.groupBy("order_date").agg(F.sum("net").cast("double").alias("v"))
    parts = daily.select("v", F.explode(F.create_map(F.lit("month"), F.month("order_date"), F.lit("weekday"), F.dayofweek("order_date"))).alias("kind", "part"))
    mean = F.broadcast(daily.agg(F.avg("v").alias("_all")))
    return parts.groupBy("kind", "part").agg(F.avg("v").alias("_v")).join(mean).select("kind", "part", F.round(F.col("_v") / F.col("_all"), 6).alias("index"))


# -- A15 ------------------------------------------------------------------------------------------------------------------------
def funnel(events: DataFrame, steps: list[str], days: int = 7) -> DataFrame:
    """Users that reach each step, each step strictly after the one before and within `days` of the first; conversions."""
    rows = events.where(F.col("event_type").isin(steps)).select("user_id", "event_type", "ts")
    at = rows.where(F.col("event_type") == steps[0]).groupBy("user_id").agg(F.min("ts").alias("t0")).withColumn("t", F.col("t0"))
    out = at.agg(F.count(F.lit(1)).alias("users")).withColumn("step", F.lit(1))
    for i, name in enumerate(steps[1:], 2):
        own = rows.where(F.col("event_type") == name).select("user_id", "ts")
        at = at.join(own, "user_id").where((F.col("ts") > F.col("t")) & (F.col("ts") <= F.col("t0") + F.expr(f"interval {days} days"))).groupBy("user_id", "t0").agg(F.min("ts").alias("t"))
        out = out.unionByName(at.agg(F.count(F.lit(1)).alias("users")).withColumn("step", F.lit(i)))
    names = F.array(*[F.lit(s) for s in steps])
    w = Window.orderBy("step")
    return out.select("step", names[F.col("step") - 1].alias("event_type"), "users", ratio("users", F.lag("users").over(w)).alias("step_conversion"), ratio("users", F.first("users").over(w)).alias("total_conversion"))


# -- A16 to A20, A22 ------------------------------------------------------------------------------------------------------------
def payment_channel(orders: DataFrame, revenue_orders: DataFrame) -> DataFrame:
    base = revenue_orders.groupBy("payment_method").agg(F.count(F.lit(1)).alias("orders"), F.sum("net").alias("_net"))
    refunds = orders.groupBy("payment_method").agg(F.avg(F.when(F.col("status") == "refunded", 1.0).otherwise(0.0)).alias("refund_rate"))
    share = ratio("_net", F.sum("_net").over(Window.partitionBy()))
    return base.join(refunds, "payment_method").select("payment_method", "orders", dbl("_net").alias("revenue"), share.alias("share"), ratio("_net", "orders", 8).alias("aov"), F.round("refund_rate", 6).alias("refund_rate"))


def attribution(orders: DataFrame, channel: str) -> DataFrame:
    """Revenue of each customer credited to the first touch, the last touch, and evenly to all; ties by order id."""
    when = F.struct("order_date", "order_id")
    total = orders.groupBy("customer_id").agg(F.sum("net").alias("_all"), F.min_by(channel, when).alias("_first"), F.max_by(channel, when).alias("_last"), F.count(F.lit(1)).alias("_n"))
    first = total.groupBy(F.col("_first").alias("channel")).agg(F.sum("_all").alias("f"), F.count(F.lit(1)).alias("customers_first"))
    last = total.groupBy(F.col("_last").alias("channel")).agg(F.sum("_all").alias("l"))
    even = orders.join(total, "customer_id").groupBy(F.col(channel).alias("channel")).agg(F.sum(F.col("_all").cast("double") / F.col("_n")).alias("e"))
    out = even.join(first, "channel", "left").join(last, "channel", "left")
    return out.select("channel", dbl(F.coalesce("f", F.lit(0)), 2).alias("first_touch"), dbl(F.coalesce("l", F.lit(0)), 2).alias("last_touch"), F.round("e", 2).alias("linear"), F.coalesce("customers_first", F.lit(0)).alias("customers_first"))


def returns(items: DataFrame, by: str = "product_id") -> DataFrame:
    """Percent of the orders of a product (or category) that were returned."""
    return items.groupBy(by).agg(F.countDistinct("order_id").alias("orders"), F.countDistinct(F.when(F.col("returned"), F.col("order_id"))).alias("returned_orders")).withColumn("return_rate", ratio(F.col("returned_orders") * 100, "orders", 4))


def fulfillment(orders: DataFrame, by: str = "region", sla_days: int = 5) -> DataFrame:
    rows = orders.where("delivery_days is not null")
    days = F.col("delivery_days").cast("double")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg(days), 4).alias("mean_days"), F.round(F.percentile(days, 0.5), 4).alias("p50_days"), F.round(F.percentile(days, 0.95), 4).alias("p95_days"), F.round(F.avg(F.when(days <= sla_days, 1.0).otherwise(0.0)), 6).alias("within_sla"))


def supplier(items: DataFrame, suppliers: DataFrame) -> DataFrame:
    sums = items.groupBy("supplier_id").agg(F.sum("line_total").alias("_rev"), F.sum("quantity").alias("units"), F.sum(F.col("line_total") - F.col("line_discount") - F.col("line_cost")).alias("_margin"), F.avg(F.when(F.col("returned"), 1.0).otherwise(0.0)).alias("_ret"))
    named = sums.join(suppliers.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier")), "supplier_id")
    named = scale.dense_rank(cut(named), "_rev", "revenue_rank", descending=True)
    return named.select("supplier_id", "supplier", dbl("_rev").alias("revenue"), "units", dbl("_margin").alias("margin"), F.round("_ret", 6).alias("return_rate"), "revenue_rank")


def supplier_delivery(items: DataFrame, suppliers: DataFrame, slow: int = 30) -> DataFrame:
    """(supplier_id, supplier, lines, delivery_days, slow_share): mean days from order to shipping of each supplier's lines, and the share
    of lines over `slow` days; lines of 0 to 180 days count."""
    days = F.datediff("ship_date", "order_date")
    rows = items.where(days.between(0, 180)).groupBy("supplier_id").agg(F.count(F.lit(1)).alias("lines"), F.avg(days).alias("_d"), F.avg((days > slow).cast("int")).alias("_s"))
    named = rows.join(suppliers.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier")), "supplier_id")
    return named.select("supplier_id", "supplier", "lines", F.round("_d", 6).alias("delivery_days"), F.round("_s", 6).alias("slow_share"))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson for all pairs in one aggregation."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"_{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def demographic(orders: DataFrame, customers: DataFrame) -> DataFrame:
    by = orders.join(customers.select("customer_id", "age_group", "gender"), "customer_id").cube("age_group", "gender").agg(F.countDistinct("customer_id").alias("customers"), F.sum("net").alias("_net"), F.count(F.lit(1)).alias("_n"), F.grouping_id().cast("int").alias("level"))
    return by.select("age_group", "gender", "level", "customers", dbl("_net").alias("revenue"), ratio("_net", "_n", 8).alias("aov"))


# -- forecasting ----------------------------------------------------------------------------------------------------------------
def daily_series(orders: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ds, y): daily revenue, 0 on days without orders between a key's first and last."""
    sums = orders.groupBy(*keys, F.col("order_date").alias("ds")).agg(F.sum("net").cast("double").alias("y"))
    span = sums.groupBy(*keys).agg(F.explode(F.sequence(F.min("ds"), F.max("ds"))).alias("ds")) if keys else sums.agg(F.explode(F.sequence(F.min("ds"), F.max("ds"))).alias("ds"))
    return span.join(sums, [*keys, "ds"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def fit_forecast(series: DataFrame, keys: list[str], horizon: int = 30, least_days: int = 14, width: float = 1.96) -> DataFrame:
    """yhat with a 95 % band for each day of history and `horizon` days after, per key: linear trend and weekday effects; under
    least_days of history the mean. Never below 0."""
    epoch = F.lit("1970-01-01").cast("date")
    rows = series.withColumn("x", F.datediff("ds", epoch).cast("double"))
    fits = rows.groupBy(*keys).agg(F.regr_slope("y", "x").alias("_b"), F.regr_intercept("y", "x").alias("_a"), F.avg("y").alias("_mean"), F.count(F.lit(1)).alias("_n"), F.max("ds").alias("_last"))
    trend = F.when(F.col("_n") >= least_days, F.col("_a") + F.col("_b") * F.col("x")).otherwise(F.col("_mean"))
    history = rows.join(fits, keys).withColumn("_t", trend).withColumn("_wd", F.dayofweek("ds"))
    effect = F.when(F.first("_n") >= least_days, F.avg(F.col("y") - F.col("_t"))).otherwise(0.0)
    weekday = history.groupBy(*keys, "_wd").agg(effect.alias("_e"))
    seen = history.join(weekday, [*keys, "_wd"]).withColumn("_f", F.col("_t") + F.col("_e"))
    spread = seen.groupBy(*keys).agg(F.coalesce(F.stddev_samp(F.col("y") - F.col("_f")), F.lit(0.0)).alias("_sd"))
    ahead = fits.withColumn("ds", F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon)))).withColumn("x", F.datediff("ds", epoch).cast("double")).withColumn("_t", trend).withColumn("_wd", F.dayofweek("ds"))
    ahead = ahead.join(weekday, [*keys, "_wd"], "left").withColumn("_f", F.col("_t") + F.coalesce("_e", F.lit(0.0))).withColumn("y", F.lit(None).cast("double"))
    both = seen.select(*keys, "ds", "y", "_f", F.lit(True).alias("is_historical")).unionByName(ahead.select(*keys, "ds", "y", "_f", F.lit(False).alias("is_historical"))).join(spread, keys)
    clip = lambda c: F.round(F.greatest(c, F.lit(0.0)), 2)
    return both.select(*keys, "ds", F.round("y", 4).alias("actual"), clip(F.col("_f")).alias("yhat"), clip(F.col("_f") - width * F.col("_sd")).alias("yhat_lower"), clip(F.col("_f") + width * F.col("_sd")).alias("yhat_upper"), "is_historical")


SEASONAL = {"low": 0.5, "medium": 1.0, "high": 1.5}


def scenario(forecast: DataFrame, grid: DataFrame, marketing: float = 0.10, price: float = -0.50) -> DataFrame:
    """Forecasts under each row of grid (marketing_pct, price_pct, seasonal), a list of settings to try: total and impact in %.

    yhat x (1 + marketing x m) x (1 + p) x (1 + price x p), the deviation from the mean scaled by the seasonal setting."""
    mean = Window.partitionBy()
    future = forecast.where("not is_historical").select("ds", "yhat").withColumn("_mean", F.avg("yhat").over(mean))
    scale_ = F.coalesce(*[F.when(F.col("seasonal") == k, v) for k, v in SEASONAL.items()])
    m, p = F.col("marketing_pct") / 100, F.col("price_pct") / 100
    changed = (F.col("_mean") + (F.col("yhat") - F.col("_mean")) * scale_) * (1 + marketing * m) * (1 + p) * (1 + price * p)
    rows = future.crossJoin(grid)  # a month of days with a list of settings
    return rows.groupBy("marketing_pct", "price_pct", "seasonal").agg(F.round(F.sum(changed), 2).alias("total"), F.round((F.sum(changed) / F.sum("yhat") - 1) * 100, 4).alias("impact_pct"))


def projected_mrr(forecast: DataFrame, days: int = 30) -> DataFrame:
    last = forecast.where("is_historical").agg(F.max("ds").alias("_last"))
    rows = forecast.join(F.broadcast(last))
    ahead = F.sum(F.when(~F.col("is_historical") & (F.col("ds") <= F.date_add("_last", days)), F.col("yhat")))
    past = F.sum(F.when(F.col("is_historical") & (F.col("ds") > F.date_sub("_last", days)), F.col("actual")))
    return rows.agg(F.round(ahead, 4).alias("projected"), F.round(past, 4).alias("last_period"), F.round(F.try_divide(ahead - past, past) * 100, 4).alias("change_pct"))


def latest_run(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the newest run_date of each series."""
    newest = forecasts.groupBy(*keys).agg(F.max("run_date").alias("run_date"))
    return forecasts.join(newest, [*keys, "run_date"]).dropDuplicates([*keys, "ds"])
