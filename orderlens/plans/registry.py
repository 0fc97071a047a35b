"""The registered queries: each applies an operator to whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlens.functions import derive
from orderlens.operators import analytics as an, forecasting, history, ingest, kpi, lookup, polarity, profiles, views
from orderlens.plans import scale
from orderlens.plans.canon import AS_OF, Canon
from orderlens.sources import partitions, tables
from orderlens.sources.shared import cut, new_path

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
STEPS = ["view", "click", "signup", "purchase"]
#: The target schema's columns with their aliases.
ALIASES = [
    ("orders", "external_id", "order id"), ("orders", "total_amount", "total amount"), ("orders", "total_amount", "sale amount"), ("orders", "order_date", "date"), ("orders", "order_date", "order date"),
    ("orders", "discount_amount", "discount"), ("order_items", "quantity", "quantity"), ("products", "sku", "sku"), ("customers", "email", "customer email"), ("customers", "country", "country"),
]
SYNONYMS = [("orders", "total_amount", ["total", "amount", "sale", "revenue"]), ("customers", "email", ["customer", "email", "mail"]), ("orders", "order_date", ["order", "date", "day"]), ("products", "name", ["product", "name", "item"])]
HEADERS = ["Order ID", "Cust_Email", "Sale Amt", "Dte", "Qty", "SKU", "Disc", "Mail of Customer", "Totl Amount", "Colour"]
#: Words of praise and of blame in the languages of the texts. Invented prose hardly has them.
PRAISE = """good great excellent amazing wonderful perfect love happy best helpful friendly quick recommend satisfied reliable
gut toll hervorragend wunderbar perfekt zufrieden schnell freundlich empfehle bon excellent parfait merveilleux satisfait rapide
aimable recommande bueno excelente perfecto maravilloso satisfecho amable recomiendo encanta""".split()
BLAME = """bad terrible awful horrible worst poor hate broken slow rude useless disappointed defective refund late idiot stupid
schlecht schrecklich furchtbar kaputt langsam nutzlos enttäuscht mauvais horrible nul lent cassé déçu inutile malo terrible pésimo
lento roto decepcionado inútil""".split()
LEXICON = [(w, 1) for w in dict.fromkeys(PRAISE)] + [(w, -1) for w in dict.fromkeys(BLAME)]


@lru_cache(4)
def _canon(spark: SparkSession, sf_dir: str) -> Canon:
    return Canon(spark, sf_dir)


def country_code(country: Column) -> Column:
    """A code for each of the given nations, which have none of their own: those that have a region in turn, every eleventh unknown,
    some in lower case."""
    n = F.regexp_extract(country, "([0-9]+)", 1).cast("int")
    code = F.element_at(F.array(*map(F.lit, [*sorted(ingest.REGIONS), "XX"])), n % (len(ingest.REGIONS) + 1) + 1)
    return F.when(n % 2 == 0, code).otherwise(F.concat(F.lit(" "), F.lower(code)))


def headers(c: Canon) -> DataFrame:
    """The header table of pending uploads: one upload for each customer, all with the same list of headers."""
    return c.customers.select(F.col("customer_id").alias("upload_job_id"), F.explode(F.array(*[F.lit(h) for h in HEADERS])).alias("csv_header"))


#: Uploads with headers of their own, for the same five columns.
UPLOADS = (
    ("Order ID", "Order Date", "Sale Amt", "Customer Email", "Country"),
    ("Bestellung", "Datum", "Betrag", "Kontakt", "Land"),
    ("col_1", "col_2", "col_3", "col_4", "col_5"),
)


def order_heads(c: Canon) -> DataFrame:
    """What upload_values() and target_values() take of the orders, derived once and written."""
    return cut(c.orders.select("order_id", "customer_id", "order_date", F.col("total").cast("decimal(14,2)").alias("total"), "country"))


def upload_values(c: Canon, orders: DataFrame) -> DataFrame:
    """The values of three uploads, a sixth of the orders (order_heads) each, by their own headers."""
    rows = orders.where("order_id % 2 = 1").join(c.customers.select("customer_id", "email"), "customer_id")
    parts = []
    for j, own in enumerate(UPLOADS):
        table = rows.where(F.floor(F.col("order_id") / 2) % 3 == j).select("order_id", F.col("order_date").cast("string"), "total", "email", "country").toDF(*own)
        parts.append(profiles.values(table, own, upload_job_id=F.lit(j)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("column", "csv_header")


def target_values(c: Canon, orders: DataFrame) -> DataFrame:
    """The values that the target's tables have: of orders (order_heads), those of no upload."""
    orders = orders.where("order_id % 2 = 0").select(F.col("order_id").alias("external_id"), F.col("order_date").cast("string").alias("order_date"), F.col("total").alias("total_amount"))
    tables_ = {"orders": orders, "customers": c.customers.select("email", "country", "full_name"), "products": c.products.select("sku", "name", "category"), "order_items": c.items.select("quantity")}
    parts = [profiles.values(df, df.columns, mapped_table=F.lit(name)) for name, df in tables_.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).withColumnRenamed("column", "mapped_column")


def resolved(c: Canon) -> DataFrame:
    return ingest.resolve_by_name(headers(c), past_mappings(c), dictionary(c), synonyms(c))


def by_values(c: Canon) -> DataFrame:
    orders = order_heads(c)
    return profiles.map_by_values(cut(upload_values(c, orders)), cut(target_values(c, orders)))


def resolved_uploads(c: Canon) -> DataFrame:
    """IN5 over uploads whose headers differ: by name where a name is known, else by values."""
    orders = order_heads(c)
    found = cut(upload_values(c, orders))
    own = cut(found.select("upload_job_id", "csv_header").distinct())
    values = profiles.map_by_values(found, cut(target_values(c, orders)))
    return ingest.resolve_mappings(own, ingest.map_exact(own, dictionary(c)), ingest.map_fuzzy(own, dictionary(c)), ingest.map_semantic(own, synonyms(c)), values)


def dictionary(c: Canon) -> DataFrame:
    return c.spark.createDataFrame(ALIASES, "mapped_table string, mapped_column string, alias string")


def synonyms(c: Canon) -> DataFrame:
    return c.spark.createDataFrame(SYNONYMS, "mapped_table string, mapped_column string, tokens array<string>")


def past_mappings(c: Canon) -> DataFrame:
    """Mappings confirmed in earlier uploads: of two, one a day later."""
    one = lambda header, table, column: F.struct(F.lit(header).alias("csv_header"), F.lit(table).alias("mapped_table"), column.alias("mapped_column"), F.col("order_date").alias("created_at"))
    both = F.array(one("Colour", "products", F.when(F.col("status") == "pending", "category").otherwise("name")), one("Qty", "order_items", F.lit("quantity")))
    return c.orders.select(F.explode(both).alias("x")).select("x.*")


def dirty(c: Canon) -> DataFrame:
    """Order uploads as strings, in the ways that real ones are dirty."""
    k = F.col("order_id")
    date = F.when(k % 3 == 0, F.date_format("order_date", "dd/MM/yyyy")).when(k % 3 == 1, F.date_format("order_date", "yyyy-MM-dd")).otherwise(F.date_format("order_date", "yyyy/MM/dd"))
    total = F.col("total").cast("decimal(14,2)").cast("string")
    amount = F.when(k % 7 == 0, F.lit("N/A")).when(k % 7 == 1, F.concat(F.lit("$"), total)).when(k % 7 == 2, F.concat(F.lit(" "), total, F.lit(" "))).otherwise(total)
    return c.orders.select((k % 97).alias("upload_job_id"), k.cast("string").alias("external_id"), date.alias("order_date"), amount.alias("total_amount"), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("usd ")).alias("currency"), F.when(k % 11 == 0, F.lit("lost")).otherwise(F.col("status")).alias("status"))


def cleaned(c: Canon) -> DataFrame:
    rows = ingest.clean_missing(dirty(c), {"currency": "USD", "status": "completed"})
    rows = ingest.coerce_numeric(ingest.standardise_dates(rows, ["order_date"], ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy"]), ["total_amount"], "decimal(14,2)")
    return rows.withColumn("currency", ingest.normalise_currency(F.col("currency")))


def rules() -> dict:
    return {"amount": F.col("total_amount") >= 0, "status": F.col("status").isin("completed", "pending", "refunded", "cancelled"), "date": F.col("order_date").isNotNull()}


def marked(c: Canon) -> DataFrame:
    return ingest.with_reasons(cleaned(c), rules())


def profile(c: Canon) -> DataFrame:
    return an.customer_profile(c.sold, AS_OF)


def daily_values(c: Canon) -> DataFrame:
    return kpi.daily_kpi(c.sold).select("day", F.col("revenue").cast("double").alias("value"))


def forecast(c: Canon, keys=()) -> DataFrame:
    return an.fit_forecast(an.daily_series(c.sold, list(keys)).withColumn("_one", F.lit(1)), [*keys, "_one"]).drop("_one")


def scored(c: Canon) -> DataFrame:
    comments = c.t["conversations"].select(F.struct("conv_id", "turn").alias("id"), "text")
    lexicon = c.spark.createDataFrame(LEXICON, "word string, weight int")
    return an.sentiment(comments, lexicon).select("id.*", "sentiment_label", "sentiment_score")


def induced(c: Canon) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A08 with polarity from the comments themselves: (words, comments' scores, comments). Rated texts give the seeds: good ones have
    quality and are not toxic."""
    comments = c.t["conversations"].select(F.struct("conv_id", "turn").alias("id"), "text")
    rated = c.t["documents"].join(c.t["labels"], "doc_id").select(F.col("doc_id").alias("id"), "text", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return *polarity.induce(comments, rated), comments


def induced_sentiment(c: Canon) -> DataFrame:
    _, scores, comments = induced(c)
    return polarity.labelled(comments, scores).select("id.*", "sentiment_label", "sentiment_score")


def upserted(c: Canon) -> DataFrame:
    """Products with the prices of a batch: every second one 10 % up, and as many new ones."""
    target = c.products.select("product_id", "name", "unit_price")
    batch = target.where("product_id % 2 = 0").withColumn("unit_price", (F.col("unit_price") * F.lit("1.10").cast("decimal(3,2)")).cast("decimal(10,2)"))
    new = target.where("product_id % 2 = 0").withColumn("product_id", F.col("product_id") + 100_000_000)
    out = ingest.upsert(target, batch.unionByName(new), "product_id")
    return out.select("product_id", "name", an.dbl("unit_price", 2).alias("unit_price"))


def upserted_table(c: Canon) -> DataFrame:
    """IN15 as writes: the products, then a batch with dearer and new ones, twice; read back."""
    path, target = new_path(c.spark), c.products.select("product_id", "name", "unit_price")
    some = target.where("product_id % 10 = 0")
    dearer = some.withColumn("unit_price", (F.col("unit_price") * F.lit("1.10").cast("decimal(3,2)")).cast("decimal(10,2)"))
    new = some.select((F.col("product_id") + 100_000_000).alias("product_id"), F.lit(None).cast("string").alias("name"), "unit_price")
    partitions.upsert_table(path, target, "product_id")
    for _ in range(2):
        partitions.upsert_table(path, dearer.unionByName(new), "product_id")
    return partitions.upserted(c.spark, path, target.schema).select("product_id", "name", an.dbl("unit_price", 2).alias("unit_price"))


def active_users(c: Canon) -> DataFrame:
    """KP10 over 1, 7 and 30 days from the stored users of each day, exact, a row a day."""
    return kpi.users_over(cut(kpi.user_days(c.events)), (1, 7, 30))


def frozen_table(c: Canon) -> DataFrame:
    """KP6 as writes: the last ten days are frozen one by one, the last one twice; what is read back is from a week on."""
    daily, path = cut(kpi.daily_kpi(c.sold)), new_path(c.spark)
    last = [r.day.isoformat() for r in daily.orderBy(F.desc("day")).limit(10).select("day").collect()]
    for day in [*reversed(last), last[0]]:
        partitions.freeze_day(path, daily, day)
    return partitions.snapshots(c.spark, path, daily.schema, first=last[6])


def inserted(c: Canon) -> DataFrame:
    heads = c.orders.select(F.col("order_id").alias("external_id"), "order_date", F.col("total").alias("total_amount"), F.col("discount").alias("discount_amount"), F.when(F.col("return_flag"), F.lit(None)).otherwise(F.col("cost")).alias("cost_amount"))
    known = heads.where("order_date < date '1998-01-01'")
    return ingest.insert_orders(heads.unionByName(heads), known).select("external_id", an.dbl("net_amount").alias("net_amount"), an.dbl("gross_margin").alias("gross_margin"))


def rolled_back(c: Canon) -> DataFrame:
    heads = c.orders.withColumn("upload_job_id", F.concat(F.lit("job"), F.year("order_date").cast("string")))
    kept, items = ingest.rollback_upload(heads, c.items, "job1999")
    return items.join(kept.select("order_id", "upload_job_id"), "order_id").groupBy("upload_job_id").agg(F.count(F.lit(1)).alias("items"), an.dbl(F.sum("line_total")).alias("total"))


def insights(c: Canon, sold: DataFrame | None = None) -> DataFrame:
    by = (c.sold if sold is None else sold).withColumn("year", F.year("order_date")).groupBy("region", "year").agg(F.sum("net").cast("double").alias("revenue"), F.count(F.lit(1)).cast("double").alias("orders"), F.countDistinct("customer_id").cast("double").alias("customers"), F.sum("cost").cast("double").alias("cost"))
    both = by.where("year = 2000").alias("a").join(by.where("year = 1999").alias("b"), "region")
    kpis = both.select("region", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"a.{n}").alias("value"), F.col(f"b.{n}").alias("previous")) for n in ("revenue", "orders", "customers", "cost")])).alias("x")).select("region", "x.*")
    return views.insight_top3(kpis, "region")


def grid(c: Canon) -> DataFrame:
    return c.spark.createDataFrame([(m, p, s) for m in (0.0, 25.0, 50.0) for p in (-10.0, 0.0, 20.0) for s in ("low", "medium", "high")], "marketing_pct double, price_pct double, seasonal string")


def raw_uploads(c: Canon) -> tuple[str, list[str]]:
    """(a folder of CSV files with the dirty uploads, their header)."""
    path, header = new_path(c.spark), ["Order ID", "Date", "Sale Amt", "Status"]
    rows = dirty(c).select("external_id", "order_date", "total_amount", "status").toDF(*header)
    rows.write.option("header", True).csv(path)
    long = dirty(c).where("external_id % 50 = 0").select("external_id", "order_date", "total_amount", "status", F.lit("more").alias("a"), F.lit("still").alias("b"))
    long.write.mode("append").option("header", True).csv(path)  # rows with more fields than the header has
    return path, header


def read_uploads(c: Canon) -> DataFrame:
    """IO1: what comes back of the uploads as raw text."""
    raw = tables.read_csv(c.spark, *raw_uploads(c))
    return raw.select(F.col("Order ID").alias("external_id"), F.col("Sale Amt").alias("total_amount"), F.col("_bad").isNull().alias("fits"))


def appended(c: Canon) -> DataFrame:
    """IO3: two appends to a fact table, read back by month."""
    path, rows = new_path(c.spark), c.orders.select("order_id", "order_date", "net")
    for part in (0, 1):
        tables.append(rows.where(F.col("order_id") % 2 == part), path)
    by = c.spark.read.parquet(path).groupBy(F.col("order_month").cast("string").alias("order_month"))
    return by.agg(F.count(F.lit(1)).alias("orders"), an.dbl(F.sum("net")).alias("net"))


def exported(c: Canon) -> DataFrame:
    """IO5: a module's result as CSV, read back."""
    path = new_path(c.spark)
    tables.export(an.payment_channel(c.orders, c.sold).select("payment_method", "orders"), path)
    return c.spark.read.option("header", True).csv(path).select("payment_method", F.col("orders").cast("long").alias("orders"))


def ingested(c: Canon) -> DataFrame:
    """IO6 and ST3: uploads as a stream of landed files into a table, every second row landing once more."""
    from orderlens.streaming import stream

    landing, target = new_path(c.spark), new_path(c.spark)
    rows = cut(dirty(c).select("external_id", "total_amount"))

    def clean(raw: DataFrame) -> DataFrame:
        return ingest.upload_rows(raw, {x: x for x in rows.columns}, {}, [], ["total_amount"]).withColumn("reasons", F.array().cast("array<string>"))

    for part in (rows, rows.where("external_id % 2 = 0")):
        part.write.mode("append").option("header", True).csv(landing)
        found = tables.stream_landing(c.spark, landing, rows.columns)
        stream.stream_ingest(found, clean, "external_id", target, target + "-state").awaitTermination()
    out = stream.ingested(c.spark, target, stream.row_schema(found, clean), stream.ACCEPTED)
    return out.select("external_id", F.col("total_amount").cast("double").alias("total_amount"))


UPLOAD = {"Order ID": "external_id", "Date": "order_date", "Sale Amt": "total_amount", "Ccy": "currency", "State": "status"}


def upload_chain(c: Canon) -> tuple[str, DataFrame]:
    """ST3: (the target, all rows it has) of the dirty uploads as they land, in two batches. Some orders come twice in the first, dearer
    the second time, every second one again in the second; some rows have no order number."""
    from orderlens.streaming import stream

    landing, target = new_path(c.spark), new_path(c.spark)
    k = F.col("external_id").cast("long")
    rows = cut(dirty(c).select(*UPLOAD.values()))
    dearer = rows.where((k % 17 == 0) & (k % 7 > 1)).withColumn("total_amount", (F.trim("total_amount").cast("decimal(14,2)") + 1).cast("string"))
    nameless = F.when(k % 13 != 0, F.col("external_id")).alias("external_id")

    def clean(raw: DataFrame) -> DataFrame:
        return ingest.upload_rows(raw, UPLOAD, rules() | {"key": F.col("external_id").isNotNull()}, ["order_date"], ["total_amount"], {"currency": "USD", "status": "completed"})

    for part in (rows.unionByName(dearer), rows.where(k % 2 == 0)):
        part.withColumn("external_id", nameless).toDF(*UPLOAD).write.mode("append").option("header", True).csv(landing)
        found = tables.stream_landing(c.spark, landing, list(UPLOAD))
        stream.stream_ingest(found, clean, "external_id", target, target + "-state", F.col("total_amount")).awaitTermination()
    return target, stream.ingested(c.spark, target, stream.row_schema(found, clean))


def chain_rows(c: Canon) -> DataFrame:
    return upload_chain(c)[1].select("external_id", "outcome", F.concat_ws(",", "reasons").alias("reasons"), "order_date", F.col("total_amount").cast("double").alias("total_amount"), "currency", "status", "batch_id")


def chain_ledger(c: Canon) -> DataFrame:
    """ST3's ledger: what each batch accepted and rejected, and why."""
    from orderlens.streaming import stream

    return stream.ledger(c.spark, upload_chain(c)[0])


#: A day on which some customers are new and some become Champions.
CARD_DAY = "1995-07-01"
#: The days of a history over all years.
YEARS = [*(f"{y}-01-01" for y in range(1996, 2002)), AS_OF]


def before(day: str, months: int = 0, days: int = 0) -> str:
    """The day so many months and days earlier, as SQL counts them."""
    d = date.fromisoformat(day)
    y, m = divmod(d.year * 12 + d.month - 1 - months, 12)
    last = (date(y + m // 11, (m + 1) % 12 + 1, 1) - timedelta(1)).day
    return (date(y, m + 1, min(d.day, last)) - timedelta(days)).isoformat()


def cards(c: Canon) -> DataFrame:
    past = history.history_over(c.sold, [before(CARD_DAY, days=7), CARD_DAY])
    return views.customer_cards(c.sold, CARD_DAY, past, "Champions")


def segment_screen(c: Canon) -> DataFrame:
    """Segments with engagement, and with the change against the customers who held each of them a month ago."""
    month = before(AS_OF, months=1)
    past = history.history_over(c.sold, [month, AS_OF])
    held = lambda day: history.held_at(past, day).withColumnRenamed("segment", "ai_segment")
    people = cut(profile(c))
    now = people.join(held(AS_OF), "customer_id").join(views.engagement_score(people), "customer_id")
    return views.segment_summary(now, "ai_segment", held(month))


def held_revenue(c: Canon) -> DataFrame:
    """Revenue by the segment that the customer held on the day of the order."""
    sold = cut(c.sold.select("customer_id", "order_date", "net"))
    rows = history.as_of(sold, history.history_over(sold, YEARS), "order_date")
    by = rows.groupBy("segment", F.year("order_date").alias("year"))
    return by.agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("customer_id").alias("customers"), an.dbl(F.sum("net")).alias("revenue"))


def model_constraints(c: Canon) -> DataFrame:
    sold = cut(c.sold.select("order_id", "customer_id", "order_date", "region", "net", "cost"))
    people = cut(an.customer_profile(sold, AS_OF))
    lines = c.items.join(sold.select("order_id", "order_date"), "order_id")
    series = an.daily_series(sold, []).withColumn("_one", F.lit(1))
    tables_ = {
        "engagement": views.engagement_score(people), "tier": an.abc_tier(lines, AS_OF), "sentiment": scored(c),
        "band": an.fit_forecast(series, ["_one"]), "bullet": insights(c, sold), "churn_risk": an.churn_risk(an.churn_features(sold, AS_OF)),
    }
    parts = [ingest.check_constraints(df, {name: ingest.MODEL_RULES[name]()}) for name, df in tables_.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def searched(c: Canon, rows: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    path = new_path(c.spark)
    lookup.write_postings(rows, key, columns, path)
    return lookup.search(rows, key, text, columns, path)


def numbered_page(c: Canon) -> DataFrame:
    """CV3 by number: page 3 of the customers by orders."""
    people = cut(profile(c).select("customer_id", "total_orders"))
    return lookup.page_at(people, cut(lookup.page_borders(people, "total_orders", "customer_id")), 3, "total_orders", "customer_id")


def broken_rows(c: Canon) -> DataFrame:
    """IN12 where it must fire: order lines, products and model rows made of orders, some of which break each rule."""
    k = F.col("order_id")
    lines = c.items.withColumn("quantity", F.when(F.col("order_id") % 9 == 0, 0).otherwise(F.col("quantity"))).withColumn("line_total", F.when(F.col("order_id") % 8 == 0, -F.col("line_total")).otherwise(F.col("line_total")))
    p = F.col("product_id")
    stock = c.products.withColumn("stock_qty", F.when(p % 10 == 0, -1).otherwise(F.col("stock_qty"))).withColumn("unit_price", F.when(p % 6 == 0, -F.col("unit_price")).when(p % 6 == 1, None).otherwise(F.col("unit_price"))).withColumn("cost_price", F.when(p % 4 == 0, -F.col("cost_price")).otherwise(F.col("cost_price")))
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    model = c.t["orders"].select(F.col("o_orderkey").alias("order_id")).select(
        (k % 120).alias("engagement_score"), ((k % 13) / 10).alias("churn_risk_score"), pick("A", "B", "C", "D").alias("abc_tier"), pick("POSITIVE", "NEGATIVE", "NEUTRAL", "ANGRY", None).alias("sentiment_label"),
        F.when(k % 5 == 0, 11).otherwise(9).alias("yhat_lower"), F.lit(10).alias("yhat"), F.when(k % 7 == 0, 9).otherwise(11).alias("yhat_upper"), (k % 5).alias("bullet_index"),
    )
    parts = [ingest.check_constraints(df, {n: r() for n, r in rules_.items()}) for df, rules_ in ((lines, ingest.LINE_RULES), (stock, ingest.STOCK_RULES), (model, ingest.MODEL_RULES))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def listed(c: Canon) -> DataFrame:
    rows = c.products.withColumn("is_active", F.col("product_id") % 10 != 0)
    return views.product_list(rows, "LARGE", True, after=("m", 0)).select("product_id", "name", "category")


def frozen(c: Canon) -> DataFrame:
    daily, day = cut(kpi.daily_kpi(c.sold)), "2001-07-31"
    once = kpi.freeze_snapshot(daily, day, daily.where("day < date '2001-07-31'"))
    return kpi.freeze_snapshot(daily, day, once)


def table_counts(c: Canon) -> DataFrame:
    """IO2: the rows of every table."""
    count = lambda n: c.t[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")).select("name", "rows")
    out = count(tables.TABLES[0])
    for n in tables.TABLES[1:]:
        out = out.unionByName(count(n))
    return out


def clv_counts(c: Canon) -> DataFrame:
    from orderlens.operators import models

    return models.rft_counts(models.rft(c.sold, AS_OF))


def _models(name: str) -> Callable[[Canon], DataFrame]:
    def run(c: Canon) -> DataFrame:
        from orderlens.operators import models

        if name == "clv":
            return models.clv(c.sold, AS_OF)
        return models.isolation_forest(cut(daily_values(c).withColumn("weekday", F.dayofweek("day").cast("double"))), ["value", "weekday"], "day")

    return run


QUERIES: dict[str, Callable[[Canon], DataFrame]] = {
    "a01_rfm": lambda c: an.rfm(c.sold, AS_OF),
    "a01_rfm_segments": lambda c: an.rfm_segments(an.rfm(c.sold, AS_OF)),
    "a02_cohort": lambda c: an.cohort(c.sold),
    "a02_cohort_matrix": lambda c: an.cohort_matrix(c.sold),
    "a03_revenue_month": lambda c: an.revenue(c.sold, "month"),
    "a03_revenue_week": lambda c: an.revenue(c.sold, "week"),
    "a04_basket_pairs": lambda c: an.basket_pairs(c.items, 2),
    "a04_itemsets": lambda c: an.basket_itemsets(c.items, 0.002).select(F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"), "support"),
    "a05_forecast": lambda c: forecast(c),
    "a06_anomaly_z": lambda c: an.anomaly_z(daily_values(c)),
    "a06_anomaly_iqr": lambda c: an.anomaly_iqr(daily_values(c)),
    "a06_isolation_forest": _models("forest"),
    "a07_clv_counts": clv_counts,
    "a07_clv": _models("clv"),
    "a08_sentiment": scored,
    "a08_polarity": lambda c: induced(c)[0].select("word", F.round("polarity", 6).alias("polarity"), "is_seed"),
    "a08_induced_sentiment": induced_sentiment,
    "a09_segmentation": lambda c: an.segmentation(profile(c)),
    "a09_segmentation_engaged": lambda c: an.segmentation(cut(profile(c).join(views.engagement_with_activity(profile(c), c.events).select("customer_id", "engagement_score"), "customer_id"))),
    "a10_abc_tier": lambda c: an.abc_tier(c.sold_items, AS_OF),
    "a11_margin_category": lambda c: an.margin(c.sold_items, ["category"]),
    "a11_margin_product": lambda c: an.margin(c.sold_items, ["product_id"]),
    "a11_margin_region": lambda c: an.margin(c.sold_items, ["region"]),
    "a12_churn_features": lambda c: an.churn_features(c.sold, AS_OF),
    "a12_churn_risk": lambda c: an.churn_risk(an.churn_features(c.sold, AS_OF)),
    "a13_geo": lambda c: an.geo(c.sold),
    "a13_geo_features": lambda c: an.geo_features(c.sold),
    "a14_seasonality": lambda c: an.seasonality(c.sold),
    "a15_funnel": lambda c: an.funnel(c.events, STEPS),
    "a16_payment_channel": lambda c: an.payment_channel(c.orders, c.sold),
    "a17_attribution": lambda c: an.attribution(c.sold, "payment_method"),
    "a17_attribution_channel": lambda c: an.attribution(c.sold, "channel"),
    "a18_returns_product": lambda c: an.returns(c.items),
    "a18_returns_category": lambda c: an.returns(c.items, "category"),
    "a19_fulfillment": lambda c: an.fulfillment(c.orders),
    "a20_supplier": lambda c: an.supplier(c.sold_items, c.t["supplier"]),
    "a20_supplier_delivery": lambda c: an.supplier_delivery(c.sold_items, c.t["supplier"]),
    "a21_correlation": lambda c: an.correlation(c.items, ["quantity", "line_total", "line_discount", "line_cost"]),
    "a22_demographic": lambda c: an.demographic(c.sold, c.customers),
    "fc1_forecast_by_region": lambda c: forecast(c, ["region"]),
    "fc1_backtest_by_region": lambda c: forecasting.backtest(an.daily_series(c.sold, ["region"]), ["region"]),
    "fc1_chosen_by_region": lambda c: forecasting.forecast(an.daily_series(c.sold, ["region"]), ["region"], horizon=90),
    "fc2_bands": lambda c: forecast(c).groupBy("is_historical").agg(F.count(F.lit(1)).alias("days"), F.count_if((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("ordered")),
    "fc3_with_history": lambda c: forecast(c).where("actual is not null or not is_historical").groupBy(F.trunc("ds", "MM").alias("month"), "is_historical").agg(F.round(F.sum(F.coalesce("actual", "yhat")), 4).alias("value")),
    "fc4_scenario": lambda c: an.scenario(forecast(c), grid(c)),
    "fc5_projected_mrr": lambda c: an.projected_mrr(forecast(c)),
    "fc6_latest_run": lambda c: an.latest_run(forecast(c).select("ds", "yhat").withColumn("series", F.lit("all")).withColumn("run_date", F.explode(F.array(F.lit("2001-08-01"), F.lit("2001-08-02")))), ["series"]),
    "kp1_daily_kpi": lambda c: kpi.daily_kpi(c.sold),
    "kp2_active_and_churn": lambda c: kpi.active_and_churn(c.orders),
    "kp3_revenue_by_region": lambda c: kpi.revenue_by_region(c.sold, REGIONS),
    "kp4_period_delta": lambda c: kpi.period_delta(kpi.daily_kpi(c.sold)),
    "kp5_sales_trend": lambda c: kpi.sales_trend(kpi.daily_kpi(c.sold)),
    "kp6_freeze_snapshot": frozen,
    "kp6_freeze_table": frozen_table,
    "kp7_mrr_growth": lambda c: an.revenue(c.sold, "month").select("period", "revenue", "growth"),
    "kp8_win_rate": lambda c: kpi.win_rate(c.orders),
    "kp9_quarterly_margin": lambda c: kpi.quarterly_margin(c.sold),
    "kp10_daily_active_users": lambda c: kpi.daily_active_users(c.events),
    "kp10_users_over_spans": active_users,
    "kp11_net_sentiment": lambda c: kpi.net_sentiment(scored(c)),
    "kp11_induced_net_sentiment": lambda c: kpi.net_sentiment(induced_sentiment(c)),
    "kp12_top_regions": lambda c: kpi.top_regions(c.sold),
    "kp13_sales_heatmap": lambda c: kpi.sales_heatmap(c.sold),
    "cv1_customer_search": lambda c: views.search(c.customers, "#00000012", ["full_name", "email", "customer_id"]).select("customer_id", "full_name", "email"),
    "cv2_customer_list": lambda c: views.customer_list(profile(c).join(c.customers, "customer_id"), "highest_ltv", F.col("region") == "EUROPE").select("customer_id", an.dbl("lifetime_value").alias("lifetime_value"), "country"),
    "cv3_page": lambda c: views.page(profile(c), "total_orders", "customer_id", 20, True, (9, 100)).select("customer_id", "total_orders"),
    "cv1_search_by_index": lambda c: searched(c, c.customers, "customer_id", "#00000012", ["full_name", "email", "customer_id"]).select("customer_id", "full_name", "email"),
    "cv3_page_by_number": numbered_page,
    "pv1_search_by_index": lambda c: searched(c, c.products, "product_id", "ring", ["name", "category", "sku"]).select("product_id", "name", "category"),
    "cv4_customer_cards": cards,
    "cv5_segment_summary": lambda c: views.segment_summary(profile(c).join(c.customers, "customer_id")),
    "cv5_segment_screen": segment_screen,
    "cv5_segment_history": lambda c: history.history_over(c.sold, YEARS),
    "cv5_segment_moves": lambda c: history.moves(history.history_over(c.sold, YEARS), YEARS[-2], YEARS[-1]),
    "cv5_held_revenue": held_revenue,
    "cv6_engagement": lambda c: views.engagement_score(profile(c)),
    "cv6_engagement_activity": lambda c: views.engagement_with_activity(profile(c), c.events),
    "cv7_arr": lambda c: profile(c).select("customer_id", an.dbl(F.coalesce("arr", F.lit(0))).alias("arr")),
    "pv1_product_search": lambda c: views.search(c.products, "ring", ["name", "category", "sku"]).select("product_id", "name", "category"),
    "pv1_product_list": listed,
    "pv2_inventory_cards": lambda c: views.inventory_cards(c.products),
    "pv3_tier_summary": lambda c: views.tier_summary(an.abc_tier(c.sold_items, AS_OF)),
    "rc1_latest_result": lambda c: views.latest_result(an.revenue(c.sold).select(F.concat(F.lit("revenue_"), F.year("period").cast("string")).alias("analysis_type"), F.col("period").alias("computed_at"), F.col("period").cast("string").alias("upload_job_id"), (F.month("period") == 12).alias("is_stale"), "revenue")),
    "rc2_insights": insights,
    "io1_read_csv": read_uploads,
    "io2_table_counts": table_counts,
    "io3_append": appended,
    "io5_export": exported,
    "io6_st3_stream_ingest": ingested,
    "st3_upload_chain": chain_rows,
    "st3_ledger": chain_ledger,
    "io4_result_json": lambda c: tables.result_json(an.payment_channel(c.orders, c.sold).select("payment_method", "orders"), "payment_channel", "job1", ["payment_method"]),
    "in1_map_exact": lambda c: ingest.map_exact(headers(c), dictionary(c)),
    "in2_map_fuzzy": lambda c: ingest.map_fuzzy(headers(c), dictionary(c)),
    "in3_map_semantic": lambda c: ingest.map_semantic(headers(c), synonyms(c)),
    "in3_map_by_values": by_values,
    "in4_map_historical": lambda c: ingest.map_historical(headers(c), past_mappings(c)),
    "in5_resolve": resolved,
    "in5_resolve_uploads": resolved_uploads,
    "in6_apply_mapping": lambda c: ingest.apply_mapping(dirty(c).withColumnRenamed("total_amount", "Sale Amt"), {"external_id": "order_ref", "Sale Amt": "total_amount"}),
    "in7_clean_missing": lambda c: ingest.clean_missing(dirty(c), {"currency": "USD"}).select("external_id", "total_amount", "currency"),
    "in8_dates": lambda c: ingest.standardise_dates(dirty(c), ["order_date"], ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy"]).select("external_id", "order_date"),
    "in9_numbers": lambda c: ingest.coerce_numeric(dirty(c), ["total_amount"], "decimal(14,2)").select("external_id", F.col("total_amount").cast("double").alias("total_amount")),
    "in10_drop_duplicates": lambda c: ingest.drop_duplicates(c.items, ["order_id", "product_id"], ["line_total", "quantity", "supplier_id", "ship_date"]).select("order_id", "product_id", an.dbl("line_total", 2).alias("line_total"), "quantity"),
    "in11_validate": lambda c: marked(c).select("external_id", F.concat_ws(",", "reasons").alias("reasons")),
    "in12_constraints": lambda c: ingest.check_constraints(c.orders, {n: r() for n, r in ingest.ORDER_RULES.items()}),
    "in12_model_constraints": model_constraints,
    "in12_stock_and_lines": lambda c: ingest.check_constraints(c.products, {n: r() for n, r in ingest.STOCK_RULES.items()}).unionByName(ingest.check_constraints(c.items, {n: r() for n, r in ingest.LINE_RULES.items()})),
    "in12_broken_rows": broken_rows,
    "in13_references": lambda c: ingest.check_references(c.t["orders"].select(F.col("o_orderkey").alias("order_id")), c.items, "order_id", "order_id"),
    "in14_unique": lambda c: ingest.check_unique(c.t["lineitem"], ["l_orderkey", "l_linenumber"]),
    "in15_upsert": upserted,
    "in15_upsert_table": upserted_table,
    "in16_insert_orders": inserted,
    "in17_refresh_customers": lambda c: ingest.refresh_customers(c.customers.select("customer_id"), c.sold).select("customer_id", "total_orders", an.dbl("lifetime_value").alias("lifetime_value"), "first_purchase_date", "last_active_at"),
    "in18_refresh_products": lambda c: ingest.refresh_products(c.products.select("product_id", "stock_qty"), c.items).select("product_id", an.dbl("total_revenue").alias("total_revenue"), "total_units_sold", "stock_qty", "oversold"),
    "in19_rollback": rolled_back,
    "in20_active_only": lambda c: ingest.active_only(c.customers.withColumn("deleted_at", F.when(F.col("gender") == "Male", F.lit("2001-01-01").cast("date")))).groupBy("region").agg(F.count(F.lit(1)).alias("customers")),
    "in21_snapshot_region": lambda c: ingest.snapshot_region(c.orders.withColumn("region", F.when(F.col("status") == "completed", F.lit("FIXED"))), c.customers).groupBy("region").agg(F.count(F.lit(1)).alias("orders")),
    "in21_region_of_country": lambda c: c.customers.select("customer_id", ingest.region_of_country(country_code(F.col("country"))).alias("region")),
    "in22_currency": lambda c: dirty(c).groupBy(ingest.normalise_currency(F.col("currency")).alias("currency")).agg(F.count(F.lit(1)).alias("orders")),
    "in23_upload_report": lambda c: ingest.upload_report(marked(c)),
    "sc_derived_orders": lambda c: c.orders.select("order_id", an.dbl(derive.net_amount(F.col("total"), F.col("discount"))).alias("net_amount"), an.dbl(derive.gross_margin(F.col("net"), F.when(F.col("return_flag"), F.lit(None)).otherwise(F.col("cost")))).alias("gross_margin"), derive.cohort_month(F.col("order_date")).alias("cohort_month"), derive.at_risk(F.col("order_date"), AS_OF).alias("at_risk")),
    "sc_derived_products": lambda c: c.products.select("product_id", F.round(derive.gross_margin_pct(F.col("unit_price"), F.col("cost_price")), 4).alias("gross_margin_pct"), derive.is_low_stock(F.col("stock_qty"), F.col("low_stock_threshold")).alias("is_low_stock"), derive.stock_band(F.col("stock_qty"), F.col("low_stock_threshold")).alias("stock_band"), an.dbl(derive.line_total(F.col("stock_qty"), F.col("unit_price")), 2).alias("stock_value")),
    "scale_global_rank": lambda c: scale.running(c.orders.select("order_id", "net"), "net", "order_id", "net", descending=True).select("order_id", "rank_", an.dbl("before_").alias("before_")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Callable[[Canon], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(_canon(spark, sf_dir))

    return {name: bound(build) for name, build in QUERIES.items()} | {"st1_stream_kpi": stream_kpi, "st1_append": stream_append, "st2_stream_dedup": stream_dedup}


def stream_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.streaming import stream

    days = stream.settle(stream.stream_kpi(stream.stream_events(spark, sf_dir)), "complete")
    return days.select(F.col("window_start").cast("date").alias("day"), "events", F.round("value", 4).alias("value"))


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 in append mode: events land in four parts, day after day; with the last come copies of every 50th of the first two, long
    late. Days that the watermark has passed come out, with the approximate users held against the exact ones."""
    from orderlens.streaming import stream

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    landing, path = new_path(spark), new_path(spark)
    span = events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
    part = F.floor(F.datediff(F.to_date("ts"), F.lit(span.a)) * 4 / ((span.b - span.a).days + 1))
    late = events.where((part < 2) & (F.col("event_id") % 50 == 0))
    for i in range(4):
        rows = events.where(part == i)
        (rows.unionByName(late) if i == 3 else rows).write.mode("append").parquet(f"{landing}/events.parquet")
        days = stream.settle(stream.stream_kpi(stream.stream_events(spark, landing)), "append", path)
    exact = events.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("users"))
    days = days.select(F.col("window_start").cast("date").alias("day"), "events", F.round("value", 4).alias("value"), "approx_users")
    near = F.abs(F.col("approx_users") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.15)
    return days.join(exact, "day").select("day", "events", "value", near.alias("users_near"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orderlens.streaming import stream

    events = stream.stream_events(spark, sf_dir)
    twice = events.unionByName(stream.stream_events(spark, sf_dir))
    return stream.settle(stream.stream_dedup(twice, ["event_id"]).select("event_id", "user_id"))
