"""The canonical customer / product / order / order-line model as views over the given tables. Amounts are decimals."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.sources.tables import load_tables

AS_OF = "2001-08-02"
STATUS = {"F": "completed", "O": "pending", "P": "refunded"}


class Canon:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.t = spark, load_tables(spark, sf_dir)

    @cached_property
    def customers(self) -> DataFrame:
        places = self.t["nation"].join(self.t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        balance = F.col("c_acctbal")
        age = F.when(balance < 0, "18-24").when(balance < 2500, "25-34").when(balance < 5000, "35-44").otherwise("45+")
        return self.t["customer"].join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"), F.concat(F.lit("c"), "c_custkey", F.lit("@example.com")).alias("email"),
            F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("channel"), age.alias("age_group"),
            F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        )

    @cached_property
    def products(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(10,2)")
        return self.t["part"].select(
            F.col("p_partkey").alias("product_id"), F.concat(F.lit("SK-"), "p_partkey").alias("sku"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
            price.alias("unit_price"), (price * F.lit("0.60").cast("decimal(3,2)")).cast("decimal(12,4)").alias("cost_price"), F.col("p_size").alias("stock_qty"), F.lit(10).alias("low_stock_threshold"),
        )

    @cached_property
    def items(self) -> DataFrame:
        """Order lines."""
        gross = F.col("l_extendedprice").cast("decimal(12,2)")
        return self.t["lineitem"].join(self.products.select("product_id", "category", "cost_price"), F.col("l_partkey") == F.col("product_id")).select(
            F.col("l_orderkey").alias("order_id"), "product_id", F.col("l_suppkey").alias("supplier_id"), "category", F.col("l_quantity").cast("int").alias("quantity"), gross.alias("line_total"),
            (gross * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(16,4)").alias("line_discount"), (F.col("l_quantity").cast("int") * F.col("cost_price")).cast("decimal(18,4)").alias("line_cost"),
            (F.col("l_returnflag") == "R").alias("returned"), F.col("l_shipdate").cast("date").alias("ship_date"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        """Orders that have lines, with the sums of these."""
        sums = self.items.groupBy("order_id").agg(F.sum("line_total").alias("total"), F.sum("line_discount").alias("discount"), F.sum("line_cost").alias("cost"), F.max("returned").alias("return_flag"), F.max("ship_date").alias("ship_date"))
        status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
        heads = self.t["orders"].select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("order_date"), status[F.col("o_orderstatus")].alias("status"), F.col("o_orderpriority").alias("payment_method"))
        days = F.datediff("ship_date", "order_date")
        out = heads.join(sums, "order_id").join(self.customers.select("customer_id", "region", "country", "channel"), "customer_id")
        return out.withColumn("net", F.col("total") - F.col("discount")).withColumn("delivery_days", F.when(days.between(0, 60), days)).drop("ship_date")

    @cached_property
    def sold(self) -> DataFrame:
        """Completed orders: those that revenue counts."""
        return self.orders.where("status = 'completed'")

    @cached_property
    def sold_items(self) -> DataFrame:
        return self.items.join(self.sold.select("order_id", "order_date", "customer_id", "region"), "order_id")

    @cached_property
    def events(self) -> DataFrame:
        return self.t["events"].withColumn("ts", F.col("ts").cast("timestamp"))


#: The same views for DuckDB.
SQL = """
cust AS (SELECT c_custkey AS customer_id, c_name AS full_name, 'c' || c_custkey || '@example.com' AS email, n_name AS country, r_name AS region, c_mktsegment AS channel,
  CASE WHEN c_acctbal < 0 THEN '18-24' WHEN c_acctbal < 2500 THEN '25-34' WHEN c_acctbal < 5000 THEN '35-44' ELSE '45+' END AS age_group, CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
prod AS (SELECT p_partkey AS product_id, 'SK-' || p_partkey AS sku, p_name AS name, p_type AS category, p_brand AS brand, p_retailprice::DECIMAL(10,2) AS unit_price, (p_retailprice::DECIMAL(10,2) * 0.60)::DECIMAL(12,4) AS cost_price, p_size AS stock_qty, 10 AS low_stock_threshold FROM part),
items AS (SELECT l_orderkey AS order_id, product_id, l_suppkey AS supplier_id, category, l_quantity::INT AS quantity, l_extendedprice::DECIMAL(12,2) AS line_total, (l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2))::DECIMAL(16,4) AS line_discount,
  (l_quantity::INT * cost_price)::DECIMAL(18,4) AS line_cost, l_returnflag = 'R' AS returned, l_shipdate::DATE AS ship_date FROM lineitem JOIN prod ON l_partkey = product_id),
sums AS (SELECT order_id, sum(line_total) AS total, sum(line_discount) AS discount, sum(line_cost) AS cost, bool_or(returned) AS return_flag, max(ship_date) AS ship_date FROM items GROUP BY order_id),
ord AS (SELECT order_id, customer_id, o_orderdate::DATE AS order_date, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'refunded' END AS status, o_orderpriority AS payment_method, total, discount, total - discount AS net, cost, return_flag,
  CASE WHEN ship_date - o_orderdate::DATE BETWEEN 0 AND 60 THEN ship_date - o_orderdate::DATE END AS delivery_days, region, country, channel FROM orders JOIN sums ON o_orderkey = order_id JOIN cust ON o_custkey = customer_id),
sold AS (SELECT * FROM ord WHERE status = 'completed'),
sitems AS (SELECT items.*, order_date, customer_id, region FROM items JOIN sold USING (order_id))
"""
