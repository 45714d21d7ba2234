"""The shop's nine tables expressed over the driver's tables.

Two grains of person: ``person="customer"`` keeps the customer key, ``person="customer_year"``
takes a customer within one calendar year as a person and one customer row per order, which gives
the many one-order people the feature and churn operators are about. Everything is lazy; a query
scans only the columns it uses.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.session import cut_lineage

STATUS = {"F": "delivered", "O": "shipped", "P": "canceled"}
ODD_CITIES = {0: "sp", 1: "04482255", 2: "vendas@creditparts.com.br", 3: "lages - sc", 4: " "}


class Shop:
    def __init__(self, spark: SparkSession, folder: str, person: str = "customer"):
        self.spark, self.folder, self.person = spark, folder, person
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step of a query that several later steps start from: built and written once."""
        if name not in self._made:
            self._made[name] = cut_lineage(make())
        return self._made[name]

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _state(self, key: str) -> Column:
        return F.get(F.array(*[F.lit(s) for s in C.STATES]), F.col(key))

    def customers(self) -> DataFrame:
        people = self.source("customer").join(
            self.source("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
        ).select(
            F.col("c_custkey"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.lower("n_name").alias("customer_city"),
            self._state("c_nationkey").alias("customer_state"),
        )
        rest = ["customer_zip_code_prefix", "customer_city", "customer_state"]
        if self.person == "customer":
            return people.select(
                F.col("c_custkey").alias("customer_id"), F.col("c_custkey").alias("customer_unique_id"), *rest
            )
        orders = self.source("orders")
        return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("customer_id"),
            (F.col("o_custkey") * 10_000 + F.year("o_orderdate")).alias("customer_unique_id"),
            *rest,
        )

    def orders(self) -> DataFrame:
        status = reduce(
            lambda acc, kv: acc.when(F.col("o_orderstatus") == kv[0], kv[1]), STATUS.items(), F.when(F.lit(False), None)
        )
        owner = "o_custkey" if self.person == "customer" else "o_orderkey"
        return self.source("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col(owner).alias("customer_id"),
            status.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
        )

    def raw_orders(self) -> DataFrame:
        """Orders with the four later dates; an order without lines was never handed over."""
        shipped = self.source("lineitem").groupBy("l_orderkey").agg(
            F.min("l_shipdate").alias("order_delivered_carrier_date"),
            F.max("l_shipdate").alias("order_delivered_customer_date"),
        )
        orders = self.orders().join(shipped, F.col("order_id") == F.col("l_orderkey"), "left")
        bought = F.col("order_purchase_timestamp")
        return orders.select(
            "order_id", "customer_id", "order_status", "order_purchase_timestamp",
            bought.alias("order_approved_at"),
            "order_delivered_carrier_date", "order_delivered_customer_date",
            (bought + F.expr("INTERVAL 30 DAYS")).alias("order_estimated_delivery_date"),
        )

    def payments(self) -> DataFrame:
        kind = F.lower(F.substring("o_orderpriority", 3, 30))
        return self.source("orders").select(
            F.col("o_orderkey").alias("_row"),
            F.col("o_orderkey").alias("order_id"),
            F.when(kind == "not specified", "not_defined").otherwise(kind).alias("payment_type"),
            F.col("o_totalprice").alias("payment_value"),
        )

    def _line_row(self) -> Column:
        """A row number that orders the lines of an order; line numbers alone repeat."""
        line = F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")
        return ((line * 100_000 + F.col("l_suppkey")) * 64 + F.col("l_quantity").cast("long")).alias("_row")

    def items(self) -> DataFrame:
        return self.source("lineitem").select(
            self._line_row(),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        )

    def reviews(self) -> DataFrame:
        return self.source("lineitem").select(
            self._line_row(),
            F.col("l_orderkey").alias("order_id"),
            F.when(F.col("l_returnflag") != "N", 1.0 + F.col("l_quantity") % 5).alias("review_score"),
        )

    def products(self) -> DataFrame:
        name = F.col("p_name")
        return self.source("part").select(
            F.col("p_partkey").alias("product_id"),
            F.lower("p_brand").alias("product_category_name"),
            F.length(name).alias("product_name_lenght"),
            F.when(F.col("p_size") > 2, F.col("p_size")).alias("product_description_lenght"),
        )

    def translation(self) -> DataFrame:
        """All brands but the last one have an English name; a few names have no brand."""
        brands = self.source("part").groupBy("p_brand").agg(F.min("p_partkey").alias("_row"))
        last = brands.agg(F.max("p_brand")).scalar()
        known = brands.where(F.col("p_brand") < last).select(
            "_row", F.lower("p_brand").alias("product_category_name"),
            F.upper("p_brand").alias("product_category_name_english"),
        )
        kinds = self.source("part").groupBy("p_type").agg(F.min("p_partkey").alias("_row"))
        return known.unionByName(
            kinds.select(
                "_row", F.lower("p_type").alias("product_category_name"),
                F.concat(F.lit("kind "), F.lower("p_type")).alias("product_category_name_english"),
            )
        )

    def category_tree(self) -> DataFrame:
        """Upper category (by the last digit of the brand) with its English names; 9 stays unmapped."""
        english = F.upper("p_brand")
        digit = F.substring("p_brand", -1, 1)
        brands = self.source("part").select(F.concat(F.lit("group_"), digit).alias("upper_category"), english.alias("name"))
        return (
            brands.where(F.col("upper_category") != "group_9")
            .groupBy("upper_category").agg(F.sort_array(F.collect_set("name")).alias("names"))
        )

    def sellers(self) -> DataFrame:
        nation = self.source("nation").select("n_nationkey", "n_name")
        city = reduce(
            lambda acc, kv: acc.when(F.col("s_nationkey") == kv[0], kv[1]), ODD_CITIES.items(), F.when(F.lit(False), None)
        ).otherwise(F.lower("n_name"))
        return self.source("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("s_suppkey").alias("_row"),
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").alias("seller_zip_code_prefix"),
            city.alias("seller_city"),
        )

    def geolocation(self) -> DataFrame:
        """Points from the first two vector components, ten zips of which one (27) nobody uses."""
        vec = F.col("embedding")
        return self.source("embeddings").select(
            F.col("vec_id").alias("_row"),
            (F.col("label") * 3).alias("geolocation_zip_code_prefix"),
            F.round(vec[0].cast("double"), 3).alias("geolocation_lat"),
            F.round(vec[1].cast("double"), 3).alias("geolocation_lng"),
            F.concat(F.lit("city "), (F.col("vec_id") % 4).cast("string")).alias("geolocation_city"),
            F.get(F.array(*[F.lit(s) for s in C.STATES]), (F.col("vec_id") % 3).cast("int")).alias("geolocation_state"),
        )

    def raw(self) -> dict[str, DataFrame]:
        return {
            "customers": self.customers(),
            "orders": self.raw_orders(),
            "orders_items": self.items(),
            "order_payments": self.payments(),
            "order_reviews": self.reviews(),
            "products": self.products(),
            "product_category_name_translation": self.translation(),
            "sellers": self.sellers(),
            "geolocation": self.geolocation(),
        }

    def event_orders(self) -> DataFrame:
        """Events as orders with times of day: one order per event, one customer per user."""
        return self.source("events").select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_unique_id"),
            F.col("ts").alias("order_purchase_timestamp"),
            F.col("value").alias("payment_value"),
            (1 + F.col("event_id") % 5).cast("double").alias("review_score"),
            F.col("event_type").alias("upper_category"),
            (F.col("event_id") % 25).cast("int").alias("seller_zip_code_prefix"),
            (F.col("user_id") % 25).cast("int").alias("customer_zip_code_prefix"),
        )
