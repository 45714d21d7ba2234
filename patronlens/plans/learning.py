"""Queries over the clustering table, evaluation, paging and the readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens import schemas
from patronlens.functions import paging
from patronlens.operators import churn, cleaning, clustering, features, models, rfm
from patronlens.plans import people, reports, tables  # noqa: F401
from patronlens.plans.registry import QUERIES, SQL, query
from patronlens.plans.tables import centroids
from patronlens.plans.views import VIEWS
from patronlens.session import scratch_path
from patronlens.sources import csv_tables, documents

YEAR = "customer_year"

# --- R16 ---------------------------------------------------------------------------------------

VIEWS["v_order_gaps"] = """SELECT order_id, customer_unique_id, CAST(date_sub('second', lag(order_purchase_timestamp) OVER (
 PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id), order_purchase_timestamp) AS DOUBLE) AS gap FROM v_event_orders"""


@query("order_gaps", "SELECT * FROM v_order_gaps WHERE gap IS NOT NULL")
def _(shop):
    return features.order_gaps(shop.event_orders())


@query("order_gaps_split", "SELECT * FROM v_order_gaps WHERE gap IS NOT NULL")
def _(shop):
    """The same gaps; kept under its name."""
    return features.order_gaps(shop.event_orders())


@query("repeat_knots", " UNION ALL ".join(
    f"SELECT {round(i / 27, 6)}::DOUBLE AS share, round(quantile_cont(gap, {i / 27!r}), 4) AS seconds FROM v_order_gaps WHERE gap IS NOT NULL"
    for i in range(28)
))
def _(shop):
    return features.repeat_knots(shop.event_orders()).select(F.round("share", 6).alias("share"), F.round("seconds", 4).alias("seconds"))


# --- clustering table --------------------------------------------------------------------------

VIEWS["y_rfm_features"] = """SELECT customer_unique_id, recency_days, total_orders_count, log10(monetary_value) AS monetary_value,
 log10(avg_order_value) AS avg_order_value, delivered_rate_percentage AS success_rate_percentage, r AS rfm_1, f AS rfm_2, m AS rfm_3 FROM y_rfm"""
VIEWS["y_placed"] = """SELECT *, coalesce(sqrt(pow(s.lat_d_mean - c.lat_d_mean, 2) + pow(s.lng_d_mean - c.lng_d_mean, 2)), 0) AS distance
FROM y_repeated LEFT JOIN v_centroids s ON s.geolocation_zip_code_prefix = seller_zip_code_prefix
LEFT JOIN v_centroids c ON c.geolocation_zip_code_prefix = customer_zip_code_prefix"""


def _table(category: str) -> str:
    return f"""SELECT p.*, f.* EXCLUDE (customer_unique_id), l."lambda", l.class FROM (
 SELECT customer_unique_id, avg(distance) AS dist, avg(review_score) AS score FROM y_placed GROUP BY 1) d
JOIN (SELECT customer_unique_id, dist, score, cat FROM (
  SELECT customer_unique_id, avg(distance) AS dist, avg(review_score) AS score FROM y_placed GROUP BY 1) JOIN ({category}) USING (customer_unique_id)) p USING (customer_unique_id)
JOIN y_rfm_features f USING (customer_unique_id) LEFT JOIN y_labels l ON l.id = p.customer_unique_id"""


VIEWS["y_clustering"] = _table("""SELECT customer_unique_id, upper_category AS cat FROM (SELECT customer_unique_id, upper_category,
 row_number() OVER (PARTITION BY customer_unique_id ORDER BY count(*) DESC, upper_category) AS i FROM y_placed GROUP BY 1, 2) WHERE i = 1""")
VIEWS["y_clustering_parity"] = _table("SELECT customer_unique_id, max(upper_category) AS cat FROM y_placed GROUP BY 1")
_WIDE = """customer_unique_id, round(dist, 6) AS dist, round(score, 6) AS score, cat, recency_days, total_orders_count,
 round(monetary_value, 6) AS monetary_value, round(avg_order_value, 6) AS avg_order_value, success_rate_percentage, rfm_1, rfm_2, rfm_3,
 round("lambda", 6) AS "lambda", class"""


def clustering_table(shop, parity=False):
    def make():
        labels = churn.poisson_labels(people.repeated(shop), people.today(shop))
        table = rfm.rfm_table(shop.orders(), shop.customers(), shop.payments())
        return clustering.clustering_table(people.repeated(shop), centroids(shop), table, labels, parity)

    return shop.once(f"clustering-{parity}", make)


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _rounded_table(df):
    return _rounded(df, "dist", "score", "monetary_value", "avg_order_value", "lambda")


@query("rfm_features", """SELECT * REPLACE (round(monetary_value, 6) AS monetary_value, round(avg_order_value, 6) AS avg_order_value) FROM y_rfm_features""", YEAR)
def _(shop):
    table = clustering.rfm_features(rfm.rfm_table(shop.orders(), shop.customers(), shop.payments()))
    return _rounded(table, "monetary_value", "avg_order_value")


@query("clustering_table", f"SELECT {_WIDE} FROM y_clustering", YEAR)
def _(shop):
    return _rounded_table(clustering_table(shop))


@query("clustering_table_parity", f"SELECT {_WIDE} FROM y_clustering_parity", YEAR)
def _(shop):
    return _rounded_table(clustering_table(shop, parity=True))


@query("standardized", """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal,
 round((c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER (), 6) AS c_nationkey FROM customer""")
def _(shop):
    scaled = clustering.standardize(shop.source("customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"])
    return _rounded(scaled, "c_acctbal", "c_nationkey")


@query("category_dummies", "SELECT order_id, " + ", ".join(
    f"CASE WHEN upper_category = '{c}' THEN 1.0::DOUBLE ELSE 0 END AS upper_category_{c}" for c in people.CATEGORIES
) + " FROM y_dataset", YEAR)
def _(shop):
    return clustering.dummies(people.dataset(shop).select("order_id", "upper_category"), "upper_category", people.CATEGORIES)


_TERMS = " + ".join(
    f"""coalesce(abs(t."{c}" - p."{c}") / nullif((SELECT max("{c}") - min("{c}") FROM y_clustering), 0), 0)""" for c in clustering.NUMERIC
)


@query("gower_distance", f"""WITH p AS (SELECT class, {', '.join(f'avg("{c}") AS "{c}"' for c in clustering.NUMERIC)} FROM y_clustering GROUP BY 1),
 k AS (SELECT class, cat FROM (SELECT class, cat, row_number() OVER (PARTITION BY class ORDER BY count(*) DESC, cat) AS i FROM y_clustering GROUP BY 1, 2) WHERE i = 1)
 SELECT t.customer_unique_id, t.class, round(({_TERMS} + CASE WHEN t.cat = k.cat THEN 0 ELSE 1 END) / 12, 6) AS distance
 FROM y_clustering t JOIN p USING (class) JOIN k USING (class)""", YEAR)
def _(shop):
    return _rounded(clustering.distance_to_profile(clustering_table(shop), "class"), "distance")


@query("cluster_shares", "SELECT rfm_1 AS cluster, round(avg(class), 2) AS probability FROM y_clustering GROUP BY 1", YEAR)
def _(shop):
    return clustering.cluster_shares(clustering_table(shop).withColumn("cluster", F.col("rfm_1")))


@query("cluster_description", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count("{c}") AS count, round(avg("{c}"), 6) AS mean, round(stddev_samp("{c}"), 6) AS std, round(CAST(min("{c}") AS DOUBLE), 6) AS min,
 round(CAST(quantile_cont("{c}", 0.25) AS DOUBLE), 6) AS q25, round(CAST(quantile_cont("{c}", 0.5) AS DOUBLE), 6) AS q50, round(CAST(quantile_cont("{c}", 0.75) AS DOUBLE), 6) AS q75, round(CAST(max("{c}") AS DOUBLE), 6) AS max
 FROM y_clustering WHERE rfm_1 = 1""" for c in clustering.NUMERIC
), YEAR)
def _(shop):
    described = clustering.describe(clustering_table(shop).where(F.col("rfm_1") == 1), clustering.NUMERIC)
    return _rounded(described, "mean", "std", "min", "q25", "q50", "q75", "max")


@query("confusion_matrix", f"""SELECT CASE WHEN days >= 231 THEN 0 ELSE 1 END AS label,
 count(CASE WHEN class = 0 THEN 1 END) AS predicted_0, count(CASE WHEN class = 1 THEN 1 END) AS predicted_1
 FROM y_labels JOIN (SELECT customer_unique_id AS id, min(days_after_order) AS days FROM y_prefixes GROUP BY 1) USING (id) GROUP BY 1""", YEAR)
def _(shop):
    return models.confusion(_two_labels(shop), "fixed", "class")


def _two_labels(shop):
    """The Poisson class next to the fixed-threshold label of the same person."""
    labels = churn.poisson_labels(people.repeated(shop), people.today(shop))
    whole = features.history_dataset(people.base(shop), people.today(shop), expand=False)
    fixed = whole.select(F.col("customer_unique_id").alias("id"), churn.fixed_label(F.col("days_after_order")).alias("fixed"))
    return labels.join(fixed, "id")


@query("label_agreement", """SELECT round(avg(CASE WHEN class = CASE WHEN days >= 231 THEN 0 ELSE 1 END THEN 1.0 ELSE 0.0 END), 8) AS accuracy
 FROM y_labels JOIN (SELECT customer_unique_id AS id, min(days_after_order) AS days FROM y_prefixes GROUP BY 1) USING (id)""", YEAR)
def _(shop):
    return _rounded(models.accuracy(_two_labels(shop), "fixed", "class"), "accuracy", digits=8)


@query("table_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 60")
def _(shop):
    rows = shop.source("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return paging.page(rows, [("o_totalprice", True), "o_orderkey"], number=3)


@query("table_page_deep", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 1200")
def _(shop):
    rows = shop.source("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return paging.page(rows, [("o_totalprice", True), "o_orderkey"], number=60, bound=500)


@query("older_members", """SELECT order_id, upper_category, time_delta FROM (SELECT order_id, upper_category,
 CAST(date_sub('day', order_purchase_timestamp, (SELECT max(order_purchase_timestamp) FROM y_orders)) AS INTEGER) AS time_delta, items
 FROM y_dataset JOIN v_profile USING (order_id, upper_category)) WHERE items = 2 AND time_delta > 100""", YEAR)
def _(shop):
    profile = features.order_profile(shop.items(), people.product_upper(shop), shop.sellers()).select("order_id", "items")
    aged = people.dataset(shop).withColumn("time_delta", features.whole_days(F.col("order_purchase_timestamp"), people.today(shop)))
    return clustering.older_members(aged.join(profile, "order_id"), 2, column="items").select("order_id", "upper_category", "time_delta")


# --- readers and writers -----------------------------------------------------------------------

_RAW_COUNTS = {
    "customers": "v_customers", "orders": "v_raw_orders", "orders_items": "v_items", "order_payments": "v_payments",
    "order_reviews": "v_reviews", "products": "v_products", "product_category_name_translation": "v_translation",
    "sellers": "v_sellers", "geolocation": "v_geo",
}


def _write_raw(shop):
    folder = scratch_path(shop.spark, "raw")
    for name, df in shop.raw().items():
        csv_tables.write_table(df, folder, name, "csv")
    return folder


def _counts(frames):
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), F.lit(",".join(sorted(df.columns))).alias("columns"), "rows")
        for name, df in frames.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _count_sql(table, columns, source):
    return f"SELECT '{table}' AS table_name, '{','.join(sorted(columns))}' AS columns, count(*) AS rows FROM {source}"


@query("csv_raw_tables", " UNION ALL ".join(_count_sql(t, schemas.RAW[t].names, s) for t, s in _RAW_COUNTS.items()))
def _(shop):
    return _counts(csv_tables.load_raw(shop.spark, _write_raw(shop)))


def _typed(table, source):
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}
    return "SELECT " + ", ".join(f"CAST({f.name} AS {kinds[f.dataType.simpleString()]}) AS {f.name}" for f in schemas.RAW[table].fields) + f" FROM {source}"


def _register_round_trip(table, source):
    @query(f"csv_{table}_values", _typed(table, source))
    def _(shop):
        written = csv_tables.write_table(shop.raw()[table], scratch_path(shop.spark, table), table, "csv")
        good, _ = csv_tables.read_checked(shop.spark, written, schemas.RAW[table], table in csv_tables.MULTILINE)
        return good.select(*schemas.RAW[table].names)


for _table, _source in _RAW_COUNTS.items():
    _register_round_trip(_table, _source)


@query("rejected_rows", """SELECT 'orders_items' AS table_name, reason, count(*) AS rows FROM (
 SELECT unnest(CASE WHEN l_linenumber = 3 THEN ['price: double'] WHEN l_linenumber = 5 THEN ['shipping_limit_date: timestamp_ntz', 'price: double'] ELSE [] END) AS reason FROM lineitem) GROUP BY 2""")
def _(shop):
    """A load whose third lines have a price, and fifth lines a price and a date, that are none."""
    line = F.col("l_linenumber")
    spoiled = shop.source("lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
        F.when(line == 5, F.lit("soon")).otherwise(F.col("l_shipdate").cast("string")).alias("shipping_limit_date"),
        F.when(line.isin(3, 5), F.concat(F.lit("R$ "), F.col("l_extendedprice").cast("string"))).otherwise(F.col("l_extendedprice").cast("string")).alias("price"),
        F.col("l_tax").alias("freight_value"),
    )
    path = csv_tables.write_table(spoiled, scratch_path(shop.spark, "spoiled"), "orders_items", "csv")
    _, rejected = csv_tables.read_checked(shop.spark, path, schemas.RAW["orders_items"])
    reasons = rejected.select(F.lit("orders_items").alias("table_name"), F.explode("reasons").alias("reason"))
    return reasons.groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("rows"))


def _register_report(name, report, *columns):
    """IO13: a report written as one of the CSV files that the shop's pages read, and read back with its types."""
    @query(f"{name}_csv_round_trip", SQL[report])
    def _(shop):
        table = QUERIES[report](shop.spark, shop.folder)
        path = csv_tables.write_table(table, scratch_path(shop.spark, name), name, "csv")
        return csv_tables.read_csv(shop.spark, path, table.schema).select(*table.columns)


for _name, _report in (("ABC", "abc_classes"), ("XYZ", "xyz_classes"), ("merged", "abc_xyz_merged")):
    _register_report(_name, _report)


@query("csv_items_round_trip", "SELECT _row, CAST(order_id AS VARCHAR) AS order_id, CAST(product_id AS VARCHAR) AS product_id, CAST(seller_id AS VARCHAR) AS seller_id, shipping_limit_date, price, freight_value FROM v_items")
def _(shop):
    path = csv_tables.write_table(shop.items(), scratch_path(shop.spark, "items"), "orders_items", "csv")
    return csv_tables.read_csv(shop.spark, path, schemas.RAW["orders_items"])


@query("clean_tables_fall_back", " UNION ALL ".join(
    _count_sql(t, schemas.cleaned(t).names if t == "products" else schemas.RAW[t].names, "v_clean_products" if t == "products" else s)
    for t, s in _RAW_COUNTS.items()
))
def _(shop):
    raw, clean = _write_raw(shop), scratch_path(shop.spark, "clean")
    csv_tables.write_table(cleaning.clean_table(shop.raw(), "products"), clean, "products", "csv")
    return _counts(csv_tables.load_clean(shop.spark, clean, raw))


@query("parquet_orders_round_trip", "SELECT * FROM v_clean_orders")
def _(shop):
    clean = scratch_path(shop.spark, "clean")
    path = csv_tables.write_table(cleaning.clean_table(shop.raw(), "orders"), clean, "orders")
    return shop.spark.read.parquet(path)


@query("json_category_tree", "SELECT upper_category, name FROM v_tree")
def _(shop):
    path = scratch_path(shop.spark, "tree")
    documents.write_json(shop.category_tree(), path)
    tree = documents.read_json(shop.spark, path, "upper_category string, names array<string>")
    return tree.select("upper_category", F.explode("names").alias("name"))


@query("json_product_table", "SELECT product_id, upper_category FROM v_upper")
def _(shop):
    path = scratch_path(shop.spark, "product-table")
    documents.write_json(people.product_upper(shop), path)
    return documents.read_json(shop.spark, path, "product_id long, upper_category string")


@query("geojson_outlines", "SELECT CAST(id AS VARCHAR) AS id, type, CAST(vertices AS INTEGER) AS vertices, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon FROM v_outlines")
def _(shop):
    path = scratch_path(shop.spark, "outlines")
    documents.write_json(documents.outline_lines(tables.features(shop)), path)
    outlines = tables.territory.state_outlines(documents.read_outlines(shop.spark, path, collection=False), step=2)
    return outlines.select(
        "id", "type", F.size("outline").alias("vertices"),
        F.round("center_lat", 6).alias("center_lat"), F.round("center_lon", 6).alias("center_lon"),
    )


@query("report_csv_round_trip", "SELECT count, date_day FROM v_daily")
def _(shop):
    from patronlens.operators import activity

    path = csv_tables.write_table(activity.daily(shop.orders(), shop.customers()), scratch_path(shop.spark, "reports"), "dau", "csv")
    return csv_tables.read_csv(shop.spark, path).select(F.col("count").cast("long"), F.col("date_day").cast("date"))


def read_order_features(spark, path):
    """Order features from CSV files, without the saved index if there is one."""
    types = {"distance": "double", "payment_value": "double", "review_score": "double", "time_delta": "int"}
    text = cleaning.drop_columns(csv_tables.read_csv(spark, path), [schemas.ROW])
    return text.withColumns({c: F.col(c).cast(t) for c, t in types.items()})
