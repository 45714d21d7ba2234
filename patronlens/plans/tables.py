"""Queries over cleaning, audits and territory."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.operators import cleaning, rfm, territory
from patronlens.plans.registry import query
from patronlens.plans.views import VIEWS

_CITIES = ", ".join("'" + c.replace("'", "''") + "'" for c in C.INVALID_SELLER_CITIES)

VIEWS["v_clean_customers"] = "SELECT * FROM v_customers WHERE customer_id IN (SELECT customer_id FROM v_raw_orders)"
VIEWS["v_clean_products"] = """SELECT product_id, product_category_name, product_name_lenght AS product_name_length,
 product_description_lenght AS product_description_length FROM v_products
WHERE product_category_name IN (SELECT product_category_name FROM v_translation)
 AND product_id IS NOT NULL AND product_name_lenght IS NOT NULL AND product_description_lenght IS NOT NULL"""
VIEWS["v_clean_payments"] = """SELECT DISTINCT order_id, payment_type, payment_value FROM v_payments
WHERE order_id IN (SELECT order_id FROM v_raw_orders) AND payment_type IS DISTINCT FROM 'not_defined'"""
VIEWS["v_clean_orders"] = """SELECT DISTINCT * FROM v_raw_orders WHERE NOT (order_status IS NOT DISTINCT FROM 'delivered' AND (
 order_id IS NULL OR customer_id IS NULL OR order_purchase_timestamp IS NULL OR order_approved_at IS NULL OR
 order_delivered_carrier_date IS NULL OR order_delivered_customer_date IS NULL OR order_estimated_delivery_date IS NULL))"""
VIEWS["v_clean_items"] = """SELECT DISTINCT order_id, product_id, seller_id, shipping_limit_date, price, freight_value FROM v_items
WHERE order_id IN (SELECT order_id FROM v_clean_orders)"""
VIEWS["v_used_geo"] = """SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, geolocation_city, geolocation_state FROM v_geo
WHERE geolocation_zip_code_prefix IN (SELECT seller_zip_code_prefix FROM v_sellers UNION SELECT customer_zip_code_prefix FROM v_clean_customers)"""
VIEWS["v_state_geo"] = """SELECT g.* REPLACE (coalesce(most_state, geolocation_state) AS geolocation_state) FROM v_used_geo g LEFT JOIN (
 SELECT geolocation_zip_code_prefix AS z, geolocation_state AS most_state,
        row_number() OVER (PARTITION BY geolocation_zip_code_prefix ORDER BY count(*) DESC, geolocation_state) AS i
 FROM v_used_geo GROUP BY 1, 2) ON z = geolocation_zip_code_prefix AND i = 1"""


def _fences(source: str, column: str) -> str:
    return f"""SELECT g.* FROM {source} g JOIN (SELECT geolocation_zip_code_prefix AS z,
  quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source} GROUP BY 1)
 ON z = geolocation_zip_code_prefix WHERE {column} >= q1 - 1.5 * (q3 - q1) AND {column} <= q3 + 1.5 * (q3 - q1)"""


VIEWS["v_lat_geo"] = _fences("v_state_geo", "geolocation_lat")
VIEWS["v_clean_geo"] = _fences("v_lat_geo", "geolocation_lng")
VIEWS["v_clean_translation"] = "SELECT product_category_name, product_category_name_english FROM v_translation"
VIEWS["v_clean_sellers"] = f"""SELECT seller_id, seller_zip_code_prefix, seller_city FROM v_sellers
WHERE seller_city IS NULL OR seller_city NOT IN ({_CITIES})"""
VIEWS["v_upper"] = """SELECT product_id, upper_category FROM v_products LEFT JOIN (
 SELECT product_category_name, coalesce(upper_category, '') AS upper_category
 FROM v_translation LEFT JOIN v_tree ON name = product_category_name_english) USING (product_category_name)"""

_CLEAN = {
    "customers": "v_clean_customers",
    "orders": "v_clean_orders",
    "orders_items": "v_clean_items",
    "order_payments": "v_clean_payments",
    "products": "v_clean_products",
    "product_category_name_translation": "v_clean_translation",
    "sellers": "v_clean_sellers",
    "geolocation": "v_clean_geo",
    "order_reviews": "SELECT order_id, review_score FROM v_reviews",
}


def _register_clean(table: str, source: str):
    sql = source if " " in source else f"SELECT * FROM {source}"

    @query(f"clean_{table}", sql)
    def _(shop):
        return cleaning.clean_table(shop.raw(), table)


for _table, _source in _CLEAN.items():
    _register_clean(_table, _source)


@query("clean_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM " + (f"({s})" if " " in s else s) for t, s in _CLEAN.items()
))
def _(shop):
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in cleaning.clean(shop.raw()).items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("products_in_catalogue", "SELECT * FROM v_products WHERE product_category_name IN (SELECT product_category_name FROM v_translation)")
def _(shop):
    return cleaning.products_in_catalogue(shop.products(), shop.translation())


@query("products_renamed", "SELECT product_id, product_name_lenght AS product_name_length, product_description_lenght AS product_description_length FROM v_products")
def _(shop):
    return cleaning.rename_product_columns(shop.products()).drop("product_category_name")


@query("distinct_items", "SELECT DISTINCT order_id, product_id, seller_id, shipping_limit_date, price, freight_value FROM v_items")
def _(shop):
    return cleaning.drop_columns(shop.items(), ["_row", *cleaning.REPEATED_ITEM_COLUMNS]).dropDuplicates()


@query("used_zips", """SELECT seller_zip_code_prefix AS geolocation_zip_code_prefix FROM v_sellers
 UNION SELECT customer_zip_code_prefix FROM v_clean_customers""")
def _(shop):
    return cleaning.used_zips(shop.sellers(), cleaning.customers(shop.customers(), shop.raw_orders()))


def _used_geo(shop, dedup=False):
    clean_customers = cleaning.customers(shop.customers(), shop.raw_orders())
    return cleaning.used_geolocation(shop.geolocation(), shop.sellers(), clean_customers, dedup)


@query("used_geolocation", "SELECT * FROM v_used_geo")
def _(shop):
    return _used_geo(shop)


@query("used_geolocation_distinct", "SELECT DISTINCT * FROM v_used_geo")
def _(shop):
    return _used_geo(shop, True)


@query("geolocation_state_fixed", "SELECT * FROM v_state_geo")
def _(shop):
    return cleaning.fix_state(_used_geo(shop))


@query("iqr_filter", """SELECT event_id, event_type, value FROM (
  SELECT *, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3
  FROM events WINDOW w AS (PARTITION BY event_type))
 WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def _(shop):
    return cleaning.iqr_filter(shop.source("events").select("event_id", "event_type", "value"), ["event_type"], ["value"])


@query("product_upper_categories", "SELECT * FROM v_upper")
def _(shop):
    return cleaning.product_categories(shop.products(), shop.translation(), shop.category_tree())


@query("ambiguous_zips", """SELECT geolocation_zip_code_prefix, count(DISTINCT geolocation_city) AS cities,
 count(DISTINCT geolocation_state) AS states FROM v_geo GROUP BY 1 HAVING cities > 1 OR states > 1""")
def _(shop):
    return cleaning.ambiguous_zips(shop.geolocation())


@query("underpaid_orders", """SELECT order_id, round(coalesce(paid, 0), 4) AS paid, round(due, 4) AS due FROM v_orders
 JOIN (SELECT order_id, sum(price) + sum(coalesce(freight_value, 0)) AS due FROM v_items GROUP BY 1) USING (order_id)
 LEFT JOIN (SELECT order_id, sum(payment_value) AS paid FROM v_payments GROUP BY 1) USING (order_id)
 WHERE order_status = 'delivered' AND round(coalesce(paid, 0), 4) < round(due, 4)""")
def _(shop):
    audit = cleaning.underpaid_orders(shop.orders(), shop.payments(), shop.items())
    return audit.withColumns({"paid": F.round("paid", 4), "due": F.round("due", 4)})


@query("odd_cities", r"""SELECT seller_city, count(*) AS count FROM v_sellers
 WHERE regexp_matches(seller_city, '[@0-9/\\]| - |^\s*$') GROUP BY 1""")
def _(shop):
    return cleaning.odd_cities(shop.sellers(), "seller_city")


# --- territory ---------------------------------------------------------------------------------

_PLACE = """row_number() OVER (PARTITION BY geolocation_zip_code_prefix ORDER BY count(*) DESC, {0}) AS i
 FROM v_clean_geo WHERE {0} IS NOT NULL GROUP BY geolocation_zip_code_prefix, {0}"""
VIEWS["v_centroids"] = f"""SELECT m.*, city, state FROM (
 SELECT geolocation_zip_code_prefix, avg(geolocation_lat) AS lat_d_mean, avg(geolocation_lng) AS lng_d_mean
 FROM (SELECT DISTINCT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng FROM v_clean_geo) GROUP BY 1) m
LEFT JOIN (SELECT geolocation_zip_code_prefix AS z, geolocation_city AS city, {_PLACE.format('geolocation_city')}) c ON c.z = geolocation_zip_code_prefix AND c.i = 1
LEFT JOIN (SELECT geolocation_zip_code_prefix AS z, geolocation_state AS state, {_PLACE.format('geolocation_state')}) s ON s.z = geolocation_zip_code_prefix AND s.i = 1"""
VIEWS["v_state_churn"] = f"""SELECT customer_state, overall, fired, CASE WHEN overall > 0 THEN fired / overall END AS share FROM (
 SELECT s AS customer_state, count(customer_unique_id) AS overall, count(CASE WHEN recency_days > 231 THEN 1 END) AS fired
 FROM (SELECT unnest([{', '.join(repr(s) for s in C.STATES)}]) AS s) LEFT JOIN (
  SELECT DISTINCT customer_unique_id, recency_days, customer_state FROM v_rates JOIN v_customers USING (customer_unique_id)) ON customer_state = s
 GROUP BY 1)"""


def clean_points(shop):
    return cleaning.clean_table(shop.raw(), "geolocation")


def centroids(shop):
    return shop.once("centroids", lambda: territory.zip_centroids(clean_points(shop)))


def _rounded_centroids(df):
    return df.withColumns({c: F.round(c, 8) for c in ("lat_d_mean", "lng_d_mean")})


_CENTROIDS = "SELECT * REPLACE (round(lat_d_mean, 8) AS lat_d_mean, round(lng_d_mean, 8) AS lng_d_mean) FROM v_centroids"


@query("zip_centroids", _CENTROIDS)
def _(shop):
    return _rounded_centroids(centroids(shop))


@query("zip_point_counts", "SELECT *, count(*) OVER (PARTITION BY geolocation_zip_code_prefix) AS points_count FROM v_clean_geo")
def _(shop):
    return territory.with_point_counts(clean_points(shop))


_SELECTED = "geolocation_zip_code_prefix IN (3, 6, 9, 12) AND"


@query("selected_points", f"SELECT * FROM v_clean_geo WHERE {_SELECTED} geolocation_state IN ('RJ', 'SP')")
def _(shop):
    return territory.select_points(clean_points(shop), ["RJ", "SP"], [3, 6, 9, 12])


@query("selected_centroids", f"{_CENTROIDS} WHERE {_SELECTED} state IN ('RJ', 'SP')")
def _(shop):
    return _rounded_centroids(territory.select_centroids(centroids(shop), ["RJ", "SP"], [3, 6, 9, 12]))


@query("map_centre", "SELECT round(avg(lat_d_mean), 8) AS lat, round(avg(lng_d_mean), 8) AS lng FROM v_centroids")
def _(shop):
    return territory.map_centre(centroids(shop)).select(F.round("lat", 8).alias("lat"), F.round("lng", 8).alias("lng"))


@query("zip_choices", "SELECT DISTINCT geolocation_zip_code_prefix FROM v_centroids ORDER BY 1")
def _(shop):
    return territory.choices(centroids(shop), "geolocation_zip_code_prefix")


@query("state_choices", "SELECT DISTINCT state FROM v_centroids ORDER BY 1")
def _(shop):
    return territory.choices(centroids(shop), "state")


def _churn(shop):
    metrics = rfm.customer_metrics(shop.orders(), shop.customers(), shop.payments())
    return territory.state_churn(rfm.rates(metrics, shop.orders()), shop.customers())


@query("state_churn", "SELECT * REPLACE (round(share, 8) AS share) FROM v_state_churn")
def _(shop):
    return _churn(shop).withColumn("share", F.round("share", 8))


@query("state_share_range", "SELECT round(min(share), 8) AS min_share, round(max(share), 8) AS max_share, round(max(share) - min(share), 8) AS delta FROM v_state_churn")
def _(shop):
    return territory.share_range(_churn(shop)).select(*[F.round(c, 8).alias(c) for c in ("min_share", "max_share", "delta")])


# A vector of the embeddings table read as an outline: consecutive components are lng and lat of a
# vertex. Every third is one polygon; the others are two, split after a third of the vertices.
VIEWS["v_rings"] = f"""SELECT vec_id, kind, k, size, CASE WHEN kind = 'Polygon' OR k < cut THEN 0 ELSE 1 END AS ring,
 CASE WHEN kind = 'Polygon' OR k < cut THEN k ELSE k - cut END AS i, lng, lat
FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind, len(embedding) // 2 AS size,
       (len(embedding) // 2) // 3 AS cut, unnest(generate_series(0, len(embedding) // 2 - 1)) AS k, embedding FROM embeddings),
 LATERAL (SELECT CAST(embedding[2 * k + 1] AS DOUBLE) AS lng, CAST(embedding[2 * k + 2] AS DOUBLE) AS lat)"""
VIEWS["v_outlines"] = """SELECT vec_id AS id, kind AS type, count(*) AS vertices,
 (max(CASE WHEN boxed THEN lat END) + min(CASE WHEN boxed THEN lat END)) / 2 AS center_lat,
 (max(CASE WHEN boxed THEN lng END) + min(CASE WHEN boxed THEN lng END)) / 2 AS center_lon
FROM (SELECT *, kind <> 'Polygon' OR i < max(i) OVER (PARTITION BY vec_id) AS boxed FROM v_rings
      WHERE i % 2 = 0 AND (kind = 'Polygon' OR ring = 1)) GROUP BY 1, 2"""


def features(shop):
    size = F.floor(F.size("embedding") / 2).cast("int")
    vertex = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda k: F.array(F.get("embedding", 2 * k).cast("double"), F.get("embedding", 2 * k + 1).cast("double")),
    )
    cut = F.floor(size / 3).cast("int")
    points = shop.source("embeddings").select("vec_id", vertex.alias("v"), cut.alias("cut"), size.alias("size"))
    two = F.array(F.array(F.slice("v", F.lit(1), F.col("cut"))), F.array(F.slice("v", F.col("cut") + 1, F.col("size"))))
    single = F.col("vec_id") % 3 == 0
    return points.select(
        F.col("vec_id").alias("id"),
        F.when(single, "Polygon").otherwise("MultiPolygon").alias("type"),
        F.when(single, F.array(F.array("v"))).otherwise(two).alias("polygons"),
    )


@query("state_outlines", "SELECT id, type, CAST(vertices AS INTEGER) AS vertices, round(center_lat, 8) AS center_lat, round(center_lon, 8) AS center_lon FROM v_outlines")
def _(shop):
    outlines = territory.state_outlines(features(shop), step=2)
    return outlines.select(
        "id", "type", F.size("outline").alias("vertices"),
        F.round("center_lat", 8).alias("center_lat"), F.round("center_lon", 8).alias("center_lon"),
    )


@query("outline_labels", """SELECT vec_id AS id, fired, overall,
 format('Штат {}: пользователей ушло {}, всего было {} ({:.1f}%)', vec_id, fired, overall, share * 100) AS text
 FROM (SELECT s.*, list_position(list_sort(list(customer_state) OVER ()), customer_state) - 1 AS k FROM v_state_churn s WHERE share IS NOT NULL) s
 JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = k""")
def _(shop):
    # States are numbered in the alphabet so that they can stand in for the outline ids.
    churn = _churn(shop).where(F.col("share").isNotNull())
    names = churn.agg(F.sort_array(F.collect_set("customer_state"))).scalar()
    numbered = churn.withColumn("customer_state", F.array_position(names, F.col("customer_state")) - 1)
    labelled = territory.labelled_outlines(territory.state_outlines(features(shop)), numbered)
    return labelled.select("id", "fired", "overall", "text")
