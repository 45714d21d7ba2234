"""Cleaning of the nine raw tables, and audits of what cleaning looks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.functions.expressions import any_null, is_one_of
from patronlens.functions.keys import keep_matching, most_common
from patronlens.functions.order_stats import exact_quantiles
from patronlens.schemas import ROW
from patronlens.session import cut_lineage

REPEATED_ITEM_COLUMNS = ["freight_value.1", "shipping_limit_date.1", "price.1"]
ZIP = "geolocation_zip_code_prefix"


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns that may be missing; names may contain dots."""
    gone = set(columns)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone])


def distinct_rows(df: DataFrame, keep_row: bool = False) -> DataFrame:
    """Rows that differ in anything but the saved index; ``keep_row`` keeps the smallest index of equal rows."""
    values = [c for c in df.columns if c != ROW]
    if not keep_row or ROW not in df.columns:
        return drop_columns(df, [ROW]).dropDuplicates()
    kept = df.groupBy(*[F.col(f"`{c}`") for c in values]).agg(F.min(ROW).alias(ROW))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def customers(raw_customers: DataFrame, raw_orders: DataFrame) -> DataFrame:
    return keep_matching(raw_customers, "customer_id", raw_orders)


def products_in_catalogue(raw_products: DataFrame, raw_translation: DataFrame) -> DataFrame:
    return keep_matching(raw_products, "product_category_name", raw_translation)


def rename_product_columns(products: DataFrame) -> DataFrame:
    return products.withColumnsRenamed({
        "product_name_lenght": "product_name_length",
        "product_description_lenght": "product_description_length",
    })


def products(raw_products: DataFrame, raw_translation: DataFrame) -> DataFrame:
    return rename_product_columns(products_in_catalogue(raw_products, raw_translation)).na.drop("any")


def reviews(raw_reviews: DataFrame, keep_row: bool = False) -> DataFrame:
    return raw_reviews if keep_row else drop_columns(raw_reviews, [ROW])


def payments(raw_payments: DataFrame, raw_orders: DataFrame, keep_row: bool = False) -> DataFrame:
    """Distinct payments of known orders with a defined type; an unknown (null) type stays."""
    defined = ~F.col("payment_type").eqNullSafe("not_defined")
    distinct = distinct_rows(raw_payments.where(defined), keep_row)
    return keep_matching(distinct, "order_id", raw_orders)


def orders(raw_orders: DataFrame) -> DataFrame:
    """Distinct orders without the delivered ones that miss any value."""
    incomplete = F.col("order_status").eqNullSafe("delivered") & any_null(raw_orders.columns)
    return raw_orders.where(~incomplete).dropDuplicates()


def items(raw_items: DataFrame, clean_orders: DataFrame, keep_row: bool = False) -> DataFrame:
    lines = distinct_rows(drop_columns(raw_items, REPEATED_ITEM_COLUMNS), keep_row)
    return keep_matching(lines, "order_id", clean_orders)


def used_zips(raw_sellers: DataFrame, clean_customers: DataFrame) -> DataFrame:
    zips = raw_sellers.select(F.col("seller_zip_code_prefix").alias(ZIP)).union(
        clean_customers.select("customer_zip_code_prefix")
    )
    return zips.distinct()


def used_geolocation(
    raw_geolocation: DataFrame, raw_sellers: DataFrame, clean_customers: DataFrame, dedup_geo: bool = False
) -> DataFrame:
    """Points of used zips. Repeated points stay, since they weigh in the outlier fences, unless asked."""
    kept = keep_matching(raw_geolocation, ZIP, used_zips(raw_sellers, clean_customers))
    points = drop_columns(kept, [ROW])
    return points.dropDuplicates() if dedup_geo else points


def fix_state(points: DataFrame) -> DataFrame:
    """Every point takes the most common state of its zip; a tie goes to the first in the alphabet."""
    state = most_common(points, [ZIP], "geolocation_state", "most_state")
    return points.join(state, ZIP, "left").select(
        *[
            F.coalesce("most_state", "geolocation_state").alias(c) if c == "geolocation_state" else F.col(c)
            for c in points.columns
        ]
    )


def iqr_filter(df: DataFrame, keys: Sequence[str], columns: Sequence[str], width: float = 1.5) -> DataFrame:
    """Rows inside the interquartile fences of their group, one column after another.

    The fences of a later column come from the survivors of the earlier ones. A group of one row
    has fences equal to its value and passes. Each pass reads its input three times (sketch, counts,
    filter), so the input is written once before it.
    """
    for column in columns:
        df = _inside_fences(cut_lineage(df), list(keys), column, width)
    return df


def _inside_fences(df: DataFrame, keys: list[str], column: str, width: float) -> DataFrame:
    quartiles = exact_quantiles(df, column, [0.25, 0.75], keys)
    spread = F.col("q")[1] - F.col("q")[0]
    fences = quartiles.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        (F.col("q")[0] - width * spread).alias("_low"),
        (F.col("q")[1] + width * spread).alias("_high"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    kept = df.join(fences, same, "inner").where(F.col(column).between(F.col("_low"), F.col("_high")))
    return kept.select(*df.columns)


def geolocation(
    raw_geolocation: DataFrame, raw_sellers: DataFrame, clean_customers: DataFrame, dedup_geo: bool = False
) -> DataFrame:
    points = fix_state(used_geolocation(raw_geolocation, raw_sellers, clean_customers, dedup_geo))
    return iqr_filter(points, [ZIP], ["geolocation_lat", "geolocation_lng"])


def translation(raw_translation: DataFrame) -> DataFrame:
    return drop_columns(raw_translation, [ROW])


def sellers(raw_sellers: DataFrame) -> DataFrame:
    kept = drop_columns(raw_sellers, [ROW])
    return kept.where(~is_one_of("seller_city", C.INVALID_SELLER_CITIES))


def clean_table(raw: dict[str, DataFrame], table: str, keep_row: bool = False) -> DataFrame:
    """One cleaned table. Customers and payments are checked against the raw orders, items against the
    clean ones, geolocation against the raw sellers and the clean customers.

    ``keep_row`` keeps the saved index of items, payments and reviews, by which the first of an order is chosen later.
    """
    if table == "customers":
        return customers(raw["customers"], raw["orders"])
    if table == "orders":
        return orders(raw["orders"])
    if table == "orders_items":
        return items(raw["orders_items"], orders(raw["orders"]), keep_row)
    if table == "order_payments":
        return payments(raw["order_payments"], raw["orders"], keep_row)
    if table == "order_reviews":
        return reviews(raw["order_reviews"], keep_row)
    if table == "products":
        return products(raw["products"], raw["product_category_name_translation"])
    if table == "product_category_name_translation":
        return translation(raw["product_category_name_translation"])
    if table == "sellers":
        return sellers(raw["sellers"])
    if table == "geolocation":
        return geolocation(raw["geolocation"], raw["sellers"], customers(raw["customers"], raw["orders"]))
    raise KeyError(table)


def clean(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All nine cleaned tables, ready for the feature operators; the saved index goes when they are written.

    Orders and customers, on which other tables depend, are written once.
    """
    done = {table: cut_lineage(clean_table(raw, table)) for table in ("orders", "customers") if table in raw}
    for table in raw:
        if table == "orders_items" and "orders" in done:
            done[table] = items(raw[table], done["orders"], keep_row=True)
        elif table == "geolocation" and "customers" in done:
            done[table] = geolocation(raw[table], raw["sellers"], done["customers"])
        elif table not in done:
            done[table] = clean_table(raw, table, keep_row=True)
    return {table: done[table] for table in raw}


def product_categories(products_table: DataFrame, translation_table: DataFrame, tree: DataFrame) -> DataFrame:
    """Product and upper category. ``tree`` has ``upper_category`` and the array ``names``.

    A category outside the tree is ``''``; a product whose category has no English name is null.
    """
    leaves = tree.select("upper_category", F.explode("names").alias("product_category_name_english"))
    leaves = leaves.groupBy("product_category_name_english").agg(F.max("upper_category").alias("upper_category"))
    named = translation_table.select("product_category_name", "product_category_name_english").join(
        leaves, "product_category_name_english", "left"
    )
    names = named.select("product_category_name", F.coalesce("upper_category", F.lit("")).alias("upper_category"))
    return products_table.select("product_id", "product_category_name").join(
        names, "product_category_name", "left"
    ).select("product_id", "upper_category")


# --- audits ------------------------------------------------------------------------------------


def ambiguous_zips(points: DataFrame) -> DataFrame:
    """Zips with more than one city or state."""
    pairs = points.groupBy(ZIP, "geolocation_city", "geolocation_state").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(ZIP).agg(
        F.countDistinct("geolocation_city").alias("cities"), F.countDistinct("geolocation_state").alias("states")
    ).where((F.col("cities") > 1) | (F.col("states") > 1))


def underpaid_orders(orders_table: DataFrame, payments_table: DataFrame, items_table: DataFrame) -> DataFrame:
    """Delivered orders whose payments do not cover prices and freight."""
    paid = payments_table.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    due = items_table.groupBy("order_id").agg(
        (F.sum("price") + F.sum(F.coalesce("freight_value", F.lit(0.0)))).alias("due")
    )
    delivered = orders_table.where(F.col("order_status") == "delivered").select("order_id")
    joined = delivered.join(due, "order_id").join(paid, "order_id", "left")
    paid_or_zero = F.coalesce("paid", F.lit(0.0))
    return joined.select("order_id", paid_or_zero.alias("paid"), "due").where(
        F.round("paid", 4) < F.round("due", 4)
    )


def odd_cities(table: DataFrame, column: str) -> DataFrame:
    """Distinct city values with an e-mail sign, a digit, a separator or nothing in them, with counts."""
    odd = F.col(column).rlike(r"[@0-9/\\]| - |^\s*$")
    return table.where(odd).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
