"""ABC classes by revenue share and XYZ classes by variation of monthly sales."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.functions.expressions import month_index
from patronlens.functions.keys import most_common
from patronlens.functions.order_stats import running_total
from patronlens.session import cut_lineage

NAME = "product_category_name_english"
PERIOD = (datetime(2016, 9, 19, 0, 15, 34), datetime(2018, 9, 19, 0, 15, 34))


def _full_outer(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Full outer join as a left join plus the unmatched rows of the other side.

    A heavy key of ``big`` can be split in a left join but not in a full outer one, and the unmatched
    side only meets the distinct keys of ``big``.
    """
    matched = big.join(small, key, "left")
    alone = small.join(big.select(key).distinct(), key, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def catalogue(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products and category names, full outer; the native name stands in for a missing English one."""
    joined = _full_outer(
        products.select("product_id", "product_category_name"),
        translation.select("product_category_name", NAME),
        "product_category_name",
    )
    return joined.select("product_id", F.coalesce(NAME, "product_category_name", F.lit("0")).alias(NAME))


def sold_lines(products: DataFrame, translation: DataFrame, items: DataFrame) -> DataFrame:
    """Catalogue and items, full outer: each row counts 1, sold or not; unknown products are ``'0'``."""
    joined = _full_outer(items, catalogue(products, translation), "product_id")
    return joined.withColumns({
        NAME: F.coalesce(NAME, F.lit("0")), "price": F.coalesce("price", F.lit(0.0)), "count": F.lit(1.0),
    })


def revenue(products: DataFrame, translation: DataFrame, items: DataFrame) -> DataFrame:
    """Price and count per category.

    Items are summed per product before they meet the catalogue; a bestseller then joins as one row.
    """
    per_product = items.groupBy("product_id").agg(
        F.sum("price").alias("price"), F.count(F.lit(1)).cast("double").alias("count")
    )
    joined = _full_outer(per_product, catalogue(products, translation), "product_id")
    return joined.groupBy(F.coalesce(NAME, F.lit("0")).alias(NAME)).agg(
        F.sum(F.coalesce("price", F.lit(0.0))).alias("price"), F.sum(F.coalesce("count", F.lit(1.0))).alias("count")
    )


def abc_class(cumulative: Column) -> Column:
    return F.when(cumulative >= 95, "C").when(cumulative > 80, "B").otherwise("A")


def abc(products: DataFrame, translation: DataFrame, items: DataFrame) -> DataFrame:
    """Share of revenue, running share from the largest category down, and the class."""
    categories = cut_lineage(revenue(products, translation, items))
    total = categories.agg(F.sum("price")).scalar()
    shares = categories.withColumn("percent", F.col("price") / F.nullif(total, F.lit(0.0)) * 100)
    ranked = running_total(shares, "percent", NAME, "cumsum_percent")
    return ranked.select(
        NAME, "price", "count", "percent", "cumsum_percent", abc_class(F.col("cumsum_percent")).alias("ABC")
    ).orderBy(F.col("price").desc(), NAME)


def shipping_span(items: DataFrame, start: datetime = PERIOD[0], end: datetime = PERIOD[1]) -> DataFrame:
    """First and last shipping date of all sold items, and the whole months of the chosen period."""
    months = (end.year - start.year) * 12 + end.month - start.month
    return items.where(F.col("shipping_limit_date").isNotNull()).agg(
        F.min("shipping_limit_date").alias("early_date"), F.max("shipping_limit_date").alias("last_date")
    ).withColumn("delta_month", F.lit(months))


def monthly_sales(
    products: DataFrame, translation: DataFrame, items: DataFrame,
    start: datetime = PERIOD[0], end: datetime = PERIOD[1],
) -> DataFrame:
    """Items sold per category and month of a period, both ends included."""
    shipped = F.col("shipping_limit_date")
    per_product = (
        items.where(shipped.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
        .groupBy("product_id", month_index(shipped).alias("month"))
        .agg(F.count(F.lit(1)).alias("sold"))
    )
    named = per_product.join(catalogue(products, translation), "product_id", "left")
    return named.groupBy(F.coalesce(NAME, F.lit("0")).alias(NAME), "month").agg(F.sum("sold").alias("count"))


def xyz_class(variation: Column) -> Column:
    return F.when(variation >= 25, "Z").when(variation >= 10, "Y").when(variation < 10, "X").otherwise("0")


def xyz(
    products: DataFrame, translation: DataFrame, items: DataFrame,
    start: datetime = PERIOD[0], end: datetime = PERIOD[1],
) -> DataFrame:
    """Mean, sample deviation and variation of the months with sales; months without are not zeros."""
    sales = monthly_sales(products, translation, items, start, end).groupBy(NAME).agg(
        F.avg("count").alias("mean_quantity_per_month"), F.stddev_samp("count").alias("std_deviation")
    )
    variation = F.col("std_deviation") / F.col("mean_quantity_per_month") * 100
    return (
        sales.withColumn("variation", variation)
        .withColumn("XYZ", xyz_class(F.col("variation")))
        .orderBy(F.col("variation").asc_nulls_last(), NAME)
    )


def merged(abc_table: DataFrame, xyz_table: DataFrame) -> DataFrame:
    return abc_table.join(xyz_table, NAME, "full")


def chart(general: DataFrame) -> DataFrame:
    """A categories one by one, B and C as one row each with their most common XYZ class."""
    single = general.where(F.col("ABC") == "A").select(F.col(NAME).alias("label"), "price", "percent", "ABC", "XYZ")
    rest = general.where(F.col("ABC").isin("B", "C"))
    sums = rest.groupBy("ABC").agg(F.sum("price").alias("price"), F.sum("percent").alias("percent"))
    grouped = sums.join(most_common(rest, ["ABC"], "XYZ", "XYZ"), "ABC", "left")
    return single.unionByName(grouped.withColumn("label", F.concat(F.lit("Группа "), F.col("ABC"))))


def class_counts(general: DataFrame) -> DataFrame:
    return general.groupBy("ABC").agg(F.count(F.lit(1)).alias("count"))
