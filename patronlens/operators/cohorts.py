"""Cohorts of people alive in a month, and their retention by month offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.functions.expressions import month_index, month_label
from patronlens.session import cut_lineage


def purchases(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.join(customers.select("customer_id", "customer_unique_id"), "customer_id", "left").select(
        "order_id", "customer_unique_id", "order_purchase_timestamp"
    )


def lifetimes(orders: DataFrame, customers: DataFrame, grace: int = C.COHORT_GRACE_MONTHS) -> DataFrame:
    """First and last month per person, and months of life: the difference plus ``grace``."""
    month = month_index(F.col("order_purchase_timestamp"))
    people = purchases(orders, customers).where(F.col("customer_unique_id").isNotNull()).groupBy("customer_unique_id")
    return people.agg(F.min(month).alias("first_month"), F.max(month).alias("last_month")).withColumn(
        "months_diff", F.col("last_month") - F.col("first_month") + grace
    )


def _pairs(orders: DataFrame, customers: DataFrame, grace: int) -> DataFrame:
    """People per (first, last) month: the only table the cohort steps read, whatever the data size."""
    people = lifetimes(orders, customers, grace)
    return cut_lineage(
        people.groupBy("first_month", "last_month", "months_diff").agg(F.count(F.lit(1)).alias("people"))
    )


def month_spine(orders: DataFrame, customers: DataFrame) -> DataFrame:
    span = lifetimes(orders, customers).agg(F.min("first_month").alias("low"), F.max("last_month").alias("high"))
    return span.select(F.explode(F.sequence("low", "high")).alias("m")).select(month_label(F.col("m")).alias("month"))


def counts(orders: DataFrame, customers: DataFrame, grace: int = C.COHORT_GRACE_MONTHS) -> DataFrame:
    """People per cohort month and offset, zeros dropped.

    A person belongs to month ``m`` at offset ``j`` when their first month is not after ``m`` and
    ``m + j`` lies within their life and the data. For each ``m`` that is a suffix sum over the last
    month people are counted in, so pairs are spread over months once, not over months and offsets.
    """
    pairs = _pairs(orders, customers, grace)
    span = pairs.agg(F.min("first_month").alias("low"), F.max("last_month").alias("high"))
    high = span.select("high").scalar()
    alive = (
        pairs.withColumn("end", F.least(F.col("first_month") + F.col("months_diff"), high))
        .select("end", "people", F.explode(F.sequence("first_month", "end")).alias("m"))
        .groupBy("m", "end")
        .agg(F.sum("people").alias("people"))
    )
    grid = span.select("high", F.explode(F.sequence("low", "high")).alias("m")).select(
        "m", F.explode(F.sequence("m", "high")).alias("end"), F.lit(0).cast("long").alias("people")
    )
    cells = alive.unionByName(grid).groupBy("m", "end").agg(F.sum("people").alias("people"))
    later = Window.partitionBy("m").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cells.withColumn("customers_count", F.sum("people").over(later))
        .where(F.col("customers_count") > 0)
        .select(month_label(F.col("m")).alias("cohort_month"), (F.col("end") - F.col("m")).alias("months_diff"), "customers_count")
    )


def bases(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("months_diff") == 0).select("cohort_month", F.col("customers_count").alias("base"))


def in_range(cells: DataFrame, low: int, high: int) -> DataFrame:
    offset = F.col("months_diff")
    return cells.where(offset.between(low, high) & (offset > 0))


def _pivot(cells: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """One row per cohort, one column per offset; the offsets are named, so no extra pass finds them."""
    offsets = list(range(max(low, 1), high + 1))
    wide = cells.groupBy("cohort_month").pivot("months_diff", offsets).agg(F.first(value))
    return wide.select("cohort_month", *[F.col(str(j)).alias(f"month_{j}") for j in offsets])


def absolute(cells: DataFrame, low: int = 1, high: int = 6) -> DataFrame:
    return _pivot(in_range(cells, low, high), "customers_count", low, high).orderBy("cohort_month")


def retention_cells(cells: DataFrame, low: int = 1, high: int = 6) -> DataFrame:
    """Percent of the base per cohort and offset, last cohort left out, one decimal (half to even)."""
    base = bases(cells)
    last = base.agg(F.max("cohort_month")).scalar()
    share = F.bround(F.col("customers_count") / F.col("base") * 100, 1)
    return base.where(F.col("cohort_month") < last).join(in_range(cells, low, high), "cohort_month", "left").select(
        "cohort_month", "months_diff", share.alias("retention")
    )


def retention(cells: DataFrame, low: int = 1, high: int = 6) -> DataFrame:
    return _pivot(retention_cells(cells, low, high), "retention", low, high).orderBy("cohort_month")


def with_bases(cells: DataFrame, low: int = 1, high: int = 6) -> DataFrame:
    """Cells of a range with their cohort's base, 0 where there is none."""
    joined = in_range(cells, low, high).join(bases(cells), "cohort_month", "left")
    return joined.withColumn("base", F.coalesce("base", F.lit(0)))
