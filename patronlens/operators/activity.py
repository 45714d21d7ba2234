"""Daily and monthly activity, and N-month retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.session import cut_lineage


def _purchases(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.select("customer_id", "order_purchase_timestamp").join(
        customers.select("customer_id", "customer_unique_id"), "customer_id"
    )


def _active(distinct: bool) -> Column:
    person = F.col("customer_unique_id")
    return (F.countDistinct(person) if distinct else F.count(person)).alias("count")


def daily(orders: DataFrame, customers: DataFrame, distinct: bool = False) -> DataFrame:
    """Purchases per day; ``distinct`` counts people instead of orders."""
    day = F.to_date("order_purchase_timestamp").alias("date_day")
    return _purchases(orders, customers).groupBy(day).agg(_active(distinct)).orderBy("date_day")


def monthly(orders: DataFrame, customers: DataFrame, distinct: bool = False) -> DataFrame:
    month = F.date_format("order_purchase_timestamp", "yyyy-MM").alias("month_year")
    return _purchases(orders, customers).groupBy(month).agg(_active(distinct)).orderBy("month_year")


def period_spine(orders: DataFrame, months: int = 1) -> DataFrame:
    """Consecutive periods from the first purchase month until one reaches the last purchase.

    Each end is the previous end plus ``months``, so ends drift to the 30th and the 28th and stay
    there; they are chained, never counted from the first month.
    """
    span = orders.agg(
        F.to_date(F.min("order_purchase_timestamp")).alias("low"),
        F.to_date(F.max("order_purchase_timestamp")).alias("high"),
    )
    return span.select("low", F.explode(_chain(F.col("low"), F.col("high"), months)).alias("p")).select(
        F.col("p.index").alias("index"), F.col("p.start").alias("start_month"), F.col("p.end").alias("end_month"), "low"
    )


def _chain(low: Column, high: Column, months: int) -> Column:
    def period(index, start, end):
        return F.struct(index.alias("index"), start.alias("start"), end.alias("end"))

    first_start = F.to_date(F.trunc(low, "MM"))
    first = F.array(period(F.lit(0), first_start, F.date_sub(F.add_months(first_start, months), 1)))
    steps = F.sequence(F.lit(1), F.ceil(F.months_between(high, low) / months).cast("int") + 2)

    def grow(chain, i):
        last = F.element_at(chain, -1)
        following = period(i, F.date_add(last["end"], 1), F.add_months(last["end"], months))
        return F.when(last["end"] < high, F.concat(chain, F.array(following))).otherwise(chain)

    return F.aggregate(steps, first, grow)


def first_last_dates(orders: DataFrame, customers: DataFrame) -> DataFrame:
    day = F.to_date("order_purchase_timestamp")
    return _purchases(orders, customers).groupBy("customer_unique_id").agg(
        F.min(day).alias("first_order_date"), F.max(day).alias("last_order_date")
    )


def period_stats(orders: DataFrame, customers: DataFrame, months: int = 1) -> DataFrame:
    """Starting, new and departed people per period.

    People are folded to one row per (first, last) date pair. Each pair is new in one period and
    counts as departed from one period on, so both become counts per period index, and the running
    sum over the spine replaces comparing every person with every period.
    """
    pairs = cut_lineage(
        first_last_dates(orders, customers)
        .groupBy("first_order_date", "last_order_date")
        .agg(F.count(F.lit(1)).alias("people"))
    )
    spine = cut_lineage(period_spine(orders, months))
    periods = spine.agg(
        F.sort_array(F.collect_list(F.struct("index", F.col("start_month").alias("s"), F.col("end_month").alias("e"))))
    ).scalar()
    first, last = F.col("first_order_date"), F.col("last_order_date")
    placed = pairs.withColumn("periods", periods).select(
        "people",
        F.size(F.filter("periods", lambda p: p["e"] < first)).alias("joined"),
        F.size(F.filter("periods", lambda p: F.add_months(p["e"], -months) <= last)).alias("lapsed"),
    ).select("people", "joined", F.greatest(F.col("joined") + 1, F.col("lapsed")).alias("departed"))
    new = placed.groupBy(F.col("joined").alias("index")).agg(F.sum("people").alias("new_customers"))
    gone = placed.groupBy(F.col("departed").alias("index")).agg(F.sum("people").alias("gone"))
    # The spine has one row per calendar period, so this one-task window is small by construction.
    upto = Window.orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    joined = spine.join(new, "index", "left").join(gone, "index", "left").na.fill(0, ["new_customers", "gone"])
    return joined.select(
        "index", "low", "start_month", "end_month",
        F.coalesce(F.sum("new_customers").over(before), F.lit(0)).alias("starting_customers"),
        "new_customers",
        F.sum("gone").over(upto).alias("departed_customers"),
    )


def retention(orders: DataFrame, customers: DataFrame, months: int = 1, label: str = "global") -> DataFrame:
    """The retention report. ``label="period"`` starts each label at the period's own month."""
    stats = period_stats(orders, customers, months)
    origin = F.col("low") if label == "global" else F.col("start_month")
    starting, departed = F.col("starting_customers"), F.col("departed_customers")
    share = (starting - departed).cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)") / F.nullif(starting, F.lit(0)).cast("decimal(20,0)")
    return stats.select(
        F.concat(F.date_format(origin, "yyyy-MM"), F.lit(" to "), F.date_format("end_month", "yyyy-MM")).alias("period"),
        "starting_customers",
        "new_customers",
        "departed_customers",
        (starting + F.col("new_customers") - departed).alias("ending_customers"),
        F.round(share, 1).cast("double").alias("retention_rate"),
    ).orderBy(F.col("index"))


def split_series(days: DataFrame, parts: int = 6) -> DataFrame:
    """Each day with its part: contiguous parts of ``ceil(n / parts)`` days, the last ones shorter.

    ``days`` is a daily report, so the ordered window sees one row per calendar day.
    """
    position = F.row_number().over(Window.orderBy("date_day")) - 1
    per_part = F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / F.lit(parts))
    return days.withColumn("part", (F.floor(position / per_part) + 1).cast("int"))


def part_ranges(days: DataFrame, parts: int = 6) -> DataFrame:
    return split_series(days, parts).groupBy("part").agg(
        F.count(F.lit(1)).alias("days"), F.min("date_day").alias("first_day"), F.max("date_day").alias("last_day")
    )


def peak_day(days: DataFrame) -> DataFrame:
    """The busiest day, the earliest one on a tie."""
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col("date_day").alias("d")))
    return days.agg(best.alias("b")).select(F.col("b.d").alias("date_day"), (-F.col("b.n")).alias("count"))


def retention_band(rate: Column) -> Column:
    return F.when(rate > 1, "good").when(rate > 0.5, "middle").when(rate.isNull(), "").otherwise("bad")


def retention_display(report: DataFrame) -> DataFrame:
    """The report with display labels and titles."""
    label = F.regexp_replace(F.regexp_replace("period", " to ", " по "), "^", "с ")
    return report.withColumn("period", label).toDF(*C.RETENTION_TITLES)
