"""Recency, frequency and money: metrics, scores, cells and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.functions.order_stats import exact_quantiles
from patronlens.session import cut_lineage


def order_payments(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(F.sum("payment_value").alias("monetary_value"))


def analysis_date(orders: DataFrame) -> DataFrame:
    """One row: the day after the latest purchase."""
    return orders.agg(F.date_add(F.to_date(F.max("order_purchase_timestamp")), 1).alias("analysis_date"))


def customer_metrics(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    """Last purchase, distinct orders, money and distinct delivered orders per person.

    Unpaid orders vanish in the inner join. The payment join comes last, so its partitioning by
    order already groups the (person, order) step and only one row per person and map task is
    shuffled to the final step.
    """
    owned = orders.select("order_id", "customer_id", "order_status", "order_purchase_timestamp").join(
        customers.select("customer_id", "customer_unique_id"), "customer_id"
    )
    per_order = (
        owned.join(order_payments(payments), "order_id")
        .groupBy("customer_unique_id", "order_id")
        .agg(
            F.max("order_purchase_timestamp").alias("last"),
            F.sum("monetary_value").alias("money"),
            F.max(F.coalesce(F.col("order_status") == "delivered", F.lit(False))).alias("delivered"),
        )
    )
    return per_order.groupBy("customer_unique_id").agg(
        F.max("last").alias("last_purchase_date"),
        F.count("order_id").alias("total_orders_count"),
        F.sum("money").alias("monetary_value"),
        F.count_if("delivered").alias("delivered_orders_count"),
    )


def rates(metrics: DataFrame, orders: DataFrame, exact_rate: bool = False) -> DataFrame:
    """Recency in calendar days, average order value and delivered percentage.

    The percentage is truncated to a whole number unless ``exact_rate`` asks for two decimals.
    """
    today = analysis_date(orders).scalar()
    orders_count = F.nullif(F.col("total_orders_count"), F.lit(0))
    hundredfold = F.col("delivered_orders_count") * 100
    if exact_rate:
        rate = F.round(hundredfold / orders_count, 2)
    else:
        rate = F.floor(hundredfold / orders_count).cast("double")
    return metrics.select(
        "customer_unique_id",
        "last_purchase_date",
        F.datediff(today, F.to_date("last_purchase_date")).alias("recency_days"),
        "total_orders_count",
        "monetary_value",
        (F.col("monetary_value") / orders_count).alias("avg_order_value"),
        rate.alias("delivered_rate_percentage"),
    )


def recency_cuts(people: DataFrame) -> DataFrame:
    """The 33% and 66% points of recency. Recency has one value per calendar day, so counts suffice."""
    days = people.groupBy("recency_days").agg(F.count(F.lit(1)).alias("n"))
    return days.agg(F.percentile("recency_days", [0.33, 0.66], F.col("n")).alias("r"))


def money_cuts(people: DataFrame) -> DataFrame:
    return exact_quantiles(people, "monetary_value", [0.33, 0.66], alias="m").select("m")


def frequency_score(count: Column) -> Column:
    return F.when(count >= 5, 1).when(count >= 2, 2).otherwise(3)


def scores(people: DataFrame) -> DataFrame:
    """Score 1 (best) to 3 on each axis, against the table's own cut points."""
    r, m = recency_cuts(people).scalar(), money_cuts(people).scalar()
    recency, money = F.col("recency_days"), F.col("monetary_value")
    return people.withColumns({
        "r_score": F.when(recency <= r[0], 1).when(recency <= r[1], 2).otherwise(3),
        "f_score": frequency_score(F.col("total_orders_count")),
        "m_score": F.when(money >= m[1], 1).when(money >= m[0], 2).otherwise(3),
    })


def describe(r: Column, f: Column, m: Column) -> Column:
    """Segment words for three scores."""
    word = [F.get(F.array(*[F.lit(w) for w in words]), score - 1) for words, score in
            ((C.RECENCY_WORDS, r), (C.FREQUENCY_WORDS, f), (C.MONEY_WORDS, m))]
    known = word[0].isNotNull() & word[1].isNotNull() & word[2].isNotNull()
    return F.when(known, F.concat_ws(", ", *word)).otherwise(C.UNDEFINED_SEGMENT)


def rfm_table(orders: DataFrame, customers: DataFrame, payments: DataFrame, exact_rate: bool = False) -> DataFrame:
    """The analysis table, one row per person.

    The metrics are read four times (two cut points in two steps each, and the scoring), so the
    join result is written once before that.
    """
    people = cut_lineage(rates(customer_metrics(orders, customers, payments), orders, exact_rate))
    scored = scores(people)
    axes = [F.col(c) for c in ("r_score", "f_score", "m_score")]
    return scored.select(
        *people.columns,
        F.concat(*[a.cast("string") for a in axes]).alias("rfm_cell"),
        describe(*axes).alias("rfm_segment_description"),
    )


def cells(rfm: DataFrame) -> DataFrame:
    return (
        rfm.groupBy("rfm_cell", "rfm_segment_description")
        .agg(F.count("customer_unique_id").alias("count"))
        .orderBy("rfm_cell")
    )


def listing(rfm: DataFrame) -> DataFrame:
    return rfm.orderBy("recency_days", "customer_unique_id")


def digits(rfm: DataFrame) -> DataFrame:
    """Count per cell with the cell split into its three scores."""
    counts = rfm.groupBy("rfm_cell").agg(F.count(F.lit(1)).alias("count"))
    digit = {name: F.substring("rfm_cell", i + 1, 1).cast("int") for i, name in enumerate(("latency", "freq", "money"))}
    return counts.withColumns(digit)


def tensor(rfm: DataFrame) -> DataFrame:
    """Counts of the cells that occur, on axes counted from zero."""
    return digits(rfm).select(
        (F.col("latency") - 1).alias("x"), (F.col("freq") - 1).alias("y"), (F.col("money") - 1).alias("z"), "count"
    )


def rollup_two_axes(rfm: DataFrame) -> DataFrame:
    """Counts on every pair of axes; the collapsed axis is null. Absent pairs have no row."""
    return _grouping(rfm, [["freq", "money"], ["latency", "money"], ["latency", "freq"]])


def rollup_one_axis(rfm: DataFrame) -> DataFrame:
    return _grouping(rfm, [["latency"], ["freq"], ["money"]])


def _grouping(rfm: DataFrame, sets: list[list[str]]) -> DataFrame:
    axes = ["latency", "freq", "money"]
    groups = [[F.col(c) for c in s] for s in sets]
    return digits(rfm).groupingSets(groups, *axes).agg(F.sum("count").alias("count")).select(*axes, "count")


def repeat_probability(seconds: Column, parity: bool = False) -> Column:
    """Share of repeat purchases made within ``seconds``, from the fixed table, capped at 1.

    Linear between the knots, clamped outside. ``parity`` adds the upper instead of the lower
    knot's share and extrapolates past the last knot, as the original formula does.
    """
    return interpolate(seconds, F.lit(C.REPEAT_SECONDS), F.lit(C.REPEAT_SHARES), parity)


def interpolate(at: Column, xs: Column, ys: Column, parity: bool = False) -> Column:
    last = F.size(xs)
    above = F.array_position(F.transform(xs, lambda x: x > at), True)
    upper = F.when(above == 0, last).otherwise(above).cast("int")
    lower = F.when(upper == 1, last if parity else F.lit(1)).otherwise(upper - 1)
    x0, x1 = F.element_at(xs, lower), F.element_at(xs, upper)
    y0, y1 = F.element_at(ys, lower), F.element_at(ys, upper)
    part = F.try_divide(at - x0, x1 - x0)
    if parity:
        return F.least(F.lit(1.0), part * (y1 - y0) + y1)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(part, F.lit(0.0))))
    return F.when(at.isNull(), None).otherwise(F.least(F.lit(1.0), inside * (y1 - y0) + y0))


def last_purchase_probability(rfm: DataFrame, today: Column, parity: bool = False) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.col("last_purchase_date"), today).cast("double")
    aged = rfm.select("customer_unique_id", seconds.alias("time"))
    return aged.withColumn("probability", repeat_probability(F.col("time"), parity))
