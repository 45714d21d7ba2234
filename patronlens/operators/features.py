"""Order and customer features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.functions.expressions import euclidean, is_one_of, whole_days
from patronlens.functions.keys import first_per_key, keep_matching, with_row
from patronlens.functions.order_stats import exact_quantiles, smallest_by_hash
from patronlens.operators import sessions as S
from patronlens.session import cut_lineage

PERSON, TIME, ORDER = S.PERSON, S.TIME, S.ORDER


def reference_date(orders: DataFrame) -> Column:
    """The latest purchase as a scalar column."""
    return orders.agg(F.max(TIME)).scalar()


def order_profile(items: DataFrame, product_upper: DataFrame, sellers: DataFrame) -> DataFrame:
    """Per order: category with the largest price sum (first in the alphabet on a tie), zip of the
    first line's seller (0 if unknown) and number of lines, all from one pass over the lines.

    The step over all lines keeps only numbers, so it is a hash aggregation. Both side tables are written
    first, so that the planner sees how small they are and need not shuffle all lines for them. Lines then move once, to their order.
    """
    upper, zips = cut_lineage(product_upper.select("product_id", "upper_category")), cut_lineage(sellers.select("seller_id", "seller_zip_code_prefix"))
    lines = with_row(items).select("_row", ORDER, "product_id", "seller_id", "price").join(upper, "product_id", "left").join(zips, "seller_id", "left")
    zip_code = F.coalesce("seller_zip_code_prefix", F.lit(0))
    lines = lines.drop("product_id", "seller_id").repartition(ORDER)
    per_category = lines.groupBy(ORDER, F.coalesce("upper_category", F.lit(C.MISSING_CATEGORY)).alias("upper_category")).agg(
        F.sum("price").alias("price"), F.min("_row").alias("row"), F.min_by(zip_code, "_row").alias("zip"),
        F.count(F.lit(1)).alias("n"),
    )
    return per_category.groupBy(ORDER).agg(
        F.min_by("upper_category", F.struct(-F.col("price"), F.col("upper_category"))).alias("upper_category"),
        F.min_by("zip", "row").alias("seller_zip_code_prefix"),
        F.sum("n").alias("items"),
    )


def first_reviews(reviews: DataFrame) -> DataFrame:
    return first_per_key(with_row(reviews), ORDER, "_row", ["review_score"])


def first_payments(payments: DataFrame) -> DataFrame:
    return first_per_key(with_row(payments), ORDER, "_row", ["payment_value"])


def scored_orders(profile: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Profiles with their first review; a missing score takes the mean of the joined orders.

    The mean is taken over reviews and bare order ids, so it does not repeat the profile's joins. First
    reviews are read twice and written before that.
    """
    first = cut_lineage(first_reviews(reviews))
    mean = keep_matching(first, ORDER, items).agg(F.avg("review_score")).scalar()
    return profile.join(first, ORDER).withColumn("review_score", F.coalesce("review_score", mean))


def kept_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their person and zip, without the statuses left out; a null status stays."""
    kept = orders.where(~is_one_of("order_status", C.DROPPED_STATUSES)).select(ORDER, "customer_id", TIME)
    return kept.join(customers.select("customer_id", PERSON, "customer_zip_code_prefix"), "customer_id").drop("customer_id")


def order_dataset(
    items: DataFrame, product_upper: DataFrame, sellers: DataFrame, reviews: DataFrame, payments: DataFrame,
    orders: DataFrame, customers: DataFrame,
) -> DataFrame:
    """One row per kept order with category, seller zip, score and first payment."""
    profile = order_profile(items, product_upper, sellers).drop("items")
    scored = scored_orders(profile, items, reviews).join(first_payments(payments), ORDER)
    return scored.join(kept_orders(orders, customers), ORDER)


def with_order_counts(dataset: DataFrame) -> DataFrame:
    return dataset.join(dataset.groupBy(PERSON).agg(F.count(F.lit(1)).alias("order_count")), PERSON)


def split_people(dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders of people with one order and of people with several."""
    counted = with_order_counts(dataset)
    one = counted.where(F.col("order_count") == 1).drop("order_count")
    return one, counted.where(F.col("order_count") > 1).drop("order_count")


def one_order_rows(dataset: DataFrame, sessions: DataFrame) -> DataFrame:
    """Original orders of everyone who has not several sessions (sessions: of several-order people)."""
    repeated = sessions.groupBy(PERSON).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(PERSON)
    return dataset.join(repeated, PERSON, "left_anti")


def with_distance(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Distance in degrees between seller and customer zip; any unknown centroid makes it 0."""
    def places(side: str) -> DataFrame:
        return centroids.select(
            F.col("geolocation_zip_code_prefix").alias(f"{side}_zip_code_prefix"),
            F.col("lat_d_mean").alias(f"_{side}_lat"), F.col("lng_d_mean").alias(f"_{side}_lng"),
        )

    placed = rows.join(places("seller"), "seller_zip_code_prefix", "left").join(
        places("customer"), "customer_zip_code_prefix", "left"
    )
    distance = euclidean("_seller_lat", "_seller_lng", "_customer_lat", "_customer_lng")
    return placed.select(*rows.columns, F.coalesce(distance, F.lit(0.0)).alias("distance"))


def order_features(rows: DataFrame, centroids: DataFrame, today: Column) -> DataFrame:
    """The classifier's columns in alphabetical order: distance, log payment, score, age, category."""
    features = with_distance(rows, centroids).withColumns({
        "time_delta": whole_days(F.col(TIME), today),
        "payment_value": F.log10(F.when(F.col("payment_value") > 0, F.col("payment_value"))),
    })
    return features.select(
        PERSON, "distance", "payment_value", "review_score", "time_delta", "upper_category"
    )


def one_order_features(
    dataset: DataFrame, centroids: DataFrame, today: Column, parity: bool = False,
    category_order: Sequence[str] = S.CATEGORY_ORDER,
) -> DataFrame:
    """Features of the orders of people who bought once, counting orders of one session as once.

    ``dataset`` is read several times; pass a written table.
    """
    _, several = split_people(dataset)
    sessions = S.anchored_sessions(several, parity, category_order)
    return order_features(one_order_rows(dataset, sessions), centroids, today)


# --- order histories ---------------------------------------------------------------------------


def order_base(orders: DataFrame, customers: DataFrame, reviews: DataFrame, payments: DataFrame) -> DataFrame:
    """Kept orders with every review (an order with two reviews gives two rows), the mean where there
    is none, and the first payment. The mean is that of all kept orders, paid or not, so all are written first."""
    kept = kept_orders(orders, customers).drop("customer_zip_code_prefix")
    reviewed = kept.join(reviews.select(ORDER, "review_score"), ORDER, "left")
    reviewed = cut_lineage(reviewed.join(first_payments(payments).withColumn("_paid", F.lit(True)), ORDER, "left"))
    mean = reviewed.agg(F.avg("review_score")).scalar()
    return reviewed.where("_paid").drop("_paid").withColumn("review_score", F.coalesce("review_score", mean))


def prefixes(base: DataFrame, today: Column, whole: bool = False) -> DataFrame:
    """Features of every history prefix: one row per order, describing the orders up to it; ``whole`` keeps each person's last one.

    Everyone's history is split by hour: the running counts and sums are taken inside each hour, and what
    the earlier hours contribute is carried over from one row per hour. So no task takes a whole
    history, however long. ``base`` is read several times; pass a written table.
    """
    pieces = base.withColumn("_piece", F.date_trunc("HOUR", TIME))
    order = [F.col(TIME), F.col(ORDER), F.col("review_score")]
    inside = Window.partitionBy(PERSON, "_piece").orderBy(*order)
    piece = Window.partitionBy(PERSON, "_piece")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.select(
        PERSON, "_piece", ORDER, TIME, "review_score", "payment_value",
        F.row_number().over(inside).alias("_i"),
        F.count(F.lit(1)).over(piece).alias("_n"),
        F.lag(TIME).over(inside).alias("_previous"),
        F.min(TIME).over(piece).alias("_first"),
        F.sum("review_score").over(earlier).alias("_scores"),
        F.sum("payment_value").over(earlier).alias("_payments"),
    )
    if whole:  # a history ends with the last row of an hour, so only these are carried to
        local = local.where(F.col("_i") == F.col("_n"))
    per_piece = pieces.groupBy(PERSON, "_piece").agg(
        F.count(F.lit(1)).alias("n"), F.max(TIME).alias("last"), F.min(TIME).alias("first"),
        F.sum("review_score").alias("scores"), F.sum("payment_value").alias("payments"),
    )
    by_piece = Window.partitionBy(PERSON).orderBy("_piece")
    passed = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(PERSON)
    carry = per_piece.select(
        F.col(PERSON).alias("_who"), F.col("_piece").alias("_when"),
        F.sum("n").over(passed).alias("c_n"), F.max("last").over(passed).alias("c_last"),
        F.min("first").over(passed).alias("c_first"), F.sum("scores").over(passed).alias("c_scores"),
        F.sum("payments").over(passed).alias("c_payments"), F.sum("n").over(everything).alias("c_total"),
    )
    rows = local.join(carry, F.col(PERSON).eqNullSafe(F.col("_who")) & F.col("_piece").eqNullSafe(F.col("_when")), "left")

    def plus(carried: str, own: str) -> Column:
        return F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))

    count = plus("c_n", "_i")
    previous = F.coalesce("_previous", "c_last")
    first = F.coalesce("c_first", "_first")
    before = F.nullif(count - 1, F.lit(0))
    result = rows.select(
        PERSON, ORDER, TIME,
        count.alias("orders_count"),
        F.coalesce("c_total", "_n").alias("history_length"),
        F.col("review_score").alias("last_score"),
        F.col("payment_value").alias("last_payment"),
        whole_days(previous, F.col(TIME)).alias("last_days_between_orders"),
        (plus("c_scores", "_scores") / before).alias("mean_score"),
        (plus("c_payments", "_payments") / before).alias("mean_payment"),
        F.when(count > 2, whole_days(first, previous) / (count - 2)).alias("mean_days_between_orders"),
        whole_days(F.col(TIME), today).alias("days_after_order"),
    )
    return result.where(F.col("orders_count") == F.col("history_length")) if whole else result


def history_dataset(
    base: DataFrame, today: Column, expand: bool = True, keep_one_order: int | None = None,
    one_order_histories: bool = True, gone_after: int | None = C.GONE_AFTER_DAYS, seed: int = 1,
) -> DataFrame:
    """The training table: all prefixes or only whole histories, labelled 0 when the last order is
    ``gone_after`` or more days old. ``keep_one_order`` keeps that many one-order people.
    ``base`` is read several times; pass a written table, as ``order_base`` returns."""
    if keep_one_order is not None:
        base = cut_lineage(sample_one_order_people(base, keep_one_order, seed))
    rows = prefixes(base, today, whole=not expand)
    whole = F.col("orders_count") == F.col("history_length")
    if gone_after is not None:
        rows = rows.withColumn("retention", F.when(whole & (F.col("days_after_order") >= gone_after), 0).otherwise(1))
    if not one_order_histories:
        rows = rows.where(F.col("orders_count") > 1)
    return rows


def sample_one_order_people(base: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """Everyone with several rows and exactly ``size`` of the people with one."""
    people = base.groupBy(PERSON).agg(F.count(F.lit(1)).alias("n"))
    singles = people.where(F.col("n") == 1).select(PERSON)
    chosen = smallest_by_hash(singles, PERSON, F.lit(size), seed=seed)
    return base.join(people.where(F.col("n") > 1).select(PERSON).unionByName(chosen), PERSON, "left_semi")


def several_order_input(base: DataFrame, today: Column) -> DataFrame:
    """Whole histories of people with several rows, without a label."""
    return history_dataset(base, today, expand=False, one_order_histories=False, gone_after=None)


def one_order_input(base: DataFrame, today: Column) -> DataFrame:
    """Score, payment and age of people with one row."""
    single = with_order_counts(base).where(F.col("order_count") == 1)
    return single.select(PERSON, "review_score", "payment_value", whole_days(F.col(TIME), today).alias("days_after_order"))


def category_shares(rows: DataFrame) -> DataFrame:
    """Rows per category and their share."""
    counts = rows.groupBy("upper_category").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def order_gaps(orders: DataFrame) -> DataFrame:
    """Seconds since the same person's previous order. Histories are split by hour, as in ``prefixes``."""
    pieces = orders.select(PERSON, TIME, ORDER).withColumn("_piece", F.date_trunc("HOUR", TIME))
    inside = Window.partitionBy(PERSON, "_piece").orderBy(TIME, ORDER)
    passed = Window.partitionBy(PERSON).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        pieces.groupBy(PERSON, "_piece").agg(F.max(TIME).alias("last"))
        .select(F.col(PERSON).alias("_who"), F.col("_piece").alias("_when"), F.max("last").over(passed).alias("_carried"))
    )
    local = pieces.withColumn("_previous", F.lag(TIME).over(inside))
    rows = local.join(carry, F.col(PERSON).eqNullSafe(F.col("_who")) & F.col("_piece").eqNullSafe(F.col("_when")), "left")
    gap = F.timestamp_diff("SECOND", F.coalesce("_previous", "_carried"), F.col(TIME)).cast("double")
    return rows.select(PERSON, ORDER, gap.alias("gap")).where(F.col("gap").isNotNull())


def repeat_knots(orders: DataFrame, knots: int = 28) -> DataFrame:
    """A repeat-purchase table from the data: gap lengths at evenly spaced shares."""
    shares = [i / (knots - 1) for i in range(knots)]
    table = exact_quantiles(order_gaps(orders), "gap", shares)
    pairs = F.arrays_zip(F.lit(shares).alias("share"), F.col("q").alias("seconds"))
    return table.select(F.inline(pairs)).toDF("share", "seconds")
