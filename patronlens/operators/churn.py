"""Churn labels from a Poisson model of the order rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.functions.expressions import span_days, whole_days
from patronlens.operators.sessions import PERSON, TIME

SHORT_SPAN = 0.333


def _spans(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(PERSON, "upper_category").agg(
        F.count(F.lit(1)).alias("n"), F.min(TIME).alias("low"), F.max(TIME).alias("high")
    )


def _gaps(repeated: DataFrame) -> DataFrame:
    """Mean gap in days per person and category, for people with fewer than four sessions."""
    spans = _spans(repeated.where(F.col("count") < 4)).withColumn("days", span_days(F.col("low"), F.col("high")))
    usable = spans.where((F.col("n") > 1) & (F.col("days") > SHORT_SPAN))
    return usable.select("upper_category", (F.col("days") / (F.col("n") - 1)).alias("gap"))


def category_rates(repeated: DataFrame) -> DataFrame:
    """Orders per day and category. A category without repeat sessions has no row."""
    return _gaps(repeated).groupBy("upper_category").agg((F.count(F.lit(1)) / F.sum("gap")).alias("rate"))


def overall_rate(repeated: DataFrame) -> Column:
    return _gaps(repeated).agg(F.count(F.lit(1)) / F.nullif(F.sum("gap"), F.lit(0.0))).scalar()


def thrice_same(repeated: DataFrame) -> DataFrame:
    """Number of people whose most frequent category occurs exactly three times."""
    return repeated.where(F.col("same") == 3).agg(F.countDistinct(PERSON).alias("people"))


def poisson_labels(repeated: DataFrame, today: Column, low: float = C.GONE_BELOW) -> DataFrame:
    """Rate, chance of having stayed and class (0 gone, 1 active, null without a rate) per person with several sessions.

    More than three sessions in one category: that category's own rate. Otherwise the rate of the
    dominant category, or the mean over all categories of someone who never repeated one. People
    and categories meet once; from there on there is one row per person.
    """
    spans = _spans(repeated).join(category_rates(repeated), "upper_category", "left")
    dominant = F.min_by(F.struct("n", "low", "high", "rate"), F.struct(-F.col("n"), F.col("upper_category")))
    people = spans.groupBy(PERSON).agg(
        dominant.alias("top"), F.avg("rate").alias("mean_rate"), F.max("high").alias("last")
    )
    top = F.col("top")
    own = (top["n"] - 1) / F.nullif(whole_days(top["low"], top["high"]), F.lit(0))
    rate = (
        F.when(top["n"] > 3, own)
        .when(top["n"] > 1, F.coalesce(top["rate"], overall_rate(repeated)))
        .otherwise(F.coalesce("mean_rate", overall_rate(repeated)))
    )
    valued = people.select(F.col(PERSON).alias("id"), rate.alias("lambda"), whole_days(F.col("last"), today).alias("days"))
    valued = valued.withColumn("val", F.exp(-F.col("lambda") * F.col("days")))
    return valued.select("id", "lambda", "val", F.when(F.col("val") < low, 0).when(F.col("val").isNotNull(), 1).alias("class"))


def class_counts(labels: DataFrame, column: str = "class") -> DataFrame:
    return labels.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def fixed_label(days: Column, gone_after: int = C.GONE_AFTER_DAYS) -> Column:
    return F.when(days >= gone_after, 0).otherwise(1)
