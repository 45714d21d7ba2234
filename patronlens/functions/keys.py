"""Joins and first-per-key picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_matching(left: DataFrame, column: str, right: DataFrame, right_column: str | None = None) -> DataFrame:
    """Rows of ``left`` whose ``column`` occurs in ``right``; null matches null.

    The right side is reduced to its distinct keys first. That reduction starts inside the map
    tasks, so a key holding a large share of the right rows reaches the join as one row.
    """
    keys = right.select(F.col(right_column or column).alias("_member")).distinct()
    return left.join(keys, F.col(column).eqNullSafe(F.col("_member")), "left_semi")


def first_per_key(df: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """``values`` of the row with the smallest ``order`` per ``key``; ``order`` is unique within a key.

    ``min_by`` over numbers is a hash aggregation combined in the map tasks: neither a ranking
    window nor a sort of all rows.
    """
    return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in values])


def most_common(df: DataFrame, keys: Sequence[str], value: str, alias: str, weight: Column | None = None) -> DataFrame:
    """Most frequent non-null ``value`` per key; a tie goes to the smallest value."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    )
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(alias))


def with_row(df: DataFrame, row: str = "_row") -> DataFrame:
    """``df`` with an order of its rows: the saved index where there is one, else a hash of the row's values."""
    return df if row in df.columns else df.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
