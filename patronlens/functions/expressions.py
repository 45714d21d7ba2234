"""Column expressions used in more than one operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_days(start: Column, end: Column) -> Column:
    """Completed 24-hour units from ``start`` to ``end``, rounded down (not a calendar difference)."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def draw(value: Column, seed: int) -> Column:
    """A number from 0 to 2^60 that depends on the text of ``value`` and the seed alone: 60 bits of md5 of ``seed:value``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), value.cast("string"))), 1, 15), 16, 10).cast("long")


def span_days(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end`` as a fraction, counted in whole seconds."""
    return F.timestamp_diff("SECOND", start, end) / F.lit(86_400.0)


def month_index(moment: Column) -> Column:
    """Months since year zero, so that a month difference is a subtraction."""
    return (F.year(moment) * 12 + F.month(moment) - 1).cast("int")


def month_label(index: Column) -> Column:
    """``yyyy-MM`` for a ``month_index``."""
    return F.concat(
        F.lpad((F.floor(index / F.lit(12))).cast("string"), 4, "0"),
        F.lit("-"),
        F.lpad((index % 12 + 1).cast("string"), 2, "0"),
    )


def any_null(columns: Sequence[str]) -> Column:
    test = F.lit(False)
    for name in columns:
        test = test | F.col(name).isNull()
    return test


def is_one_of(column: str, values: Sequence) -> Column:
    """Membership test that is false, not null, for a null value."""
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def euclidean(lat_a: str, lng_a: str, lat_b: str, lng_b: str) -> Column:
    return F.sqrt(F.pow(F.col(lat_a) - F.col(lat_b), 2) + F.pow(F.col(lng_a) - F.col(lng_b), 2))
