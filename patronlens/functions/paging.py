"""Pages of a large sorted table without sorting what lies before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges a table is counted in at a time, and rows that are few enough to be sorted for a page.
RANGES, SORTED = 1000, 10_000
#: Bytes of a text that one number holds in order.
CHUNK = 6

Order = str | tuple[str, bool]


def _direction(order: Sequence[Order]) -> list[tuple[str, bool]]:
    return [(o, False) if isinstance(o, str) else o for o in order]


def sorting(order: Sequence[Order]) -> list[Column]:
    """Sort columns of names and (name, descending) pairs; nulls come first, or last when descending."""
    return [F.col(f"`{name}`").desc() if down else F.col(f"`{name}`").asc() for name, down in _direction(order)]


def _numbers(df: DataFrame, name: str, down: bool) -> list[Column]:
    """Doubles that never fall along the sort order of a column; a text has one for every ``CHUNK`` bytes of its start."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        code = F.encode(column, "UTF-8")
        chunks = [F.conv(F.rpad(F.hex(F.substring(code, 1 + CHUNK * i, CHUNK)), 2 * CHUNK, "0"), 16, 10).cast("double") for i in range(4)]
    elif isinstance(kind, T.TimestampNTZType):
        chunks = [F.unix_micros(column.cast("timestamp")).cast("double")]
    elif isinstance(kind, T.TimestampType):
        chunks = [F.unix_micros(column).cast("double")]
    elif isinstance(kind, T.DateType):
        chunks = [F.unix_date(column).cast("double")]
    elif isinstance(kind, T.NumericType | T.BooleanType):
        chunks = [F.when(F.isnan(column.cast("double")), F.lit(float("inf"))).otherwise(column.cast("double"))]
    else:
        return []
    low, sign = F.lit(float("-inf")), -1.0 if down else 1.0
    return [F.coalesce(c, low) * sign for c in chunks]


def _range_counts(df: DataFrame, key: Column, ranges: int) -> tuple[list[float], list[int]]:
    """At most ``ranges`` values of ``key`` and the rows below the first, equal to it, between it and the second, and so on."""
    shares = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    keyed = df.select(key.alias("_key"))
    ends = sorted(set(keyed.agg(F.expr(f"percentile_approx(_key, array({shares}), {4 * ranges})")).first()[0] or []))
    marks = F.array(*[F.lit(e) for e in ends]).cast("array<double>")
    part = 2 * F.size(F.filter(marks, lambda e: e < F.col("_key"))) + F.array_contains(marks, F.col("_key")).cast("int")
    counted = {r["_part"]: r["n"] for r in keyed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return ends, [counted.get(i, 0) for i in range(2 * len(ends) + 1)]


def _between(key: Column, ends: list[float], first: int, last: int) -> Column:
    """The parts ``first`` to ``last`` of ``_range_counts`` as a condition; odd parts are single values."""
    inside = F.lit(True)
    if first % 2:
        inside = inside & (key >= F.lit(ends[first // 2]))
    elif first:
        inside = inside & (key > F.lit(ends[first // 2 - 1]))
    if last % 2:
        inside = inside & (key <= F.lit(ends[last // 2]))
    elif last < 2 * len(ends):
        inside = inside & (key < F.lit(ends[last // 2]))
    return inside


def _stretch(df: DataFrame, keys: list[tuple[Column, str]], order: list[Column], start: int, size: int, ranges: int, bound: int) -> list[DataFrame]:
    """The rows at ``start`` and the ``size - 1`` places after it, in one or several pieces."""
    if not keys:
        return [df.orderBy(*order).offset(start).limit(size)]
    key, name = keys[0]
    ends, counts = _range_counts(df, key, ranges)
    if sum(counts) <= bound:
        return [df.orderBy(*order).offset(start).limit(size)] if start < sum(counts) else []
    runs: list[list[int]] = []  # first part, last part, rows before, rows
    before = 0
    for part, n in enumerate(counts):
        if n and before < start + size and before + n > start:
            if runs and runs[-1][3] + n <= bound:
                runs[-1][1], runs[-1][3] = part, runs[-1][3] + n
            else:
                runs.append([part, part, before, n])
        before += n
    pieces = []
    for first, last, ahead, n in runs:
        inside, skip = df.where(_between(key, ends, first, last)), max(0, start - ahead)
        take = min(size, start + size - ahead - skip)
        if n <= bound:
            pieces.append(inside.orderBy(*order).offset(skip).limit(take))
            continue
        rest = keys[first % 2:]  # rows of one key are told apart by the next one
        if first % 2 and rest and rest[0][1] != name and inside.select(f"`{name}`").distinct().limit(2).count() > 1:
            rest = []  # the numbers do not tell all values of the column apart
        pieces += _stretch(inside, rest, order, skip, take, ranges, bound)
    return pieces


def page(df: DataFrame, order: Sequence[Order], number: int = 0, size: int = 20, ranges: int = RANGES, bound: int = SORTED) -> DataFrame:
    """Page ``number`` of ``df`` in a total ``order`` of names and (name, descending) pairs; empty beyond the end.

    The rows are counted per range of the first column, running totals say in which ranges the page
    lies, and only these are looked at again, range by range and, where one value is too common, column by column,
    until at most ``bound`` rows are left, or rows that numbers do not tell apart: long texts of one start. Those are
    sorted. Only ends and counts of ranges come to the driver, and no task keeps the rows before a page.
    """
    keys: list[tuple[Column, str]] = []
    for name, down in _direction(order):
        own = _numbers(df, name, down)
        if not own:
            break
        keys += [(key, name) for key in own]
    pieces = _stretch(df, keys, sorting(order), number * size, size, ranges, bound)
    if not pieces:
        return df.limit(0)
    result = pieces[0]
    for piece in pieces[1:]:
        result = result.unionByName(piece)
    return result.orderBy(*sorting(order))
