"""Exact quantiles, running totals and hash samples that no single task has to see whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.functions.expressions import draw
from patronlens.session import cut_lineage

#: Parts a bracket is cut into while it holds too many values.
PARTS = 64


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    accuracy: int = 10_000,
    alias: str = "q",
) -> DataFrame:
    """Exact linear-interpolated quantiles per key: ``keys``, ``n`` and the array ``alias``.

    A mergeable sketch first brackets every wanted rank. Values outside the brackets are then only
    counted, values inside are counted per distinct value. While a bracket may hold more than
    ``10 * accuracy`` different values it is cut into ``PARTS`` parts, the parts are counted, and the part with the
    rank is the new bracket; every round reads only what the last one left. The ranks are read off the
    running count of what remains, so no window task sees more than ``10 * accuracy`` rows for a rank. Groups up to that size
    need no sketch. A rank outside its first bracket would be an error in the sketch and raises instead
    of giving a wrong number.
    """
    keys, bound = list(keys), 10 * accuracy
    margin = 4.0 / accuracy
    cuts = [min(max(p + sign * margin, 0.0), 1.0) for p in probs for sign in (-1, 1)]
    # Without keys all rows have one, a constant; it is never shuffled on before rows are counted.
    names = [f"_k{i}" for i in range(len(keys))] or ["_k"]
    named = [F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("_k")]
    rows = df.where(F.col(value).isNotNull()).select(*named, F.col(value).cast("double").alias("_v"))
    sketch = cut_lineage(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.expr(
        f"IF(count(1) > {bound}, percentile_approx(_v, array({', '.join(f'{c!r}D' for c in cuts)}), {accuracy}), NULL)"
    ).alias("_cuts")))
    if keys:
        rows = _joined(rows, sketch, names)
    else:
        rows = rows.withColumns({c: sketch.select(c).scalar() for c in ("_n", "_cuts")})

    # A value outside every bracket is stored under the last bracket end below it (null: below all).
    inside = " OR ".join(f"_v BETWEEN _cuts[{2 * i}] AND _cuts[{2 * i + 1}]" for i in range(len(probs)))
    marked = rows.withColumn("_gap", F.expr(f"NOT (_cuts IS NULL OR {inside})"))
    stored = F.expr("IF(_gap, array_max(filter(_cuts, c -> c < _v)), _v)")
    histogram = marked.groupBy(*names, stored.alias("_v"), "_gap").agg(F.count(F.lit(1)).alias("_c"))
    largest = sketch.agg(F.max("_n")).first()[0] or 0
    if largest > bound and 2 * margin * len(probs) * largest > bound:
        picked = _picked_apart(cut_lineage(histogram), sketch, probs, names, bound)
    else:
        picked = _picked(histogram, probs, names)
    at = "IF({0}._gap, CAST(raise_error('quantile rank outside its bracket; raise accuracy') AS DOUBLE), {0}._v)"
    between = "{low} + ({high} - {low}) * ((_n - 1) * {p!r}D - floor((_n - 1) * {p!r}D))"
    results = [
        F.expr(between.format(low=at.format(f"_floor{i}"), high=at.format(f"_ceil{i}"), p=float(p)))
        for i, p in enumerate(probs)
    ]
    return picked.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("_n").alias("n"), F.array(*results).alias(alias))


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """An inner join on ``names`` in which null matches null."""
    renamed = right.withColumnsRenamed({n: f"{n}_right" for n in names})
    joined = left.join(renamed, [F.col(n).eqNullSafe(F.col(f"{n}_right")) for n in names], "inner")
    return joined.drop(*[f"{n}_right" for n in names])


def _picked(histogram: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``names``, ``_n`` and the histogram rows at both ranks of every probability, from one running count per key."""
    upto = (
        Window.partitionBy(*names).orderBy(F.col("_v").asc_nulls_first(), "_gap")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = histogram.withColumns({"_cum": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(*names))})
    hit = "min(IF(_cum > {end}((_n - 1) * {p!r}D), struct(_cum, _gap, _v), NULL)) AS _{end}{i}"
    return ranked.groupBy(*names).agg(F.max("_n").alias("_n"), *[
        F.expr(hit.format(end=end, p=float(p), i=i)) for i, p in enumerate(probs) for end in ("floor", "ceil")
    ])


def narrowed(bracket: DataFrame, keys: Sequence[str], bound: int) -> DataFrame:
    """The rows of ``bracket`` (``keys``, ``_low``, ``_high``, ``_v``, ``_c``) that hold the ranks, at most ``bound`` or so per key.

    ``_low`` and ``_high`` are two neighbouring ranks counted from the start of the bracket; they move with it.
    """
    parts = ", ".join(f"{i / PARTS!r}D" for i in range(1, PARTS))
    while True:
        marks = cut_lineage(bracket.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.expr(f"percentile_approx(_v, array({parts}), {20 * PARTS})").alias("_marks")))
        if (marks.agg(F.max("_rows")).first()[0] or 0) <= bound:
            return bracket
        held = _joined(bracket, marks, keys).withColumn("_marks", F.when(F.col("_rows") > bound, F.array_distinct("_marks")))
        held = held.withColumn("_part", F.coalesce(F.size(F.filter("_marks", lambda m: m < F.col("_v"))), F.lit(0))).drop("_marks", "_rows")
        counted = held.groupBy(*keys, "_part", "_low", "_high").agg(F.sum("_c").alias("_in"))
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        wanted = counted.where((F.col("_before") <= F.col("_high")) & (F.col("_before") + F.col("_in") > F.col("_low")))
        # Neighbouring ranks may lie in two parts; both stay, counted from the first one's start.
        first = Window.partitionBy(*keys)
        wanted = wanted.withColumn("_start", F.min("_before").over(first)).select(*keys, "_part", "_start")
        bracket = _joined(held, wanted, [*keys, "_part"])
        bracket = cut_lineage(bracket.select(*keys, (F.col("_low") - F.col("_start")).alias("_low"), (F.col("_high") - F.col("_start")).alias("_high"), "_v", "_c"))


def _picked_apart(histogram: DataFrame, sketch: DataFrame, probs: Sequence[float], names: Sequence[str], bound: int) -> DataFrame:
    """As ``_picked``, with every rank's bracket narrowed by itself before its values are ranked."""
    rank = "{end}((_n - 1) * element_at(array({all}), _i))"
    wanted = sketch.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(len(probs)))))
    share = ", ".join(f"{float(p)!r}D" for p in probs)
    wanted = wanted.select(
        *names, "_n", "_i", F.expr("_cuts[2 * _i - 2]").alias("_from"), F.expr("_cuts[2 * _i - 1]").alias("_to"),
        *[F.expr(rank.format(end=end, all=share)).cast("long").alias(f"_{name}") for end, name in (("floor", "low"), ("ceil", "high"))],
    )
    held = _joined(histogram, wanted, names)
    # Without a bracket (a small group) all values are inside.
    ahead = held.groupBy(*names, "_i").agg(F.sum(F.expr("IF(_from IS NOT NULL AND (_v IS NULL OR _v < _from), _c, 0)")).alias("_ahead"))
    inside = held.where(F.expr("NOT _gap AND (_from IS NULL OR _v BETWEEN _from AND _to)"))
    inside = _joined(inside, ahead, [*names, "_i"])
    moved = [(F.col(c) - F.col("_ahead")).alias(c) for c in ("_low", "_high")]
    keys = [*names, "_i"]
    left = narrowed(cut_lineage(inside.select(*keys, *moved, "_v", "_c")), keys, bound)
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = left.withColumn("_cum", F.sum("_c").over(upto))
    found = ranked.groupBy(*keys).agg(*[
        F.expr(f"IF(min(_{r}) < 0, NULL, min(IF(_cum > _{r}, _v, NULL)))").alias(f"_at_{r}") for r in ("low", "high")
    ])
    at = "max(IF(_i = {i}, struct(_at_{r} IS NULL AS _gap, _at_{r} AS _v), NULL)) AS _{end}{j}"
    picked = found.groupBy(*names).agg(*[
        F.expr(at.format(i=i + 1, r=r, end=end, j=i)) for i in range(len(probs)) for end, r in (("floor", "low"), ("ceil", "high"))
    ])
    return _joined(picked, sketch.select(*names, "_n"), names)


def running_total(df: DataFrame, amount: str, tie: str, alias: str) -> DataFrame:
    """``df`` with the running sum of ``amount`` from the largest row down, ties by ``tie``.

    Rows are ranked inside magnitude bands (sixteen per power of two), bands among themselves. Only
    the band totals meet in one task, and their number is bounded by the range of a double.
    """
    size = F.floor(F.log2(F.abs(F.col(amount))) * 16)
    band = F.when(F.col(amount) > 0, size + 100_000).when(F.col(amount) < 0, -size - 100_000).otherwise(0)
    rows = df.withColumn("_band", band.cast("int"))
    totals = rows.groupBy("_band").agg(F.sum(amount).alias("_sum"))
    ahead = Window.orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_band", F.coalesce(F.sum("_sum").over(ahead), F.lit(0.0)).alias("_ahead"))
    within = (
        Window.partitionBy("_band")
        .orderBy(F.col(amount).desc(), tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_within", F.sum(amount).over(within))
    return rows.join(totals, "_band").withColumn(alias, F.col("_ahead") + F.col("_within")).drop("_band", "_ahead", "_within")


def smallest_by_hash(
    df: DataFrame, id_col: str, keep: Column, strata: Sequence[str] = (), seed: int = 1
) -> DataFrame:
    """Exactly ``keep`` rows per stratum, those with the smallest seeded hash of ``id_col``.

    ``keep`` may use ``_size``, the stratum's row count. Rows are counted per 16-bit hash prefix,
    which says for every prefix whether it is in, out or cut through; only the one cut prefix of a
    stratum (1/65,536 of it) is sorted.
    """
    strata = list(strata)
    rows = df.withColumn("_hash", draw(F.col(id_col), seed))
    rows = rows.withColumn("_prefix", F.shiftright("_hash", 44))
    counts = rows.groupBy(*strata, "_prefix").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*strata).orderBy("_prefix")
    counts = (
        counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_size", F.sum("_c").over(Window.partitionBy(*strata)))
        .withColumn("_left", keep - (F.col("_upto") - F.col("_c")))
        .where(F.col("_left") > 0)
        .select(
            *[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)],
            F.col("_prefix").alias("_p"), "_c", "_left",
        )
    )
    same = [F.col("_prefix") == F.col("_p")] + [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)]
    rows = rows.join(counts, same, "inner")
    whole = rows.where(F.col("_c") <= F.col("_left"))
    rank = F.row_number().over(Window.partitionBy(*strata, "_prefix").orderBy("_hash", id_col))
    cut = rows.where(F.col("_c") > F.col("_left")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left"))
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))
