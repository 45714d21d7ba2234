"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words by weight, never more than ``limit`` times its own words; what
it cannot take is shared again by weight among the others. Each document of a source then expects
target / source words copies. The documents stand in order of size (then of a hash of the id), the
expected copies are summed along that order from one offset per source, and a document is emitted
once per whole number its step crosses. So every document gets the rounded-down or rounded-up number
of copies, and because sizes are in order the words taken differ from the target by little more than
the largest document.

The running sum is a rank times a constant, and ranks are built from counts: sizes of a source,
hash buckets of a size, documents of a bucket. No window sees more than one of these levels, so a
source with a third of all rows, or a group of copies of one size, is spread over all tasks.

Defined cases: null text has size 0, as has one of white space; such documents may be repeated but
take nothing. A null source is a source, the last in order. Rows that agree in id, source and size are
copied alike. An empty table gives an empty table. Other columns pass through unless they bear a
result's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.llm.common import unused
from patronlens.session import cut_lineage

WEIGHTS = (1, 2, 3)
LIMIT = 3
BUCKETS = 1024
RESULTS = ["size", "source_size", "target", "copies", "taken"]
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(value: Column) -> Column:
    """A number in [0, 1) from 48 bits of md5."""
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit("~"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target from (source, size) rows.

    Works on one row per source. A source is capped when its limit per weight is among the lowest;
    walking up that order, the level is what the capped leave divided by the remaining weight. It rises
    up to the first source whose limit reaches it and falls behind, so it is the highest level that a source reaches.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    totals = totals.withColumn("level", level)
    final = F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything)
    return totals.withColumn("final", final).select("source", "source_size", F.least(F.col("cap"), F.col("final") * F.col("weight")).alias("target"))


def with_rank(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Distinct ``rows`` (source, size, doc_id) and ``_rank``, 1 upwards in each source by size, then hash of the id."""
    rows = rows.withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))))
    rows = rows.withColumn("_bucket", F.conv(F.substring("_hash", 1, 6), 16, 10).cast("int") % buckets)
    rows = rows.withColumn("_within", F.row_number().over(Window.partitionBy("source", "size", "_bucket").orderBy("_hash", "doc_id")))
    cells = rows.groupBy("source", "size", "_bucket").agg(F.max("_within").alias("n"))
    in_size = Window.partitionBy("source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("smaller"))
    cells = cells.join(sizes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    cells = cells.select("_s", "_z", F.col("_bucket").alias("_b"), (F.col("ahead") + F.col("smaller")).alias("_offset"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_bucket") == F.col("_b"))
    ranked = rows.join(cells, same).withColumn("_rank", F.col("_within") + F.col("_offset"))
    return ranked.drop("_hash", "_bucket", "_within", "_offset", "_s", "_z", "_b")


def plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and ``rows``, the number of such rows in ``documents``.

    Rows that agree in id, source and size are copied alike and stand as one row here.
    """
    groups = cut_lineage(
        documents.select("doc_id", "source", size_of(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    )
    targets = source_targets(groups.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, limit)
    targets = targets.withColumn("_step", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    targets = targets.withColumn("_begin", unit_hash(F.col("source"))).withColumnRenamed("source", "_source")
    ranked = with_rank(groups).join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    upto = lambda rank: F.floor(F.col("_begin") + F.col("_step") * rank)
    copies = (upto(F.col("_rank")) - upto(F.col("_rank") - 1)).cast("int")
    planned = ranked.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return planned.drop("_step", "_begin", "_rank")


def mixture(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """The mixed corpus: every row of ``documents`` as often as it is copied, columns as they are."""
    own = unused(documents, "in_doc", "in_source", "in_size", "copies", "copy")
    copied = plan(documents, weights, limit).where("copies > 0").select("doc_id", "source", "size", "copies").toDF(*own[:4])
    doc, source, size, copies = (F.col(c) for c in own[:4])
    same = F.col("doc_id").eqNullSafe(doc) & F.col("source").eqNullSafe(source) & (size_of(F.col("text")) == size)
    return documents.join(copied, same).withColumn(own[4], F.explode(F.sequence(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in documents.columns])
