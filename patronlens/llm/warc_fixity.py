"""Fixity audit of replicated WARC archives by Merkle trees.

A leaf is the SHA-256 of a record with its offset and length. The records that start in one
``RANGE`` of offsets make a node, sixteen neighbouring nodes make the next, up to the archive and the
collection. Two replicas are compared from the root down, and only below nodes that differ is the
next level looked at. The records of the differing ranges are matched by archive, id and digest, so one that merely stands
elsewhere because another before it grew is no damage; what is left is changed, missing or
extra. A node has a bounded number of children, so no task grows with an archive; damaged records of one repeated id meet in one task.

Defined cases: null payloads are empty; null record ids and URLs are allowed, archives and offsets must
not be null; records of a repeated id are paired in order; equal rows of a replica are several equal leaves, and those too many or too few are
extra or missing; two empty replicas differ nowhere; one empty replica makes all records of the other missing or
extra. Other columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.session import cut_lineage

RANGE = 1 << 16
FAN_OUT = 16
RECORDS_PER_ARCHIVE = 512
RECORDS = ["archive", "record_id", "offset", "length", "digest"]


def record_bytes(record_id: Column, url: Column, payload: Column) -> Column:
    """A WARC response record as text: header lines, an empty line, the payload and two line ends."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archived(pages: DataFrame, per_archive: int = RECORDS_PER_ARCHIVE) -> DataFrame:
    """The manifest of the pages' archives: archive, record_id, offset, length, digest and the page's url.

    An archive holds the records of ``per_archive`` consecutive page ids (all null ids form one); its offsets add up
    the lengths of the records before. Only lengths and digests are shuffled.
    """
    record = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / F.lit(per_archive)), F.lit(-1)).cast("long").alias("archive"),
        F.col("page_id").cast("long").alias("record_id"), "url", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"),
    )
    before = Window.partitionBy("archive").orderBy("record_id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))


def leaves(replica: DataFrame) -> DataFrame:
    """One row per archive and offset: its range, the number of records there and the hash of all of them."""
    leaf = F.concat_ws(":", F.col("offset"), F.col("length"), "digest", F.coalesce(F.col("record_id").cast("string"), F.lit("~")))
    grouped = replica.groupBy("archive", "offset").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), "|"), 256).alias("hash"),
        F.min("record_id").alias("record_id"), F.max("length").alias("length"), F.min("digest").alias("digest"),
    )
    return grouped.withColumn("range", F.floor(F.col("offset") / F.lit(RANGE)).cast("long"))


def parents(nodes: DataFrame, order: str, divisor: int) -> DataFrame:
    """The next level: archive, range, and the hash of the children's places and hashes in order."""
    children = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("hash").alias("h"))))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["at"], c["h"])), "|")
    key = F.floor(F.col(order) / F.lit(divisor)).cast("long").alias("range")
    return nodes.groupBy("archive", key).agg(F.sha2(text, 256).alias("hash"))


def tree(replica_leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of nodes from single ranges up to one node per archive."""
    built = [parents(replica_leaves, "offset", RANGE)]
    for _ in range(levels):
        built.append(parents(built[-1], "range", FAN_OUT))
    return [cut_lineage(level) for level in built]


def differing(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that only one side has."""
    other = theirs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("hash").alias("_hash"))
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in keys])
    joined = ours.select(*keys, "hash").join(other, same, "full_outer").where(~F.col("hash").eqNullSafe(F.col("_hash")))
    return joined.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys])


def below(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """The nodes whose parent is in ``changed``."""
    marks = changed.select(F.col("archive").alias("_a"), F.col("range").alias("_r"))
    return nodes.join(marks, (F.col("archive") == F.col("_a")) & (F.floor(F.col("range") / F.lit(FAN_OUT)) == F.col("_r")), "left_semi")


def records_below(replica: DataFrame, marks: DataFrame) -> DataFrame:
    """The records that start in one of the marked ranges."""
    place = F.floor(F.col("offset") / F.lit(RANGE)).cast("long")
    return replica.join(marks, (F.col("archive") == F.col("_a")) & (place == F.col("_r")), "left_semi")


def unmatched(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """What is left of both sides when records of one archive, id, length and digest are taken off against each other, paired by id.

    Records that merely stand at another offset cancel out. The rest of an id (without one, of an offset) is paired in order of offsets.
    """
    sides = ours.withColumn("side", F.lit(1)).unionByName(theirs.withColumn("side", F.lit(-1)))
    at = lambda side: F.min(F.when(F.col("side") == side, F.col("offset")))
    left = sides.groupBy("archive", "record_id", "length", "digest").agg(F.sum("side").alias("surplus"), at(1).alias("first"), at(-1).alias("second")).where("surplus <> 0")
    left = left.select(
        "archive", "record_id", "length", "digest", F.signum("surplus").cast("int").alias("side"), F.when(F.col("surplus") > 0, F.col("first")).otherwise(F.col("second")).alias("offset"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.abs("surplus"))).alias("copy"),
    )
    pair = F.coalesce(F.concat(F.lit("id "), F.col("record_id").cast("string")), F.concat(F.lit("at "), F.col("offset").cast("string")))
    left = left.withColumn("pair", pair)
    left = cut_lineage(left.withColumn("rank", F.row_number().over(Window.partitionBy("archive", "pair", "side").orderBy("offset", "length", "digest", "copy"))))
    a, b = left.where("side = 1"), left.where("side = -1")
    b = b.select(*[F.col(c).alias(f"their_{c}") for c in ("archive", "pair", "rank", "offset", "record_id", "length", "digest")])
    same = (F.col("archive") == F.col("their_archive")) & (F.col("pair") == F.col("their_pair")) & (F.col("rank") == F.col("their_rank"))
    found = a.join(b, same, "full_outer")
    status = F.when(F.col("their_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return found.select(
        *[F.coalesce(c, f"their_{c}").alias(c) for c in ("archive", "offset", "record_id")], status.alias("status"), "length", "their_length", "digest", "their_digest",
    )


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records in which two replicas (archive, record_id, offset, length, digest) differ.

    Returns archive, offset (ours, or theirs of an extra record), record_id, status (``changed``, ``missing`` in theirs, ``extra`` in theirs) and both lengths and digests.
    """
    ours, theirs = (cut_lineage(side.select(*RECORDS)) for side in (ours, theirs))
    mine, other = (cut_lineage(leaves(side)) for side in (ours, theirs))
    last = max((r[0] or 0) for side in (mine, other) for r in side.agg(F.max("range")).collect())
    levels = 0
    while FAN_OUT**levels <= last:
        levels += 1
    my_tree, other_tree = tree(mine, levels), tree(other, levels)
    roots = [cut_lineage(parents(t[-1].groupBy(F.col("archive").alias("range")).agg(F.max("hash").alias("hash")).withColumn("archive", F.lit(0)), "range", 1 << 10)) for t in (my_tree, other_tree)]
    groups = differing(*roots, ["range"]).select(F.col("range").alias("_group"))
    tops = [t[-1].join(groups, F.floor(F.col("archive") / F.lit(1 << 10)) == F.col("_group"), "left_semi") for t in (my_tree, other_tree)]
    changed = cut_lineage(differing(*tops, ["archive", "range"]))
    for level in range(levels - 1, -1, -1):
        changed = cut_lineage(differing(below(my_tree[level], changed), below(other_tree[level], changed), ["archive", "range"]))
    marks = changed.select(F.col("archive").alias("_a"), F.col("range").alias("_r"))
    return unmatched(*(records_below(side, marks) for side in (ours, theirs)))
