"""How document filters overlap: what each removes in every order, alone, and on average over all orders.

Five filters: A short, B repetitive, C shouting, D markup characters, E a text that a smaller id has too.
A to D are decided by a document's own text. E needs the whole table, and is found in three steps:

1. Every text's hash sets three counters in one block of a counting Bloom sketch. Tasks count for
   themselves, their sketches are added up, and only counters of two or more are kept, packed as bits.
2. A text with a counter of one is surely alone. Only the others, possible repeats, are shuffled with
   their whole text for the smallest id; the texts of one task that agree travel once.
3. The ids that come back are the first of their text; a possible repeat that is not among them fails E.

A sketch has at most ``MAX_BLOCKS`` rows of two longs (about 16 MB), so it may be broadcast. From some
four million documents on it is fuller, and more lone texts take the exact way of step 2; no result changes.

The flags of a document are five bits. Documents are counted per part and mask, and all orders follow from
these at most 32 rows a part: a filter after others removes the masks that hold its bit and none of theirs.

Defined cases: null text is empty, and empty texts repeat each other; a null id neither fails E nor makes
another fail; rows of one id and text do not make each other fail; several label rows of one document
count if any of them says so; a null part is the empty string; an empty table gives an empty table. Other
columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.session import cut_lineage

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
GAP = r"[\x20\x09-\x0D]+"
MARKUP = r"[#$%&*|]"

#: A block has three groups of counters and a text one counter in each.
GROUPS, GROUP_COUNTERS, TEXTS_PER_BLOCK, MAX_BLOCKS = 3, 21, 4, 1 << 20
RESULTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def own_failures(text: Column) -> Column:
    """The bits of the filters that a text alone decides."""
    words = F.array_remove(F.split(text, GAP), "")
    fails = {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_UPPER_PERCENT * F.length(text),
        "D": text.rlike(MARKUP),
    }
    return sum((F.when(fail, BIT[f]).otherwise(0) for f, fail in fails.items()), F.lit(0))


def blocks_for(n_texts: int) -> int:
    """A power of two with about ``TEXTS_PER_BLOCK`` texts a block, at most ``MAX_BLOCKS``."""
    return min(MAX_BLOCKS, 1 << max(0, (max(1, n_texts) // TEXTS_PER_BLOCK).bit_length()))


def _counters(key: Column) -> list[Column]:
    """The places of a text's counters in its block, from bits that do not choose the block."""
    return [(F.pmod(F.shiftrightunsigned(key, 22 + 14 * g), F.lit(GROUP_COUNTERS)) + GROUP_COUNTERS * g).cast("int") for g in range(GROUPS)]


def _block(key: Column, blocks: int) -> Column:
    return key.bitwiseAND(F.lit(blocks - 1).cast("long"))


def sketch(keys: DataFrame, blocks: int) -> DataFrame:
    """``block`` and the bits of its counters that reached two, from a column ``key`` of text hashes.

    The sketches of single tasks are merged by adding counters up, so a text that a third of all rows
    share is three rows a task.
    """
    places = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array(*_counters(F.col("key")))).alias("counter"))
    counted = places.groupBy("block", "counter").agg(F.count(F.lit(1)).alias("n"))
    bit = F.expr("shiftleft(1L, counter)")
    return counted.where("n > 1").groupBy("block").agg(F.bit_or(bit).alias("repeated"))


def possible_repeats(rows: DataFrame, merged: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` has no counter of one; ``merged`` has at most ``MAX_BLOCKS`` rows and is broadcast."""
    probed = rows.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(merged), "block")
    for place in _counters(F.col("key")):
        probed = probed.where(F.call_function("shiftright", F.col("repeated"), place).bitwiseAND(F.lit(1).cast("long")) == 1)
    return probed.drop("block", "repeated")


def flagged(documents: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part and ``mask`` (bit i for filter i of ``FILTERS``) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = documents.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own_failures(text).alias("mask"), F.xxhash64(text).alias("key"))
    own = cut_lineage(own)
    blocks = blocks_for(own.count())
    merged = cut_lineage(sketch(own.select("key"), blocks))
    texts = possible_repeats(documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key")), merged, blocks)
    firsts = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    firsts = firsts.select("doc_id", F.xxhash64("text").alias("key"), F.lit(True).alias("first")).distinct()
    repeats = possible_repeats(own.where("doc_id IS NOT NULL"), merged, blocks).join(firsts, ["doc_id", "key"], "left_anti")
    repeats = repeats.select("doc_id", "key").distinct().withColumn("repeat", F.lit(BIT["E"]))
    named = own.where("doc_id IS NOT NULL").join(repeats, ["doc_id", "key"], "left")
    named = named.select("doc_id", "part", (F.col("mask") + F.coalesce("repeat", F.lit(0))).alias("mask"))
    return named.unionByName(own.where("doc_id IS NULL").select("doc_id", "part", "mask"))


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part that fail just these filters."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    named = flags.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", "good", "toxic")
    nameless = flags.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return named.unionByName(nameless).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def _places() -> dict[tuple[int, int], list[str]]:
    """(bits of the filters before, bit of the filter) and the orders in which this happens."""
    found: dict[tuple[int, int], list[str]] = {}
    for order in permutations(FILTERS):
        before = 0
        for f in order:
            found.setdefault((before, BIT[f]), []).append("".join(order))
            before |= BIT[f]
    return found


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of ``RESULTS`` for all orders of the filters.

    A filter comes first among the k filters that a document fails in 120 / k of the orders, so the
    removals summed over all orders need no order at all.
    """
    places = _places()
    each = F.array(*[F.struct(F.lit(before).alias("before"), F.lit(own).alias("own")) for before, own in places])
    rows = counts.select("*", F.inline(each))
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    firsts = F.lit(len(list(permutations(FILTERS)))) / F.greatest(F.bit_count("mask"), F.lit(1))
    total = lambda condition, value, name: F.sum(F.when(condition, value).otherwise(0)).cast("long").alias(name)
    cells = rows.groupBy("part", "before", "own").agg(
        total(~fails & ~gone, F.col("n"), "kept"),
        total(fails & ~gone, F.col("n"), "removed"),
        total(fails & gone, F.col("n"), "redundant"),
        total(F.col("mask") == F.col("own"), F.col("n"), "unique_fails"),
        total(fails & ~gone, F.col("good"), "good_lost"),
        total(fails & ~gone, F.col("toxic"), "toxic_lost"),
        total(fails, F.col("n") * firsts.cast("long"), "shapley"),
    )
    cells = cells.withColumn("step", (F.bit_count("before") + 1).cast("int"))
    orders = counts.sparkSession.createDataFrame([(b, o, order) for (b, o), orders in places.items() for order in orders], "before int, own int, filter_order string")
    return cells.join(F.broadcast(orders), ["before", "own"]).select("part", "filter_order", "step", *RESULTS)
