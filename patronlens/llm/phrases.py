"""Phrases whose words stand together more often than their parts would by chance.

Texts are lower-cased and cut into pieces at punctuation and line ends. Every word opens one window: itself and
the next words of its piece in lead columns, null beyond the piece's end. Only these longest windows
are taken out of the texts and counted. All shorter counts are their margins: ROLLUP over the lead
columns sums ever shorter prefixes, down to the number of words. The leads are read off the piece's
word array, so building windows moves no data, and tasks count before the shuffle, so a word or
pair that is everywhere is one row a task.

Nearly all longest windows of a corpus are different, and most hold a phrase that is too rare to matter. So
windows are first counted by one long that packs a few hash bits of each word. Its prefixes bound the
counts of the phrases from above; those that may reach ``MIN_COUNT`` go into a Bloom filter of bounded size, and a window ends
before the first word that makes it surely rare. A full filter or equal bits only let more windows
through: the counts that are used come from the words themselves.

A phrase of at least ``MIN_COUNT`` occurrences is a candidate. Cut after its first k words it scores
floor(1,000,000 a² / (l r)) with the counts of the whole and the two parts; the lowest cut counts. Parts
of a candidate are at least as frequent, so rare phrases leave early. A candidate inside a longer one
with at least half its count is dropped. Scores are exact decimals of 38 digits, enough for counts of
up to 10^15.

Defined cases: null text is empty and has no words; a null part is ``und``; white space other than
blanks, tabs and line ends belongs to words; ties in the score go to the shorter first part, ties in
rank to the more frequent and then the smaller phrase by its bytes; repeated rows count each; an empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.llm import bloom
from patronlens.llm.common import ascii_lower
from patronlens.session import cut_lineage

LONGEST, MIN_COUNT, TOP, HELD_PERCENT = 3, 10, 2000, 50
PIECE_END = r"[.,;:!?\x0A-\x0D]"


def windows(documents: DataFrame, part: str = "lang", longest: int = LONGEST) -> DataFrame:
    """part, w0, w1, ...: a row per word with the words that follow it in its piece, null beyond the end.

    Tabs become blanks first: splitting at one character needs no regular expression.
    """
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    pieces = documents.select(F.coalesce(F.col(part).cast("string"), F.lit("und")).alias("part"), F.explode(F.split(text, PIECE_END)).alias("piece"))
    words = pieces.select("part", F.array_remove(F.split(F.replace("piece", F.lit("\t"), F.lit(" ")), " "), "").alias("w0")).where(F.size("w0") > 0)
    leads = [F.slice("w0", k + 1, F.size("w0")).alias(f"w{k}") for k in range(1, longest)]
    names = [f"w{k}" for k in range(longest)]
    return words.select("part", "w0", *leads).select("part", F.inline(F.arrays_zip(*names)))


def packed(names: list[str]) -> list[Column]:
    """For the first one, two, ... lead columns one long of equally many hash bits a word, 0 where a window has ended.

    The part is hashed with the first word, which all keys hold. Bits are shifted out, which is cheaper than a remainder.
    """
    bits = 63 // len(names)
    hashes = [F.xxhash64("part", names[0]), *[F.xxhash64(n) for n in names[1:]]]
    places = [F.when(F.col(n).isNotNull(), F.greatest(F.shiftrightunsigned(h, 64 - bits), F.lit(1))).otherwise(0) for n, h in zip(names, hashes)]
    keys = [places[0]]
    for place in places[1:]:
        keys.append(F.shiftleft(keys[-1], bits) + place)
    return keys


def without_rare(opened: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """The windows, each ended before the first word with which its phrase surely stays below ``min_count``."""
    names = [f"w{k}" for k in range(longest)]
    bits = 63 // longest
    counted = opened.select(packed(names)[-1].alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # Keys of ended windows may stay among the frequent ones: a window ends there anyway. Without a condition
    # on the key all levels read one shuffle.
    kept = []
    for size in range(longest, 1, -1):
        level = counted if size == longest else counted.groupBy(F.shiftright("key", bits * (longest - size)).alias("key")).agg(F.sum("n").alias("n"))
        kept.append(level.where(F.col("n") >= min_count).select(F.xxhash64(F.lit(size), "key").alias("frequent")))
    frequent = kept[0]
    for more in kept[1:]:
        frequent = frequent.unionByName(more)
    frequent = cut_lineage(frequent)
    keyed = opened.select("part", *names, *[F.xxhash64(F.lit(size), key).alias(f"k{size}") for size, key in enumerate(packed(names), 1) if size > 1])
    for size in range(2, longest + 1):
        keyed = bloom.probe(keyed, f"k{size}", frequent, "frequent", f"may{size}")
    ended = {}
    open_still = F.lit(True)
    for size, name in enumerate(names, 1):
        if size > 1:
            open_still = open_still & F.col(f"may{size}")
            ended[name] = F.when(open_still, F.col(name))
    return keyed.select("part", names[0], *[column.alias(name) for name, column in ended.items()])


def phrase_counts(opened: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """part, phrase, size, f of all phrases of up to ``longest`` words; size 0 holds a part's number of words.

    Phrases below ``min_count`` are left out.
    """
    names = [f"w{k}" for k in range(longest)]
    counted = opened.groupBy("part", *names).agg(F.count(F.lit(1)).alias("n"))
    prefixes = ", ".join(names)
    # A rolled-up column counts one bit of the grouping id, so the prefix length is what is left.
    margins = counted.sparkSession.sql(
        f"SELECT part, {prefixes}, CAST({longest} - bit_count(grouping_id()) AS INT) AS size, sum(n) AS f FROM {{counted}} GROUP BY part, ROLLUP({prefixes})",
        counted=counted,
    )
    whole = F.lit(True)
    for k, name in enumerate(names):
        whole = whole & (F.col(name).isNotNull() | (F.col("size") <= k))
    margins = margins.where(whole & ((F.col("f") >= min_count) | (F.col("size") == 0)))
    return margins.select("part", F.concat_ws(" ", *names).alias("phrase"), "size", "f")


def scored(counts: DataFrame) -> DataFrame:
    """part, phrase, size, a, l, r, score of every candidate, by its lowest-scoring cut."""
    frequent = counts.where("size > 0").select("part", "phrase", "f")
    words = F.split("phrase", " ")
    cuts = counts.where("size > 1").select("part", "phrase", "size", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "part", "phrase", "size", "a", "k",
        F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("rest"),
    )
    cuts = cuts.join(frequent.withColumnsRenamed({"phrase": "first", "f": "l"}), ["part", "first"])
    cuts = cuts.join(frequent.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["part", "rest"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    cuts = cuts.withColumns({f"{c}_wide": v for c, v in wide.items()}).withColumn("score", F.expr("(a_wide * a_wide * 1000000) div (l_wide * r_wide)"))
    lowest = cuts.groupBy("part", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("part", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def without_held(candidates: DataFrame, held_percent: int = HELD_PERCENT) -> DataFrame:
    """Candidates that no longer candidate holds with at least ``held_percent`` of their count."""
    words = F.split("phrase", " ")
    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.array_join(F.slice(words, s, m), " "))))
    inside = candidates.where("size > 2").select("part", F.explode(starts).alias("phrase"), F.col("a").alias("around"))
    inside = inside.groupBy("part", "phrase").agg(F.max("around").alias("around"))
    kept = candidates.join(inside, ["part", "phrase"], "left")
    return kept.where(F.col("around").isNull() | (100 * F.col("around") < held_percent * F.col("a"))).drop("around")


def collocations(documents: DataFrame, part: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """part, rank, phrase, a, l, r, n, score: the first ``top`` phrases of every part."""
    opened = without_rare(windows(documents, part, longest), longest, min_count)
    counts = cut_lineage(phrase_counts(opened, longest, min_count))
    kept = without_held(cut_lineage(scored(counts)))
    order = Window.partitionBy("part").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("part", F.col("f").alias("n"))
    return ranked.join(totals, "part").select("part", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
