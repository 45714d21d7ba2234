"""Benchmark decontamination: a prefix-filtered join of document shingles with item windows.

A window is ``window`` consecutive words of an item (a shorter item is one window). Its shingles of
``shingle`` words are ordered by how often the documents hold them, which is counted first, by hash alone.
Since a window must be contained whole, the rarest shingle alone is a sufficient prefix; only prefixes are joined with the
documents' positions. A position that holds a prefix is a candidate; it must leave room for the window
before and behind (position and length bounds), and the words themselves, joined back by document, are then compared.

All steps are DataFrame functions. What is shuffled is (id, position, hash), never a position with its text. The hashes are
broadcast while there are at most ``BROADCAST_ROWS`` of them; otherwise a blocked Bloom filter passes
the positions that may hold one to the same join by shuffle. Words match
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.

Defined cases: null or wordless texts have no words, no hits and are not contaminated; a wordless
item has no window; items of equal text are hit together; without items nothing is hit. A row of
documents is known by its id and a hash of its text, so repeated rows give repeated equal results
and a null id is allowed. Other columns of documents pass through ``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.llm import bloom
from patronlens.llm.common import ascii_lower, unused
from patronlens.session import cut_lineage

WINDOW, SHINGLE = 10, 5
BROADCAST_ROWS = 500_000
RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
SEPARATOR_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Array of words, empty for null and wordless texts."""
    inner = F.trim(ascii_lower(text), F.lit(SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(F.split(inner, SEPARATOR_RUN), F.array().cast("array<string>"))
    )


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, phrase (its words with single spaces), words, length: every distinct window of every item."""
    worded = items.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - F.lit(window)))).alias("start")
    pieces = worded.select("item_id", "words", starts).select(
        "item_id", F.slice("words", F.col("start") + 1, F.lit(window)).alias("words")
    )
    return pieces.withColumn("phrase", F.array_join("words", " ")).withColumn("length", F.size("words")).distinct()


def _hash_at(words: str, at: str, size: int) -> Column:
    return F.expr("xxhash64(" + ", ".join(f"get({words}, {at} + {i})" for i in range(size)) + ")")


def positions(documents: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, _text_hash, at, room (words from there on) and hash of every shingle of the sizes in every document."""
    spread = documents.select("doc_id", "_text_hash", F.size("_words").alias("n"), "_words", F.posexplode("_words").alias("at", "word"))
    room = F.col("n") - F.col("at")
    hashes = F.array(*[F.when(room >= size, _hash_at("_words", "at", size)) for size in sizes])
    each = spread.select("doc_id", "_text_hash", "at", room.alias("room"), F.explode(hashes).alias("hash"))
    return each.where("hash IS NOT NULL")


def among(places: DataFrame, hashes: DataFrame, broadcast_rows: int) -> DataFrame:
    """The ``places`` whose hash is among the hashes or, where these are too many to be broadcast, passes their Bloom filter."""
    known = hashes.select(F.col("hash").alias("known")).distinct()
    if known.count() <= broadcast_rows:
        return places.join(F.broadcast(known), F.col("hash") == F.col("known"), "left_semi")
    return bloom.probe(places, "hash", known, "known", "possible").where("possible").drop("possible")


def rarest(phrases: DataFrame, places: DataFrame, shingle: int, broadcast_rows: int) -> DataFrame:
    """phrase, length, offset and hash of each phrase's rarest shingle, for phrases all of whose shingles stand in the documents."""
    size = F.least(F.col("length"), F.lit(shingle))
    offsets = phrases.select("phrase", "words", "length", F.explode(F.sequence(F.lit(0), F.col("length") - size)).alias("offset"))
    hashed = F.lit(None).cast("long")
    for n in range(1, shingle + 1):
        hashed = F.when(size == n, _hash_at("words", "offset", n)).otherwise(hashed)
    offsets = cut_lineage(offsets.select("phrase", "length", "offset", hashed.alias("hash")))
    often = among(places.select("hash"), offsets, broadcast_rows).groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    ranked = offsets.join(often, "hash", "left").groupBy("phrase", "length")
    least = ranked.agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "offset", "hash")).alias("p"))
    return least.where("p.often > 0").select("phrase", "length", "p.offset", "p.hash")


def occurrences(documents: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified window occurrences: doc_id, _text_hash, phrase, start, end."""
    phrases = cut_lineage(windows.select("phrase", "words", "length").distinct())
    sizes = sorted(r[0] for r in phrases.select(F.least("length", F.lit(shingle)).alias("s")).distinct().collect()) or [shingle]
    texts = documents.select("doc_id", F.xxhash64("text").alias("_text_hash"), "text")
    places = positions(texts.select("doc_id", "_text_hash", words_of(F.col("text")).alias("_words")), sizes)
    prefix = cut_lineage(rarest(phrases, places, shingle, broadcast_rows))
    start = F.col("at") - F.col("offset")
    near = among(places, prefix, broadcast_rows).join(prefix, "hash").where((start >= 0) & (F.col("room") + F.col("offset") >= F.col("length")))
    near = cut_lineage(near.select("doc_id", "_text_hash", start.alias("start"), "length", "phrase").distinct())
    held = near.select(F.col("doc_id").alias("d"), F.col("_text_hash").alias("h")).distinct()
    same = (F.col("_text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))
    worded = texts.join(held, same, "left_semi").select(F.col("doc_id").alias("d"), F.col("_text_hash").alias("h"), words_of(F.col("text")).alias("words"))
    exact = F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ") == F.col("phrase")
    found = near.join(worded, same).where(exact)
    return found.select("doc_id", "_text_hash", "phrase", "start", (F.col("start") + F.col("length")).alias("end")).distinct()


def covered(spans: Column) -> Column:
    """Number of positions inside the union of (start, end) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("upto"))
    step = lambda acc, s: F.struct(
        (acc["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("sum"),
        F.greatest(acc["upto"], s["end"]).alias("upto"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["sum"])


def hit_documents(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of documents: doc_id, _text_hash, n_words, n_hit, spans, item_ids (as strings, sorted)."""
    windows = cut_lineage(item_windows(items, window))
    found = cut_lineage(occurrences(documents, windows, window, shingle, broadcast_rows))
    key = ["doc_id", "_text_hash"]
    spans = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    owners = windows.select("phrase", F.col("item_id").cast("string").alias("item")).distinct()
    pairs = found.select(*key, "phrase").distinct().join(owners, "phrase")
    listed = pairs.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    result = documents.select("doc_id", F.xxhash64("text").alias("_text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    for part in (spans, listed):
        other = part.withColumnsRenamed({"doc_id": "_d", "_text_hash": "_h"})
        result = result.join(other, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text_hash") == F.col("_h")), "left").drop("_d", "_h")
    none = F.array().cast("array<string>")
    result = result.withColumn("item_ids", F.coalesce("item_ids", none))
    return result.withColumn("n_hit", F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")))


def drop_contaminated(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``documents`` that hold no whole window of any item, columns as they are."""
    found = occurrences(documents, cut_lineage(item_windows(items, window)), window, shingle)
    hit = cut_lineage(found.select("doc_id", "_text_hash").distinct().toDF(*unused(documents, "hit_id", "hit_hash")))
    hit_id, hit_hash = hit.columns
    same = F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64("text") == F.col(hit_hash))
    return documents.join(hit, same, "left_anti")
