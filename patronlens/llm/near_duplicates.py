"""MinHash near-duplicates with an LSH forest: several sorted signature orders, confirmed on full sets.

1. Every text becomes its set of word shingles. Texts of one set are a class, known by its smallest
   id, so thousands of copies go on as one row.
2. A class stands in ``trees`` orders, each sorted by ``depth`` min-hashes of its signature. Within
   an order, a class is compared (on signatures) with the ``neighbours`` rows before it that share at
   least the first hash. Where few share it, these are all that do; where many do, they are those
   with the longest common prefix. So the depth adapts to how crowded a region is, and no region
   is collected. Orders are range-partitioned sorts, a frequent prefix spreads over many tasks.
3. Pairs whose estimate lies less than four standard errors below the threshold join their classes to
   a candidate family. A family is confirmed in one task on its full sets if these are small enough
   (``PIECE_SHINGLES``, each text counting for ``TEXT_WEIGHT`` more, so that short texts are not too many to compare);
   a larger one is cut along each of the orders into pieces of that size.
4. In a piece, pairs not yet joined are confirmed exactly, the likeliest first. Linked pairs that
   join two groups are the only output, fewer than rows; their components are a first result.
5. What the bounds of 2 and 3 left uncompared is compared now: texts that share a first hash in an order with
   more rows of that hash than ``neighbours``, in one that two tasks of the scan share, or with a
   text of a family that was cut. Of these, all pairs of different components are compared, block by block on
   signatures, and the likely ones confirmed on full sets. A crowd that is one component costs nothing here.

Defined cases: texts that are null or without words have an empty set and are linked with nothing; a
text of fewer words than a shingle is one shingle; rows that repeat an id are one node, which has
the links of all its texts; rows of a null id are linked with nothing and kept. An empty table gives
an empty table. Other columns pass through ``deduplicated`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.llm import bloom, grams
from patronlens.llm.common import connected, unused
from patronlens.session import cut_lineage

TREES, DEPTH = 10, 12
NEIGHBOURS = 128
SHINGLE, PERCENT = 5, 80
PIECE_SHINGLES, TEXT_WEIGHT = 3_000_000, 1000
PROFILE = "doc_id long, n_shingles long, class binary, signature binary"
SETS = "doc_id long, class binary, shingles binary"


def multipliers(count: int) -> np.ndarray:
    return grams.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(grams.BASE)) | np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash of a set under each factor, taken over blocks of bounded size."""
    best = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        hashed = (shingles[at: at + 4096, None] * factors) >> np.uint64(32)
        np.minimum(best, hashed.min(axis=0), out=best)
    return best.astype(np.uint32)


def _texts(batches: Iterator[pa.RecordBatch], size: int):
    """(doc_id scalar, shingle set) of every row."""
    for batch in batches:
        ids = batch.column("doc_id")
        for piece in grams.words(batch.column("text")):
            for row in range(piece.last - piece.first):
                own = piece.hashes[piece.rows[row]: piece.rows[row + 1]]
                yield ids[piece.first + row].as_py(), grams.shingles(own, size)


def _class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _batched(rows, schema: pa.Schema, most: int = 4 << 20):
    """Record batches of rows, cut by count and by the bytes of their last column."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if weight >= most or len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def profiles(documents: DataFrame, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, class (128-bit digest of the set, null if empty) and signature of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("signature", pa.binary())])

    def profile(batches):
        factors = multipliers(trees * depth)

        def rows():
            for doc_id, found in _texts(batches, size):
                if len(found):
                    yield doc_id, len(found), _class_of(found), signature(found, factors).astype(">u4").tobytes()
                else:
                    yield doc_id, 0, None, None

        yield from _batched(rows(), schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(profile, PROFILE)


def shingle_sets(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, class and the sorted distinct shingle hashes (8 bytes each) of every row with words."""
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("shingles", pa.binary())])

    def sets(batches):
        rows = ((i, _class_of(s), s.tobytes()) for i, s in _texts(batches, size) if len(s))
        yield from _batched(rows, schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sets, SETS)


def _by_tree(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """One row per class and tree, with the tree's first hash."""
    rows = classes.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return rows.withColumn("first", F.substring("signature", F.col("tree") * (4 * depth) + 1, 4))


def orders(classes: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per class and tree whose first hash another class shares: tree, first, label, and the class's columns.

    The label is what the order is sorted by: the tree's hashes in turn, the first in full and the others by two bytes.
    """
    width = 4 * depth
    parts = [F.col("first")]
    parts += [F.substring("signature", F.col("tree") * width + 4 * i + 3, 2) for i in range(1, depth)]
    rows = _by_tree(classes, trees, depth)
    shared = rows.groupBy("tree", "first").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("tree").alias("_t"), F.col("first").alias("_f"))
    rows = rows.join(shared, (F.col("tree") == F.col("_t")) & (F.col("first") == F.col("_f"))).drop("_t", "_f")
    return rows.withColumn("label", F.concat(*parts))


class Joined:
    """Union-find over small integers."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def least_estimate(percent: int, hashes: int) -> float:
    share = percent / 100
    return share - 4 * (share * (1 - share) / hashes) ** 0.5


def likely_pairs(ordered: DataFrame, percent: int, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Edges (a, b) that join neighbours of the sorted orders whose estimated similarity may reach the threshold.

    The stream holds the last ``neighbours`` rows only; a pair that an earlier one implies is left out.
    Rows whose ``b`` is null name what a task may hold a part of only: ``a`` is the tree and first hash it begins or ends with.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def scan(batches):
        held_ids = held_first = held_sig = held_n = begun = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                tree = part.column("tree").to_numpy(zero_copy_only=False).astype(np.uint64)
                first = np.frombuffer(b"".join(part.column("first").to_pylist()), dtype=">u4").astype(np.uint64) | (tree << np.uint64(32))
                raw = b"".join(part.column("signature").to_pylist())
                sig = np.frombuffer(raw, dtype=">u4").reshape(len(ids), -1).astype(np.uint16)
                n = part.column("n_shingles").to_numpy(zero_copy_only=False)
                begun = int(first[0]) if begun is None else begun
                if held_ids is not None:
                    ids, first, sig, n = (np.concatenate(x) for x in ((held_ids, ids), (held_first, first), (held_sig, sig), (held_n, n)))
                new = 0 if held_ids is None else len(held_ids)
                least = least_estimate(percent, sig.shape[1]) * sig.shape[1]
                known, out = Joined(len(ids)), []
                for back in range(1, min(neighbours, len(ids) - 1) + 1):
                    later = np.arange(max(new, back), len(ids))
                    later = later[first[later] == first[later - back]]
                    if not len(later):
                        break  # sorted by the first hash: no nearer neighbour shares it, so none further does
                    small, large = np.minimum(n[later], n[later - back]), np.maximum(n[later], n[later - back])
                    later = later[100 * small >= percent * large]
                    likely = later[(sig[later] == sig[later - back]).sum(axis=1) >= least]
                    out += [(int(ids[i]), int(ids[i - back])) for i in likely if ids[i] != ids[i - back] and known.join(int(i), int(i - back))]
                keep = slice(max(0, len(ids) - neighbours), None)
                held_ids, held_first, held_sig, held_n = ids[keep], first[keep], sig[keep], n[keep]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
        if begun is not None:
            yield pa.RecordBatch.from_arrays([pa.array([begun, int(held_first[-1])], pa.int64()), pa.nulls(2, pa.int64())], schema=schema)

    return ordered.select("tree", "first", "doc_id", "n_shingles", "signature").mapInArrow(scan, "a long, b long")


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Range-partitioned and sorted by the keys; a frequent prefix spreads over many partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def confirm(ids: np.ndarray, sets: list[np.ndarray], percent: int, hashes: int = 128, rest: tuple | None = None) -> list[tuple[int, int]]:
    """Linked pairs that span the components of 100 * intersection >= percent * union among the sets.

    Only pairs not joined yet are looked at, by falling estimate and in growing portions, each exactly.
    ``rest`` has each set's component, block and first hashes of earlier trees: sets of one component are joined
    already, those of one block of two have their own piece, and those that share an earlier hash are compared there.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    links, label = [], np.arange(count)
    if rest is not None:
        groups, blocks, earlier = rest
        label = np.unique(groups, return_inverse=True)[1]
        two = blocks.min() != blocks.max()
    if count > 2:
        factors = multipliers(hashes)
        sigs = np.array([signature(s, factors).astype(np.uint16) for s in sets])
        least = least_estimate(percent, hashes) * hashes
    for i in range(1, count):
        near = np.flatnonzero((100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])) & (ids[:i] != ids[i]) & (label[:i] != label[i]))
        if rest is not None:
            near = near[~(earlier[near] == earlier[i]).any(axis=1)]
            near = near[blocks[near] != blocks[i]] if two else near
        if count > 2 and len(near):
            alike = (sigs[near] == sigs[i]).sum(axis=1)
            near = near[alike >= least][np.argsort(-alike[alike >= least], kind="stable")]
        portion = 4
        while len(near):
            near = near[label[near] != label[i]]
            now, near, portion = near[:portion], near[portion:], min(portion * 4, 1024)
            if not len(now):
                break
            joined = np.concatenate([sets[j] for j in now])
            at = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
            starts = np.concatenate([[0], np.cumsum(sizes[now])[:-1]])
            common = np.add.reduceat((sets[i][at] == joined).astype(np.int64), starts)
            for j in now[100 * common >= percent * (sizes[now] + sizes[i] - common)]:
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    links.append((int(ids[i]), int(ids[j])))
    return links


def confirmed_links(pieces: DataFrame, percent: int) -> DataFrame:
    """Exact links (a, b) within each piece; ``pieces`` has piece, doc_id, shingles and a bounded number of shingles a piece.

    With columns component, block and earlier (of ``rest_pieces``) only what these leave open is compared.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    columns = ["piece", "doc_id", "shingles", *[c for c in ("component", "block", "earlier") if c in pieces.columns]]

    def check(batches):
        current, ids, sets, more = None, [], [], []

        def flush():
            rest = None
            if len(columns) > 3 and more:
                component, block, earlier = zip(*more)
                rest = np.array(component), np.array(block), np.frombuffer(b"".join(earlier), dtype=np.uint32).reshape(len(more), -1)
            links = confirm(np.array(ids), sets, percent, rest=rest) if len(ids) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], schema=schema)

        for batch in batches:
            for piece, doc_id, raw, *others in zip(*(batch.column(c).to_pylist() for c in columns)):
                if piece != current:
                    yield from flush()
                    current, ids, sets, more = piece, [], [], []
                ids.append(doc_id)
                sets.append(np.frombuffer(raw, dtype=np.uint64))
                more.append(others)
        yield from flush()

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.select(*columns).repartition(parts, "piece").sortWithinPartitions("piece").mapInArrow(check, "a long, b long")


def cut_families(families: DataFrame, classes: DataFrame, trees: int, depth: int, limit: int = PIECE_SHINGLES) -> DataFrame:
    """piece and doc_id, class of its members. A family of a weight of at most ``limit`` is one piece.

    A larger one is cut along every order of the forest. Its share of an order is range-partitioned,
    and pieces are counted off within each partition, so the cutting never collects a family.
    """
    members = classes.join(families.withColumnsRenamed({"node": "_node", "component": "family"}), F.col("doc_id") == F.col("_node")).drop("_node")
    weights = members.groupBy("family").agg(F.sum(F.col("n_shingles") + TEXT_WEIGHT).alias("weight"))
    members = cut_lineage(members.join(weights, "family"))
    small = members.where(F.col("weight") <= limit).select(F.concat_ws("|", F.lit("f"), "family").alias("piece"), "doc_id", "class")
    large = members.where(F.col("weight") > limit)
    if large.isEmpty():
        return small
    schema = pa.schema([("piece", pa.string()), ("doc_id", pa.int64()), ("class", pa.binary())])

    def count_off(batches):
        family, weight, piece = None, 0, 0
        name = None
        for batch in batches:
            out = []
            for fam, tree, doc_id, cls, n in zip(*(batch.column(c).to_pylist() for c in ("family", "tree", "doc_id", "class", "n_shingles"))):
                if (fam, tree) != family or weight + n + TEXT_WEIGHT > limit:
                    family, weight, piece = (fam, tree), 0, piece + 1
                    name = f"{fam}|{tree}|{doc_id}"
                weight += n + TEXT_WEIGHT
                out.append((name, doc_id, cls))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    width = 4 * depth
    rows = large.select("family", "doc_id", "class", "n_shingles", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.withColumn("label", F.substring("signature", F.col("tree") * width + 1, F.lit(width))).drop("signature")
    cut = in_order(rows, "family", "tree", "label", "doc_id").mapInArrow(count_off, "piece string, doc_id long, class binary")
    return small.unionByName(cut)


def open_buckets(rows: DataFrame, torn: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``_tree`` and ``_first`` of the first hashes whose texts the scan and the pieces may not all have compared.

    ``rows`` has tree, first, component and ``cut`` (the text's family was cut); ``torn`` has the hashes that two tasks may
    share. Where all texts are one component nothing is left to find.
    """
    counted = rows.groupBy("tree", "first").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("cut").alias("cut")
    ).where("low <> high")
    code = F.shiftleft(F.col("tree").cast("long"), 32) + F.conv(F.hex("first"), 16, 10).cast("long")
    counted = counted.join(torn.select("code", F.lit(True).alias("torn")).distinct(), code == F.col("code"), "left")
    return counted.where((F.col("n") > neighbours) | F.col("cut") | F.col("torn")).select(F.col("tree").alias("_tree"), F.col("first").alias("_first"))


def _blocks(rows: DataFrame, limit: int, most: int) -> DataFrame:
    """``rows`` in order, with the ``block`` of their bucket: at most ``most`` rows and a weight of about half of ``limit``.

    Rows are counted off within each partition, and what the partitions before hold of the same bucket is added from one row per
    bucket and partition. So blocks are full however finely the rows are partitioned: a row is compared with as many blocks as its bucket fills.
    """
    fields = [("part", pa.int32()), ("tree", pa.int32()), ("first", pa.binary()), ("own", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()),
              ("component", pa.int64()), ("class", pa.binary()), ("signature", pa.binary()), ("rows_before", pa.int64()), ("weight_before", pa.int64())]
    schema = pa.schema(fields)

    def count_off(batches):
        bucket, held, weight = None, 0, 0
        for batch in batches:
            counts, weights = [], []
            for tree, first, own, n in zip(*(batch.column(c).to_pylist() for c in ("tree", "first", "own", "n_shingles"))):
                if (tree, first, own) != bucket:
                    bucket, held, weight = (tree, first, own), 0, 0
                counts.append(held)
                weights.append(weight)
                held, weight = held + 1, weight + n + TEXT_WEIGHT
            made = {"rows_before": pa.array(counts, pa.int64()), "weight_before": pa.array(weights, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[f] if f in made else batch.column(f).cast(t) for f, t in fields], schema=schema)

    ordered = in_order(rows, "tree", "first", "own", "n_shingles", "doc_id").withColumn("part", F.spark_partition_id())
    kinds = "part int, tree int, first binary, own long, doc_id long, n_shingles long, component long, class binary, signature binary, rows_before long, weight_before long"
    counted = cut_lineage(ordered.mapInArrow(count_off, kinds))
    spans = counted.groupBy("tree", "first", "own", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles") + TEXT_WEIGHT).alias("weight"))
    bucket = Window.partitionBy("tree", "first").orderBy("own", "part").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("tree", "first", "own").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    spans = spans.withColumns({"n_before": earlier("n", same), "w_before": earlier("weight", same), "last": F.lead("part").over(Window.partitionBy("tree", "first", "own").orderBy("part")).isNull()})
    number = lambda n, weight: F.floor(n / most) + F.floor(weight / (limit // 2))
    filled = F.when(F.col("last"), number(F.col("n_before") + F.col("n"), F.col("w_before") + F.col("weight")) + 1).otherwise(0)
    spans = spans.withColumn("filled", filled).withColumn("begin", earlier("filled", bucket)).select(
        *[F.col(c).alias(f"_{c}") for c in ("tree", "first", "own", "part")], "n_before", "w_before", "begin")
    held = counted.join(spans, (F.col("tree") == F.col("_tree")) & (F.col("first") == F.col("_first")) & F.col("own").eqNullSafe(F.col("_own")) & (F.col("part") == F.col("_part")))
    block = F.col("begin") + number(F.col("n_before") + F.col("rows_before"), F.col("w_before") + F.col("weight_before"))
    return held.select("tree", "first", block.cast("long").alias("block"), "doc_id", "n_shingles", "component", "class", "signature")


def rest_pieces(rows: DataFrame, wanted: DataFrame, percent: int, depth: int, limit: int = PIECE_SHINGLES, most: int = 1024) -> DataFrame:
    """piece, doc_id, class, component, block and first hashes of earlier trees (``earlier``) of the texts of likely pairs of different components in the ``wanted`` buckets of ``rows``.

    A bucket's texts are counted off into blocks, those of a large component apart and else by size. Every two blocks
    that may hold a link are compared on signatures in one task; the texts of its likely pairs are a piece.
    """
    rows = rows.join(wanted, (F.col("tree") == F.col("_tree")) & (F.col("first") == F.col("_first"))).drop("_tree", "_first")
    sizes = rows.groupBy("tree", "first", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most // 2)
    sizes = sizes.select(F.col("tree").alias("_tree"), F.col("first").alias("_first"), F.col("component").alias("own"))
    same = (F.col("tree") == F.col("_tree")) & (F.col("first") == F.col("_first")) & (F.col("component") == F.col("own"))
    rows = cut_lineage(_blocks(rows.join(sizes, same, "left").drop("_tree", "_first"), limit, most))
    blocks = rows.groupBy("tree", "first", "block").agg(
        F.min("n_shingles").alias("least"), F.max("n_shingles").alias("largest"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    one, two = (blocks.select("tree", "first", *[F.col(c).alias(f"{c}_{i}") for c in ("block", "least", "largest", "low", "high")]) for i in (1, 2))
    pairs = one.join(two, ["tree", "first"]).where("block_1 <= block_2").where("least(low_1, low_2) <> greatest(high_1, high_2)")
    pairs = pairs.where(f"{percent} * greatest(least_1, least_2) <= 100 * least(largest_1, largest_2)")
    sides = pairs.select("tree", "first", "block_1", "block_2", F.explode(F.array_distinct(F.array("block_1", "block_2"))).alias("block"))
    held = rows.join(sides, ["tree", "first", "block"]).withColumn("piece", F.concat_ws("|", "tree", F.hex("first"), "block_1", "block_2"))
    schema = pa.schema([("piece", pa.string()), ("doc_id", pa.int64()), ("class", pa.binary()), ("component", pa.int64()), ("block", pa.int64()), ("earlier", pa.binary())])
    columns = ["piece", "block", "block_1", "block_2", "tree", "doc_id", "class", "component", "n_shingles", "signature"]

    def likely(piece, members):
        _, block, first, second, tree, ids, classes, component, n, raw = zip(*members)
        block, component, n, tree = np.array(block), np.array(component), np.array(n), tree[0]
        sig = np.frombuffer(b"".join(raw), dtype=">u4").reshape(len(n), -1)
        low = np.ascontiguousarray(sig.astype(np.uint16).T)
        a = np.flatnonzero(block == first[0])
        b = a if first[0] == second[0] else np.flatnonzero(block == second[0])
        alike = np.zeros((len(a), len(b)), dtype=np.uint16)
        for column in low:
            alike += column[a][:, None] == column[b]
        hit = alike >= least_estimate(percent, len(low)) * len(low)
        hit &= component[a][:, None] != component[b]
        hit &= 100 * np.minimum(n[a][:, None], n[b]) >= percent * np.maximum(n[a][:, None], n[b])
        x, y = (side[at] for side, at in zip((a, b), np.nonzero(hit)))
        # A pair that shares an earlier tree's first hash is compared there, or has been by the scan.
        earlier = sig[:, : tree * depth: depth]
        fresh = ~(earlier[x] == earlier[y]).any(axis=1)
        for i in np.unique(np.concatenate([x[fresh], y[fresh]])):
            yield piece, ids[i], classes[i], int(component[i]), int(block[i]), earlier[i].astype(np.uint32).tobytes()

    def compare(batches):
        current, members = None, []

        def flush():
            found = list(likely(current, members)) if members else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[0] != current:
                    yield from flush()
                    current, members = row[0], []
                members.append(row)
        yield from flush()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.select(*columns).repartition(parts, "piece").sortWithinPartitions("piece")
    return dealt.mapInArrow(compare, "piece string, doc_id long, class binary, component long, block long, earlier binary")


def _with_sets(pieces: DataFrame, documents: DataFrame, shingle: int) -> DataFrame:
    """``pieces`` with the full sets of their texts; only these texts are read into sets."""
    wanted = pieces.select("doc_id").distinct()
    texts = bloom.probe(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted, "doc_id", "_wanted")
    sets = shingle_sets(texts.where("_wanted"), shingle).dropDuplicates(["doc_id", "class"])
    return pieces.join(sets.withColumnsRenamed({"doc_id": "_d", "class": "_c"}), (F.col("doc_id") == F.col("_d")) & (F.col("class") == F.col("_c")))


def components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH,
               piece_shingles: int = PIECE_SHINGLES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``documents``."""
    rows = cut_lineage(profiles(documents, shingle, trees, depth))
    named = rows.where("doc_id IS NOT NULL AND class IS NOT NULL")
    heads = named.groupBy("class").agg(F.min("doc_id").alias("head"))
    first = heads.withColumnsRenamed({"class": "_class", "head": "_head"})
    classes = named.join(first, (F.col("class") == F.col("_class")) & (F.col("doc_id") == F.col("_head"))).select(*named.columns)
    classes = cut_lineage(classes.dropDuplicates(["class", "doc_id"]))
    ordered = in_order(orders(classes, trees, depth), "tree", "label")
    likely = cut_lineage(likely_pairs(ordered, percent, neighbours))
    families = connected(likely)
    pieces = cut_lineage(cut_families(families, classes, trees, depth, piece_shingles))
    links = cut_lineage(confirmed_links(_with_sets(pieces, documents, shingle), percent))
    repeated = named.groupBy("doc_id").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("doc_id")
    other = named.join(repeated, "doc_id", "left_semi").join(heads, "class").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    links = cut_lineage(links.unionByName(other))
    joined = connected(links)
    cut = pieces.where(~F.col("piece").startswith("f|")).select(F.col("doc_id").alias("_cut")).distinct()
    own = classes.join(joined, F.col("doc_id") == F.col("node"), "left").join(cut, F.col("doc_id") == F.col("_cut"), "left")
    own = cut_lineage(own.select(*classes.columns, F.coalesce("component", "doc_id").alias("component"), F.col("_cut").isNotNull().alias("cut")))
    own = _by_tree(own, trees, depth)
    wanted = cut_lineage(open_buckets(own, likely.where("b IS NULL").select(F.col("a").alias("code")), neighbours))
    if not wanted.isEmpty():
        rest = cut_lineage(rest_pieces(own, wanted, percent, depth, piece_shingles))
        if not rest.isEmpty():
            joined = connected(links.unionByName(confirmed_links(_with_sets(rest, documents, shingle), percent)))
    placed = heads.join(joined, F.col("head") == F.col("node"), "left").select(F.col("class").alias("_class"), F.coalesce("component", "head").alias("_component"))
    result = rows.join(placed, F.col("class") == F.col("_class"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return result.select("doc_id", "n_shingles", own.alias("component_id"))


def kept(doc_id: Column, component: Column) -> Column:
    """A row is kept when it stands for its component; so is one without an id."""
    return F.coalesce(doc_id == component, F.lit(True))


def deduplicated(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the smallest id's (of rows repeating it, one), columns as they are."""
    lost, many_id, rank = unused(documents, "lost", "many_id", "rank")
    gone = components(documents, shingle, percent).where(~kept(F.col("doc_id"), F.col("component_id")))
    rest = documents.join(gone.select(F.col("doc_id").alias(lost)).distinct(), F.col("doc_id") == F.col(lost), "left_anti")
    many = rest.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(many_id))
    same = F.col("doc_id") == F.col(many_id)
    single = rest.join(many, same, "left_anti")
    repeats = rest.join(many, same, "left_semi")
    pick = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return single.unionByName(repeats.withColumn(rank, F.row_number().over(pick)).where(F.col(rank) == 1).drop(rank))
