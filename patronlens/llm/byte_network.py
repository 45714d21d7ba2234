"""Quality by a convolutional network over the bytes of a text, in numpy.

Bytes are embedded, filters of ``WIDTH`` bytes slide over all positions, and every chunk of ``CHUNK``
bytes keeps how strongly each filter fired (max-pooling) and how much on average. A chunk begins
every ``STEP`` bytes, so chunks overlap by half and cover the whole text. A dense layer turns a
chunk into ``HIDDEN`` signs of quality; their maxima and means over all chunks give one logit and its
probability.

The fit is bounded: of at most ``TRAIN_PER_CLASS`` labelled documents of each class, drawn by a hash of the
id, at most ``TRAIN_CHUNKS`` chunks spread evenly over the whole text come to the driver, and all layers
are learned there by Adam in ``ROUNDS`` balanced batches. The logit is then moved to the shares that the
labels have. Scoring reads whole texts of all rows, a few thousand bytes at a time, and shuffles nothing.

Defined cases: a null or empty text is one of zero bytes and gets the network's answer for it; rows
without label or id do not train; conflicting labels of an id count as 1; with one class only, every
score is that class, with none 0.5; equal texts get equal scores; an empty table gives an empty table.
Other columns pass through unless they bear a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronlens.llm import grams

EMBEDDED, WIDTH, FILTERS, HIDDEN = 8, 8, 24, 16
STEP = 256
CHUNK = 2 * STEP
TRAIN_PER_CLASS, TRAIN_CHUNKS, ROUNDS, BATCH, CHUNKS_A_ROUND = 1200, 12, 240, 32, 4
LEARNING_RATE, DECAY, SEED = 4e-3, 1e-4, 13
#: Positions worked on at a time, a multiple of ``STEP``.
BLOCK = 1 << 12
THRESHOLD = 0.3
RESULTS = ["score", "predicted"]


class Network(NamedTuple):
    embedding: np.ndarray  # 256, EMBEDDED
    filters: np.ndarray  # WIDTH * EMBEDDED, FILTERS
    filter_bias: np.ndarray
    dense: np.ndarray  # 2 * FILTERS, HIDDEN
    dense_bias: np.ndarray
    out: np.ndarray  # 2 * HIDDEN
    bias: np.ndarray  # 1


def fresh(rng: np.random.Generator) -> Network:
    draw = lambda *shape: (rng.normal(size=shape) * (2.0 / shape[0]) ** 0.5).astype(np.float32)
    embedding = (0.5 * rng.normal(size=(256, EMBEDDED))).astype(np.float32)
    zeros = lambda n: np.zeros(n, dtype=np.float32)
    return Network(embedding, draw(WIDTH * EMBEDDED, FILTERS), zeros(FILTERS), draw(2 * FILTERS, HIDDEN), zeros(HIDDEN), draw(2 * HIDDEN), zeros(1))


def activations(net: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embedded windows and what the filters make of them, for every position with ``WIDTH`` bytes."""
    flat = net.embedding[data].reshape(-1)
    n = len(data) - WIDTH + 1
    seen = np.lib.stride_tricks.as_strided(flat, (n, WIDTH * EMBEDDED), (4 * EMBEDDED, 4), writeable=False)
    seen = np.ascontiguousarray(seen)
    fired = seen @ net.filters
    fired += net.filter_bias
    np.maximum(fired, 0, out=fired)
    return seen, fired


def padded(text: np.ndarray) -> np.ndarray:
    """A text's bytes and the zero bytes that give its last ones a full window; an empty text is a zero byte."""
    return np.concatenate([text if len(text) else np.zeros(1, dtype=np.uint8), np.zeros(WIDTH - 1, dtype=np.uint8)])


def chunk_starts(length: int) -> np.ndarray:
    """Where the chunks of a text of ``length`` positions begin: every ``STEP``, each but a lone one longer than that."""
    return np.arange(max(1, -(-length // STEP) - 1)) * STEP


def pooled_steps(net: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum and sum of each filter over every ``STEP`` positions of a padded text, and the numbers of positions."""
    n = len(data) - WIDTH + 1
    most, total, count = [], [], []
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        _, fired = activations(net, data[a: b + WIDTH - 1])
        at = np.arange(0, b - a, STEP)
        most.append(np.maximum.reduceat(fired, at))
        total.append(np.add.reduceat(fired, at))
        count.append(np.diff(np.append(at, b - a)))
    return np.concatenate(most), np.concatenate(total), np.concatenate(count)


def chunk_features(net: Network, data: np.ndarray) -> np.ndarray:
    """Maxima and means of the filters of every chunk, made of two neighbouring steps."""
    most, total, count = pooled_steps(net, data)
    if len(count) > 1:
        most, total, count = np.maximum(most[:-1], most[1:]), total[:-1] + total[1:], count[:-1] + count[1:]
    return np.concatenate([most, total / count[:, None].astype(np.float32)], axis=1)


def logits(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """One logit for each text, from all its chunks."""
    if not texts:
        return np.zeros(0)
    features = [chunk_features(net, padded(t)) for t in texts]
    starts = np.cumsum([0] + [len(f) for f in features[:-1]])
    signs = np.maximum(np.concatenate(features) @ net.dense + net.dense_bias, 0)
    means = np.add.reduceat(signs, starts) / np.array([len(f) for f in features], dtype=np.float32)[:, None]
    return np.concatenate([np.maximum.reduceat(signs, starts), means], axis=1) @ net.out + net.bias[0]


def gradients(net: Network, chunks: np.ndarray, lengths: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> Network:
    """Of the mean log loss over documents; ``chunks`` are rows of one size with so many positions each, ``owner`` ascends."""
    n, width = chunks.shape
    positions = width - WIDTH + 1
    flat = chunks.reshape(-1)
    seen, fired = activations(net, flat)
    inside = np.concatenate([fired, np.zeros((WIDTH - 1, FILTERS), dtype=np.float32)]).reshape(n, width, FILTERS)[:, :positions]
    inside = inside * (np.arange(positions)[None, :] < lengths[:, None])[:, :, None]
    where = inside.argmax(axis=1)
    features = np.concatenate([inside.max(axis=1), inside.sum(axis=1) / lengths[:, None]], axis=1).astype(np.float32)
    signs = np.maximum(features @ net.dense + net.dense_bias, 0)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    number = np.diff(np.append(starts, n))
    best = np.maximum.reduceat(signs, starts)
    document = np.concatenate([best, np.add.reduceat(signs, starts) / number[:, None]], axis=1).astype(np.float32)
    chance = 1 / (1 + np.exp(-(document @ net.out + net.bias[0])))
    d_logit = ((chance - labels) / len(labels)).astype(np.float32)
    d_document = d_logit[:, None] * net.out[None, :]
    row = np.repeat(np.arange(len(starts)), number)
    winner = signs == best[row]
    winner = winner / np.maximum(np.add.reduceat(winner.astype(np.float32), starts), 1)[row]
    d_signs = (d_document[row, :HIDDEN] * winner + d_document[row, HIDDEN:] / number[row, None]) * (signs > 0)
    d_features = d_signs @ net.dense.T
    d_inside = np.repeat(d_features[:, None, FILTERS:] / lengths[:, None, None], positions, axis=1)
    np.add.at(d_inside, (np.arange(n)[:, None], where, np.arange(FILTERS)[None, :]), d_features[:, :FILTERS])
    d_fired = np.zeros((n, width, FILTERS), dtype=np.float32)
    d_fired[:, :positions] = d_inside * (inside > 0)
    d_fired = d_fired.reshape(-1, FILTERS)[: len(seen)]
    d_seen = (d_fired @ net.filters.T).reshape(-1, WIDTH, EMBEDDED)
    d_flat = np.zeros((len(flat), EMBEDDED), dtype=np.float32)
    for k in range(WIDTH):
        d_flat[k: k + len(d_seen)] += d_seen[:, k]
    d_embedding = np.stack([np.bincount(flat, weights=d_flat[:, e], minlength=256) for e in range(EMBEDDED)], axis=1).astype(np.float32)
    return Network(
        d_embedding, seen.T @ d_fired, d_fired.sum(axis=0), features.T @ d_signs, d_signs.sum(axis=0), document.T @ d_logit, d_logit.sum(keepdims=True),
    )


def learned(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = ROUNDS) -> Network:
    """The network after ``rounds`` batches, half of each class; a sample is a document's chunks and their numbers of positions."""
    rng = np.random.default_rng(SEED)
    net = fresh(rng)
    moment, power = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net]
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    for step in range(1, rounds + 1):
        drawn = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        chunks, lengths, owner = [], [], []
        for place, i in enumerate(drawn):
            held, positions = samples[i]
            picked = rng.permutation(len(held))[:CHUNKS_A_ROUND]
            chunks.append(held[picked])
            lengths.append(positions[picked])
            owner.append(np.full(len(picked), place))
        found = gradients(net, np.concatenate(chunks), np.concatenate(lengths), np.concatenate(owner), labels[drawn].astype(np.float32))
        rate = LEARNING_RATE * min(1.0, 2.0 * (1 - step / (rounds + 1)))
        weights = []
        for i, (w, g) in enumerate(zip(net, found)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            power[i] = 0.99 * power[i] + 0.01 * g * g
            change = (moment[i] / (1 - 0.9**step)) / (np.sqrt(power[i] / (1 - 0.99**step)) + 1e-8)
            weights.append((w - rate * (change + DECAY * w)).astype(np.float32))
        net = Network(*weights)
    return net


def training_chunks(text: np.ndarray) -> tuple[bytes, bytes]:
    """At most ``TRAIN_CHUNKS`` chunks spread over the whole text, filled with zero bytes to one size, and their numbers of positions."""
    data = padded(text)
    length = len(data) - WIDTH + 1
    starts = chunk_starts(length)
    if len(starts) > TRAIN_CHUNKS:
        starts = starts[np.linspace(0, len(starts) - 1, TRAIN_CHUNKS).round().astype(int)]
    size = CHUNK + WIDTH - 1
    return b"".join(data[a: a + size].tobytes().ljust(size, b"\0") for a in starts), np.minimum(CHUNK, length - starts).astype(np.int32).tobytes()


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int = TRAIN_PER_CLASS) -> pd.DataFrame:
    """label, chunks, lengths of at most ``per_class`` documents of each class, in order of a hash of the id.

    At most 2 * ``per_class`` ids are drawn from the labels, so they are broadcast to the documents.
    """

    def cut(batches):
        for batch in batches:
            data, offsets = grams.text_bytes(batch.column("text"))
            made = [training_chunks(data[a:b]) for a, b in zip(offsets, offsets[1:])]
            columns = [batch.column("id"), batch.column("label"), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "chunks", "lengths"])

    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # About twice as many as wanted are ranked; the rank alone is the bound.
    ranked = known.join(F.broadcast(sizes), "label").withColumn("draw", share).where(F.col("draw") * F.col("size") < 2 * per_class + 100)
    order = Window.partitionBy("label").orderBy("draw", "doc_id")
    drawn = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_class).select("doc_id", "label")
    texts = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "label", "text")
    rows = texts.mapInArrow(cut, "id string, label int, chunks binary, lengths binary")
    rows = rows.groupBy("id", "label").agg(F.min(F.struct("chunks", "lengths")).alias("cut")).select("id", "label", "cut.chunks", "cut.lengths")
    return rows.toPandas().sort_values("id", kind="stable").reset_index(drop=True)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = TRAIN_PER_CLASS, rounds: int = ROUNDS) -> Network | float:
    """The network of the labelled rows; without two classes the one score that all texts get."""
    sample = labelled_sample(documents, labels, label, per_class)
    marks = sample["label"].to_numpy()
    if len(set(marks)) < 2:
        return float(marks[0]) if len(marks) else 0.5
    size = CHUNK + WIDTH - 1
    samples = [(np.frombuffer(c, dtype=np.uint8).reshape(-1, size), np.frombuffer(n, dtype=np.int32)) for c, n in zip(sample["chunks"], sample["lengths"])]
    net = learned(samples, marks, rounds)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    return net._replace(bias=net.bias + np.float32(np.log(sizes[1] / sizes[0])))


def score(documents: DataFrame, model: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with score and predicted (1 from ``threshold`` on)."""
    kept = documents.drop(*RESULTS)
    if not isinstance(model, Network):
        chance = F.lit(float(model))
    else:
        shared = documents.sparkSession.sparkContext.broadcast(tuple(model))

        @F.pandas_udf("double")
        def chance_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            net = Network(*shared.value)
            for series in batches:
                data, offsets = grams.text_bytes(pa.array(series, pa.string(), from_pandas=True))
                found = np.empty(len(series))
                for first, last in grams.pieces(offsets):
                    found[first:last] = logits(net, [data[a:b] for a, b in zip(offsets[first:last], offsets[first + 1: last + 1])])
                yield pd.Series(1 / (1 + np.exp(-np.clip(found.astype(np.float64), -500, 500))))

        chance = chance_of("text")
    scored = kept.select("*", chance.alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
