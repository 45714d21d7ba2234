"""Language by a blended-spectrum string kernel with Nyström landmarks and ridge regression.

Two texts are alike by the number of byte 1-, 2- and 3-grams present in both, over the root of the
product of their numbers of grams. Landmarks are some texts of each language; the Nyström map turns a
text's similarities to them into features on which one ridge regression per language is solved. Texts
are scored in batches: a presence matrix times the landmark matrix gives the similarities, and these
times the coefficients the scores. Grams that no landmark has are outside the feature space.

The fit uses a bounded sample of labelled rows: about ``TRAIN_PER_LANGUAGE`` texts of each language, chosen by
a hash of the id, the first ``LANDMARKS_PER_LANGUAGE`` of them as landmarks, of the ``MAX_LANGUAGES`` languages
with most rows (ties by name); rarer ones are not learned. Scoring covers whole texts of all rows and shuffles nothing.

Defined cases: text that is null or has no letter is ``und`` with score 0; rows without a language or
text do not train; with nothing to learn from every text is ``und``; repeated rows get equal results; an
empty table gives an empty table. Other columns pass through unless they bear a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.llm import grams
from patronlens.llm.common import unused

TRAIN_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE, MAX_LANGUAGES = 240, 32, 400
RIDGE, SHARPNESS = 1e-2, 6.0
BATCH = 128
RESULTS = ["lang_pred", "score"]
CODES = 1 << 24

#: Bytes as the kernel sees them: ASCII letters in lower case, bytes of other letters as they are, the rest a space.
FOLDED = np.full(256, 0x20, dtype=np.uint8)
FOLDED[0x80:] = np.arange(0x80, 0x100)
FOLDED[97:123] = np.arange(97, 123)
FOLDED[65:91] = np.arange(97, 123)


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray
    landmarks: np.ndarray
    coefficients: np.ndarray
    bias: np.ndarray


def gram_codes(text: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text's bytes; folded bytes are never 0, so the lengths keep apart."""
    b = FOLDED[text].astype(np.int32)
    return np.concatenate([b, b[:-1] << 8 | b[1:], b[:-2] << 16 | b[1:-1] << 8 | b[2:]])


def _presence_rows(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = grams.text_bytes(column)
    for row in range(len(offsets) - 1):
        yield gram_codes(data[offsets[row]: offsets[row + 1]])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def training_sample(documents: DataFrame, train: Column, label: str, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """doc_id, text, label of about ``per_language`` training rows of each language, by a hash of the id."""
    usable = documents.where(train & F.col(label).isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(MAX_LANGUAGES).collect()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = F.lit(False)
    for language, n in sizes:
        chosen = chosen | ((F.col(label) == language) & (draw < per_language / n))
    return usable.where(chosen).select("doc_id", "text", F.col(label).alias("label"))


def fit(documents: DataFrame, train: Column, label: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, landmarks_each: int = LANDMARKS_PER_LANGUAGE) -> Model | None:
    """The model of the sampled training rows; None without any. The driver receives gram sets of the sample only."""

    def gram_sets(batches):
        for batch in batches:
            sets = [np.unique(c).astype(np.int32).tobytes() for c in _presence_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(sets, pa.binary())], names=["doc_id", "label", "grams"])

    sample = training_sample(documents, train, label, per_language).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label")
    rows = sample.mapInArrow(gram_sets, "doc_id string, label string, grams binary").toPandas()
    rows = rows[rows["grams"].map(len) > 0].sort_values(["label", "doc_id"], kind="stable").reset_index(drop=True)
    if rows.empty:
        return None
    sets = [np.frombuffer(g, dtype=np.int32) for g in rows["grams"]]
    languages = sorted(rows["label"].unique())
    chosen = [i for _, part in rows.groupby("label") for i in part.index[:landmarks_each]]
    codes = np.unique(np.concatenate([sets[i] for i in chosen]))

    def similarities(indices, landmarks):
        held = np.zeros((len(indices), len(codes)), dtype=np.float32)
        for r, i in enumerate(indices):
            held[r, np.searchsorted(codes, np.intersect1d(sets[i], codes, assume_unique=True))] = 1
        norm = np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))
        return held / norm if landmarks is None else (held / norm) @ landmarks

    landmarks = similarities(chosen, None).T.copy()
    kernel = np.concatenate([similarities(range(i, min(i + BATCH, len(sets))), landmarks) for i in range(0, len(sets), BATCH)]).astype(np.float64)
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    solid = values > 1e-6 * values.max()
    whiten = vectors[:, solid] / np.sqrt(values[solid])
    features = kernel @ whiten
    target = np.where(rows["label"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = 1.0 / rows.groupby("label")["label"].transform("size").to_numpy()[:, None]
    weight = share / share.sum()
    mean_x, mean_y = (weight * features).sum(axis=0), (weight * target).sum(axis=0)
    centred = features - mean_x
    inner = centred.T @ (weight * centred) + RIDGE / len(rows) * np.eye(features.shape[1])
    solved = np.linalg.solve(inner, centred.T @ (weight * (target - mean_y)))
    return Model(languages, codes, landmarks, (whiten @ solved).astype(np.float32), (mean_y - mean_x @ solved).astype(np.float32))


class Scorer:
    """The model with its gram table (64 MB), built once in each task."""

    def __init__(self, model: Model):
        self.model = model
        self.place = np.full(CODES, len(model.codes), dtype=np.int32)
        self.place[model.codes] = np.arange(len(model.codes))
        self.held = np.zeros((BATCH, len(model.codes) + 1), dtype=np.float32)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        held = self.held[: len(rows)]
        held[:] = 0
        for r, codes in enumerate(rows):
            held[r, self.place[codes]] = 1
        found = held[:, :-1]
        similar = (found @ self.model.landmarks) / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))
        return similar @ self.model.coefficients + self.model.bias


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` with lang_pred and score (the softmax share of the best language)."""
    kept = documents.drop(*RESULTS)
    if model is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = documents.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Model(*shared.value))
        names = np.array(scorer.model.languages, dtype=object)
        for series in batches:
            column = pa.array(series, pa.string(), from_pandas=True)
            best, score, held = [], [], []

            def flush():
                margins = scorer.scores(held).astype(np.float64) * SHARPNESS
                shares = np.exp(margins - margins.max(axis=1, keepdims=True))
                shares /= shares.sum(axis=1, keepdims=True)
                best.extend(names[shares.argmax(axis=1)])
                score.extend(shares.max(axis=1))
                held.clear()

            for codes in _presence_rows(column):
                held.append(codes)
                if len(held) == BATCH:
                    flush()
            if held:
                flush()
            blank = [not has_letter(t) for t in series]
            yield pd.DataFrame({"lang_pred": np.where(blank, "und", np.array(best, dtype=object)), "score": np.where(blank, 0.0, np.array(score, dtype=float))})

    (judged,) = unused(kept, "judged")
    return kept.withColumn(judged, judge("text")).select("*", f"{judged}.lang_pred", f"{judged}.score").drop(judged)
