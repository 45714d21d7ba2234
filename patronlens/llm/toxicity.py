"""Toxicity by a lexicon that also catches misspelled terms, scored in context windows.

The lexicon is learned from labelled rows: whole words and stems (beginnings of words) that toxic texts
hold far more often than clean ones. It is kept as a trie, and Levenshtein automata of its terms are run
against a word all at once: a state is a set of trie places with their edits, made when first met, so
a word is read letter by letter in a table. A place that is a stem's end accepts whatever follows.
Digits and signs that stand for letters are read as these.

Every hit weighs what the labelled rows say of its term, exact and misspelled apart. In its window of
words the weight is lowered inside quotation marks or after a verb of saying, and raised beside an
address of the reader; the strongest window, the sums, and the text's length go into a logistic score.

The fit uses a bounded sample: at most about ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled rows, chosen by a hash of
the id, and at most ``LEXICON`` terms. Scoring covers whole texts of all rows and shuffles nothing.

Defined cases: null and empty texts have no hits and get the score of no words; rows without a label or
text do not train; where one of the two labels is not met, every score is 0; repeated rows get equal
results; an empty table gives an empty table. Other columns pass through unless they bear a result's name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import unused

SAMPLE_TOXIC, SAMPLE_CLEAN, LEXICON = 4000, 8000, 4000
LEAST_DOCUMENTS, LEAST_WEIGHT = 3, 1.2
STEM = range(3, 10)
FUZZY_LENGTH, EDITS = 5, 1
WINDOW = 12
QUOTED, ADDRESSED = 0.35, 1.3
STATES = 60_000
MEMO = 300_000
THRESHOLD = 0.7
PENALTY = 3e-5
RESULTS = ["score", "predicted", "n_hits", "strongest"]
TOKEN = re.compile(r"[\w@$]+|[\"“”„«»]")
LIKE_LETTERS = str.maketrans("013457@$", "oieastas")
QUOTES = frozenset("\"“”„«»")
SAYING = frozenset("said says wrote writes quote quoted quotes called calls dit disait écrit sagte schrieb zitat dijo escribió cita".split())
READER = frozenset("you your youre ur u tu toi vous du dich dein ihr tú te usted".split())


def tokens(text: str) -> list[str]:
    """Words in lower case and quotation marks, in order."""
    found = TOKEN.findall(text.lower())
    return [w if w.isalpha() or w in QUOTES else w.translate(LIKE_LETTERS) for w in found]


class Term(NamedTuple):
    text: str
    stem: bool
    weight: float
    fuzzy_weight: float


class Matcher:
    """Trie of the terms and the lazily built table of the automata's joint states."""

    def __init__(self, terms: list[Term], edits: int = EDITS):
        self.terms, self.edits = terms, edits
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, term in enumerate(terms):
            node = 0
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][letter]
            self.ends[node].append(number)
        self.memo: dict[str, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.stems: list[tuple | None] = []
        self.wholes: list[tuple | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, places: set) -> int:
        waiting = list(places)
        while waiting:  # letters of the term left out of the word
            node, used = waiting.pop()
            if used < self.edits:
                for child in self.children[node].values():
                    if (child, used + 1) not in places and (child, used) not in places:
                        places.add((child, used + 1))
                        waiting.append((child, used + 1))
        key = frozenset(places)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            stem = whole = None
            for node, used in key:
                for number in self.ends[node]:
                    term = self.terms[number]
                    if used and len(term.text) < FUZZY_LENGTH:
                        continue
                    rank = (used, -len(term.text), number)
                    if term.stem:
                        stem = min(stem, rank) if stem else rank
                    whole = min(whole, rank) if whole else rank
            self.stems.append(stem)
            self.wholes.append(whole)
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        after = set()
        for node, used in self.sets[state]:
            child = self.children[node].get(letter)
            if child is not None:
                after.add((child, used))
            if used < self.edits:
                after.add((node, used + 1))
                after.update((c, used + 1) for c in self.children[node].values() if c != child)
        to = self._state(after) if after else -1
        self.steps[state][letter] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest and then longest term, or None."""
        found = self.memo.get(word, 0)
        if found == 0:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(self.sets) >= STATES:
                self._reset()
            state, best = self.start, None
            for letter in word:
                to = self.steps[state].get(letter)
                state = self._step(state, letter) if to is None else to
                if state < 0:
                    break
                stem = self.stems[state]
                if stem and (best is None or stem < best):
                    best = stem
            else:
                whole = self.wholes[state]
                if whole and (best is None or whole < best):
                    best = whole
            found = self.memo[word] = best and (best[2], best[0])
        return found


def hits_of(words: list[str], matcher: Matcher) -> list[tuple[int, int, int]]:
    """(place, term, edits) of every word that meets a term."""
    found = map(matcher.match, words)
    return [(i, hit[0], hit[1]) for i, hit in enumerate(found) if hit]


FEATURES = ["strongest", "exact", "fuzzy", "density", "words", "n_hits", "distinct", "any"]


def features_of(words: list[str], matcher: Matcher) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    hits = [h for h in hits_of(words, matcher) if (matcher.terms[h[1]].fuzzy_weight if h[2] else matcher.terms[h[1]].weight) > 0]
    if not hits:
        return [0.0, 0.0, 0.0, 0.0, float(np.log1p(len(words))), 0.0, 0.0, 0.0]
    quoted, inside = set(), False
    marks = [i for i, w in enumerate(words) if w in QUOTES]
    for a, b in zip(marks[::2], marks[1::2]):
        if b - a <= 60:
            quoted.update(range(a, b))
    weights = []
    for place, term, edits in hits:
        weight = matcher.terms[term].fuzzy_weight if edits else matcher.terms[term].weight
        near = words[max(0, place - WINDOW // 2): place + WINDOW // 2]
        if place in quoted or any(w in SAYING for w in words[max(0, place - 4): place]):
            weight *= QUOTED
        elif any(w in READER for w in near):
            weight *= ADDRESSED
        weights.append(weight)
    strongest, low, running = 0.0, 0, 0.0
    for high, (place, _, _) in enumerate(hits):
        running += weights[high]
        while hits[low][0] <= place - WINDOW:
            running -= weights[low]
            low += 1
        strongest = max(strongest, running)
    exact = sum(w for w, h in zip(weights, hits) if not h[2])
    fuzzy = sum(w for w, h in zip(weights, hits) if h[2])
    best: dict[int, float] = {}
    for weight, (_, term, _) in zip(weights, hits):
        best[term] = max(weight, best.get(term, 0.0))
    return [
        float(np.log1p(strongest)), float(np.log1p(exact)), float(np.log1p(fuzzy)), (exact + fuzzy) / len(words) ** 0.5,
        float(np.log1p(len(words))), float(len(hits)), sum(best.values()) / (1 + len(words)) ** 0.25, 1.0,
    ]


class Model(NamedTuple):
    terms: list[tuple]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """doc_id, text, label (0 or 1), weight of about so many labelled rows; the weight restores the label's share."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label")).where("doc_id IS NOT NULL")
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rate = {k: min(1.0, most / sizes[k]) for k, most in ((1, toxic), (0, clean)) if sizes.get(k)}
    chosen = known.where((F.col("label") == 1) & (draw < rate.get(1, 0.0)) | (F.col("label") == 0) & (draw < rate.get(0, 0.0)))
    weight = F.when(F.col("label") == 1, 1 / rate.get(1, 1.0)).otherwise(1 / rate.get(0, 1.0))
    chosen = chosen.select(F.col("doc_id").alias("_id"), "label", weight.alias("weight"))
    rows = documents.select("doc_id", "text").where("text IS NOT NULL")
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label", "weight")


def _log_odds(toxic, clean, n_toxic, n_clean, prior=0.5):
    return np.log((toxic + prior) / (n_toxic + 2 * prior)) - np.log((clean + prior) / (n_clean + 2 * prior))


def _term_counts(sample: DataFrame) -> DataFrame:
    """term, stem, toxic and clean numbers of sampled texts with the word or the beginning, for terms of enough toxic texts."""

    def count(batches):
        for batch in batches:
            sums: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = set(tokens(text)) - QUOTES
                sums.update((w, False, label) for w in words if len(w) > 2)
                sums.update((t, True, label) for t in {w[:n] for w in words for n in STEM if n < len(w)})
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array([k[2] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())],
                    names=["term", "stem", "label", "n"],
                )

    counts = sample.select("text", F.col("label").cast("long").alias("label")).mapInArrow(count, "term string, stem boolean, label long, n long")
    sums = counts.groupBy("term", "stem").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))
    return sums.where(F.col("toxic") >= LEAST_DOCUMENTS)


def _choose_terms(counts: pd.DataFrame, n_toxic: int, n_clean: int) -> list[Term]:
    """Words of enough weight, the shortest stems of enough weight, and below these stems the words known better."""
    counts = counts.assign(weight=_log_odds(counts["toxic"], counts["clean"], n_toxic, n_clean))
    strong = counts[(counts["weight"] >= LEAST_WEIGHT)]
    stems: dict[str, float] = {}
    for row in strong[strong["stem"]].assign(size=lambda d: d["term"].str.len()).sort_values(["size", "term"]).itertuples():
        shorter = [row.term[:n] for n in STEM if n < len(row.term)]
        if row.weight >= 2 * LEAST_WEIGHT and not any(s in stems and stems[s] >= row.weight - 0.7 for s in shorter):
            stems[row.term] = row.weight
    terms = [Term(t, True, float(w), 0.0) for t, w in stems.items()]
    for row in counts[~counts["stem"]].itertuples():
        below = any(row.term[:n] in stems for n in STEM)
        if below or row.weight >= 2 * LEAST_WEIGHT:
            terms.append(Term(row.term, False, float(row.weight) if row.weight >= LEAST_WEIGHT else 0.0, 0.0))
    return sorted(terms, key=lambda t: (-abs(t.weight), t.text, t.stem))


def logistic_weights(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of a logistic score and, last, its constant. More hits never lower the score and more words never raise it:
    the feature whose weight breaks this most is left out until none does."""
    z = np.column_stack([z, np.ones(len(z))])
    sign = np.array([-1.0 if f == "words" else 1.0 for f in FEATURES])
    used = np.append(np.ones(len(FEATURES), dtype=bool), True)
    while True:
        own = z[:, used]
        beta, penalty = np.zeros(own.shape[1]), np.append(np.full(own.shape[1] - 1, PENALTY), 0.0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(own @ beta, -30, 30)))
            step = np.linalg.solve((own * (w * p * (1 - p))[:, None]).T @ own + np.diag(penalty + 1e-9), own.T @ (w * (y - p)) - penalty * beta)
            beta = beta + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-8:
                break
        weights = np.zeros(z.shape[1])
        weights[used] = beta
        wrong = weights[:-1] * sign
        if wrong.min() >= 0:
            return weights
        used[int(wrong.argmin())] = False


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", lexicon: int = LEXICON) -> Model | None:
    """The model of the labelled rows; None where one of the labels is missing. ``labels`` has the rows to learn from."""
    sample = labelled_sample(documents, labels, label)
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return None
    counts = _term_counts(sample).withColumn("odds", F.log((F.col("toxic") + 0.5) / n_toxic) - F.log((F.col("clean") + 0.5) / n_clean))
    counts = counts.orderBy(F.col("odds").desc(), F.col("toxic").desc(), "term", "stem").limit(10 * lexicon).toPandas()
    terms = _choose_terms(counts, n_toxic, n_clean)[:lexicon]
    shared = sample.sparkSession.sparkContext.broadcast([tuple(t) for t in terms])

    def fuzzy_counts(batches):
        matcher = Matcher([Term(*t) for t in shared.value])
        for batch in batches:
            sums: Counter = Counter()
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                sums.update((t, mark) for t in {t for _, t, e in hits_of(tokens(text), matcher) if e})
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["term", "label", "n"])

    slim = sample.select("text", F.col("label").cast("long").alias("label"), F.col("weight").cast("double").alias("weight"))
    met = slim.select("text", "label").mapInArrow(fuzzy_counts, "term long, label long, n long").groupBy("term", "label").agg(F.sum("n").alias("n")).collect()
    met = {(r[0], r[1]): r[2] for r in met}
    weighed = []
    for number, term in enumerate(terms):
        toxic, clean = met.get((number, 1), 0), met.get((number, 0), 0)
        odds = float(_log_odds(toxic, clean, n_toxic, n_clean, 1.0)) if toxic + clean else 0.5 * term.weight
        weighed.append(tuple(term._replace(fuzzy_weight=min(term.weight, odds) if odds >= LEAST_WEIGHT else 0.0)))
    ready = sample.sparkSession.sparkContext.broadcast(weighed)

    def featurize(batches):
        matcher = Matcher([Term(*t) for t in ready.value])
        for batch in batches:
            rows = [features_of(tokens(t), matcher) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "weight", "x"])

    rows = slim.mapInArrow(featurize, "label long, weight double, x array<double>").toPandas()
    x, y, w = np.array(rows["x"].tolist()), rows["label"].to_numpy(dtype=float), rows["weight"].to_numpy()
    order = np.lexsort((y, *x.T))
    x, y, w = x[order], y[order], w[order] / w.sum()
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    beta = logistic_weights((x - mean) / scale, y, w)
    return Model(weighed, mean, scale, beta)


def score(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with score, predicted (1 from the threshold up), n_hits and the strongest window's weight."""
    kept = documents.drop(*RESULTS)
    if model is None:
        return kept.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "n_hits": F.lit(0), "strongest": F.lit(0.0)})
    shared = documents.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("score double, predicted int, n_hits int, strongest double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        matcher = Matcher([Term(*t) for t in own.terms])
        for texts in batches:
            x = np.array([features_of(tokens(t or ""), matcher) for t in texts]).reshape(len(texts), -1)
            chance = 1 / (1 + np.exp(-np.clip((x - own.mean) / own.scale @ own.weights[:-1] + own.weights[-1], -30, 30)))
            yield pd.DataFrame({"score": chance, "predicted": (chance >= threshold).astype(np.int32), "n_hits": x[:, 5].astype(np.int32), "strongest": np.expm1(x[:, 0])})

    (judged,) = unused(kept, "judged")
    return kept.withColumn(judged, judge("text")).select("*", f"{judged}.*").drop(judged)
