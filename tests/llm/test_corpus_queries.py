"""The corpus queries with SQL against DuckDB, the others against brute force, on the smallest tables."""

import hashlib
import math
import os
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from check_queries import compare  # noqa: E402
from patronlens.llm import packing  # noqa: E402
from patronlens.llm.queries import ORACLE, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def read(sql):
    return duckdb.connect().execute(sql.replace("$", FOLDER)).fetchall()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    status, _, _, note = compare(spark, FOLDER, name, QUERIES[name], ORACLE[name])
    assert status == "ok", note


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_toxicity_finds_the_held_out_toxic_texts(spark):
    labels = dict(read("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'"))
    rows = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (crc(r.doc_id) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic = [r.score for r in held if labels[r.doc_id]]
    clean = [r.score for r in held if not labels[r.doc_id]]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85
    assert sum(s >= 0.7 for s in clean) <= 0.05 * len(clean)


def test_language_of_held_out_texts(spark):
    langs = dict(read("SELECT doc_id, lang FROM '$/documents.parquet'"))
    rows = QUERIES["op10_language"](spark, FOLDER).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and held and all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95


def test_language_model_counts_and_base_score(spark):
    texts = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in read("SELECT doc_id, text FROM '$/documents.parquet'")}
    counts = Counter(w for i, words in texts.items() if crc(i) % 10 for w in words)
    total, distinct = sum(counts.values()), len(counts)
    rows = QUERIES["op5_lm_scoring"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        words = texts[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r.held_out == (crc(r.doc_id) % 10 == 0) and math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)


def test_packing_round_trip(spark):
    texts = dict(read("SELECT doc_id, text FROM '$/documents.parquet'"))
    encoder, pieces = packing.encoding(packing.read_vocabulary()), {}
    for r in QUERIES["op7_packing"](spark, FOLDER).collect():
        ids, positions = np.frombuffer(r.input_ids, dtype="<u2"), np.frombuffer(r.position_ids, dtype="<u2")
        assert len(ids) == len(positions) == packing.LENGTH and r.cu_seqlens[-1] == r.n_ids <= packing.LENGTH
        assert (ids[r.n_ids:] == packing.END_ID).all()
        for doc_id, number, a, b in zip(r.doc_ids, r.piece_numbers, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (positions[a:b] == np.arange(b - a)).all()
            pieces[doc_id, number] = ids[a:b].tolist()
    back = {}
    for (doc_id, _), ids in sorted(pieces.items()):
        back.setdefault(doc_id, []).extend(ids)
    assert all(ids[-1] == packing.END_ID for ids in back.values())
    assert {i: encoder.decode(ids[:-1]) for i, ids in back.items()} == texts


def test_embedding_links(spark, tmp_path):
    table = read("SELECT vec_id, embedding FROM '$/embeddings.parquet' ORDER BY vec_id")
    rng, x = np.random.default_rng(7), np.array([v for _, v in table], dtype=np.float64)
    near = x[rng.integers(0, 200, 300)]
    x = np.concatenate([x, near + 0.05 * np.linalg.norm(near, axis=1, keepdims=True) * rng.normal(size=near.shape) / 4])
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    rows = QUERIES["op8_embedding_near_duplicates"](spark, str(tmp_path)).toPandas().set_index("vec_id").sort_index()
    assert rows["n_links"].sum() >= 0.97 * links.sum() > 0 and (rows["n_links"].to_numpy() <= links.sum(axis=1)).all()
    assert rows["audited_recall"].iloc[0] >= 0.9


def brute_near_groups(texts, size, percent):
    sets = {}
    for i, text in texts.items():
        w = text.encode().lower().split()
        sets[i] = {tuple(w[k: k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {i for i in ids if root(i) == i}


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    state, columns = docs, docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, FOLDER).cache()
        kept[name] = state.collect()
        assert state.columns == columns
    clean = {r.doc_id: r.text or "" for r in kept["toxicity"]}
    assert {r.doc_id for r in kept["near_dedup"]} == brute_near_groups(clean, 5, 80)
    leaked = {r.doc_id for r in QUERIES["op2_decontamination"](spark, FOLDER).collect() if r.contaminated}
    assert {r.doc_id for r in kept["decontamination"]} == {r.doc_id for r in kept["near_dedup"]} - leaked
    sizes = Counter()
    target = Counter()
    for r in kept["decontamination"]:
        sizes[r.source] += len((r.text or "").encode().split())
    for r in kept["mixing"]:
        target[r.source] += len((r.text or "").encode().split())
    assert max(Counter(r.doc_id for r in kept["mixing"]).values()) <= 3
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    level = sum(sizes.values()) / sum(weights.values())
    largest = max(len((r.text or "").split()) for r in kept["decontamination"])
    for source, size in sizes.items():
        if all(weights[s] * level < 3 * sizes[s] for s in sizes):
            assert abs(target[source] - weights[source] * level) <= 2 * largest
    packed = corpus_pipeline.STAGES[-1][1](spark, state, FOLDER).collect()
    ends = sum(np.frombuffer(r.input_ids, dtype="<u2")[: r.n_ids].tolist().count(packing.END_ID) for r in packed)
    assert ends == len(kept["mixing"])
    assert len({hashlib.sha256(r.input_ids).digest() + r.pack_id.encode() for r in packed}) == len(packed)
