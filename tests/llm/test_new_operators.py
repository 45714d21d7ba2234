"""Filter audit, phrases and the byte network: defined cases, and plain computations where SQL is not enough."""

import random
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from patronlens.llm import byte_network, filter_audit, phrases
from patronlens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, mask string, part string, key string, score string, w0 string, n string, block string"
EXTRA = ("m", "p", "k", "s", "w", "n", "b")
LONG = " ".join(f"word{i % 700}" for i in range(30_000))


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    shout = "LOUD " * 300
    rows = [
        (1, "a b # c", "en"), (2, "a b # c", "en"), (3, None, "en"), (4, "", "de"), (5, " \t\n", None), (6, LONG, "en"), (7, LONG, ""), (8, shout, "fr"),
        (9, "x" * 90_000, "fr"), (None, "a b # c", "en"), (None, None, None), (1, "a b # c", "en"), (1, "other | text", None), (0, "other | text", "de"), (10, "Ünï çödé 中文字", "en"),
    ]
    return rows


def plain_masks(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    masks = []
    for i, text, lang in rows:
        text = text or ""
        words = text.encode().split()
        mask = (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
        mask += 8 * any(c in "#$%&*|" for c in text) + 16 * (i is not None and i > least[text])
        masks.append((i, lang or "", int(mask)))
    return masks


def test_flags_of_odd_rows(spark, odd):
    got = [tuple(r) for r in filter_audit.flagged(frame(spark, odd)).select("doc_id", "part", "mask").collect()]
    none_last = lambda t: (t[0] is None, *(v for v in t if v is not None))
    assert sorted(got, key=none_last) == sorted(plain_masks(odd), key=none_last)
    assert filter_audit.flagged(frame(spark, odd).limit(0)).count() == 0


def test_audit_equals_filters_applied_one_after_the_other(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (6, 0, 1), (8, 1, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    good, toxic = {1, 2, 8}, {1, 6, 8}
    flags = filter_audit.flagged(frame(spark, odd))
    got = {(r["part"], r["filter_order"], r["step"]): r.asDict() for r in filter_audit.audit(filter_audit.mask_counts(flags, labels)).collect()}
    masks = plain_masks(odd)
    parts = {p for _, p, _ in masks}
    assert len(got) == len(parts) * 600
    for part in parts:
        mine, shapley = [(i, m) for i, p, m in masks if p == part], Counter()
        want = {}
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                removed = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                shapley[f] += len(removed)
                want["".join(order), step] = [
                    len(left), len(removed), sum(bool(m & bit) for _, m in mine) - len(removed), sum(m == bit for _, m in mine),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                ]
        for (order, step), counts in want.items():
            row = got[part, order, step]
            assert [row[c] for c in filter_audit.RESULTS] == [*counts, shapley[order[step - 1]]]
    assert filter_audit.audit(filter_audit.mask_counts(flags.limit(0), labels)).count() == 0


def test_the_sketch_never_clears_a_repeat(spark, monkeypatch):
    """At one block nearly everything is possible, at many nearly nothing else; the flags are the same."""
    rows = [(i, f"text {i if i % 3 else i // 30}", "en") for i in range(600)]
    want = sorted(plain_masks(rows))
    for most in (1, 1 << 20):
        monkeypatch.setattr(filter_audit, "MAX_BLOCKS", most)
        assert sorted(tuple(r) for r in filter_audit.flagged(frame(spark, rows)).collect()) == want
    keys = frame(spark, rows).select(F.xxhash64("text").alias("key"))
    blocks = filter_audit.blocks_for(600)
    possible = filter_audit.possible_repeats(keys, filter_audit.sketch(keys, blocks), blocks).count()
    repeated = sum(1 for i, t, _ in rows if sum(t == u for _, u, _ in rows) > 1)
    assert repeated <= possible < 0.5 * (repeated + 600)


def plain_phrases(rows, longest, least, top):
    """All phrases of every piece counted one by one, in plain Python."""
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(end, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang or "und", tuple(words[i: i + size])] += 1
    found = []
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        around = [b for (other, longer), b in candidates.items() if other == lang and len(longer) > len(words)
                  and any(longer[i: i + len(words)] == words for i in range(len(longer) - len(words) + 1))]
        if any(100 * b >= 50 * a for b in around):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    result = []
    for lang in {f[0] for f in found}:
        mine = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))
        result += [(f[0], i, *f[1:]) for i, f in enumerate(mine[:top], 1)]
    return sorted(result)


@pytest.mark.parametrize("longest, least, top", [(3, 4, 2000), (3, 2, 5), (4, 3, 2000)])
def test_phrases_equal_plain_counts(spark, longest, least, top):
    rng = random.Random(longest * least)
    vocabulary = ["the", "of", "The", "new", "york", "city", "hall", "é", "ÉÉ", "x\x0by", "a-b", "中"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) for _ in range(60)), rng.choice(["en", "de", None])) for i in range(30)]
    rows += [(100 + i, "new york city hall stands. of the new york", "en") for i in range(12)]
    rows += [(200, None, "en"), (201, "", None), (202, " \t ,, ..", "de"), (None, "one word each", "it"), (7, rows[0][1], rows[0][2])]
    got = phrases.collocations(frame(spark, rows), longest=longest, min_count=least, top=top).select("part", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, longest, least, top)


def test_phrases_of_a_hot_text_and_of_none(spark):
    rows = [(i, "buy now " * 50, "en") for i in range(40)] + [(99, LONG, "en")]
    got = phrases.collocations(frame(spark, rows)).select("part", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 3, 10, 2000)
    assert phrases.collocations(frame(spark, rows).limit(0)).count() == 0


def test_scores_of_huge_counts_are_exact(spark):
    counts = spark.createDataFrame([("en", "a b", 2, 10**12 - 1), ("en", "a", 1, 10**12 + 7), ("en", "b", 1, 3 * 10**12)], "part string, phrase string, size int, f long")
    row = phrases.scored(counts).first()
    assert row["score"] == 1_000_000 * (10**12 - 1) ** 2 // ((10**12 + 7) * 3 * 10**12)


def test_network_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = byte_network.fresh(rng)
    chunks, lengths = rng.integers(0, 256, (6, 40)).astype(np.uint8), np.array([33, 20, 33, 5, 33, 12])
    owner, labels = np.array([0, 0, 1, 2, 2, 3]), np.array([0, 1, 1, 0], dtype=np.float32)

    def loss(net):
        total = 0.0
        for d in range(4):
            signs = []
            for c, n in zip(chunks[owner == d], lengths[owner == d]):
                fired = byte_network.activations(net, c)[1][:n]
                signs.append(np.maximum(np.concatenate([fired.max(axis=0), fired.mean(axis=0)]) @ net.dense + net.dense_bias, 0))
            signs = np.array(signs)
            chance = 1 / (1 + np.exp(-(np.concatenate([signs.max(axis=0), signs.mean(axis=0)]) @ net.out + net.bias[0])))
            total -= np.log(chance if labels[d] else 1 - chance) / 4
        return total

    found = byte_network.gradients(net, chunks, lengths, owner, labels)
    for name in net._fields:
        weights, slope = getattr(net, name), getattr(found, name)
        place = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        up, down = weights.copy(), weights.copy()
        up[place] += 1e-2
        down[place] -= 1e-2
        assert slope[place] == pytest.approx((loss(net._replace(**{name: up})) - loss(net._replace(**{name: down}))) / 2e-2, rel=2e-2)


@pytest.mark.parametrize("length", [0, 1, 7, 255, 256, 257, 511, 512, 513, 768, 5000, 50_000])
def test_chunks_cover_the_whole_text(length):
    """Features made in blocks equal those of every chunk by itself, and the last byte is in the last chunk."""
    rng = np.random.default_rng(length)
    net, text = byte_network.fresh(rng), rng.integers(1, 256, length).astype(np.uint8)
    data = byte_network.padded(text)
    positions = len(data) - byte_network.WIDTH + 1
    starts = byte_network.chunk_starts(positions)
    assert positions == max(1, length) and starts[-1] + byte_network.CHUNK >= positions
    fired = byte_network.activations(net, data)[1]
    want = [np.concatenate([fired[a: a + byte_network.CHUNK].max(axis=0), fired[a: a + byte_network.CHUNK].mean(axis=0)]) for a in starts]
    np.testing.assert_allclose(byte_network.chunk_features(net, data), np.array(want), rtol=1e-4, atol=1e-5)


def test_quality_of_odd_rows(spark, odd):
    documents = frame(spark, odd + [(100 + i, ("good plain words here " if i % 2 else "BAD!! NOISE!! $$$ ") * 9, "en") for i in range(40)])
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(100, 0), (None, 1), (9999, 1)], "doc_id long, quality int")
    net = byte_network.fit(documents, labels, rounds=40)
    scored = byte_network.score(documents, net)
    assert scored.columns == [*[c for c in documents.columns if c != "score"], "score", "predicted"]
    found = scored.collect()
    assert len(found) == len(odd) + 40 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    by_text = {}
    for r in found:
        assert by_text.setdefault(r["text"] or "", r["score"]) == pytest.approx(r["score"], abs=1e-6)
    assert np.mean([r["score"] for r in found if (r["doc_id"] or 0) >= 100 and r["doc_id"] % 2]) > np.mean([r["score"] for r in found if (r["doc_id"] or 0) >= 100 and r["doc_id"] % 2 == 0])
    assert byte_network.score(documents.limit(0), net).count() == 0
    assert byte_network.fit(documents, labels.where("quality = 1")) == 1.0
    assert {r["score"] for r in byte_network.score(documents, byte_network.fit(documents, labels.limit(0))).collect()} == {0.5}


def test_quality_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    known = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    rows = QUERIES["op13_quality"](spark, folder).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    good, bad = ([r["score"] for r in held if known[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.9
    assert np.mean([r["predicted"] for r in held if known[r["doc_id"]]]) > 0.95
