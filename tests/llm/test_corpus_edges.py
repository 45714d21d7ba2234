"""Defined cases of the corpus operators: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patronlens.llm import bloom, decontamination, grams, language, lm_scoring, mixing, near_duplicates, packing, toxicity, url_filter, vector_graph, warc_fixity
from patronlens.llm.common import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _row string, n string"
LONG = " ".join(f"word{i % 700}" for i in range(30_000))
CLEAN = "the quick brown fox jumps over the lazy dog near a calm river bank today"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, CLEAN, "en", "a", 5, "x", "y", "z"), (1, CLEAN, "en", "a", 5, "x", "y", "z"), (2, CLEAN, None, None, None, None, None, None),
        (3, None, "en", "a", None, "s", None, None), (4, "", "en", "b", 0, "s", None, None), (5, " \t\n ", "de", "b", 0, "s", None, None),
        (6, LONG, "en", "b", 1, "s", None, None), (7, "x" * 9000, "fr", "c", 1, "s", None, None), (None, CLEAN, "en", None, 1, "s", None, None),
        (None, None, None, None, None, None, None, None), (8, "Ünï çödé 中文字 text 123 --- !!", "en", "c", 1, "s", None, None), (9, "one two", "en", "c", 1, "s", None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_equal_pythons_split():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbZ é\t\n\x0b\x0c\r 中") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    found = []
    for size in (16, 1 << 20):
        rows, hashes = [], {}
        for piece in grams.words(pa.array(texts), size):
            for r in range(piece.last - piece.first):
                span = range(piece.rows[r], piece.rows[r + 1])
                rows.append([bytes(piece.data[piece.starts[i]: piece.ends[i]]) for i in span])
                for i, word in zip(span, rows[-1]):
                    assert hashes.setdefault(int(piece.hashes[i]), word) == word
        found.append(rows)
    assert found[0] == found[1] == [(t or "").encode().lower().split() for t in texts]


def test_connected(spark):
    pairs = [(i, i + 1) for i in range(30, 60)] + [(5, 7), (9, 7), (7, 5), (3, 3), (None, 2), (80, 60)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 30 for i in range(30, 61)}, 80: 30, 5: 5, 7: 5, 9: 5}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys, rows = spark.range(0, 500).select(F.col("id").cast("string").alias("k")), spark.range(0, 5000).select(F.col("id").cast("string").alias("key"))
    for most in (1, 1 << 18):
        flagged = bloom.probe(rows, "key", keys, "k", "maybe", most).collect()
        assert len(flagged) == 5000 and all(r.maybe for r in flagged if int(r.key) < 500)
    assert sum(r.maybe for r in flagged) < 700


def naive_match(word, terms):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + row[1:], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    best = None
    for number, term in enumerate(terms):
        ends = [word[:n] for n in range(1, len(word) + 1)] if term.stem else [word]
        edits = min(distance(term.text, e) for e in ends)
        if edits == 0 or edits == 1 and len(term.text) >= toxicity.FUZZY_LENGTH:
            rank = (edits, -len(term.text), number)
            best = min(best, rank) if best else rank
    return best and (best[2], best[0])


def test_automata_equal_edit_distance():
    rng = random.Random(5)
    terms = [toxicity.Term("".join(rng.choice("abc") for _ in range(rng.randint(3, 7))), bool(rng.getrandbits(1)), 1.0, 1.0) for _ in range(25)]
    terms = [toxicity.Term(*t) for t in dict.fromkeys(map(tuple, terms))]
    matcher = toxicity.Matcher(terms)
    for _ in range(1500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        assert matcher.match(word) == naive_match(word, terms), word


def test_toxicity_of_odd_rows(spark, odd, none):
    bad = [(100 + i, f"you are an idiot and a moron number{i}") for i in range(20)] + [(200 + i, f"a calm day by the river number{i}") for i in range(20)]
    train = spark.createDataFrame(bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in bad] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    more = spark.createDataFrame([(1, "you idiiot , m0ron"), (2, 'she said "idiot" once'), (3, "idiot idiot idiot"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(more, model).collect()}
    assert got[1].n_hits >= 2 and got[2].strongest < got[3].strongest and min(got[1].score, got[3].score) > 0.7 > got[4].score == got[5].score
    rows = toxicity.score(odd, model)
    assert rows.count() == odd.count() and set(odd.columns) <= set(rows.columns)
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(more, toxicity.fit(none, labels)).collect()} == {0.0}


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, CLEAN), (2, "Two!"), (3, None), (4, "--"), (5, CLEAN.upper())], "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontamination.hit_documents(odd, items).collect())
    assert len(got) == odd.count()
    assert (False, 1, 15, 15, ["1", "5"]) in got and (True, None, 15, 15, ["1", "5"]) in got and (False, 9, 2, 1, ["2"]) in got
    assert (False, 3, 0, 0, []) in got and (False, 4, 0, 0, []) in got and (False, 6, 30_000, 0, []) in got
    kept = decontamination.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5
    assert decontamination.hit_documents(odd, items.where("false")).where("n_hit > 0").count() == 0
    assert decontamination.hit_documents(none, items).count() == 0


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in near_duplicates.components(odd).collect())
    assert got == sorted([(1, 11, 1), (1, 11, 1), (2, 11, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 700, 6), (7, 1, 7), (-1, 11, None), (-1, 0, None), (8, 3, 8), (9, 1, 9)])
    kept = near_duplicates.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert near_duplicates.components(none).count() == 0


def test_large_families_are_cut_without_losing_links(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = {r.doc_id: r.component_id for r in near_duplicates.components(docs, 3, 70).collect()}
    cut = {r.doc_id: r.component_id for r in near_duplicates.components(docs, 3, 70, piece_shingles=22_000).collect()}
    assert whole == cut and set(whole.values()) == {0}


def _components_by_brute_force(rows, shingle, percent):
    sets = {}
    for i, text in rows:
        words = text.split()
        sets[i] = {tuple(words[j: j + shingle]) for j in range(len(words) - shingle + 1)}
    head = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((head[i], head[j]))
                head = {k: low if h == high else h for k, h in head.items()}
    return head


def _loose_crowd(size):
    """Texts of one base whose likeness lies on both sides of seventy per cent, so that their family holds several components."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(size):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([5, 6])):
            words[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_links_between_pieces_of_a_cut_family_are_found(spark):
    rows = _loose_crowd(70)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = _components_by_brute_force(rows, 3, 70)
    assert 1 < len(set(expected.values())) < 70
    got = {r.doc_id: r.component_id for r in near_duplicates.components(docs, 3, 70, piece_shingles=2_500).collect()}
    assert got == expected


def test_links_beyond_the_nearest_neighbours_are_found(spark):
    rows = _loose_crowd(70)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = _components_by_brute_force(rows, 3, 70)
    for options in ({"neighbours": 1}, {"neighbours": 1, "piece_shingles": 2_500}):
        assert {r.doc_id: r.component_id for r in near_duplicates.components(docs, 3, 70, **options).collect()} == expected


def test_mixing_of_odd_rows(spark, odd, none):
    rows = mixing.plan(odd).collect()
    assert sum(r.rows for r in rows) == odd.count() and all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in rows)
    total = sum(r.size * r.rows for r in rows)
    targets = {r.source: r.target for r in rows}
    sizes = {r.source: r.source_size for r in rows}
    assert math.isclose(sum(targets.values()), total) and all(targets[s] <= 3 * sizes[s] + 1e-6 for s in targets)
    assert mixing.mixture(odd).columns == odd.columns and mixing.plan(none).count() == 0


def test_water_level_with_capped_sources(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 20), ("d", 5), (None, 700)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert {s: got[s] for s in "bcd"} == {"b": 30.0, "c": 60.0, "d": 15.0} and math.isclose(sum(got.values()), 1735)
    assert math.isclose(got[None] / got["a"], 2.0)


def test_repeats_equal_a_plain_loop():
    rng = random.Random(2)
    rows = np.sort(np.array([rng.randrange(6) for _ in range(400)]))
    words = np.array([rng.randrange(1, 5) for _ in range(400)], dtype=np.uint64)
    value = np.log10(np.full(400, 0.2))
    got, want = lm_scoring.with_repeats(words, rows, value), []
    for row in range(6):
        followed, score, behind = {}, {False: [0.4, 1.0], True: [9.0, 10.0]}, False
        own = [int(w) for w in words[rows == row]]
        for i, word in enumerate(own):
            expected = followed.get(tuple(own[i - 2: i])) if i >= 2 else None
            chance = 0.2
            now = False
            if expected is not None:
                true, tries = score[behind]
                now = expected == word
                chance = true / tries * now + (1 - true / tries) * 0.2
                score[behind] = [true + now, tries + 1]
            if i >= 2:
                followed[tuple(own[i - 2: i])] = word
            behind = now
            want.append(math.log10(chance))
    assert np.allclose(got, want)


def test_bit_chances_sum_to_one(spark):
    words = [b"aa", b"ab", b"ba", lm_scoring.END, b"a" * 150]
    counts = np.array([9, 3, 1, 4, 1])
    shape = lm_scoring.Shape(12, 14, lm_scoring.trie_checks(words, counts, 14))
    tables = np.zeros((2, shape.places), dtype=np.float32)
    lm_scoring.added_counts(tables, words, counts, shape)
    weights = lm_scoring.first_weights()
    sums = np.zeros((2, 256 * lm_scoring.LEVELS))
    mass = lm_scoring.online_mix(tables, words, counts, shape, weights, np.zeros_like(weights), sums)
    assert math.isclose(sums[0].sum(), mass)
    ready = lm_scoring.Ready(lm_scoring.Model(tables, weights, lm_scoring.refine(sums), shape))
    data = np.frombuffer(bytes(range(256)), dtype=np.uint8)
    one_byte = lm_scoring.log10_of(ready, data, np.arange(256), np.ones(256, dtype=np.int64))
    assert math.isclose((10**one_byte).sum(), 1.0, rel_tol=1e-6)
    assert lm_scoring.log10_of(ready, *lm_scoring.laid_out([b"aa", b"zz"])).tolist() == sorted(lm_scoring.log10_of(ready, *lm_scoring.laid_out([b"aa", b"zz"])), reverse=True)


def test_language_model_of_odd_rows(spark, odd, none):
    rows = lm_scoring.scored(odd, F.lit(True), table_bits=14, frequent_words=2).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in rows if r.doc_id is not None}
    assert got[1] == (16, 16) and got[3] == got[4] == got[5] == (1, 1) and got[6] == (30_001, 30_001)
    listed = lm_scoring.scored(odd, F.lit(True), table_bits=14).collect()
    order = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)
    for a, b in zip(sorted(rows, key=order), sorted(listed, key=order)):
        assert a.n_known == b.n_known and math.isclose(a.base_score, b.base_score, rel_tol=1e-9) and math.isclose(a.score, b.score, rel_tol=0.02 if a.doc_id == 6 else 1e-9)
    untrained = lm_scoring.scored(odd, F.lit(False), table_bits=14).collect()
    assert {(r.train_tokens, r.n_known) for r in untrained} == {(0, 0)}
    assert lm_scoring.scored(none, F.lit(True), table_bits=14).count() == 0


def test_fixity_finds_each_kind_of_damage(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (i * 37 % 9000)) for i in range(1500)] + [(None, None, None)], "page_id long, url string, html string")
    ours = warc_fixity.archived(pages)
    theirs = ours.where("record_id <> 7 OR record_id IS NULL").withColumn("digest", F.when(F.col("record_id") == 1300, F.lit("bad")).otherwise(F.col("digest")))
    extra = spark.createDataFrame([(1, 99, "u", 10, "d", 10**7)], "archive long, record_id long, url string, length long, digest string, offset long")
    theirs = theirs.unionByName(extra)
    got = sorted((r.record_id, r.status) for r in warc_fixity.audit(ours, theirs).collect())
    assert got == [(7, "missing"), (99, "extra"), (1300, "changed")]
    assert warc_fixity.audit(ours, ours).count() == 0
    empty = ours.where("false")
    assert warc_fixity.audit(empty, empty).count() == 0
    assert {r.status for r in warc_fixity.audit(ours, empty).collect()} == {"missing"}


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(1)
    for length in (7, 8, 64):
        for _ in range(100):
            sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
            rows, free = packing.best_fit(sizes, length), []
            for size in sorted(sizes, reverse=True):
                fits = [c for c in free if c >= size]
                if fits:
                    free.remove(min(fits))
                free.append((min(fits) if fits else length) - size)
            assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
            assert len(rows) == len(free) and all(sum(sizes[i] for i in r) <= length for r in rows)


def test_packing_of_odd_rows(spark, odd, none):
    vocabulary = packing.read_vocabulary()
    encoder, back = packing.encoding(vocabulary), []
    pieces = []
    for r in packing.packed(odd.coalesce(1), vocabulary, length=64, window_rows=4).collect():
        ids = np.frombuffer(r.input_ids, dtype="<u2")
        pieces += [(d, n, ids[a:b].tolist()) for d, n, a, b in zip(r.doc_ids, r.piece_numbers, r.cu_seqlens, r.cu_seqlens[1:])]
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd.collect())
    for doc_id in {p[0] for p in pieces} - {1, None}:
        ids = [i for p in sorted(p for p in pieces if p[0] == doc_id) for i in p[2]]
        back.append((doc_id, encoder.decode(ids[:-1])))
    assert sorted(back) == [t for t in texts if t[0] not in (-1, 1)]
    assert packing.packed(none, vocabulary).count() == 0


def test_embedding_edges(spark):
    rng = np.random.default_rng(4)
    far = rng.normal(size=(40, 16))
    tight = rng.normal(size=16) + 0.05 * rng.normal(size=(30, 16))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.concatenate([far, tight]))]
    rows += [(100, rows[0][1]), (101, [2 * v for v in rows[0][1]]), (102, None), (103, [0.0] * 16), (104, [float("nan")] * 16), (105, [None] * 16), (106, [1.0, 2.0]), (107, []), (108, rows[40][1]), (108, rows[40][1]), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (2000, 16):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_graph.near_duplicates(table, shard=shard).collect()}
        assert len(got) == 80 and got[0] == got[100] == got[101] == (2, 0)
        assert got[40] == got[108] and {got[i][1] for i in range(40, 70)} == {40} and all(got[i][0] <= 30 for i in range(40, 70))
        assert sum(got[i][0] for i in range(40, 70)) >= (900 if shard == 2000 else 780)
        assert all(got[i] == (0, i) for i in range(102, 108)) and got[None] == (0, None)
    assert vector_graph.near_duplicates(table.where("false")).count() == 0
    assert vector_graph.audited(table, vector_graph.near_duplicates(table), queries=1000) > 0.95


def test_embedding_links_of_a_dense_region_are_all_found(spark):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=64)
    middle /= np.linalg.norm(middle)
    noise = rng.normal(size=(1000, 64)) / 8
    x = np.concatenate([rng.normal(size=(1200, 64)), middle + 0.26 * noise, middle + 0.5 * rng.normal(size=(300, 64)) / 8])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    group = np.arange(len(x))
    while True:
        least = np.minimum(group, np.where(links, group[None, :], len(x)).min(axis=1))
        if (least == group).all():
            break
        group = least
    for shard in (90, 1 << 20):
        got = vector_graph.near_duplicates(table, shard=shard).toPandas().sort_values("vec_id")
        assert (got["n_links"].to_numpy() == links.sum(axis=1)).all() and (got["component_id"].to_numpy() == group).all()


def test_embedding_cells_lose_no_link_across_borders(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_graph.near_duplicates(table, shard=60).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() == links.sum(axis=1)).all()


def test_embedding_audit_without_links_is_no_evidence(spark):
    table = spark.createDataFrame([(i, [float(i == k) for k in range(8)]) for i in range(8)], "vec_id long, embedding array<double>")
    assert vector_graph.audit(table, vector_graph.near_duplicates(table), queries=1000) == (None, 0)
    twice = table.unionByName(table.selectExpr("vec_id + 8 AS vec_id", "embedding"))
    assert vector_graph.audit(twice, vector_graph.near_duplicates(twice), queries=1000) == (1.0, 16)


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM?x", "HTTP://www.example.com/en/a?utm_source=q", "https://x.net/es/y", "https://net/fr/", "ftp://evil.org/p/?ref=1#f", "ftp://evil.org/p/?ref=1#f", "http://evilcom/"]
    pages = spark.createDataFrame([(i, u, "mine", "k") for i, u in enumerate(urls)], "page_id int, url string, verdict string, name string")
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/")]
    listed = spark.createDataFrame([("http://www.evil.org/p",), (None,)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, rules).collect()}
    assert [got[i] for i in range(11)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "", None, "allow"),
        ("www.example.com", "/en/a", "www.example.com/en/", "allow"), ("x.net", "/es/y", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"),
        ("evil.org", "/p/", None, "block"), ("evil.org", "/p/", None, "block"), ("evilcom", "/", None, "allow"),
    ]
    assert url_filter.judge(pages.where("false"), listed, rules).count() == 0 and url_filter.judge(pages, listed.where("false"), rules).where("listed").count() == 0


def test_language_edges(spark, odd, none):
    model = language.fit(odd, F.lit(True))
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows if r.text and any(c.isalpha() for c in r.text)} <= {"en", "fr", "de"}
    assert language.predict(none, model).count() == 0 and {r.lang_pred for r in language.predict(odd, language.fit(none, F.lit(True))).collect()} == {"und"}


def test_graph_walk_finds_what_brute_force_finds():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 48))
    crowd = rng.normal(size=48) + 0.3 * rng.normal(size=(1500, 48))
    for x in (np.concatenate([base, base[:700] + 0.3 * rng.normal(size=(700, 48))]), np.concatenate([base[:1500], crowd]), base[:1], base[:2]):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        lists = vector_graph.robust_pruned(x)
        assert lists.shape[1] == vector_graph.DEGREE and all(i not in own for i, own in enumerate(lists.tolist()))
        both = vector_graph.both_ways(x.astype(np.float32), lists)
        entries = vector_graph.medoids_of(x, both)
        got = vector_graph.searched(x.astype(np.float32), both, entries, x.astype(np.float32), 0.85) >= 0.9
        truth = x.astype(np.float32) @ x.astype(np.float32).T >= 0.9
        assert not (got & ~truth).sum() > 2 and got[truth].mean() >= 0.999


def test_blocks_are_full_however_finely_a_bucket_is_partitioned(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(t, bytes([t]), own, i, 40 + i % 7, own or i, b"c", b"s") for t in (0, 1) for i, own in [*((i, None) for i in range(2000)), *((i, 9999) for i in range(2000, 2600))]]
    rows.append((1, b"x", None, 9000, 40_000, 9000, b"c", b"s"))
    table = spark.createDataFrame(rows, "tree int, first binary, own long, doc_id long, n_shingles long, component long, class binary, signature binary")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = near_duplicates._blocks(table, near_duplicates.PIECE_SHINGLES, 1024).toPandas()
        light = near_duplicates._blocks(table, 200_000, 1024).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(light) == len(rows) and got["doc_id"].nunique() == 2601
    for found in (got, light):
        assert (found.assign(own=found["component"].where(found["component"] == 9999, -1)).groupby(["tree", "first", "block"])["own"].nunique() == 1).all()
    # Blocks ended with their partition before, so there were as many as partitions.
    sizes = got.groupby(["tree", "first", "block"]).size()
    assert sizes.max() <= 1024 and len(sizes) <= 2 * 5 + 1
    weights = light.assign(weight=light["n_shingles"] + near_duplicates.TEXT_WEIGHT).groupby(["tree", "first", "block"])["weight"].sum()
    assert (weights.drop(index=(1, b"x", 0)) <= 100_000 + 1046).all()


def test_one_of_two_cells_reaches_for_the_other():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x = np.concatenate([x, x[:1000] + 0.4 * rng.normal(size=(1000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, longest = x[:4000:500], math.sqrt(0.2)
    reach = vector_graph.reaches(x, centre, 0.9)
    assert (np.maximum(reach, 0) + np.maximum(reach.T, 0) >= longest).all()
    near, searched = vector_graph.cells_of(x, centre, reach)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert len(a) > 500 and (near[a, 0] != near[b, 0]).sum() > 100
    assert (searched[a, near[b, 0]] | searched[b, near[a, 0]]).all()
    # Vectors without structure lie near every border: before, each searched all eight cells.
    assert searched.sum(axis=1).mean() < 5


def test_a_longer_record_damages_no_other(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (40 * i + 5000)) for i in range(50)] + [(None, "u", "v"), (7, "twice", None), (7, "twice", None)], "page_id long, url string, html string")
    ours = warc_fixity.archived(pages)
    longer = pages.withColumn("html", F.when(F.col("page_id") == 3, F.concat("html", F.lit("yy"))).otherwise(F.col("html")))
    got = [(r.record_id, r.status, r.their_length - r.length) for r in warc_fixity.audit(ours, warc_fixity.archived(longer)).collect()]
    assert got == [(3, "changed", 2)]
    fewer = warc_fixity.archived(longer.where("coalesce(page_id, 0) <> 20").dropDuplicates())
    got = sorted((r.record_id, r.status) for r in warc_fixity.audit(ours, fewer).collect())
    assert got == [(3, "changed"), (7, "missing"), (20, "missing")]
    assert sorted((r.record_id, r.status) for r in warc_fixity.audit(fewer, ours).collect()) == [(3, "changed"), (7, "extra"), (20, "extra")]


@pytest.mark.parametrize("most", [0, 500_000])
def test_decontamination_by_both_joins(spark, odd, most):
    texts = ["the quick brown", CLEAN, CLEAN, "over the lazy dog near a calm river bank today", "word1 word2 word3 word4", "never found here at all", None, "--"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {}
    for r in decontamination.hit_documents(odd, items, broadcast_rows=most).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.item_ids))
    whole = (15, 15, ["0", "1", "2", "3"])
    assert got[1] == [whole, whole] and got[2] == [whole] and got[3] == got[4] == got[5] == [(0, 0, [])]
    assert sorted(got[None]) == [(0, 0, []), whole] and got[6] == [(30_000, 4 * 43, ["4"])] and got[7] == [(1, 0, [])]


def test_columns_of_any_name_pass_through(spark):
    names = ["_d", "_h", "_s", "_z", "_copies", "_copy", "copies", "copy", "in_doc", "lost", "_gone", "_rank", "rank", "many_id", "hit_id", "hit_hash", "judged", "_judged", "key", "_key", "name", "possible", "block", "block_of", "w0", "w3"]
    extra = [F.lit(f"own {n}").alias(n) for n in names]
    documents = spark.createDataFrame([(1, CLEAN, "a"), (1, CLEAN, "a"), (2, CLEAN, "b"), (3, "alone here", None)], "doc_id long, text string, source string").select("*", *extra)
    items = spark.createDataFrame([(1, "alone here")], "item_id long, text string")
    kept = decontamination.drop_contaminated(near_duplicates.deduplicated(documents), items)
    assert kept.columns == documents.columns and [(r.doc_id, r.lost, r.w0) for r in kept.collect()] == [(1, "own lost", "own w0")]
    assert mixing.mixture(documents).columns == documents.columns
    pages = spark.createDataFrame([("http://a.com/x",), (None,)], "url string").select("*", *extra)
    judged = url_filter.judge(pages, pages.select("url"), []).collect()
    assert {(r.listed, r.key, r.name, r.possible, r.w3) for r in judged} == {(True, "own key", "own name", "own possible", "own w3"), (False, "own key", "own name", "own possible", "own w3")}
    assert {r.judged for r in language.predict(documents, language.fit(documents.withColumn("lang", F.col("source")), F.lit(True))).collect()} == {"own judged"}


def test_language_scores_equal_plain_kernels(spark):
    texts = [("en", "the cat sat on the mat"), ("en", "a dog and the bird"), ("de", "der hund und die katze"), ("de", "ein vogel sitzt auf dem dach"), ("fr", "le chat est sur la table")]
    table = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.fit(table, F.lit(True), landmarks_each=1)
    folded = lambda t: "".join(c if c.isalpha() else " " for c in t.lower())
    grams_of = lambda t: {t[i: i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)}
    sets = [grams_of(folded(t)) for _, t in texts]
    order = sorted(range(5), key=lambda i: (texts[i][0], str(i)))
    marks = [next(i for i in order if texts[i][0] == g) for g in ("de", "en", "fr")]
    space = set().union(*(sets[i] for i in marks))
    known = [s & space for s in sets]
    alike = lambda a, b: len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    between = np.array([[alike(known[a], known[b]) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(between)
    root = vectors / np.sqrt(values)
    features = np.array([[alike(known[a], known[b]) for b in marks] for a in range(5)]) @ root
    share = np.array([1 / sum(g == h for h, _ in texts) for g, _ in texts])
    weight = share / share.sum()
    target = np.array([[1.0 if g == h else -1.0 for h in ("de", "en", "fr")] for g, _ in texts])
    x, y = features - weight @ features, target - weight @ target
    w = np.linalg.solve(x.T @ np.diag(weight) @ x + language.RIDGE / 5 * np.eye(x.shape[1]), x.T @ np.diag(weight) @ y)
    margins = (x @ w + weight @ target) * language.SHARPNESS
    chance = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
    rows = sorted(language.predict(table, model).collect(), key=lambda r: r.doc_id)
    assert np.allclose([r.score for r in rows], chance.max(axis=1), atol=1e-4) and [r.lang_pred for r in rows] == [("de", "en", "fr")[i] for i in chance.argmax(axis=1)]
