"""Neighbour votes, density clusters and components against plain computations."""

import random

import numpy as np
import pytest

from patronlens.functions.graph import connected
from patronlens.operators import clustering, density, linkage, neighbours

from conftest import rows

COLUMNS = ["x", "y", "z"]


def mixed_frame(spark, data):
    return spark.createDataFrame(data, "id long, x double, y double, z double, cat string, cluster int")


def distances(a, b, span):
    """The mixed distance of two lists of (x, y, z, cat); a null number is no distance."""
    out = np.zeros((len(a), len(b)))
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            parts = [abs(p[c] - q[c]) / span[c] if p[c] is not None and q[c] is not None and span[c] else 0.0 for c in range(3)]
            out[i, j] = (sum(parts) + (p[3] != q[3])) / 4
    return out


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(1, 1000)]
    star = [(5000, i) for i in range(2000, 2030)]
    ring = [(7000 + i, 7000 + (i + 1) % 9) for i in range(9)]
    other = [(None, 1), (9000, 9000), (8001, 8000), (8001, 8000)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(chain + star + ring + other, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 1001)} | {i: 2000 for i in [*range(2000, 2030), 5000]} | {7000 + i: 7000 for i in range(9)} | {8000: 8000, 8001: 8000}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(330)]
    group = {n: n for e in edges for n in e}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        group[high] = low
    want = {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a string, b string")).collect()} == want


def test_votes_equal_a_plain_computation(spark):
    rng = random.Random(5)

    def point(i):
        spread = [round(rng.random(), 1) if rng.random() < 0.9 else None for _ in COLUMNS]
        return (i, *spread, rng.choice(["a", "b", None]), rng.randrange(4) if rng.random() < 0.95 else None)

    known, new = [point(i) for i in range(120)], [point(1000 + i) for i in range(60)]
    both = known + new
    span = [max(p[c] for p in both if p[c] is not None) - min(p[c] for p in both if p[c] is not None) for c in (1, 2, 3)]
    voting = [p for p in known if p[5] is not None]
    far = np.round(distances([p[1:5] for p in new], [p[1:5] for p in voting], span), 9)
    want = []
    for i, p in enumerate(new):
        nearest = sorted(range(len(voting)), key=lambda j: (far[i, j], voting[j][0]))[:4]
        labels = [voting[j][5] for j in nearest]
        want.append((p[0], min(labels, key=lambda x: (-labels.count(x), x))))
    got = neighbours.knn_vote(mixed_frame(spark, new), mixed_frame(spark, known), numeric=COLUMNS, categorical=["cat"], id_col="id")
    assert rows(got, "id", "cluster") == want and set(got.columns) == {"id", "x", "y", "z", "cat", "cluster"}


def test_votes_of_few_rows_and_of_none(spark):
    new = mixed_frame(spark, [(9, 0.0, 0.0, 0.0, "a", None)])
    three = mixed_frame(spark, [(1, 0.1, 0.0, 0.0, "a", 7), (2, 0.2, 0.0, 0.0, "a", 3), (3, 0.9, 1.0, 1.0, "b", 5)])
    vote = lambda known, **more: neighbours.knn_vote(new, known, numeric=COLUMNS, categorical=["cat"], id_col="id", **more).first()["cluster"]
    assert vote(three) == 3
    assert vote(three.where("id = 1")) == 7
    assert vote(three.where("id > 5")) is None
    assert vote(three, bound=1) in (7, 3, 5)
    equal = mixed_frame(spark, [(i, 0.5, 0.5, 0.5, "a", c) for i, c in enumerate([9, 9, 2, 2, 1, 1, 1, 1])])
    assert vote(equal) == 2


def test_votes_in_small_batches_with_distances_next_to_a_half(spark, monkeypatch):
    """Distances that differ after the ninth digit are equal, and the order of ids decides, however rows are batched."""
    monkeypatch.setattr(neighbours, "ROWS", 3)
    known = [(i, x, 0.0, 0.0, "a", i) for i, x in enumerate([0.5 + 4e-12, 0.5, 0.5 + 2e-9, 0.5 + 2e-9 - 1e-12, 0.5 + 4e-9, 0.0, 1.0])]
    new = [(100 + i, float(i % 2), 0.0, 0.0, "a", None) for i in range(8)]
    got = neighbours.knn_vote(mixed_frame(spark, new), mixed_frame(spark, known), k=2, numeric=COLUMNS, categorical=["cat"], id_col="id")
    far = {p[0]: sorted((float(f"{abs(p[1] - q[1]) / 4:.9f}"), q[0]) for q in known)[:2] for p in new}
    assert rows(got, "id", "cluster") == [(i, min(j for _, j in near)) for i, near in sorted(far.items())]


def plain_density(data, eps, least, span):
    near = distances([p[1:5] for p in data], [p[1:5] for p in data], span) <= eps
    core = near.sum(axis=1) >= least
    cluster = [None] * len(data)
    for i in range(len(data)):
        if core[i] and cluster[i] is None:
            todo = [i]
            cluster[i] = data[i][0]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if cluster[j] is None:
                        cluster[j] = data[i][0]
                        if core[j]:
                            todo.append(j)
    return sorted((p[0], c, bool(k)) for p, c, k in zip(data, cluster, core))


@pytest.mark.parametrize("seed, eps, least", [(1, 0.05, 6), (2, 0.12, 12), (3, 0.02, 3)])
def test_density_clusters_equal_the_matrix_form(spark, seed, eps, least):
    rng = random.Random(seed)
    data = []
    for i in range(420):
        kind = rng.random()
        if kind < 0.35:  # a third of the rows in one dense place
            place = [0.2 + 0.02 * rng.random() for _ in COLUMNS]
        elif kind < 0.5:
            place = [0.6, 0.6, 0.3 + 0.3 * rng.random()]
        elif kind < 0.75:
            place = [round(rng.random(), 1) for _ in COLUMNS]
        else:
            place = [rng.random() for _ in COLUMNS]
        data.append((i, *place, "a" if kind < 0.35 else rng.choice(["a", "b"]), None))
    data += [(1000, 0.0, 0.0, 0.0, "c", None), (1001, 1.0, 1.0, 1.0, "c", None)]
    want = plain_density(data, eps, least, [1.0, 1.0, 1.0])
    got = density.density_clusters(mixed_frame(spark, data).drop("cluster"), eps, least, COLUMNS, "cat", "id")
    assert rows(got, "id", "cluster", "core") == want
    assert len({c for _, c, _ in want if c is not None}) > 1 and any(c is None for _, c, _ in want)


def test_density_of_hot_cells_in_slices(spark, monkeypatch):
    """Slices of five cells and points: the same clusters, and many slices for the dense place."""
    monkeypatch.setattr(density, "SLICE", 5)
    rng = random.Random(4)
    data = [(i, *[0.5 + 0.03 * rng.random() for _ in COLUMNS], "a", None) for i in range(120)]
    data += [(500 + i, *[rng.random() for _ in COLUMNS], rng.choice(["a", "b"]), None) for i in range(120)]
    data += [(900, 0.0, 0.0, 0.0, "c", None), (901, 1.0, 1.0, 1.0, "c", None)]
    got = density.density_clusters(mixed_frame(spark, data).drop("cluster"), 0.05, 8, COLUMNS, "cat", "id")
    assert rows(got, "id", "cluster", "core") == plain_density(data, 0.05, 8, [1.0, 1.0, 1.0])


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_density_of_many_blocks(spark, monkeypatch, spread):
    """Blocks of six points: neighbours are counted, clusters joined and border points placed across blocks."""
    monkeypatch.setattr(density, "BLOCK", 6)
    monkeypatch.setattr(density, "CHUNK", 40)
    rng = random.Random(5)
    data = [(i, *[round(spread * rng.random(), 2) for _ in COLUMNS], rng.choice(["a", "b"]), None) for i in range(300)]
    data += [(900, 0.0, 0.0, 0.0, "c", None), (901, 1.0, 1.0, 1.0, "c", None)]
    got = density.density_clusters(mixed_frame(spark, data).drop("cluster"), 0.05, 8, COLUMNS, "cat", "id")
    assert rows(got, "id", "cluster", "core") == plain_density(data, 0.05, 8, [1.0, 1.0, 1.0])


def test_density_of_no_rows_equal_rows_and_wrong_eps(spark):
    empty = mixed_frame(spark, []).drop("cluster")
    assert density.density_clusters(empty, 0.05, 2, COLUMNS, "cat", "id").count() == 0
    equal = mixed_frame(spark, [(i, 1.0, None, 2.0, None, None) for i in range(40)]).drop("cluster")
    got = density.density_clusters(equal, 0.05, 30, COLUMNS, "cat", "id")
    assert {(r["cluster"], r["core"]) for r in got.collect()} == {(0, True)}
    with pytest.raises(ValueError):
        density.density_clusters(equal, 0.25, 30, COLUMNS, "cat", "id")


def plain_ward(data, k):
    """Merging the pair of groups that adds least to the squared distances, all groups looked at each time."""
    span = [max(p[c] for p in data) - min(p[c] for p in data) for c in (1, 2, 3)]
    low = [min(p[c] for p in data) for c in (1, 2, 3)]
    kinds = sorted({p[4] for p in data})
    x = np.array([[(p[c + 1] - low[c]) / span[c] for c in range(3)] + [(p[4] == n) / 2**0.5 for n in kinds] for p in data])
    spread = lambda group: ((x[group] - x[group].mean(axis=0)) ** 2).sum()
    groups = [[i] for i in range(len(data))]
    while len(groups) > k:
        _, a, b = min((spread(g + h) - spread(g) - spread(h), a, b) for a, g in enumerate(groups) for b, h in enumerate(groups) if a < b)
        groups[a] += groups.pop(b)
    groups.sort(key=lambda g: min(data[i][0] for i in g))
    return sorted((data[i][0], n) for n, g in enumerate(groups, 1) for i in g)


def test_ward_equals_the_plain_linkage(spark):
    rng = random.Random(12)
    data = [(i, rng.gauss(i % 4, 0.6), rng.gauss(i % 3, 0.5), rng.random(), rng.choice("ab"), None) for i in range(40)]
    data += [(100 + i, *data[i][1:]) for i in range(8)]  # equal rows are one micro-cluster of two
    got = linkage.ward_clusters(mixed_frame(spark, data), 5, COLUMNS, "cat", "id")
    assert rows(got, "id", "cluster") == plain_ward(data, 5)


def test_ward_over_micro_clusters(spark):
    rng = random.Random(3)
    data = [(i, i % 3 + 0.05 * rng.random(), 5 * (i % 3) + 0.05 * rng.random(), rng.random() / 9, "abc"[i % 3], None) for i in range(600)]
    got = linkage.ward_clusters(mixed_frame(spark, data), 3, COLUMNS, "cat", "id", bound=20)
    assert rows(got, "id", "cluster") == [(i, i % 3 + 1) for i in range(600)]
    features = linkage.cluster_features(clustering.unit_points(mixed_frame(spark, data), COLUMNS, "cat", "id"), "cat", 3).orderBy("cat").collect()
    assert [(f["n"], f["first"], f["cats"]) for f in features] == [(200, i, {"abc"[i]: 200}) for i in range(3)]


def test_ward_of_few_rows(spark):
    few = mixed_frame(spark, [(1, 0.0, None, 0.0, None, None), (2, 9.0, 1.0, 0.0, "a", None)])
    assert rows(linkage.ward_clusters(few, 3, COLUMNS, "cat", "id"), "id", "cluster") == [(1, 1), (2, 2)]
    assert linkage.ward_clusters(few.where("id > 5"), 3, COLUMNS, "cat", "id").count() == 0


def plain_prototypes(data, centres, gamma):
    """Rounds of nearest centre, means and modes over (numbers, category) rows until no row moves; labels and cost."""
    labels = None
    while True:
        cost = np.array([[sum((p[c] - m[c]) ** 2 for c in range(3)) + gamma * (p[3] != m[3]) for m in centres] for p in data])
        found = cost.argmin(axis=1)
        if labels is not None and (found == labels).all():
            return labels, cost.min(axis=1).sum()
        labels = found
        for g in range(len(centres)):
            mine = [p for p, at in zip(data, labels) if at == g]
            if mine:
                kinds = [p[3] for p in mine]
                centres[g] = (*[np.mean([p[c] for p in mine]) for c in range(3)], min(set(kinds), key=lambda x: (-kinds.count(x), x)))


def test_prototypes_settle_as_the_plain_rounds_do(spark):
    rng = random.Random(10)
    data = [(f"p{i}", rng.gauss(i % 3, 0.8), rng.gauss(0, 1), rng.random(), rng.choices("abc", [6, 3, 1])[0]) for i in range(150)]
    people = spark.createDataFrame(data, "customer_unique_id string, x double, y double, z double, cat string")
    model = clustering.fit_prototypes(people, 5, 1.0, COLUMNS)
    placed = {r["customer_unique_id"]: r["cluster"] for r in clustering.assign_prototypes(people, model, 1.0, COLUMNS).collect()}
    centres = [(*[c[n] for n in COLUMNS], c["cat"]) for c in model.centres]
    labels, cost = plain_prototypes([p[1:] for p in data], list(centres), 1.0)
    assert [placed[p[0]] for p in data] == labels.tolist() and model.cost == pytest.approx(cost)
    table = clustering.prototype_centres(spark, model, COLUMNS).toPandas()
    assert list(table.columns) == ["cluster", *COLUMNS, "cat"] and len(table) == 5
    rows_ = clustering.complete(people, COLUMNS)
    draw = clustering.F.min(clustering.F.xxhash64("customer_unique_id", clustering.F.lit(1)))
    start = clustering._drawn_start(rows_, 5, COLUMNS, "cat", draw)
    assert model.cost <= clustering._settled(rows_, start, COLUMNS, "cat", 1.0, 300).cost + 1e-9
    dealt = [c["cat"] for c in clustering._frequent_start(rows_, 5, COLUMNS, "cat", draw)]
    counts = {c: sum(p[4] == c for p in data) for c in "abc"}
    assert len(dealt) == 5 and dealt.count("a") >= dealt.count("b") >= dealt.count("c") and dealt.count("a") >= 5 * counts["a"] // 150
    held_out = clustering.assign_prototypes(people.where("x > 100"), model, 1.0, COLUMNS)
    assert held_out.count() == 0 and held_out.columns[-1] == "cluster"


def test_prototypes_of_few_equal_and_no_rows(spark):
    few = spark.createDataFrame([("a", 1.0, 1.0, None, None), ("b", 1.0, 1.0, None, None), ("c", 2.0, 0.0, 0.0, "x")], "customer_unique_id string, x double, y double, z double, cat string")
    clustered, cost = clustering.k_prototypes(few, 4, 1.0, COLUMNS)
    assert cost == 0 and len({r["cluster"] for r in clustered.collect()}) == 2
    clustered, cost = clustering.k_prototypes(few.where("x > 9"), 4, 1.0, COLUMNS)
    assert cost == 0 and clustered.count() == 0
