"""Fits of several numbers of centres share their passes over the rows."""

import random

import pytest

from patronlens.operators import clustering

COLUMNS = ["x", "y"]


def test_all_fits_go_over_the_rows_together(spark, monkeypatch):
    """As many passes as the longest fit has rounds; costs as in fits alone; null and many categories among the rows."""
    monkeypatch.setattr(clustering, "_CATEGORIES", 3)
    rng = random.Random(3)
    data = [(f"p{i}", rng.gauss(i % 3, 0.9), rng.random(), rng.choice(["a", "b", "c", "d", "e"])) for i in range(120)]
    people = spark.createDataFrame(data, "customer_unique_id string, x double, y double, cat string")
    alone = clustering.fit_prototypes(people, 3, 1.0, COLUMNS)
    passes, rounds, gathered = [], [], clustering._gathered
    settled = clustering._all_settled
    monkeypatch.setattr(clustering, "_gathered", lambda *a: passes.append(1) or gathered(*a))
    monkeypatch.setattr(clustering, "_all_settled", lambda *a: [rounds.append(f.rounds) or f for f in settled(*a)])
    costs = {r["k"]: r["cost"] for r in clustering.prototype_elbow(people, [1, 3], numeric=COLUMNS).collect()}
    assert len(rounds) == 4 and len(passes) == max(rounds)
    assert costs[3] == pytest.approx(alone.cost) and costs[1] > costs[3]
