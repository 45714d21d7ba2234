import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronlens.functions.order_stats import exact_quantiles, narrowed, running_total, smallest_by_hash

PROBS = [0.0, 0.25, 0.33, 0.66, 0.75, 1.0]


def frame(spark, groups):
    data = [(k, float(v)) for k, values in groups.items() for v in values]
    return spark.createDataFrame(data, "k string, v double")


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_match_numpy(spark, accuracy):
    """An accuracy of 20 sends every group beyond 200 rows through the brackets."""
    rng = random.Random(3)
    groups = {
        "one": [5.0],
        "two": [1.0, 9.0],
        "even": list(range(1, 1001)),
        "hot": [7.0] * 3000 + [rng.random() * 100 for _ in range(1500)],
        "skewed": [rng.lognormvariate(3, 2) for _ in range(2500)],
        "negative": [-rng.random() for _ in range(400)] + [0.0] * 50,
    }
    got = exact_quantiles(frame(spark, groups), "v", PROBS, ["k"], accuracy).collect()
    assert {r["k"]: r["n"] for r in got} == {k: len(v) for k, v in groups.items()}
    for r in got:
        np.testing.assert_allclose(r["q"], np.quantile(groups[r["k"]], PROBS), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_without_keys_and_with_nulls(spark, accuracy):
    values = [float(i * i % 1013) for i in range(900)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 10, "v double")
    got = exact_quantiles(df, "v", PROBS, accuracy=accuracy).first()
    assert got["n"] == 900
    np.testing.assert_allclose(got["q"], np.quantile(values, PROBS))


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: r["q"][0] for r in exact_quantiles(df, "v", [0.5], ["k"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_running_total_orders_by_amount_then_tie(spark):
    rng = random.Random(1)
    data = [(f"c{i:03}", rng.choice([0.0, -2.5, 1.0, 3.0, 1e6, 0.001, rng.random() * 50])) for i in range(300)]
    got = {r["name"]: r["cum"] for r in running_total(spark.createDataFrame(data, "name string, x double"), "x", "name", "cum").collect()}
    total = 0.0
    for name, x in sorted(data, key=lambda p: (-p[1], p[0])):
        total += x
        assert got[name] == pytest.approx(total, abs=1e-6)
    assert len(got) == 300


def test_smallest_by_hash_is_exact_and_repeatable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("s"))
    first = smallest_by_hash(df, "id", F.floor(F.col("_size") * 0.8), ["s"])
    again = smallest_by_hash(df.repartition(13), "id", F.floor(F.col("_size") * 0.8), ["s"])
    assert {r["s"]: r["count"] for r in first.groupBy("s").count().collect()} == {0: 1333, 1: 1333, 2: 1332}
    assert {r["id"] for r in first.collect()} == {r["id"] for r in again.collect()}
    assert smallest_by_hash(df, "id", F.lit(17)).count() == 17
    assert smallest_by_hash(df, "id", F.lit(99_999)).count() == 5000
    assert smallest_by_hash(df, "id", F.lit(17), seed=2).exceptAll(smallest_by_hash(df, "id", F.lit(17))).count() > 0


def test_quantiles_of_a_million_values_in_bounded_windows(spark):
    """One group of 10^6 different values beside small ones, at most 1,000 values a window."""
    hot = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    small = frame(spark, {"few": [3.0, 1.0], "ties": [2.0] * 1500})
    got = {r["k"]: r["q"] for r in exact_quantiles(hot.unionByName(small), "v", PROBS, ["k"], accuracy=100).collect()}
    np.testing.assert_allclose(got["hot"], np.quantile(np.arange(1_000_000, dtype=float) ** 2, PROBS), rtol=1e-12)
    np.testing.assert_allclose(got["few"], np.quantile([3.0, 1.0], PROBS))
    assert got["ties"] == [2.0] * len(PROBS)


def test_brackets_shrink_to_the_bound(spark):
    rng = random.Random(6)
    values = [rng.random() for _ in range(20_000)] + [0.5] * 4000
    counts = frame(spark, {"a": values, "b": values[:50]}).groupBy("k", "v").agg(F.count("*").alias("_c")).withColumnRenamed("v", "_v")
    for low in (0, 777, 12_000, 23_999):
        start = counts.withColumns({"_low": F.when(F.col("k") == "a", low).otherwise(7).cast("long")}).withColumn("_high", F.col("_low") + F.when(F.col("_low") < 23_999, 1).otherwise(0))
        left = narrowed(start.select("k", "_low", "_high", "_v", "_c"), ["k"], 100)
        sizes = {r["k"]: r["count"] for r in left.groupBy("k").count().collect()}
        assert sizes["a"] <= 200 and sizes["b"] == 50
        kept = left.where("k = 'a'").orderBy("_v").collect()
        spread = [r["_v"] for r in kept for _ in range(r["_c"])]
        assert spread[kept[0]["_low"]] == sorted(values)[low]
