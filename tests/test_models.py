import random

import pytest
from pyspark.sql import functions as F

from patronlens.operators import clustering, models
from patronlens.operators.sessions import PERSON

from conftest import rows


@pytest.fixture(scope="module")
def people(spark):
    rng, data = random.Random(4), []
    for i in range(300):
        g = i % 3
        numbers = [g * 5 + rng.random() for _ in clustering.NUMERIC]
        data.append((f"p{i}", *numbers, ["art", "toys", ""][g], int(g > 0)))
    columns = ", ".join(f"`{c}` double" for c in clustering.NUMERIC)
    return spark.createDataFrame(data, f"{PERSON} string, {columns}, cat string, class int").cache()


def test_gower_equals_a_plain_computation(spark, people):
    table = people.select(PERSON, *clustering.NUMERIC, "cat").toPandas()
    span = table[clustering.NUMERIC].max() - table[clustering.NUMERIC].min()
    pair = people.where(f"{PERSON} = 'p0'").select(F.struct(*clustering.NUMERIC, "cat").alias("a")).join(
        people.select(PERSON, F.struct(*clustering.NUMERIC, "cat").alias("b")), F.lit(True)
    )
    got = {r[PERSON]: r["d"] for r in pair.withColumn("d", clustering.gower(F.col("a"), F.col("b"), clustering.gower_ranges(people))).collect()}
    for i in (0, 1, 5, 299):
        numeric = ((table.loc[i, clustering.NUMERIC] - table.loc[0, clustering.NUMERIC]).abs() / span).sum()
        assert got[f"p{i}"] == pytest.approx((numeric + (table.cat[i] != table.cat[0])) / 12)


def test_standardize_and_dummies(spark, people):
    scaled = clustering.standardize(people, ["dist", "score"]).agg(F.avg("dist"), F.stddev_pop("dist")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)
    constant = clustering.standardize(people.withColumn("dist", F.lit(3.0)), ["dist"])
    assert constant.agg(F.max(F.abs("dist"))).first()[0] == 0
    wide = clustering.dummies(people.select("cat"), "cat", ["art", "pets"])
    assert wide.columns == ["cat_art", "cat_pets"] and wide.agg(F.sum("cat_art"), F.sum("cat_pets")).first()[:] == (100.0, 0.0)


def test_clusters_find_the_groups(spark, people):
    for model in (clustering.hierarchical(people), clustering.kmeans(people, k=3)):
        found = clustering.assign(model, people).groupBy("cat").agg(F.countDistinct("cluster").alias("n"), F.count("*").alias("c"))
        assert {(r["n"], r["c"]) for r in found.collect()} == {(1, 100)}
    clustered, cost = clustering.k_prototypes(clustering.standardize(people, clustering.NUMERIC), k=3)
    one = clustering.k_prototypes(clustering.standardize(people, clustering.NUMERIC), k=1)[1]
    assert 0 < cost < one and clustered.count() == 300
    costs = [r["cost"] for r in clustering.elbow(people, range(1, 4)).orderBy("k").collect()]
    assert costs[0] > costs[1] > costs[2] > 0
    shares = clustering.cluster_shares(clustering.assign(clustering.hierarchical(people), people))
    assert sorted(r["probability"] for r in shares.collect()) == [0.0, 1.0, 1.0]


def test_describe(spark, people):
    got = clustering.describe(people, ["dist"]).first()
    values = people.select("dist").toPandas().dist
    want = values.describe()
    assert [got[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(list(want))


def test_splits_do_not_leak(spark, people):
    train, test = models.stratified_split(people, "class")
    assert {r["class"]: r["count"] for r in train.groupBy("class").count().collect()} == {0: 80, 1: 160}
    assert train.join(test, PERSON, "left_semi").count() == 0 and train.count() + test.count() == 300
    doubled = people.unionByName(people)
    folds = models.group_folds(doubled)
    assert folds.groupBy(PERSON).agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    assert {r["part"] for r in folds.select("part").distinct().collect()} == {"train", "valid", "test"}
    left, right = models.random_split(people)
    assert left.count() + right.count() == 300 and 200 < left.count() < 280


@pytest.fixture(scope="module")
def histories(spark):
    rng, data = random.Random(9), []
    for i in range(600):
        good = rng.random() < 0.6
        score = rng.uniform(3, 5) if good else rng.uniform(1, 3.5)
        single = i % 4 == 0
        data.append((f"h{i}", 1 if single else 3, score, 100.0, None if single else 10, None if single else score, None if single else 90.0,
                     None if single else 12.0, rng.randrange(0, 200) if good else rng.randrange(150, 500), int(good)))
    names = ["orders_count int", "last_score double", "last_payment double", "last_days_between_orders int", "mean_score double",
             "mean_payment double", "mean_days_between_orders double", "days_after_order int", "retention int"]
    return models.group_folds(spark.createDataFrame(data, f"{PERSON} string, " + ", ".join(names))).cache()


def part(histories, name):
    return histories.where(F.col("part") == name)


def test_models_beat_the_majority(spark, histories, tmp_path):
    train, valid, test = (part(histories, p) for p in ("train", "valid", "test"))
    majority = max(test.groupBy("retention").count().toPandas()["count"]) / test.count()
    two_stage = models.SeveralOrdersModel.fit(train, valid, trees=20)
    scored = two_stage.transform(test)
    assert models.accuracy(scored, "retention").first()[0] > majority
    again = models.SeveralOrdersModel.fit(train, valid, trees=20).transform(test)
    assert rows(scored, PERSON, "probability") == rows(again, PERSON, "probability")
    two_stage.save(str(tmp_path / "model"))
    loaded = models.SeveralOrdersModel.load(str(tmp_path / "model"))
    assert rows(loaded.transform(test), PERSON, "probability") == rows(scored, PERSON, "probability")
    boosted = models.predict(models.retention_boosting(train, rounds=5), test, [*models.HISTORY, "days_after_order"])
    assert models.accuracy(boosted, "retention").first()[0] > majority
    table = models.confusion(boosted, "retention", "prediction").toPandas().set_index("label")
    assert table.to_numpy().sum() == test.count()


def test_one_order_regression(spark, histories):
    one = histories.select(PERSON, F.col("last_score").alias("review_score"), F.col("last_payment").alias("payment_value"), "days_after_order", "retention")
    weights = models.coefficients(models.one_order_regression(one), models.ONE_ORDER)
    assert weights["review_score"] > 0 > weights["days_after_order"]


def test_scoring_keeps_columns_fixed(spark):
    rng, data = random.Random(2), []
    for i in range(200):
        c = i % 2
        data.append((f"p{i}", float(c * 3 + rng.random()), 2.0, 4.0, c * 300 + 10, ["art", "toys"][c], c))
    df = spark.createDataFrame(data, f"{PERSON} string, distance double, payment_value double, review_score double, time_delta int, upper_category string, cluster int")
    model = models.cluster_forest(df, trees=5)
    shares = spark.createDataFrame([(0, 0.93), (1, 0.03)], "cluster int, probability double")
    only_art = df.where("upper_category = 'art'").drop("cluster")
    scored = models.score_one_order(model, only_art, models.cluster_table(shares))
    assert rows(scored.select("cluster", "probability", "note").distinct()) == [(0, 0.93, "недавно покупал")]
    sizes = clustering.cluster_sizes(scored.select("cluster"), shares)
    assert rows(sizes, "cluster", "count") == [(0, 100)]
    held = models.predict_clusters(model, df).withColumn("class", 1 - F.col("cluster"))
    stage = models.share_regression(held, shares)
    assert models.accuracy(models.predict(stage, models.with_share(held, shares), ["time_delta", "rfc"]), "class").first()[0] == 1.0
