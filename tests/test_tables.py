"""Cleaning, territory and feature edge cases."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.functions.keys import first_per_key, keep_matching, most_common, with_row
from patronlens.operators import churn, cleaning, features, sessions, territory

from conftest import rows

T = datetime.fromisoformat


def test_null_keys_match_null_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(keep_matching(left, "k", right), "v") == [(1,), (2,)]


def test_null_status_city_and_type_stay(spark):
    orders = spark.createDataFrame([("o1", None, None), ("o2", "delivered", None), ("o3", "delivered", "x"), ("o4", "shipped", None)], "order_id string, order_status string, note string")
    assert rows(cleaning.orders(orders), "order_id") == [("o1",), ("o3",), ("o4",)]
    payments = spark.createDataFrame([(0, "o1", None), (1, "o1", "not_defined"), (2, "o1", "card"), (3, "o1", "card"), (4, "o9", "card")], "_row int, order_id string, payment_type string")
    assert rows(cleaning.payments(payments, orders), "payment_type") == [(None,), ("card",)]
    sellers = spark.createDataFrame([(0, "s1", None), (1, "s2", " "), (2, "s3", "sp"), (3, "s4", "natal")], "_row int, seller_id string, seller_city string")
    assert rows(cleaning.sellers(sellers), "seller_id") == [("s1",), ("s4",)]


def test_repeated_item_columns_are_dropped_when_present(spark):
    orders = spark.createDataFrame([("o1",)], "order_id string")
    items = spark.createDataFrame([(0, "o1", 1.0, 1.0), (1, "o1", 1.0, 1.0), (2, "o2", 1.0, 1.0)], "_row int, order_id string, price double, `price.1` double")
    assert cleaning.items(items, orders).columns == ["order_id", "price"]
    assert cleaning.items(items, orders).count() == 1
    assert cleaning.items(items.drop("price.1"), orders).count() == 1


def test_products_lose_unknown_names_and_nulls(spark):
    products = spark.createDataFrame([("p1", "n1", 5, 9), ("p2", "n1", None, 9), ("p3", "n7", 5, 9), ("p4", None, 5, 9)], "product_id string, product_category_name string, product_name_lenght int, product_description_lenght int")
    translation = spark.createDataFrame([("n1", "one")], "product_category_name string, product_category_name_english string")
    kept = cleaning.products(products, translation)
    assert rows(kept, "product_id") == [("p1",)]
    assert kept.columns[2:] == ["product_name_length", "product_description_length"]


def brute_iqr(points):
    def inside(values, x):
        q1, q3 = np.quantile(values, 0.25), np.quantile(values, 0.75)
        return q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)

    kept = []
    for zip_code in {p[0] for p in points}:
        group = [p for p in points if p[0] == zip_code]
        group = [p for p in group if inside([g[1] for g in group], p[1])]
        kept += [p for p in group if inside([g[2] for g in group], p[2])]
    return sorted(kept)


def test_outlier_fences_of_longitude_come_from_latitude_survivors(spark):
    points = [(1, float(i), 10.0 + i / 10, i) for i in range(12)] + [(1, 500.0, 10.0, 90), (1, 5.0, 60.0, 91), (2, 3.0, 4.0, 92)]
    points += [(3, 1.0, 1.0, 93), (3, 100.0, 100.0, 94)]
    df = spark.createDataFrame(points, "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, id int")
    got = sorted(tuple(r) for r in cleaning.iqr_filter(df, ["geolocation_zip_code_prefix"], ["geolocation_lat", "geolocation_lng"]).collect())
    assert got == brute_iqr(points)
    assert {90, 91}.isdisjoint({g[3] for g in got}) and 92 in {g[3] for g in got}


def geo(spark, data):
    return spark.createDataFrame(data, "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, geolocation_city string, geolocation_state string")


def test_states_and_centroids(spark):
    points = geo(spark, [(1, 0.0, 0.0, "b", "SP"), (1, 0.0, 0.0, "b", "SP"), (1, 2.0, 4.0, "a", "RJ"), (2, 5.0, 5.0, "y", "MG"), (2, 5.0, 6.0, "x", "BA"), (3, 1.0, 1.0, None, None)])
    fixed = cleaning.fix_state(points)
    assert rows(fixed.groupBy("geolocation_zip_code_prefix").agg(F.max("geolocation_state"))) == [(1, "SP"), (2, "BA"), (3, None)]
    assert rows(territory.zip_centroids(points), "geolocation_zip_code_prefix", "lat_d_mean", "lng_d_mean", "city", "state") == [
        (1, 1.0, 2.0, "b", "SP"), (2, 5.0, 5.5, "x", "BA"), (3, 1.0, 1.0, None, None)
    ]
    assert rows(territory.with_point_counts(points), "points_count") == [(1,), (2,), (2,), (3,), (3,), (3,)]


def test_selection_without_choice(spark):
    points = geo(spark, [(1, 0.0, 0.0, "b", "SP")])
    assert territory.select_points(points).count() == 0
    assert territory.select_points(points, ["SP"]).count() == 1
    assert territory.select_points(points, ["SP"], [2]).count() == 0
    assert territory.select_centroids(territory.zip_centroids(points)).count() == 1


def test_state_without_people(spark):
    recency = spark.createDataFrame([("a", 10), ("b", 232), ("c", 231)], "customer_unique_id string, recency_days int")
    customers = spark.createDataFrame([("a", "SP"), ("a", "SP"), ("b", "SP"), ("c", "RJ")], "customer_unique_id string, customer_state string")
    got = territory.state_churn(recency, customers)
    assert got.count() == 27
    assert rows(got.where("customer_state IN ('SP', 'RJ', 'AC')"), "customer_state", "overall", "fired", "share") == [
        ("AC", 0, 0, None), ("RJ", 1, 0, 0.0), ("SP", 2, 1, 0.5)
    ]


def test_outline_boxes(spark):
    ring = [[float(i), float(i * 2)] for i in range(21)]
    short = [[100.0, 100.0], [101.0, 101.0]]
    df = spark.createDataFrame(
        [("SP", "Polygon", [[ring, short]]), ("RJ", "MultiPolygon", [[short], [ring]])],
        "id string, type string, polygons array<array<array<array<double>>>>",
    )
    got = {r["id"]: r for r in territory.state_outlines(df).collect()}
    assert got["SP"]["outline"] == [[0.0, 0.0], [10.0, 20.0], [20.0, 40.0]] == got["RJ"]["outline"]
    assert (got["SP"]["center_lat"], got["SP"]["center_lon"]) == (10.0, 5.0)
    assert (got["RJ"]["center_lat"], got["RJ"]["center_lon"]) == (20.0, 10.0)
    churn_by_state = spark.createDataFrame([("SP", 8, 1, 0.125)], "customer_state string, overall long, fired long, share double")
    text = territory.labelled_outlines(territory.state_outlines(df), churn_by_state).first()["text"]
    assert text == "Штат SP: пользователей ушло 1, всего было 8 (12.5%)"


def test_first_row_may_be_null(spark):
    data = [("o1", 7, 5.0), ("o1", 3, 2.0), ("o1", 9, 1.0), ("o2", 1, None), ("o2", 2, 4.0)]
    df = spark.createDataFrame(data, "order_id string, _row int, review_score double")
    assert rows(first_per_key(df, "order_id", "_row", ["review_score"])) == [("o1", 2.0), ("o2", None)]


def test_most_common_tie(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (2, "c")], "k int, v string")
    assert rows(most_common(df, ["k"], "v", "top")) == [(1, "a"), (2, "c")]


def test_with_row(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "k string, v int")
    ranks = {r["k"]: r["_row"] for r in with_row(df).collect()}
    assert len(set(ranks.values())) == 2 and with_row(with_row(df)).columns == ["k", "v", "_row"]


def test_distinct_rows_keep_the_first_index(spark):
    df = spark.createDataFrame([(5, "a", None), (2, "a", None), (9, "b", 1.0)], "_row long, k string, v double")
    assert rows(cleaning.distinct_rows(df, keep_row=True), "_row", "k") == [(2, "a"), (9, "b")]
    assert cleaning.distinct_rows(df).columns == ["k", "v"] and cleaning.distinct_rows(df).count() == 2


def test_order_profile(spark):
    items = spark.createDataFrame(
        [(1, "o1", "p1", "s1", 5.0), (2, "o1", "p2", "s2", 5.0), (3, "o1", "p9", "s2", 4.0), (1, "o2", "p9", "s9", 1.0)],
        "_row int, order_id string, product_id string, seller_id string, price double",
    )
    upper = spark.createDataFrame([("p1", "toys"), ("p2", "art")], "product_id string, upper_category string")
    sellers = spark.createDataFrame([("s1", 11), ("s2", 22)], "seller_id string, seller_zip_code_prefix int")
    assert rows(features.order_profile(items, upper, sellers)) == [("o1", "art", 11, 3), ("o2", "miss", 0, 1)]


def test_missing_score_takes_the_mean_of_joined_orders(spark):
    items = spark.createDataFrame([("o1",), ("o2",), ("o3",)], "order_id string")
    profile = items.withColumn("upper_category", F.lit("art"))
    reviews = spark.createDataFrame([(0, "o1", 5.0), (1, "o1", 1.0), (2, "o2", 2.0), (3, "o3", None), (4, "o7", 1.0)], "_row int, order_id string, review_score double")
    assert rows(features.scored_orders(profile, items, reviews), "order_id", "review_score") == [("o1", 5.0), ("o2", 2.0), ("o3", 3.5)]


def test_unknown_centroid_gives_zero_distance(spark):
    df = spark.createDataFrame([(1, 2), (1, 9), (1, 1)], "seller_zip_code_prefix int, customer_zip_code_prefix int")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "geolocation_zip_code_prefix int, lat_d_mean double, lng_d_mean double")
    assert rows(features.with_distance(df, places), "distance") == [(0.0,), (0.0,), (5.0,)]


BASE = "customer_unique_id string, order_id int, order_purchase_timestamp timestamp_ntz, review_score double, payment_value double"


def test_history_prefixes(spark):
    data = [
        ("a", 1, T("2018-01-01 12:00"), 5.0, 10.0), ("a", 2, T("2018-01-03 11:00"), 3.0, 20.0), ("a", 3, T("2018-01-03 13:00"), 1.0, 30.0),
        ("a", 4, T("2018-01-20 12:00"), 2.0, 40.0), ("b", 5, T("2017-01-01"), 4.0, 1.0),
    ]
    base = spark.createDataFrame(data, BASE)
    today = F.lit(T("2018-01-21 11:00")).cast("timestamp_ntz")
    got = {r["order_id"]: r for r in features.prefixes(base, today).collect()}
    last = got[4]
    assert (last["orders_count"], last["last_days_between_orders"], last["mean_score"], last["mean_payment"], last["mean_days_between_orders"], last["days_after_order"]) == (4, 16, 3.0, 20.0, 1.0, 0)
    assert (got[2]["last_days_between_orders"], got[2]["mean_score"], got[2]["mean_days_between_orders"]) == (1, 5.0, None)
    assert (got[3]["last_days_between_orders"], got[3]["mean_score"], got[3]["mean_days_between_orders"]) == (0, 4.0, 1.0)
    assert (got[1]["last_days_between_orders"], got[1]["mean_score"], got[1]["history_length"]) == (None, None, 4)
    labels = {r["order_id"]: r["retention"] for r in features.history_dataset(base, today).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_keeping_a_number_of_one_order_people(spark):
    data = [(f"p{i}", i, T("2018-01-01"), 1.0, 1.0) for i in range(50)] + [("twice", 60, T("2018-01-01"), 1.0, 1.0), ("twice", 61, T("2018-01-02"), 1.0, 1.0)]
    kept = features.sample_one_order_people(spark.createDataFrame(data, BASE), 7)
    assert kept.count() == 9 and kept.where("customer_unique_id = 'twice'").count() == 2


SESSION = "customer_unique_id string, order_purchase_timestamp timestamp_ntz, upper_category string, payment_value double, review_score double, seller_zip_code_prefix int, customer_zip_code_prefix int"


def test_poisson_labels(spark):
    def visit(person, day, category):
        return (person, T(f"2018-01-{day:02}"), category, 1.0, 1.0, 1, 1)

    data = [visit("often", d, "art") for d in (1, 3, 5, 7)]
    data += [visit("pair", 1, "books"), visit("pair", 5, "books")] + [visit("slow", 1, "toys"), visit("slow", 9, "toys")]
    data += [visit("mixed", 1, "books"), visit("mixed", 2, "toys")] + [visit("new", 1, "pets"), visit("new", 2, "auto")]
    repeated = sessions.repeated_sessions(spark.createDataFrame(data, SESSION))
    today = F.lit(T("2018-01-17")).cast("timestamp_ntz")
    rates = {r["upper_category"]: r["rate"] for r in churn.category_rates(repeated).collect()}
    assert rates == {"books": 0.25, "toys": 0.125}
    got = {r["id"]: r for r in churn.poisson_labels(repeated, today).collect()}
    assert got["often"]["lambda"] == 0.5 and got["often"]["val"] == pytest.approx(np.exp(-5.0)) and got["often"]["class"] == 0
    assert got["pair"]["lambda"] == 0.25 and got["slow"]["lambda"] == 0.125
    assert got["mixed"]["lambda"] == pytest.approx(0.1875)
    assert got["new"]["lambda"] == pytest.approx(2 / 12)
    assert churn.thrice_same(repeated).first()[0] == 0


def test_category_tree_covers_its_names():
    names = [n for names in C.CATEGORY_TREE.values() for n in names]
    assert len(C.CATEGORY_TREE) == 12 and len(names) == len(set(names)) == 71
    assert len(C.STATES) == 27 and len(C.INVALID_SELLER_CITIES) == 18 and len(C.REPEAT_SECONDS) == len(C.REPEAT_SHARES) == 28
