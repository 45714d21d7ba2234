"""Lines go to their order once, and the mean score is that of all kept orders, paid or not."""

from patronlens.operators import features

from conftest import rows


def test_lines_are_shuffled_once_to_their_order(spark):
    items = spark.createDataFrame(
        [(1, 10, 1, 5, 2.0), (2, 10, 2, 6, 2.0), (3, 10, 3, 6, 1.0), (4, 11, 9, 7, 1.0), (5, None, 1, 5, 1.0)],
        "_row long, order_id long, product_id long, seller_id long, price double",
    )
    upper = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "product_id long, upper_category string")
    sellers = spark.createDataFrame([(5, 50), (6, 60)], "seller_id long, seller_zip_code_prefix int")
    got = features.order_profile(items, upper, sellers)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(order_id") == 1
    assert rows(got) == [(None, "b", 50, 1), (10, "a", 50, 3), (11, "miss", 0, 1)]


def test_mean_score_of_kept_orders_in_one_pass(spark, at):
    day = at("2020-01-01")
    orders = spark.createDataFrame([(i, i, "delivered", day) for i in (1, 2, 3)], "order_id long, customer_id long, order_status string, order_purchase_timestamp timestamp_ntz")
    customers = spark.createDataFrame([(i, 7, 0) for i in (1, 2, 3)], "customer_id long, customer_unique_id long, customer_zip_code_prefix int")
    reviews = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (3, 2, 6.0), (4, 9, 100.0)], "_row long, order_id long, review_score double")
    payments = spark.createDataFrame([(1, 1, 5.0), (2, 3, None)], "_row long, order_id long, payment_value double")
    base = features.order_base(orders, customers, reviews, payments)
    assert "LeftOuter" not in base._jdf.queryExecution().optimizedPlan().toString()  # joined and written already
    assert rows(base, "order_id", "review_score", "payment_value") == [(1, 1.0, 5.0), (1, 2.0, 5.0), (3, 3.0, None)]


def test_whole_histories_move_and_write_their_base_once(spark, at, monkeypatch):
    written = []
    monkeypatch.setattr(features, "cut_lineage", lambda df: written.append(df) or df)
    base = spark.createDataFrame(
        [(1, 1, at("2020-01-01"), 1.0, 5.0), (1, 2, at("2020-01-01"), 2.0, 6.0), (1, 2, at("2020-01-01"), 4.0, 6.0),
         (1, 3, at("2020-02-01"), 3.0, 7.0), (2, 4, at("2020-02-03"), None, 8.0), (None, 5, at("2020-02-04"), 5.0, None)],
        "customer_unique_id long, order_id long, order_purchase_timestamp timestamp_ntz, review_score double, payment_value double",
    )
    today = base.agg({"order_purchase_timestamp": "max"}).scalar()
    every = features.prefixes(base, today).where("orders_count = history_length")
    got = features.history_dataset(base, today, expand=False, gone_after=None)
    assert rows(got) == rows(every) and len(rows(got)) == 3 and not written
    assert "(_i" in got._jdf.queryExecution().optimizedPlan().toString()  # rows inside an hour end before the join
