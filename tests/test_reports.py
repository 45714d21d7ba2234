"""Hand-made frames with results worked out by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from patronlens import constants as C
from patronlens.operators import abcxyz, activity, cohorts, rfm

from conftest import rows


def shop(spark, purchases):
    """Orders and customers from (person, time, status)."""
    orders = [(f"o{i}", f"c{i}", status, datetime.fromisoformat(t)) for i, (_, t, status) in enumerate(purchases)]
    people = [(f"c{i}", person, "SP") for i, (person, _, _) in enumerate(purchases)]
    return (
        spark.createDataFrame(orders, "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz"),
        spark.createDataFrame(people, "customer_id string, customer_unique_id string, customer_state string"),
    )


def test_period_ends_drift(spark):
    orders, _ = shop(spark, [("a", "2016-09-04 10:00", "delivered"), ("b", "2017-04-10", "delivered")])
    ends = [r["end_month"] for r in activity.period_spine(orders).collect()]
    assert ends == [date(2016, 9, 30), date(2016, 10, 30), date(2016, 11, 30), date(2016, 12, 30),
                    date(2017, 1, 30), date(2017, 2, 28), date(2017, 3, 28), date(2017, 4, 28)]


def test_quarterly_labels_show_the_drift(spark):
    orders, customers = shop(spark, [("a", "2016-09-04", "delivered"), ("b", "2017-08-01", "delivered")])
    labels = [r["period"] for r in activity.retention(orders, customers, 3, "period").collect()]
    assert labels == ["2016-09 to 2016-11", "2016-12 to 2017-02", "2017-03 to 2017-05", "2017-05 to 2017-08"]


def test_retention_counts(spark):
    orders, customers = shop(spark, [
        ("a", "2016-09-04", "x"), ("b", "2016-10-02", "x"), ("a", "2016-10-20", "x"), ("c", "2016-12-30", "x"),
    ])
    got = [tuple(r)[1:] for r in activity.retention(orders, customers).collect()]
    # Departed by the end of December: b (last before 30 November); a on 20 October too.
    assert got == [(0, 1, 0, 1, None), (1, 1, 0, 2, 100.0), (2, 0, 2, 0, 0.0), (2, 1, 2, 1, 0.0)]


def test_retention_carries_over(spark):
    """start(k+1) = start(k) + new(k), and everyone is new exactly once."""
    import random

    rng = random.Random(2)
    purchases = [(f"p{rng.randrange(80)}", f"2017-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", "x") for _ in range(200)]
    orders, customers = shop(spark, purchases)
    got = activity.retention(orders, customers).collect()
    for now, then in zip(got, got[1:]):
        assert then["starting_customers"] == now["starting_customers"] + now["new_customers"]
    assert sum(r["new_customers"] for r in got) == len({p[0] for p in purchases})


def test_daily_counts_orders_and_peak_takes_the_earliest(spark):
    orders, customers = shop(spark, [
        ("a", "2017-01-01 01:00", "x"), ("a", "2017-01-01 23:00", "x"), ("b", "2017-01-03", "x"), ("c", "2017-01-03", "x"),
    ])
    days = activity.daily(orders, customers)
    assert rows(days, "date_day", "count") == [(date(2017, 1, 1), 2), (date(2017, 1, 3), 2)]
    assert rows(activity.daily(orders, customers, distinct=True), "count") == [(1,), (2,)]
    assert tuple(activity.peak_day(days).first()) == (date(2017, 1, 1), 2)


def test_display_and_bands(spark):
    report = spark.createDataFrame([("2016-09 to 2016-10", 1, 2, 3, 4, None)], "period string, a int, b int, c int, d int, r double")
    shown = activity.retention_display(report).first()
    assert shown["Период"] == "с 2016-09 по 2016-10"
    bands = spark.createDataFrame([(2.0,), (1.0,), (0.5,), (None,)], "r double").select(activity.retention_band(F.col("r")))
    assert [r[0] for r in bands.collect()] == ["good", "middle", "bad", ""]


def test_rfm_unpaid_orders_vanish_and_rate_is_truncated(spark):
    orders, customers = shop(spark, [
        ("a", "2018-01-01", "delivered"), ("a", "2018-01-05", "shipped"), ("a", "2018-01-07 23:00", None), ("b", "2018-01-09", "delivered"),
    ])
    payments = spark.createDataFrame([("o0", 10.0), ("o0", 5.0), ("o1", 1.0), ("o2", 2.0)], "order_id string, payment_value double")
    got = rfm.rates(rfm.customer_metrics(orders, customers, payments), orders).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["recency_days"], r["total_orders_count"], r["monetary_value"], r["avg_order_value"], r["delivered_rate_percentage"]) == (3, 3, 18.0, 6.0, 33.0)


def test_segment_words(spark):
    df = spark.createDataFrame([(1, 2, 3), (3, 3, 1), (4, 1, 1)], "r int, f int, m int")
    words = [r[0] for r in df.select(rfm.describe(F.col("r"), F.col("f"), F.col("m"))).collect()]
    assert words == ["Недавние, не очень часто, низкий чек", "Давние, редкие, высокий чек", "Не определено"]


def test_repeat_probability_inside_and_outside_the_knots(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (1.5,), (3.0,), (1e9,), (None,)], "t double")
    got = [r[0] for r in df.select(rfm.repeat_probability(F.col("t"))).collect()]
    want = [0.0, 0.0, (C.REPEAT_SHARES[1] + C.REPEAT_SHARES[2]) / 2, (C.REPEAT_SHARES[2] + C.REPEAT_SHARES[3]) / 2, C.REPEAT_SHARES[-1], None]
    assert got[:-1] == pytest.approx(want[:-1]) and got[-1] is None
    parity = df.where("t = 1.5").select(rfm.repeat_probability(F.col("t"), parity=True)).first()[0]
    assert parity == pytest.approx(0.5 * (C.REPEAT_SHARES[2] - C.REPEAT_SHARES[1]) + C.REPEAT_SHARES[2])


@pytest.fixture
def goods(spark):
    products = spark.createDataFrame([("p1", "n1"), ("p2", "n2"), ("p3", "n3"), ("p4", "n1")], "product_id string, product_category_name string")
    translation = spark.createDataFrame([("n1", "one"), ("n2", "two"), ("n9", "nine")], "product_category_name string, product_category_name_english string")
    sold = [("p1", 70.0, "1996-10-05"), ("p1", 10.0, "1996-10-06"), ("p1", 0.0, "1996-11-01"), ("p2", 15.0, "1996-10-07"), ("lost", 5.0, "1996-12-01")]
    items = spark.createDataFrame(
        [(f"o{i}", p, price, datetime.fromisoformat(t)) for i, (p, price, t) in enumerate(sold)],
        "order_id string, product_id string, price double, shipping_limit_date timestamp_ntz",
    )
    return products, translation, items


def test_abc_counts_unsold_and_unknown(spark, goods):
    got = {r[0]: tuple(r)[1:] for r in abcxyz.abc(*goods).collect()}
    # Never sold: p3 (no English name), p4 (category one), and the translation without products.
    assert got == {
        "one": (80.0, 4.0, 80.0, 80.0, "A"), "two": (15.0, 1.0, 15.0, 95.0, "C"), "0": (5.0, 1.0, 5.0, 100.0, "C"),
        "nine": (0.0, 1.0, 0.0, 100.0, "C"), "n3": (0.0, 1.0, 0.0, 100.0, "C"),
    }


def test_abc_borders(spark):
    df = spark.createDataFrame([(80.0,), (80.1,), (94.9,), (95.0,)], "c double")
    assert [r[0] for r in df.select(abcxyz.abc_class(F.col("c"))).collect()] == ["A", "B", "B", "C"]


def test_xyz_single_month_has_no_class(spark, goods):
    got = {r[0]: tuple(r)[1:] for r in abcxyz.xyz(*goods, datetime(1996, 1, 1), datetime(1997, 1, 1)).collect()}
    assert got["two"] == (1.0, None, None, "0")
    assert got["one"][0] == 1.5 and got["one"][3] == "Z"


def test_chart_takes_the_commonest_class(spark):
    general = spark.createDataFrame(
        [("a", 9.0, 60.0, "A", "X"), ("b", 2.0, 20.0, "B", "Z"), ("c", 1.0, 10.0, "B", "Y"), ("d", 1.0, 10.0, "B", None)],
        f"{abcxyz.NAME} string, price double, percent double, ABC string, XYZ string",
    )
    assert rows(abcxyz.chart(general), "label", "price", "percent", "XYZ") == [("a", 9.0, 60.0, "X"), ("Группа B", 4.0, 40.0, "Y")]


def brute_cohorts(people, grace):
    high = max(last for _, last in people)
    cells = {}
    for first, last in people:
        life = last - first + grace
        for i in range(life + 1):
            for j in range(life + 1 - i):
                if first + i + j <= high:
                    cells[first + i, j] = cells.get((first + i, j), 0) + 1
    return cells


@pytest.mark.parametrize("grace", [0, 2, 7])
def test_cohorts_equal_the_triple_loop(spark, grace):
    import random

    rng, purchases, people = random.Random(grace), [], []
    for p in range(40):
        first = rng.randrange(0, 14)
        last = first + rng.choice([0, 0, 1, 3, 5])
        people.append((2017 * 12 + first, 2017 * 12 + last))
        for m in (first, last):
            purchases.append((f"p{p}", f"{2017 + m // 12}-{m % 12 + 1:02}-15", "x"))
    orders, customers = shop(spark, purchases)
    got = {(r["cohort_month"], r["months_diff"]): r["customers_count"] for r in cohorts.counts(orders, customers, grace).collect()}
    label = lambda m: f"{m // 12}-{m % 12 + 1:02}"
    assert got == {(label(m), j): n for (m, j), n in brute_cohorts(people, grace).items()}


def test_cohort_without_offset_in_range_keeps_its_row(spark):
    cells = spark.createDataFrame([("2017-01", 0, 8), ("2017-01", 1, 3), ("2017-02", 0, 5), ("2017-03", 0, 2)], "cohort_month string, months_diff int, customers_count long")
    got = [tuple(r) for r in cohorts.retention(cells, 1, 2).collect()]
    assert got == [("2017-01", 37.5, None), ("2017-02", None, None)]
    assert [tuple(r) for r in cohorts.absolute(cells, 1, 2).collect()] == [("2017-01", 3, None)]
