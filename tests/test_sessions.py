import random
from datetime import datetime, timedelta

import pytest

from patronlens.operators import sessions

COLUMNS = (
    "customer_unique_id string, order_purchase_timestamp timestamp_ntz, order_id long, upper_category string, "
    "payment_value double, review_score double, seller_zip_code_prefix int, customer_zip_code_prefix int"
)
DAY = timedelta(hours=24)
ORDER = ["art", "books", "miss"]


def orders(seed, people=12, dense=False):
    rng, data, number = random.Random(seed), [], 0
    for p in range(people):
        t = datetime(2017, 1, 1) + timedelta(minutes=rng.randrange(3000))
        for _ in range(rng.randrange(1, 60 if dense else 12)):
            number += 1
            data.append((f"p{p}", t, number, rng.choice(["art", "books", "miss", "other"]), rng.randrange(1, 400) / 4, float(rng.randrange(1, 6)), p, p + 1))
            t += rng.choice([timedelta(0), timedelta(minutes=rng.randrange(1, 900)), timedelta(hours=rng.randrange(1, 24 if dense else 60)), DAY])
    return data


def expected(data, parity):
    """One pass over each person's orders."""
    result = {}
    for person in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == person), key=lambda d: (d[1], d[2]))
        open_at = None
        for i, d in enumerate(mine):
            if open_at is None or d[1] >= open_at + DAY:
                open_at = d[1]
                result[person, open_at] = {"pay": {}, "scores": [], "zip": d[6]}
            elif parity and i == len(mine) - 1:
                continue
            s = result[person, open_at]
            s["pay"][d[3]] = s["pay"].get(d[3], 0.0) + d[4]
            s["scores"].append(d[5])
    rank = {c: i for i, c in enumerate(ORDER)}
    return {
        key: (min(s["pay"], key=lambda c: (-s["pay"][c], rank.get(c, 99), c)), sum(s["pay"].values()),
              sum(s["scores"]) / len(s["scores"]), len(s["scores"]))
        for key, s in result.items()
    }


@pytest.mark.parametrize("parity", [False, True])
@pytest.mark.parametrize("fold_limit", [1_000, 15, 0])
@pytest.mark.parametrize("dense", [False, True])
def test_sessions_equal_a_sequential_walk(spark, parity, fold_limit, dense):
    data = orders(7 if dense else 5, dense=dense)
    df = sessions.anchored_sessions(spark.createDataFrame(data, COLUMNS), parity, ORDER, fold_limit)
    got = {
        (r["customer_unique_id"], r["order_purchase_timestamp"]):
            (r["upper_category"], r["payment_value"], pytest.approx(r["review_score"]), r["orders"])
        for r in df.collect()
    }
    assert got == expected(data, parity)


def test_trailing_order_within_the_day(spark, at):
    """Two last orders one hour apart: kept together by default, the last one left out in parity."""
    data = [
        ("a", at("2017-01-01 10:00"), 1, "art", 10.0, 5.0, 1, 1),
        ("a", at("2017-01-05 10:00"), 2, "art", 20.0, 4.0, 2, 1),
        ("a", at("2017-01-05 11:00"), 3, "books", 30.0, 1.0, 3, 1),
    ]
    df = spark.createDataFrame(data, COLUMNS)
    kept = {r["order_purchase_timestamp"]: r for r in sessions.anchored_sessions(df).collect()}
    last = kept[at("2017-01-05 10:00")]
    assert (last["payment_value"], last["review_score"], last["upper_category"], last["seller_zip_code_prefix"]) == (50.0, 2.5, "books", 2)
    dropped = {r["order_purchase_timestamp"]: r for r in sessions.anchored_sessions(df, parity=True).collect()}
    last = dropped[at("2017-01-05 10:00")]
    assert (last["payment_value"], last["review_score"], last["upper_category"]) == (20.0, 4.0, "art")


def test_anchor_does_not_move_with_the_last_order(spark, at):
    """20 hours, then 20 hours again: the third order is 40 hours after the anchor and opens a session."""
    times = ["2017-01-01 00:00", "2017-01-01 20:00", "2017-01-02 16:00", "2017-01-03 15:59:59", "2017-01-03 16:00"]
    data = [("a", at(t), i, "art", 1.0, 1.0, 1, 1) for i, t in enumerate(times)]
    got = sessions.with_anchors(spark.createDataFrame(data, COLUMNS)).select("order_id", "anchor").collect()
    assert {r["order_id"]: r["anchor"] for r in got} == {
        0: at(times[0]), 1: at(times[0]), 2: at(times[2]), 3: at(times[2]), 4: at(times[4])
    }
