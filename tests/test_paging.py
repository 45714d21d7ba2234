import random
import re
from datetime import datetime, timedelta

import pytest

from patronlens.functions.paging import page, sorting

from conftest import rows


def test_pages_cover_the_table_once(spark):
    df = spark.range(45).selectExpr("id", "id % 5 AS x")
    pages = [[r["id"] for r in page(df, ["x", "id"], k).collect()] for k in range(4)]
    assert [len(p) for p in pages] == [20, 20, 5, 0]
    assert sum(pages, []) == sorted(range(45), key=lambda i: (i % 5, i))


@pytest.mark.parametrize("order", [["x", "id"], [("x", True), "id"], ["t", ("id", True)], [("s", True), "id"], ["s", "x", "id"], [("d", True), "id"]])
def test_deep_pages_equal_the_full_sort(spark, order):
    """Ranges of 7 and sorts of at most 50 rows, with nulls, texts of one long start and a value of a third of the rows."""
    rng, start = random.Random(2), datetime(2020, 1, 1)
    data = []
    for i in range(1500):
        x = 5.0 if rng.random() < 0.35 else rng.choice([None, float("nan"), rng.gauss(0, 100), rng.gauss(0, 1)])
        s = rng.choice([None, "", "é", "a" * 30 + str(rng.randrange(90)), "b" + str(rng.randrange(9))])
        data.append((i, x, s, start + timedelta(minutes=rng.randrange(2000)), (start + timedelta(days=rng.randrange(9))).date()))
    df = spark.createDataFrame(data, "id long, x double, s string, t timestamp_ntz, d date").cache()
    ids = [r["id"] for r in df.orderBy(*sorting(order)).collect()]
    for number in (0, 31, 74, 75):
        assert [r["id"] for r in page(df, order, number, 20, ranges=7, bound=50).collect()] == ids[number * 20: number * 20 + 20], number


def test_a_deep_page_skips_only_rows_of_its_range(spark):
    df = spark.range(200_000).selectExpr("id", "(id * 7919) % 200003 AS x")
    deep = page(df, ["x", "id"], 9000, 20, bound=1000)
    plan = deep._jdf.queryExecution().optimizedPlan().toString()
    skipped = [int(n) for n in re.findall(r"Offset (\d+)", plan)]
    assert len(skipped) <= 2 and max(skipped, default=0) < 1000
    assert rows(deep, "x") == rows(df.orderBy("x").offset(180_000).limit(20), "x")


def test_pages_of_an_empty_table(spark):
    assert page(spark.createDataFrame([], "id long"), ["id"], 2).collect() == []
