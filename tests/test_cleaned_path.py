"""From nine CSV files to features: load, clean, order dataset, one-order features, RFM cells, saved tables."""

import os

import pytest
from pyspark.errors import PySparkException

from conftest import rows
from patronlens.operators import cleaning, features, rfm, territory
from patronlens.plans.driver_tables import Shop
from patronlens import schemas
from patronlens.session import cut_lineage
from patronlens.sources import csv_tables

FOLDER = "/root/testdata/sf0.001"


def dataset_of(tables, tree):
    upper = cleaning.product_categories(tables["products"], tables["product_category_name_translation"], tree)
    return features.order_dataset(
        tables["orders_items"], upper, tables["sellers"], tables["order_reviews"], tables["order_payments"], tables["orders"], tables["customers"]
    )


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_cleaned_csv_tables_feed_the_features(spark, tmp_path):
    shop = Shop(spark, FOLDER, "customer_year")
    raw = {name: cut_lineage(df) for name, df in shop.raw().items()}
    for name, df in raw.items():
        csv_tables.write_table(df, str(tmp_path / "raw"), name, "csv")
    loaded = cleaning.clean(csv_tables.load_raw(spark, str(tmp_path / "raw")))
    direct = cleaning.clean(raw)
    tree = shop.category_tree()
    a, b = (cut_lineage(dataset_of(t, tree)) for t in (loaded, direct))
    names = ["upper_category", "seller_zip_code_prefix", "review_score", "payment_value"]
    assert rows(a, *names) == rows(b, *names) and a.count() > 0
    today = features.reference_date(loaded["orders"])
    one = features.one_order_features(a, territory.zip_centroids(loaded["geolocation"]), today)
    assert one.count() > 0 and one.where("time_delta IS NULL").count() == 0
    cells = rfm.cells(rfm.rfm_table(loaded["orders"], loaded["customers"], loaded["order_payments"]))
    assert cells.agg({"count": "sum"}).first()[0] == rfm.rfm_table(direct["orders"], direct["customers"], direct["order_payments"]).count()
    csv_tables.save_clean(loaded, str(tmp_path / "clean"))
    saved = csv_tables.load_clean(spark, str(tmp_path / "clean"), str(tmp_path / "raw"))
    assert all("_row" not in df.columns for df in saved.values()) and dataset_of(saved, tree).count() == a.count()


def test_quoted_line_breaks_and_bad_values(spark, tmp_path):
    text = ',order_id,review_score,comment\n0,o1,4.0,"two\nlines, a comma and a ""quote"""\n1,o2,,\n2,o3,5,plain\n'
    (tmp_path / "order_reviews.csv").write_text(text)
    read = csv_tables.read_csv(spark, str(tmp_path / "order_reviews.csv"), schemas.RAW["order_reviews"], multiline=True)
    assert rows(read, "_row", "order_id", "review_score", "comment") == [(0, "o1", 4.0, 'two\nlines, a comma and a "quote"'), (1, "o2", None, None), (2, "o3", 5.0, "plain")]
    (tmp_path / "bad.csv").write_text("_row,order_id,review_score\n0,o1,x4\n")
    with pytest.raises(PySparkException):
        csv_tables.read_csv(spark, str(tmp_path / "bad.csv"), schemas.RAW["order_reviews"]).collect()
    (tmp_path / "whole.csv").write_text("product_id,product_name_lenght\np1,40.0\np2,7\n")
    assert rows(csv_tables.read_csv(spark, str(tmp_path / "whole.csv"), schemas.RAW["products"])) == [("p1", 40), ("p2", 7)]


def test_one_person_with_most_orders_of_one_day(spark):
    start = 1_500_000_000
    data = [("hot", f"h{i:05d}", start + i, float(i % 5), float(i % 7)) for i in range(3000)]
    data += [(f"p{i}", f"o{i}", start + 90_000 * i, 3.0, 1.0) for i in range(20)] + [("p1", "late", start + 10**7, 1.0, 2.0)]
    base = spark.createDataFrame(data, "customer_unique_id string, order_id string, t long, review_score double, payment_value double")
    base = cut_lineage(base.selectExpr("customer_unique_id", "order_id", "CAST(timestamp_seconds(t) AS TIMESTAMP_NTZ) AS order_purchase_timestamp", "review_score", "payment_value"))
    got = {r["order_id"]: r for r in features.prefixes(base, features.reference_date(base)).collect()}
    assert len(got) == len(data)
    score = 0.0
    for i in range(3000):
        row = got[f"h{i:05d}"]
        assert row["orders_count"] == i + 1 and row["history_length"] == 3000
        assert i == 0 or abs(row["mean_score"] - score / i) < 1e-9
        score += i % 5
    gaps = {r["order_id"]: r["gap"] for r in features.order_gaps(base).collect()}
    assert len(gaps) == 3000 and gaps["h02999"] == 1.0 and gaps["late"] == 10**7 - 90_000
