import json
from datetime import datetime

from pyspark.sql import types as T

from patronlens import constants as C
from patronlens import schemas
from patronlens.operators import cleaning, territory
from patronlens.plans.learning import read_order_features
from patronlens.sources import csv_tables, database, documents

from conftest import rows


def test_raw_csv_with_saved_index(spark, tmp_path):
    (tmp_path / "order_reviews.csv").write_text(',order_id,review_score,comment\n0,o1,5,"a, ""b"""\n1,o2,,\n', encoding="utf-8")
    df = csv_tables.read_csv(spark, str(tmp_path / "order_reviews.csv"), schemas.RAW["order_reviews"])
    assert df.columns == ["_row", "order_id", "review_score", "comment"]
    assert rows(df) == [(0, "o1", 5.0, 'a, "b"'), (1, "o2", None, None)]
    assert cleaning.reviews(df).columns == ["order_id", "review_score", "comment"]


def test_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("order_status,order_id,order_purchase_timestamp\ndelivered,o1,2017-10-02 10:56:33\n")
    df = csv_tables.read_csv(spark, str(tmp_path / "orders.csv"), schemas.RAW["orders"])
    assert df.first().asDict() == {"order_status": "delivered", "order_id": "o1", "order_purchase_timestamp": datetime(2017, 10, 2, 10, 56, 33)}
    assert isinstance(df.schema["order_purchase_timestamp"].dataType, T.TimestampNTZType)


def test_clean_tables_fall_back_one_by_one(spark, tmp_path):
    raw, clean = tmp_path / "raw", tmp_path / "clean"
    raw.mkdir()
    for table, schema in schemas.RAW.items():
        (raw / f"{table}.csv").write_text(",".join(schema.names) + "\n")
    products = spark.createDataFrame([("p1", "n", 1, 2)], schemas.cleaned("products"))
    sellers = spark.createDataFrame([("s1", 5, "natal")], schemas.cleaned("sellers"))
    csv_tables.save_clean({"products": products}, str(clean), "csv")
    csv_tables.save_clean({"sellers": sellers}, str(clean))
    loaded = csv_tables.load_clean(spark, str(clean), str(raw))
    assert rows(loaded["products"]) == [("p1", "n", 1, 2)] and rows(loaded["sellers"]) == [("s1", 5, "natal")]
    assert loaded["customers"].count() == 0 and loaded["order_reviews"].columns == schemas.RAW["order_reviews"].names


def test_category_tree_file(spark, tmp_path):
    (tmp_path / "tree.json").write_text(json.dumps(C.CATEGORY_TREE, indent=4))
    read = documents.read_category_tree(spark, str(tmp_path / "tree.json"))
    assert {r["upper_category"]: r["names"] for r in read.collect()} == C.CATEGORY_TREE
    products = spark.createDataFrame([("p1", "brinquedos"), ("p2", "novo"), ("p3", "sem")], "product_id string, product_category_name string")
    translation = spark.createDataFrame([("brinquedos", "toys"), ("novo", "brand_new")], "product_category_name string, product_category_name_english string")
    got = cleaning.product_categories(products, translation, documents.category_tree(spark))
    assert rows(got) == [("p1", "baby_kids"), ("p2", ""), ("p3", None)]


def test_feature_collection(spark, tmp_path):
    ring = [[float(i), float(-i)] for i in range(12)]
    features = [
        {"type": "Feature", "id": "SP", "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "id": "RJ", "geometry": {"type": "MultiPolygon", "coordinates": [[ring[:2]], [ring]]}},
    ]
    (tmp_path / "map.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    read = documents.read_outlines(spark, str(tmp_path / "map.json"))
    assert {r["id"]: r["polygons"] for r in read.collect()} == {"SP": [[ring]], "RJ": [[ring[:2]], [ring]]}
    documents.write_json(documents.outline_lines(read), str(tmp_path / "lines"))
    again = documents.read_outlines(spark, str(tmp_path / "lines"), collection=False)
    assert rows(territory.state_outlines(again), "id", "center_lat", "center_lon") == [("RJ", -5.0, 5.0), ("SP", 0.0, 0.0)]


def test_order_features_with_and_without_index(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",customer_unique_id,distance,payment_value,review_score,time_delta,upper_category\n0,p1,1.5,2.0,5.0,12,art\n")
    (tmp_path / "b.csv").write_text("customer_unique_id,distance,payment_value,review_score,time_delta,upper_category\np1,1.5,2.0,5.0,12,art\n")
    assert rows(read_order_features(spark, str(tmp_path / "a.csv"))) == rows(read_order_features(spark, str(tmp_path / "b.csv"))) == [("p1", 1.5, 2.0, 5.0, 12, "art")]


class Recorder:
    """Stands in for a DataFrame and its writer and notes what would be written."""

    def __init__(self, log):
        self.log, self.options, self.how = log, {}, None
        self.write = self

    def format(self, name):
        self.options = {"format": name}
        return self

    def option(self, key, value):
        self.options[key] = value
        return self

    def mode(self, how):
        self.how = how
        return self

    def limit(self, n):
        self.options["limit"] = n
        return self

    def save(self):
        self.log.append((self.how, dict(self.options)))


def test_database_writes():
    """No database is started here; the requests to the JDBC writer are checked instead."""
    log = []
    tables = {t: Recorder(log) for t in ("orders", "orders_items", "products")}
    database.empty(tables, "jdbc:x", {"user": "u"})
    database.load(tables, "jdbc:x")
    assert [(how, o["dbtable"]) for how, o in log] == [
        ("overwrite", "orders_items"), ("overwrite", "orders"), ("overwrite", "products"),
        ("append", "products"), ("append", "orders"), ("append", "orders_items"),
    ]
    assert log[0][1]["truncate"] is True and log[0][1]["user"] == "u" and log[3][1]["batchsize"] == 1_000


def test_rows_that_do_not_fit_are_set_apart(spark, tmp_path):
    for table, schema in schemas.RAW.items():
        (tmp_path / f"{table}.csv").write_text(",".join(schema.names) + "\n")
    (tmp_path / "orders_items.csv").write_text(
        "Unnamed: 0,order_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
        "0,o1,p1,s1,2017-10-02 10:56:33,1.5,2\n1.0,o2,p1,s1,,,\n2,o3,p1,s1,yesterday,cheap,2\n3,o4,p1\n4,o5,p1,s1,2017-10-02,1,2,9\n"
    )
    (tmp_path / "order_reviews.csv").write_text('_row,order_id,review_score,comment\n0,o1,5,"two\nlines"\n1,o2,many,"a ""b"""\n')
    tables, rejects = csv_tables.load_checked(spark, str(tmp_path))
    assert rows(tables["orders_items"], "_row", "order_id", "price") == [(0, "o1", 1.5), (1, "o2", None)]
    assert rows(tables["order_reviews"]) == [(0, "o1", 5.0, "two\nlines")]
    assert rows(rejects) == [
        ("order_reviews", "review_score: double", 1), ("orders_items", "fields", 2),
        ("orders_items", "price: double", 1), ("orders_items", "shipping_limit_date: timestamp_ntz", 1),
    ]
    good, bad = csv_tables.read_checked(spark, str(tmp_path / "order_reviews.csv"), schemas.RAW["order_reviews"], True)
    assert good.count() == 1 and json.loads(bad.first()["fields"]) == {"_row": "1", "order_id": "o2", "review_score": "many", "comment": 'a "b"'}
