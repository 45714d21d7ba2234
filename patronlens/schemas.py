"""Explicit schemas of the nine raw tables, so that no reader has to infer types."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT, _LONG, _DOUBLE, _TIME = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType(),
)

ROW = "_row"


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW = {
    "customers": _schema(
        ("customer_id", _TEXT), ("customer_unique_id", _TEXT), ("customer_zip_code_prefix", _INT),
        ("customer_city", _TEXT), ("customer_state", _TEXT),
    ),
    "orders": _schema(
        ("order_id", _TEXT), ("customer_id", _TEXT), ("order_status", _TEXT),
        ("order_purchase_timestamp", _TIME), ("order_approved_at", _TIME),
        ("order_delivered_carrier_date", _TIME), ("order_delivered_customer_date", _TIME),
        ("order_estimated_delivery_date", _TIME),
    ),
    "orders_items": _schema(
        (ROW, _LONG), ("order_id", _TEXT), ("product_id", _TEXT), ("seller_id", _TEXT),
        ("shipping_limit_date", _TIME), ("price", _DOUBLE), ("freight_value", _DOUBLE),
    ),
    "order_payments": _schema(
        (ROW, _LONG), ("order_id", _TEXT), ("payment_type", _TEXT), ("payment_value", _DOUBLE),
    ),
    "order_reviews": _schema((ROW, _LONG), ("order_id", _TEXT), ("review_score", _DOUBLE)),
    "products": _schema(
        ("product_id", _TEXT), ("product_category_name", _TEXT), ("product_name_lenght", _INT),
        ("product_description_lenght", _INT),
    ),
    "product_category_name_translation": _schema(
        (ROW, _LONG), ("product_category_name", _TEXT), ("product_category_name_english", _TEXT),
    ),
    "sellers": _schema(
        (ROW, _LONG), ("seller_id", _TEXT), ("seller_zip_code_prefix", _INT), ("seller_city", _TEXT),
    ),
    "geolocation": _schema(
        (ROW, _LONG), ("geolocation_zip_code_prefix", _INT), ("geolocation_lat", _DOUBLE),
        ("geolocation_lng", _DOUBLE), ("geolocation_city", _TEXT), ("geolocation_state", _TEXT),
    ),
}


def cleaned(table: str) -> T.StructType:
    """Schema of a cleaned table: no index column, spelling of the product columns corrected."""
    fields = []
    for field in RAW[table].fields:
        if field.name != ROW:
            fields.append(T.StructField(field.name.replace("lenght", "length"), field.dataType, True))
    return T.StructType(fields)
