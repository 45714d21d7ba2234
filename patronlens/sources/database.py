"""Loading tables into a relational database over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Parents first; emptied in the opposite order, because children refer to their parents.
LOAD_ORDER = [
    "product_category_name_translation", "products", "customers", "orders", "order_reviews", "order_payments",
    "sellers", "geolocation", "orders_items",
]


def _writer(df: DataFrame, url: str, table: str, properties: dict[str, str] | None, batch_size: int, connections: int):
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table)
    writer = writer.option("batchsize", batch_size).option("numPartitions", connections)
    for key, value in (properties or {}).items():
        writer = writer.option(key, value)
    return writer


def append(
    df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, batch_size: int = 1_000,
    connections: int = 16,
) -> None:
    """Append rows in batches over at most ``connections`` connections."""
    _writer(df, url, table, properties, batch_size, connections).mode("append").save()


def empty(tables: dict[str, DataFrame], url: str, properties: dict[str, str] | None = None) -> None:
    """Truncate all tables, children before parents; their definitions stay."""
    for table in reversed([t for t in LOAD_ORDER if t in tables]):
        nothing = tables[table].limit(0)
        _writer(nothing, url, table, properties, 1_000, 1).option("truncate", True).option(
            "cascadeTruncate", True
        ).mode("overwrite").save()


def load(tables: dict[str, DataFrame], url: str, properties: dict[str, str] | None = None) -> None:
    for table in [t for t in LOAD_ORDER if t in tables]:
        append(tables[table], url, table, properties)
