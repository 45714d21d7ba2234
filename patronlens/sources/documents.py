"""JSON dimensions and state outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens import constants as C

RINGS = "array<array<array<double>>>"
GEOMETRY = "struct<type: string, coordinates: string>"
FEATURE_LINE = f"type string, id string, geometry {GEOMETRY}"
COLLECTION = f"features array<struct<type: string, id: string, geometry: {GEOMETRY}>>"


def category_tree(spark: SparkSession) -> DataFrame:
    """The built-in tree: ``upper_category`` and its English ``names``."""
    return spark.createDataFrame(list(C.CATEGORY_TREE.items()), "upper_category string, names array<string>")


def read_category_tree(spark: SparkSession, path: str) -> DataFrame:
    """A tree stored as one JSON object from upper category to names (a dozen entries)."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, array<string>>")
    return text.select(F.explode(entries).alias("upper_category", "names"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, so that readers can split the files."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _polygons(kind: Column, coordinates: Column) -> Column:
    single = F.array(F.from_json(coordinates, RINGS))
    return F.when(kind == "Polygon", single).when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{RINGS}>"))


def read_outlines(spark: SparkSession, path: str, collection: bool = True) -> DataFrame:
    """GeoJSON features as ``id``, ``type`` and ``polygons``.

    ``collection=True`` reads a feature collection, which is one object and so one task; it is meant
    for a map of states. Many outlines come one feature per line with ``collection=False``.
    """
    if collection:
        whole = spark.read.schema(COLLECTION).option("multiLine", True).json(path)
        features = whole.select(F.inline("features"))
    else:
        features = read_json(spark, path, FEATURE_LINE)
    kind = F.col("geometry.type")
    return features.select("id", kind.alias("type"), _polygons(kind, F.col("geometry.coordinates")).alias("polygons"))


def outline_lines(features: DataFrame) -> DataFrame:
    """Features in the shape ``read_outlines(collection=False)`` reads."""
    kind = F.col("type")
    coordinates = F.when(kind == "Polygon", F.to_json(F.get("polygons", 0))).otherwise(F.to_json("polygons"))
    return features.select(
        F.lit("Feature").alias("type"), F.col("id").cast("string").alias("id"),
        F.struct(kind.alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )
