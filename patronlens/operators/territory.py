"""Zip centroids, map filters, churn by state and state outlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens import constants as C

ZIP = "geolocation_zip_code_prefix"


def zip_centroids(points: DataFrame) -> DataFrame:
    """Mean of a zip's distinct points, its most common city and state (over all rows).

    Points, cities and states are counted in one pass with grouping sets; what reaches a zip's own
    step is one row per distinct point, city or state.
    """
    lat, lng, city, state = "geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state"
    sets = [[lat, lng], [city], [state]]
    columns = [ZIP, lat, lng, city, state]
    counted = points.groupingSets([[F.col(c) for c in [ZIP, *s]] for s in sets], *columns).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(s[0]).alias(f"without_{i}") for i, s in enumerate(sets)]
    )

    def top(column: str, i: int) -> Column:
        voted = (F.col(f"without_{i}") == 0) & F.col(column).isNotNull()
        return F.min(F.when(voted, F.struct(-F.col("n"), F.col(column).alias("v"))))

    return counted.groupBy(ZIP).agg(
        F.avg(F.when(F.col("without_0") == 0, F.col(lat))).alias("lat_d_mean"),
        F.avg(F.when(F.col("without_0") == 0, F.col(lng))).alias("lng_d_mean"),
        top(city, 1).alias("city"),
        top(state, 2).alias("state"),
    ).withColumns({"city": F.col("city.v"), "state": F.col("state.v")})


def with_point_counts(points: DataFrame) -> DataFrame:
    """Each point with the number of points of its zip.

    Counted per zip and joined back: a zip with very many points is split in the join, where a
    window would put it into one task.
    """
    return points.join(points.groupBy(ZIP).agg(F.count(ZIP).alias("points_count")), ZIP, "left")


def select_points(points: DataFrame, states: Sequence[str] = (), zips: Sequence[int] = ()) -> DataFrame:
    """Single points of the chosen states and zips; with nothing chosen, nothing."""
    if not states and not zips:
        return points.where(F.lit(False))
    return _select(points, "geolocation_state", states, zips)


def select_centroids(centroids: DataFrame, states: Sequence[str] = (), zips: Sequence[int] = ()) -> DataFrame:
    """Centroids of the chosen states and zips; with nothing chosen, all."""
    return _select(centroids, "state", states, zips)


def _select(df: DataFrame, state_column: str, states: Sequence[str], zips: Sequence[int]) -> DataFrame:
    if zips:
        df = df.where(F.col(ZIP).isin(list(zips)))
    if states:
        df = df.where(F.col(state_column).isin(list(states)))
    return df


def map_centre(centroids: DataFrame) -> DataFrame:
    return centroids.agg(F.avg("lat_d_mean").alias("lat"), F.avg("lng_d_mean").alias("lng"))


def choices(centroids: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values for a selector."""
    return centroids.select(column).distinct().orderBy(column)


def state_churn(
    recency: DataFrame, customers: DataFrame, states: Sequence[str] = tuple(C.STATES), gone_after: int = C.GONE_AFTER_DAYS
) -> DataFrame:
    """People per state, those gone, and the share. A state without people counts 0 and has no share."""
    people = (
        recency.select("customer_unique_id", "recency_days")
        .join(customers.select("customer_unique_id", "customer_state"), "customer_unique_id")
        .distinct()
    )
    counted = people.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("overall"), F.count_if(F.col("recency_days") > gone_after).alias("fired")
    )
    listed = customers.sparkSession.createDataFrame([(s,) for s in states], "customer_state string")
    filled = listed.join(counted, "customer_state", "left").na.fill(0, ["overall", "fired"])
    return filled.withColumn("share", F.col("fired") / F.nullif(F.col("overall"), F.lit(0)))


def share_range(churn: DataFrame) -> DataFrame:
    return churn.agg(F.min("share").alias("min_share"), F.max("share").alias("max_share")).withColumn(
        "delta", F.col("max_share") - F.col("min_share")
    )


def _thinned(ring: Column, step: int) -> Column:
    return F.filter(ring, lambda _, i: i % step == 0)


def state_outlines(features: DataFrame, step: int = 10) -> DataFrame:
    """Outline of each feature, thinned to every ``step``-th vertex, and the middle of its box.

    ``features`` has ``id``, ``type`` and ``polygons`` (polygons, rings, vertices, lng and lat). A
    multi-polygon is represented by the polygon whose outer ring has most vertices. A single polygon
    leaves its last thinned vertex out of the box, a multi-polygon does not.
    """
    outer = F.transform("polygons", lambda p: F.get(p, 0))
    longest = F.array_max(F.transform(outer, F.size))
    ring = F.get(F.filter(outer, lambda r: F.size(r) == longest), 0)
    outlined = features.where(F.col("type").isin("Polygon", "MultiPolygon")).select(
        "id", "type", F.when(F.col("type") == "Polygon", F.get(outer, 0)).otherwise(ring).alias("ring")
    )
    outlined = outlined.withColumn("outline", _thinned(F.col("ring"), step)).drop("ring")
    boxed = F.when(F.col("type") == "Polygon", F.slice("outline", F.lit(1), F.greatest(F.size("outline") - 1, F.lit(0)))).otherwise(F.col("outline"))

    def middle(axis: int) -> Column:
        values = F.transform("boxed", lambda v: F.get(v, axis))
        return (F.array_max(values) + F.array_min(values)) / 2

    return outlined.withColumn("boxed", boxed).select(
        "id", "type", "outline", middle(1).alias("center_lat"), middle(0).alias("center_lon")
    )


def labelled_outlines(outlines: DataFrame, churn: DataFrame) -> DataFrame:
    """Outlines of the states with their shares and the label text."""
    joined = outlines.join(churn.withColumnRenamed("customer_state", "id"), "id")
    text = F.format_string(
        "Штат %s: пользователей ушло %d, всего было %d (%.1f%%)",
        "id", F.col("fired"), F.col("overall"), F.col("share") * 100,
    )
    return joined.withColumn("text", F.when(F.col("share").isNotNull(), text))
