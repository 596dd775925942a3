"""What a map shows: names, locations, markers, and feeds of places, visits and predictions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Metres of a degree of latitude, of the first circle of markers and between circles; markers of a circle.
DEGREE_M, FIRST_M, STEP_M, CIRCLE = 111_320.0, 8.0, 6.0, 8


def first_non_empty(*columns: Column) -> Column:
    """The first of the columns that is neither null nor an empty text; null if none is."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def display_name(place_name: Column, place_type: Column, cluster_id: Column) -> Column:
    return first_non_empty(place_name, place_type, cluster_id)


def location(center: Column, lat: Column, lng: Column, coordinates: Column) -> Column:
    """struct(lat, lng): the centre, else the plain columns, else the stored (lng, lat) point; each only where it is whole; null if none is."""
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b), F.struct(a.alias("lat"), b.alias("lng")))
    return F.coalesce(pair(center["lat"], center["lng"]), pair(lat, lng), pair(F.try_element_at(coordinates, F.lit(2)), F.try_element_at(coordinates, F.lit(1))))


def infer_activity(kmph: Column) -> Column:
    """STAY for 0, WALK up to 7, DRIVE above; UNKNOWN for what is no number."""
    return F.when(kmph == 0, "STAY").when(kmph <= 7, "WALK").when((kmph > 7) & ~F.isnan(kmph), "DRIVE").otherwise("UNKNOWN")


def spread_markers(points: DataFrame, order: list[str]) -> DataFrame:
    """points (lat, lng, ..) with marker_lat and marker_lng: those at one position of 7 decimals are moved onto circles around it.

    Positions are counted by a window; a position with a great share of all rows is one group of it.
    """
    key = ["_a", "_o"]
    q = points.withColumns({"_a": F.round("lat", 7), "_o": F.round("lng", 7)})
    q = q.withColumns({"_n": F.count("*").over(Window.partitionBy(*key)), "_i": F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1})
    away, turn = FIRST_M + F.floor(F.col("_i") / CIRCLE) * STEP_M, F.col("_i") / F.col("_n") * (2 * pi)
    moved = lambda d, c: F.when(F.col("_n") > 1, F.col(c) + d).otherwise(F.col(c))
    q = q.withColumns({"marker_lat": moved(F.cos(turn) * away / DEGREE_M, "lat"), "marker_lng": moved(F.sin(turn) * away / (DEGREE_M * F.cos(F.radians("lat"))), "lng")})
    return q.drop("_a", "_o", "_n", "_i")


def with_centres(visits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Visits with the centre of their cluster as lat and lng, null where it has none."""
    return visits.join(clusters.select("user_id", "cluster_id", "lat", "lng"), ["user_id", "cluster_id"], "left")


def visit_feed(visits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Visits that have a position, with their cluster's name and figures."""
    about = clusters.select("user_id", "cluster_id", "place_type", "place_type_confidence", F.col("total_points").alias("total_cluster_points"), "visit_count", "lat", "lng")
    q = visits.join(about, ["user_id", "cluster_id"], "left").where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    name = display_name(F.lit(None), F.col("place_type"), F.col("cluster_id"))
    return q.select("user_id", "cluster_id", name.alias("cluster_name"), "lat", "lng", "duration_sec", "point_count", "day_of_week", "time_of_day", "date", "visit_start", "visit_end", "place_type_confidence", "total_cluster_points", "visit_count")


def prediction_feed(predictions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Predicted places (user_id, rank, cluster_id, confidence) that have a finite position."""
    at = clusters.select("user_id", "cluster_id", "place_type", "lat", "lng")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    q = predictions.join(at, ["user_id", "cluster_id"]).where(finite("lat") & finite("lng"))
    return q.select("user_id", "rank", "cluster_id", first_non_empty(F.col("place_type"), F.col("cluster_id")).alias("cluster_name"), "confidence", "lat", "lng")


def clusters_of_visits(clusters: DataFrame, visits: DataFrame) -> DataFrame:
    """The clusters that some visit of their user names."""
    return clusters.join(visits.select("user_id", "cluster_id"), ["user_id", "cluster_id"], "left_semi")


def model_first(rules: DataFrame, model: DataFrame, least: float = 0.7) -> DataFrame:
    """The model's places for the requests (user_id, from_cluster_id) whose first one it gives `least` or more, else those of the rules.

    Both have user_id, from_cluster_id, rank, next_cluster_id, confidence and
    expected_trip_duration_min; source tells where a row is from.
    """
    columns = ["user_id", "from_cluster_id", "rank", "next_cluster_id", "confidence", "expected_trip_duration_min", "source"]
    sure = model.where((F.col("rank") == 1) & (F.col("confidence") >= least)).select("user_id", "from_cluster_id").distinct()
    by_model = model.withColumns({"source": F.lit("ml_model"), "expected_trip_duration_min": F.round("expected_trip_duration_min").cast("long")})
    return by_model.join(sure, ["user_id", "from_cluster_id"], "left_semi").select(columns).unionByName(rules.join(sure, ["user_id", "from_cluster_id"], "left_anti").select(columns))
