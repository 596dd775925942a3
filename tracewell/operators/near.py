"""The nearest of a table of places, whatever its size, by equi-joins of squares that grow from round to round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.geo import DBSCAN_EARTH_M, haversine_m, valid_lat_lng
from tracewell.operators.clusters import squares_around, square_width
from tracewell.sources.tables import at_rest

#: Metres of the first round's reach, and how much each round's is of the one before.
FIRST_M, GROWTH = 25.0, 4.0


def within(spots: DataFrame, places: DataFrame, reach_m: float) -> DataFrame:
    """(lat, lng, near struct<distance, label, kind>) of the spots with a place within reach_m: the nearest, ties to the least label."""
    side = float(np.degrees(reach_m / DBSCAN_EARTH_M)) * 1.001
    row = F.floor(F.col("lat") / side)
    # a place near the date line also counts on the other side of it
    turns = F.explode(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)))
    held = places.withColumn("turn", turns).withColumn("east", F.col("lng") + F.col("turn")).withColumn("row", row)
    held = held.select("label", "kind", F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"), "row", F.floor(F.col("east") / square_width(F.col("row"), side)).alias("col"))
    asked = spots.select("lat", "lng", F.explode(squares_around(F.col("lat"), F.col("lng"), F.col("lng"), row, (-1, 1), reach_m, side)).alias("s")).select("lat", "lng", "s.row", "s.col")
    both = asked.join(held, ["row", "col"]).withColumn("distance", haversine_m(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng")))
    return both.where(F.col("distance") <= reach_m).groupBy("lat", "lng").agg(F.min(F.struct("distance", "label", "kind")).alias("near"))


def nearest_places(points: DataFrame, places: DataFrame, limit_m: float = 180.0, first_m: float = FIRST_M) -> DataFrame:
    """points (lat, lng, ..) with known_place, known_type and known_distance of the nearest place (label, place_type, lat, lng) within limit_m, else nulls.

    Distinct positions are looked up among the places of neighbouring squares, within
    first_m at first; those that have none there go on to a round of a greater reach, so
    crowded places are compared only with what is close. Both sides stay distributed.
    Of equally near places the least label counts; invalid positions have none.
    """
    good = valid_lat_lng(F.col("lat"), F.col("lng"))
    known = at_rest(places.where(good & F.col("label").isNotNull()).select("label", F.col("place_type").alias("kind"), "lat", "lng"), "places")
    todo, reach, found = at_rest(points.where(good).select("lat", "lng").distinct(), "spots"), min(first_m, limit_m), None
    while True:
        near = at_rest(within(todo, known, reach), "near")
        found = near if found is None else found.unionByName(near)
        if reach >= limit_m:
            break
        todo = at_rest(todo.join(near.select("lat", "lng"), ["lat", "lng"], "left_anti"), "spots")
        if todo.isEmpty():
            break
        reach = min(limit_m, reach * GROWTH)
    out = points.join(found, ["lat", "lng"], "left")
    return out.select(*points.columns, F.col("near.label").alias("known_place"), F.col("near.kind").alias("known_type"), F.round("near.distance", 2).alias("known_distance"))
