"""Transition patterns between places by weekday and time of day, and training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUTE = ("user_id", "from_cluster_id", "to_cluster_id", "day_of_week", "time_of_day")
RELIABLE = ("GOOD", "LOW_POINTS")


def with_places(trips: DataFrame, clusters: DataFrame, columns: dict[str, str]) -> DataFrame:
    """trips with columns of both ends' clusters: {cluster column: suffix}; at most one cluster matches each end."""
    for end in ("from", "to"):
        side = clusters.select("user_id", F.col("cluster_id").alias(f"{end}_cluster_id"), *(F.col(c).alias(f"{end}_{name}") for c, name in columns.items()))
        trips = trips.join(side, ["user_id", f"{end}_cluster_id"], "left")
    return trips


def routes(trips: DataFrame) -> DataFrame:
    """Trips counted by route and travel mode first, so that the commonest mode needs no list of modes; then by route."""
    reliable = F.coalesce(F.col("data_quality").isin(*RELIABLE), F.lit(False))
    by_mode = trips.groupBy(*ROUTE, "travel_mode").agg(
        F.count("*").alias("n"), F.sum("departure_hour").alias("h"), F.sum("duration_sec").alias("s"), F.sum(F.when(reliable, F.col("distance_meters"))).alias("m"),
        F.count(F.when(reliable, 1)).alias("good"), F.sum("avg_speed_kmph").alias("v"), F.max("max_speed_kmph").alias("top"), F.min("trip_start").alias("first_seen"), F.max("trip_end").alias("last_seen"),
    )
    known = F.when(F.coalesce(F.col("travel_mode"), F.lit("")) != "", F.struct("n", (-F.col("first_seen")).alias("early"), F.col("travel_mode").alias("mode")))
    good = F.sum("good")
    return by_mode.groupBy(*ROUTE).agg(
        F.sum("n").alias("transition_count"), F.round(F.sum("h") / F.sum("n"), 2).alias("avg_departure_hour"), F.floor(F.sum("s") / F.sum("n") + 0.5).cast("long").alias("avg_travel_duration_sec"),
        F.when(good > 0, F.round(F.sum("m") / good, 2)).alias("avg_distance_meters"), F.round(F.sum("v") / F.sum("n"), 2).alias("avg_speed_kmph"), F.round(F.max("top"), 2).alias("max_speed_kmph"),
        good.alias("reliable_trip_count"), (F.sum("n") - good).alias("unreliable_trip_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.coalesce(F.max(known)["mode"], F.lit("UNKNOWN")).alias("most_common_travel_mode"),
    )


def patterns(trips: DataFrame, clusters: DataFrame) -> DataFrame:
    """Routes with their probability among the departures from one place at one weekday and time of day, and both place types."""
    total = F.sum("transition_count").over(Window.partitionBy("user_id", "from_cluster_id", "day_of_week", "time_of_day"))
    shares = routes(trips).withColumn("total_transitions_from_cluster", total).withColumn("probability", F.round(F.col("transition_count") / total, 4))
    return with_places(shares, clusters, {"place_type": "place_type"})


def first_visit_ending(visits: DataFrame) -> DataFrame:
    """One visit for each (user, end): the first by start and cluster."""
    least = F.min(F.struct("visit_start", "cluster_id", "prev_cluster_id", "is_weekend", "duration_sec"))
    return visits.groupBy("user_id", "visit_end").agg(least.alias("v")).select("user_id", F.col("visit_end").alias("trip_start"), "v.prev_cluster_id", "v.is_weekend", F.col("v.duration_sec").alias("stay_sec"))


def next_place_samples(trips: DataFrame, visits: DataFrame, clusters: DataFrame) -> DataFrame:
    """A training row for each trip, with defaults where its place or visit isn't known."""
    side = {"place_type": "place_type", "visit_count": "cluster_visit_count", "avg_duration_sec": "cluster_avg_duration_sec", "night_visit_ratio": "cluster_night_visit_ratio", "day_visit_ratio": "cluster_day_visit_ratio", "place_type_confidence": "cluster_place_type_confidence"}
    q = with_places(trips, clusters, side).join(first_visit_ending(visits), ["user_id", "trip_start"], "left")
    zero = [f"from_{name}" for name in side.values() if name != "place_type"]
    return q.select(
        "user_id", "date", "trip_start", "from_cluster_id", F.coalesce("from_place_type", F.lit("UNKNOWN")).alias("from_place_type"), F.col("prev_cluster_id").alias("previous_cluster_id"),
        "day_of_week", F.coalesce("is_weekend", F.lit(False)).alias("is_weekend"), "time_of_day", "departure_hour", F.coalesce("stay_sec", F.lit(0)).cast("long").alias("current_stay_duration_sec"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in zero), "travel_mode", "avg_speed_kmph", "to_cluster_id", F.coalesce("to_place_type", F.lit("UNKNOWN")).alias("to_place_type"), F.lit("trip_segments").alias("source"),
    )


def trip_duration_samples(trips: DataFrame) -> DataFrame:
    return trips.where(F.col("data_quality").isin(*RELIABLE) & (F.col("distance_meters") > 0) & (F.col("duration_sec") > 0)).select("user_id", "date", "trip_start", "from_cluster_id", "to_cluster_id", "distance_meters", "travel_mode", "day_of_week", "departure_hour", "duration_sec")


def place_type_samples(clusters: DataFrame) -> DataFrame:
    return clusters.where(F.col("place_type").isNotNull() & ~F.col("place_type").isin("UNKNOWN", "OTHER")).select("user_id", "cluster_id", "avg_arrival_hour", "avg_departure_hour", "avg_duration_sec", "night_visit_ratio", "day_visit_ratio", "weekday_ratio", "visit_count", "place_type")
