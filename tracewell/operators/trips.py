"""Trips between consecutive visits, measured on the pings of their windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import timefn as T
from tracewell.functions.geo import haversine_m, speed_kmph, valid_lat_lng

SAME_S, LEAST_S, MAX_KMPH, BUCKET_S = 120, 60, 180, 3600


def candidates(visits: DataFrame) -> DataFrame:
    """Consecutive visits as trips, with skip_reason for those that are none and filter_reason for soft filters."""
    w = Window.partitionBy("user_id").orderBy("visit_start", "cluster_id")
    end = F.coalesce("visit_end", F.col("visit_start") + F.col("duration_sec"))
    q = visits.select("user_id", F.col("cluster_id").alias("from_cluster_id"), F.lead("cluster_id").over(w).alias("to_cluster_id"), F.col("visit_start").alias("from_start"), end.alias("trip_start"), F.lead("visit_start").over(w).alias("trip_end"), F.row_number().over(w).alias("visit_no"))
    q = q.where("to_cluster_id is not null").withColumn("duration_sec", F.col("trip_end") - F.col("trip_start"))
    skip = F.when(F.coalesce(F.col("trip_start"), F.lit(0)) == 0, "missing_fields").when(F.coalesce(F.col("trip_end"), F.lit(0)) == 0, "missing_fields").when(F.col("duration_sec") <= 0, "non_positive_duration")
    soft = F.when((F.col("from_cluster_id") == F.col("to_cluster_id")) & (F.col("duration_sec") < SAME_S), "same_cluster_small_gap").when(F.col("duration_sec") < LEAST_S, "below_min_duration")
    return q.withColumns({"skip_reason": skip, "filter_reason": soft})


def skip_report(candidates: DataFrame, day: int) -> DataFrame:
    """(reason, n) of candidates that a report on one local day leaves out; those that begin after or end before it are outside_day_window."""
    start = day * 86_400 - T.OFFSET
    outside = (F.col("trip_start") >= start + 86_400) | (F.col("trip_end") < start)
    reason = F.coalesce("skip_reason", "filter_reason", F.when(outside, "outside_day_window"))
    return candidates.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def dated(trips: DataFrame, once: bool = False) -> DataFrame:
    """A row for each date under which a trip is kept: that of the next visit, and that of this one where the window touches its day.

    once keeps the first of them only.
    """
    own, nxt = T.day_number(F.col("from_start")), T.day_number(F.col("trip_end"))
    touches = lambda d: (F.col("trip_start") < (d + 1) * 86_400 - T.OFFSET) & (F.col("trip_end") >= d * 86_400 - T.OFFSET)
    days = F.array_distinct(F.filter(F.array(F.when(touches(own), own), F.when(touches(nxt), nxt)), lambda d: d.isNotNull()))
    day = F.element_at(days, 1) if once else F.explode(days)
    return trips.withColumn("_day", day).withColumn("date", F.date_format(F.date_from_unix_date("_day"), "yyyy-MM-dd")).drop("_day")


def windows_with_points(trips: DataFrame, points: DataFrame) -> DataFrame:
    """Every trip with every ping of its user inside its window, both ends included; trips without pings have one row of nulls.

    An interval join by hours: windows are spread over the hours they touch, pings have one hour each.
    """
    key = ["user_id", "trip_start", "trip_end"]
    spread = trips.select(*key).distinct().withColumn("_hour", F.explode(F.sequence(F.floor(F.col("trip_start") / BUCKET_S), F.floor(F.col("trip_end") / BUCKET_S))))
    pings = points.select("user_id", "gps_ts", "raw_id", "lat", "lng", "activity_type", F.floor(F.col("gps_ts") / BUCKET_S).alias("_hour"))
    inside = spread.join(pings, ["user_id", "_hour"]).where(F.col("gps_ts").between(F.col("trip_start"), F.col("trip_end"))).drop("_hour")
    return trips.select(*key).distinct().join(inside, key, "left")


def travel_mode(walk: str = "walk", drive: str = "drive") -> Column:
    w, d = F.col(walk), F.col(drive)
    return F.when(w + d == 0, "UNKNOWN").when(d / (w + d) >= 0.6, "DRIVE").when(w / (w + d) >= 0.6, "WALK").when((d > 0) & (w > 0), "MIXED").otherwise("UNKNOWN")


def data_quality() -> Column:
    n, jumps, valid = F.col("point_count"), F.col("gps_jump_count"), F.col("valid_segment_count")
    return F.when(n == 0, "NO_POINTS").when(n < 5, "LOW_POINTS").when((jumps > 0) & (valid > 0), "GPS_JUMP_FILTERED").otherwise("GOOD")


def metrics(trips: DataFrame, points: DataFrame) -> DataFrame:
    """Distance, speeds, mode, counts and quality of each window; all of its pings take part, anomalous ones too."""
    key = ["user_id", "trip_start", "trip_end"]
    w = Window.partitionBy(*key).orderBy("gps_ts", "raw_id")
    q = windows_with_points(trips, points).withColumn("prev", F.lag(F.struct("gps_ts", "lat", "lng")).over(w))
    q = q.withColumns({"gap": F.col("gps_ts") - F.col("prev.gps_ts"), "d": haversine_m(F.col("prev.lat"), F.col("prev.lng"), F.col("lat"), F.col("lng"))})
    usable = valid_lat_lng(F.col("prev.lat"), F.col("prev.lng")) & valid_lat_lng(F.col("lat"), F.col("lng")) & (F.col("gap") > 0)
    q = q.withColumn("kmph", F.when(usable, speed_kmph(F.col("d"), F.col("gap"))))
    good = F.col("kmph") <= MAX_KMPH
    sums = q.groupBy(*key).agg(
        F.count("raw_id").alias("point_count"), F.count(F.when(good, 1)).alias("valid_segment_count"), F.count(F.when(F.col("kmph") > MAX_KMPH, 1)).alias("gps_jump_count"),
        F.coalesce(F.sum(F.when(good, F.col("d"))), F.lit(0.0)).alias("m"), F.coalesce(F.max(F.when(good, F.col("kmph"))), F.lit(0.0)).alias("top"),
        F.count(F.when(F.col("activity_type") == "WALK", 1)).alias("walk"), F.count(F.when(F.col("activity_type") == "DRIVE", 1)).alias("drive"),
    )
    half_up = lambda c, n: F.floor(c * 10**n + 0.5) / 10**n
    return sums.select(
        *key, half_up(F.col("m"), 2).alias("distance_meters"), half_up(F.col("m") / 1000, 4).alias("distance_km"),
        half_up(F.col("m") / (F.col("trip_end") - F.col("trip_start")) * 3.6, 2).alias("avg_speed_kmph"), half_up(F.col("top"), 2).alias("max_speed_kmph"),
        travel_mode().alias("travel_mode"), "point_count", "valid_segment_count", "gps_jump_count", data_quality().alias("data_quality"),
    )


def trip_segments(visits: DataFrame, points: DataFrame, strict: bool = False, once: bool = False) -> DataFrame:
    """Trips with metrics, dates and time fields; strict drops the softly filtered ones, once keeps a trip under one date."""
    made = candidates(visits).where("skip_reason is null")
    if strict:
        made = made.where("filter_reason is null")
    q = dated(made.join(metrics(made, points), ["user_id", "trip_start", "trip_end"]), once)
    hour = T.hour(F.col("trip_start"))
    return q.drop("skip_reason", "from_start", "visit_no").withColumns({"is_filtered": F.col("filter_reason").isNotNull(), "source": F.lit("cluster_visits"), "departure_hour": hour, "day_of_week": T.day_of_week(F.col("trip_start")), "time_of_day": T.time_of_day(hour, "trip")})
