"""Visits: stay pings of one place in a row, split by gaps, filtered and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import timefn as T
from tracewell.operators.points import with_previous_and_begin

SPLIT_S, LEAST_S, MERGE_S = 1800, 300, 300


def islands(points: DataFrame, split_s: int | None = SPLIT_S) -> DataFrame:
    """Runs of clustered pings: a new one where the cluster changes or a gap is over split_s (None: never split by gaps).

    Neighbours' clusters are those of the runs before and after, whatever is dropped later.
    """
    p = points.where("cluster_id is not null and cluster_id <> '-1'").select("user_id", "gps_ts", "raw_id", "cluster_id")

    def new(prev: Column, now: Column) -> Column:
        moved = prev["cluster_id"] != now["cluster_id"]
        return moved if split_s is None else moved | (now["gps_ts"] - prev["gps_ts"] > split_s)

    begun = with_previous_and_begin(p, new, "island", ("gps_ts", "raw_id", "cluster_id"))
    runs = begun.groupBy("user_id", "island").agg(F.max("cluster_id").alias("cluster_id"), F.min("gps_ts").alias("visit_start"), F.max("gps_ts").alias("visit_end"), F.count("*").alias("point_count"))
    w = Window.partitionBy("user_id").orderBy("island")
    return runs.withColumns({"duration_sec": F.col("visit_end") - F.col("visit_start"), "prev_cluster_id": F.lag("cluster_id").over(w), "next_cluster_id": F.lead("cluster_id").over(w)})


def visits_from(runs: DataFrame, least_s: int = LEAST_S, merge_s: int = MERGE_S) -> DataFrame:
    """Visits: runs of least_s or more; neighbours of one cluster no more than merge_s apart become one."""
    kept = runs.where(F.col("duration_sec") >= least_s)
    w = Window.partitionBy("user_id").orderBy("visit_start")
    gap = F.col("visit_start") - F.lag("visit_end").over(w)
    joins = F.coalesce((F.lag("cluster_id").over(w) == F.col("cluster_id")) & gap.between(0, merge_s), F.lit(False))
    numbered = kept.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("user_id", "_no").agg(
        F.max("cluster_id").alias("cluster_id"), F.min("visit_start").alias("visit_start"), F.max("visit_end").alias("visit_end"), F.sum("point_count").alias("point_count"),
        F.min_by("prev_cluster_id", "visit_start").alias("prev_cluster_id"), F.max_by("next_cluster_id", "visit_start").alias("next_cluster_id"), (F.count("*") > 1).alias("is_merged"),
    )
    start, hour = F.col("visit_start"), T.hour(F.col("visit_start"))
    return merged.drop("_no").withColumns({
        "duration_sec": F.col("visit_end") - start, "arrival_hour": hour, "departure_hour": T.hour(F.col("visit_end")), "day_of_week": T.day_of_week(start),
        "is_weekend": T.is_weekend(start), "time_of_day": T.time_of_day(hour, "visit"), "date": T.date_text(start),
    })


def visits(points: DataFrame, split_s: int | None = SPLIT_S) -> DataFrame:
    return visits_from(islands(points, split_s))
