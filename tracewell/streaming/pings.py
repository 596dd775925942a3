"""Structured Streaming: visits as session windows, and stays carried in per-user state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions.geo import EARTH_M
from tracewell.operators.points import RULES, PointRules


def session_visits(pings: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, cluster_id, visit_start, visit_end, point_count) of clustered pings by session windows; works on streams and batches.

    Late pings are waited for as long as `late`; a window closes when the watermark has passed its gap.
    """
    timed = pings.withColumn("ts", F.timestamp_seconds("gps_ts")).withWatermark("ts", late)
    w = F.session_window("ts", gap)
    return timed.groupBy("user_id", "cluster_id", w).agg(F.min("gps_ts").alias("visit_start"), F.max("gps_ts").alias("visit_end"), F.count("*").alias("point_count")).drop("session_window")


def distinct_pings(pings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Pings of a stream without repeats of their raw_id."""
    return pings.withColumn("ts", F.timestamp_seconds("gps_ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["raw_id"])


def streaming_stays(pings: DataFrame, rules: PointRules = RULES) -> DataFrame:
    """(user_id, raw_id, gps_ts, stay_start_time, stay_duration, is_stay_point) of known, regular pings of a stream.

    Each user's anchor is carried from batch to batch, so batch borders change nothing.
    Within a batch a user's pings are sorted by time; pings older than the last one
    handled are flagged by an earlier step and aren't part of the input.
    """
    import math

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["gps_ts", "raw_id"], kind="stable")
        starts = []
        for ts, lat, lng in zip(rows["gps_ts"], rows["lat"], rows["lng"], strict=True):
            if anchor is not None and ts - anchor[3] <= rules.reset_gap_s:
                a = math.sin(math.radians(lat - anchor[0]) / 2) ** 2 + math.cos(math.radians(anchor[0])) * math.cos(math.radians(lat)) * math.sin(math.radians(lng - anchor[1]) / 2) ** 2
                near = 2 * EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a)) <= rules.stay_radius_m
            else:
                near = False
            anchor = (anchor[0], anchor[1], anchor[2], int(ts)) if near else (float(lat), float(lng), int(ts), int(ts))
            starts.append(anchor[2])
        state.update(anchor)
        duration = rows["gps_ts"].to_numpy() - starts
        yield pd.DataFrame({"user_id": key[0], "raw_id": rows["raw_id"], "gps_ts": rows["gps_ts"], "stay_start_time": starts, "stay_duration": duration, "is_stay_point": duration >= rules.stay_min_s})

    schema = "user_id string, raw_id long, gps_ts long, stay_start_time long, stay_duration long, is_stay_point boolean"
    return pings.select("user_id", "raw_id", "gps_ts", "lat", "lng").groupBy("user_id").applyInPandasWithState(step, schema, "lat double, lng double, start long, last long", "append", GroupStateTimeout.NoTimeout)
