"""From raw pings to processed points: lags, anomalies, activity, trips and stays.

One pass per user without batch borders. The lag windows are partitioned by user and
day, and each day's first ping gets the last one of the user's day before from a small
table of last pings, so one long history spreads over many tasks. Later steps work on
sessions, which a gap of a minute ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.geo import haversine_m, heading_diff, speed_kmph, valid_lat_lng
from tracewell.sources.tables import at_rest


@dataclass(frozen=True)
class PointRules:
    max_accuracy_m: float = 100
    jump_m: float = 2000
    reset_gap_s: int = 60
    max_kmph: float = 180
    stay_kmph: float = 1.5
    stay_step_m: float = 30
    drive_kmph: float = 12
    walk_kmph: float = 7
    walk_step_m: float = 5
    walk_gap_s: int = 30
    trip_start_kmph: float = 5
    trip_stop_kmph: float = 1
    trip_stop_s: int = 300
    stay_radius_m: float = 50
    stay_min_s: int = 120


RULES = PointRules()
STATE = ("gps_ts", "lat", "lng", "speed", "heading", "raw_id")


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("_day", F.coalesce(F.floor(F.col("gps_ts") / 86_400), F.lit(-(1 << 40))))


def with_previous(df: DataFrame, state: tuple[str, ...] = STATE) -> DataFrame:
    """df with struct `prev`, the state columns of the user's row before by (gps_ts, raw_id); null for the first."""
    dated, columns = _dated(df), F.struct(*state)
    within = Window.partitionBy("user_id", "_day").orderBy("gps_ts", "raw_id")
    last = dated.groupBy("user_id", "_day").agg(F.max_by(columns, F.struct("gps_ts", "raw_id")).alias("_last"))
    before = last.select("user_id", "_day", F.lag("_last").over(Window.partitionBy("user_id").orderBy("_day")).alias("_before"))
    lagged = dated.withColumn("prev", F.lag(columns).over(within)).join(before, ["user_id", "_day"])
    return lagged.withColumn("prev", F.coalesce("prev", "_before")).drop("_before", "_day")


def with_begin(df: DataFrame, begins: Column, name: str) -> DataFrame:
    """df with struct `name`, (gps_ts, raw_id) of the user's last row at or before this one where begins holds.

    Begins are carried forward within each day, and over days from a small table of each
    day's last begin.
    """
    dated = _dated(df).withColumn("_begin", F.when(begins, F.struct("gps_ts", "raw_id")))
    days = dated.groupBy("user_id", "_day").agg(F.max("_begin").alias("_own"))
    order = Window.partitionBy("user_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("user_id", "_day", F.last("_own", ignorenulls=True).over(order).alias("_carried"))
    within = Window.partitionBy("user_id", "_day").orderBy("gps_ts", "raw_id").rowsBetween(Window.unboundedPreceding, 0)
    out = dated.withColumn(name, F.last("_begin", ignorenulls=True).over(within)).join(carried, ["user_id", "_day"])
    return out.withColumn(name, F.coalesce(name, "_carried")).drop("_carried", "_begin", "_day")


def with_previous_and_begin(df: DataFrame, breaks: Callable[[Column, Column], Column], name: str, state: tuple[str, ...] = STATE) -> DataFrame:
    """df with `prev`, as with_previous() gives it, and `name`, as with_begin() does where a row begins that is a user's first or breaks(prev, row).

    One exchange by (user, day) and one sort. Only the rows before a day's first break lack
    something then: they are joined with a small table of one row for each user and day.
    state holds gps_ts and raw_id. Rows without a user are left out, as by the two others.
    """
    now, place, prev = F.struct(*state), F.struct("gps_ts", "raw_id"), F.col("prev")
    within = Window.partitionBy("user_id", "_day").orderBy("gps_ts", "raw_id")
    q = _dated(df.where("user_id is not null")).withColumns({"prev": F.lag(now).over(within), "_final": F.lead(F.lit(1)).over(within).isNull()})
    own = F.when(prev.isNotNull() & breaks(prev, now), place)
    q = at_rest(q.withColumn(name, F.last(own, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))), "days")
    ends = q.where("prev is null or _final").groupBy("user_id", "_day").agg(F.max(F.when(prev.isNull(), now)).alias("_first"), F.max(F.when(F.col("_final"), now)).alias("_last"), F.max(name).alias("_own"))
    days = Window.partitionBy("user_id").orderBy("_day")
    ends = ends.withColumn("_before", F.lag("_last").over(days))
    opens = F.when(F.col("_before").isNull() | breaks(F.col("_before"), F.col("_first")), F.struct("_first.gps_ts", "_first.raw_id"))
    ends = ends.withColumn("_opens", opens)
    carried = F.last(F.coalesce("_own", "_opens"), ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, -1))
    ends = at_rest(ends.select("user_id", "_day", "_before", F.coalesce("_opens", carried).alias("_head")), "ends")
    heads = q.where(F.col(name).isNull()).join(ends, ["user_id", "_day"]).withColumns({"prev": F.coalesce("prev", "_before"), name: F.col("_head")})
    return q.where(F.col(name).isNotNull()).unionByName(heads.drop("_before", "_head")).drop("_day", "_final")


def with_features(points: DataFrame) -> DataFrame:
    """Adds prev, time_gap, distance, calculated speed, speed and heading change; 0 for a user's first ping."""
    return features(with_previous(points))


def features(p: DataFrame) -> DataFrame:
    """with_features() of pings that have their `prev`."""
    first = F.col("prev").isNull()
    p = p.withColumn("time_gap", F.when(first, 0).otherwise(F.col("gps_ts") - F.col("prev.gps_ts")).cast("long"))
    p = p.withColumn("distance", F.when(first, 0.0).otherwise(haversine_m(F.col("prev.lat"), F.col("prev.lng"), F.col("lat"), F.col("lng"))))
    p = p.withColumn("calculated_kmph", speed_kmph(F.col("distance"), F.col("time_gap")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return p.withColumns({
        "speed_change": F.when(first, 0.0).otherwise(zero("speed") - zero("prev.speed")),
        "heading_change": F.when(first, 0.0).otherwise(heading_diff(zero("prev.heading"), zero("heading"))),
    })


def with_anomaly(p: DataFrame, rules: PointRules = RULES) -> DataFrame:
    """Adds anomaly_reason, the first rule that holds, or null; and is_anomaly."""
    gap = F.col("time_gap")
    reason = (
        F.when(~valid_lat_lng(F.col("lat"), F.col("lng")), "INVALID_LAT_LNG")
        .when(F.col("gps_ts").isNull() | (F.col("gps_ts") <= 0), "INVALID_TIMESTAMP")
        .when(F.col("accuracy") > rules.max_accuracy_m, "LOW_GPS_ACCURACY")
        .when(F.col("prev").isNull(), F.lit(None))
        .when(gap <= 0, "NON_INCREASING_TIMESTAMP")
        .when((F.col("distance") > rules.jump_m) & (gap < rules.reset_gap_s), "IMPOSSIBLE_DISTANCE_JUMP")
        .when(F.col("calculated_kmph") > rules.max_kmph, "IMPOSSIBLE_SPEED")
    )
    return p.withColumn("anomaly_reason", reason).withColumn("is_anomaly", F.col("anomaly_reason").isNotNull())


def with_activity(p: DataFrame, rules: PointRules = RULES) -> DataFrame:
    """Adds activity_type STAY, WALK, DRIVE or UNKNOWN, and activity_confidence 1 or 0."""
    speed, calc, d, gap = F.coalesce("speed", F.lit(0.0)), F.col("calculated_kmph"), F.col("distance"), F.col("time_gap")
    activity = (
        F.when(F.col("is_anomaly") | (gap > rules.reset_gap_s), "UNKNOWN")
        .when((speed <= rules.stay_kmph) & (d <= rules.stay_step_m), "STAY")
        .when((speed > rules.drive_kmph) | (calc > rules.drive_kmph), "DRIVE")
        .when((speed > rules.stay_kmph) & (speed <= rules.walk_kmph) & (d > rules.walk_step_m) & (gap <= rules.walk_gap_s), "WALK")
        .otherwise("UNKNOWN")
    )
    return p.withColumn("activity_type", activity).withColumn("activity_confidence", F.when(activity == "UNKNOWN", 0.0).otherwise(1.0))


def with_sessions(p: DataFrame, rules: PointRules = RULES) -> DataFrame:
    """Adds session, (gps_ts, raw_id) of the ping that began it: a user's first, or the first after a gap over the reset gap."""
    return with_begin(p, F.col("prev").isNull() | (F.col("time_gap") > rules.reset_gap_s), "session")


def with_trips(p: DataFrame, rules: PointRules = RULES) -> DataFrame:
    """Adds trip_no, a number of the session's trips, null outside trips and for anomalies.

    A trip starts at speed over trip_start_kmph with a known activity, and ends at the
    first ping of an unbroken run below trip_stop_kmph that has lasted trip_stop_s. All
    by windows over the regular pings of a session's day: the state is that of the last
    event. What a day takes over from the days before (the begin of a slow run, the last
    event, the number of trips) comes from tables of one row for each session and day.
    """
    keys = ["user_id", "session", "is_anomaly", "_alone", "_day"]
    order = Window.partitionBy(*keys).orderBy("gps_ts", "raw_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    days = Window.partitionBy(*keys[:-1]).orderBy("_day")
    earlier, place = days.rowsBetween(Window.unboundedPreceding, -1), F.struct("gps_ts", "raw_id")
    speed = F.coalesce("speed", F.lit(0.0))
    slow = speed < rules.trip_stop_kmph

    # _alone keeps anomalies out of the regular pings' windows, each for itself
    q = _dated(p).withColumn("_alone", F.when(F.col("is_anomaly"), F.coalesce("raw_id", F.lit(0))).otherwise(0))
    q = q.withColumn("_run", F.sum(F.when(slow, 0).otherwise(1)).over(upto))
    run = Window.partitionBy(*keys, "_run").orderBy("gps_ts", "raw_id").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("_since", F.min(F.when(slow, F.col("gps_ts"))).over(run))
    ends = q.groupBy(*keys).agg((F.max("_run") > 0).cast("int").alias("_broken"), F.max_by("_since", place).alias("_tail"))
    ends = ends.withColumn("_runs", F.sum("_broken").over(days))
    own = Window.partitionBy(*keys[:-1], "_runs").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_open", F.min("_tail").over(own))
    q = q.join(ends.select(*keys, F.lag("_open").over(days).alias("_before")), keys)
    since = F.when(F.col("_run") == 0, F.coalesce("_before", "_since")).otherwise(F.col("_since"))

    event = F.when((speed > rules.trip_start_kmph) & (F.col("activity_type") != "UNKNOWN"), "S").when(slow & (F.col("gps_ts") - since >= rules.trip_stop_s), "E")
    q = q.withColumn("_event", event).withColumn("_state", F.last("_event", ignorenulls=True).over(upto))
    starts = (F.col("_event") == "S") & (F.coalesce(F.lag("_state").over(order), F.lit("E")) != "S")
    q = q.withColumn("_starts", F.coalesce(starts.cast("int"), F.lit(0))).drop("_run", "_since", "_before")
    seen = F.when(F.col("_event").isNotNull(), F.struct("gps_ts", "raw_id", "_event"))
    sums = q.groupBy(*keys).agg(F.min(seen).alias("_first"), F.max(seen).alias("_last"), F.sum("_starts").alias("_n"))
    sums = sums.withColumn("_was", F.last("_last._event", ignorenulls=True).over(earlier))
    sums = sums.withColumn("_same", F.when((F.col("_was") == "S") & (F.col("_first._event") == "S"), 1).otherwise(0))
    sums = sums.withColumn("_trips", F.coalesce(F.sum(F.col("_n") - F.col("_same")).over(earlier), F.lit(0)))
    q = q.join(sums.select(*keys, "_was", "_same", "_trips"), keys)
    number = F.col("_trips") + F.sum("_starts").over(upto) - F.when(F.col("_state").isNotNull(), F.col("_same")).otherwise(0)
    q = q.withColumn("trip_no", F.when((F.coalesce("_state", "_was") == "S") & ~F.col("is_anomaly"), number))
    return q.drop("_alone", "_day", "_event", "_state", "_starts", "_was", "_same", "_trips")


def stay_fold(ts: np.ndarray, lat: np.ndarray, lng: np.ndarray, radius_m: float) -> np.ndarray:
    """Start of the stay that each ping of an unbroken stretch belongs to: the time of the last anchor.

    A ping farther than radius_m from the anchor becomes the next anchor. Whole runs are
    compared at once: from each anchor the distances of what follows are computed in
    growing pieces until one is too far.
    """
    n, start = len(ts), 0
    out = np.empty(n, np.int64)
    rlat, rlng = np.radians(lat), np.radians(lng)
    while start < n:
        end, step = start + 1, 32
        while end < n:
            to = min(n, end + step)
            a = np.sin((rlat[end:to] - rlat[start]) / 2) ** 2 + np.cos(rlat[start]) * np.cos(rlat[end:to]) * np.sin((rlng[end:to] - rlng[start]) / 2) ** 2
            far = np.flatnonzero(2 * 6371000.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a)) > radius_m)
            if len(far):
                end += int(far[0])
                break
            end, step = to, step * 2
        out[start:end] = ts[start]
        start = end
    return out


Anchor = tuple[int, float, float]
CHUNK = ["user_id", "begin", "_day"]
HANDED = "in_ts double, in_lat double, in_lng double"
TRIED = f"user_id string, begin long, _day long, {HANDED}, whole boolean, out_ts double, out_lat double, out_lng double, south double, north double, west double, east double"


def _handed(g: pd.DataFrame) -> Anchor | None:
    ts, lat, lng = g["in_ts"].iloc[0], g["in_lat"].iloc[0], g["in_lng"].iloc[0]
    return None if pd.isna(ts) else (int(ts), float(lat), float(lng))


def _folded(g: pd.DataFrame, radius_m: float, anchor: Anchor | None) -> tuple[np.ndarray, Anchor]:
    """(stay begins of the ordered pings of a stretch, the last anchor); the stretch goes on from `anchor`, if given."""
    ts, lat, lng = (g[c].to_numpy() for c in ("gps_ts", "lat", "lng"))
    if anchor:
        ts, lat, lng = np.append(np.int64(anchor[0]), ts), np.append(anchor[1], lat), np.append(anchor[2], lng)
    begin = stay_fold(ts, lat, lng, radius_m)
    last = int(np.searchsorted(ts, begin[-1]))  # regular pings of a session have rising times
    return begin[1:] if anchor else begin, (int(ts[last]), float(lat[last]), float(lng[last]))


def _covers(row: dict, anchor: Anchor, radius_m: float) -> bool:
    """Whether the box around a day's pings lies within the radius of an anchor, so that the anchor outlasts the day."""
    lat, lng = np.radians([row["south"], row["north"]]), np.radians([row["west"], row["east"]])
    at = np.radians(anchor[1:])
    a = np.sin((lat[:, None] - at[0]) / 2) ** 2 + np.cos(at[0]) * np.cos(lat[:, None]) * np.sin((lng[None, :] - at[1]) / 2) ** 2
    return bool((2 * 6371000.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))).max() <= 0.99 * radius_m)


def handed_anchors(part: DataFrame, rules: PointRules = RULES) -> DataFrame | None:
    """(user_id, begin, _day, in_ts, in_lat, in_lng): the anchor that a session's day takes over from the day before; none where no session has two days.

    Each day is folded as if it took nothing over. Then each session's days, one row
    each, are walked in order: a day that an unknown activity or anomaly breaks hands on
    the same anchor whatever it got, and one that lies within the radius hands on what it
    got. The other days are folded again with the anchor that reached them, all at once,
    until no day gets an anchor that it wasn't folded with. Folds from different anchors
    mostly meet at the first move, so few rounds are needed; each settles a day at least.
    """
    several = part.groupBy("user_id", "begin").agg((F.min("_day") < F.max("_day")).alias("x")).where("x").drop("x")
    rows = at_rest(part.where("_left = 0 or _stretch = 0").join(several, ["user_id", "begin"], "left_semi"), "handed")
    if rows.isEmpty():
        return None

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["gps_ts", "raw_id"], kind="stable")
        anchor, tail, whole = _handed(g), g[g["_left"] == 0], bool(((g["_left"] == 0) & (g["_stretch"] == 0)).any())
        out = _folded(tail, rules.stay_radius_m, anchor if whole else None)[1] if len(tail) else (None, None, None)
        kept = g.iloc[0][[*CHUNK, "in_ts", "in_lat", "in_lng"]].tolist()
        row = [*kept, whole, *out, g["lat"].min(), g["lat"].max(), g["lng"].min(), g["lng"].max()]
        return pd.DataFrame([row], columns=[c.split()[0] for c in TRIED.split(", ")])

    def tried(days: DataFrame) -> DataFrame:
        return rows.join(days, CHUNK).groupBy(*CHUNK).applyInPandas(fold, TRIED)

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        outcome = {(r["_day"], *((r["in_ts"], r["in_lat"], r["in_lng"]) if pd.notna(r["in_ts"]) else ())): r for r in g.to_dict("records")}
        got, before, out = None, None, []
        for day in sorted(set(g["_day"])):
            alone = outcome[day,]
            anchor = got if before == day - 1 else None
            found = outcome.get((day, *anchor)) if anchor and alone["whole"] else alone
            through = found is None and _covers(alone, anchor, rules.stay_radius_m)
            out.append((*g[["user_id", "begin"]].iloc[0], day, *(anchor or (None, None, None)), found is None and not through))
            last = alone if found is None else found
            got = anchor if through else (last["out_ts"], last["out_lat"], last["out_lng"]) if pd.notna(last["out_ts"]) else None
            before = day
        return pd.DataFrame(out, columns=[*CHUNK, "in_ts", "in_lat", "in_lng", "missing"])

    none = [F.lit(None).cast("double").alias(c) for c in ("in_ts", "in_lat", "in_lng")]
    known = at_rest(tried(rows.select(*CHUNK).distinct().select(*CHUNK, *none)), "tried")
    while True:
        walked = at_rest(known.groupBy("user_id", "begin").applyInPandas(walk, f"user_id string, begin long, _day long, {HANDED}, missing boolean"), "walked")
        todo = walked.where("missing").drop("missing")
        if todo.isEmpty():
            return walked.where("in_ts is not null").drop("missing")
        known = at_rest(known.unionByName(tried(todo)), "tried")


def with_stays(p: DataFrame, rules: PointRules = RULES) -> DataFrame:
    """Adds is_stay_point, stay_start_time and stay_duration.

    The anchor is greedy, so each stretch without anomaly, unknown activity or reset is
    folded in order, day by day; a day's first stretch goes on from the anchor that
    handed_anchors() finds for it. Only the pings' key columns travel through Python, in
    batches of sorted partitions.
    """
    known = ~F.col("is_anomaly") & (F.col("activity_type") != "UNKNOWN")
    chunk = Window.partitionBy("user_id", "session.raw_id", "_day")
    upto = chunk.orderBy("gps_ts", "raw_id").rowsBetween(Window.unboundedPreceding, 0)
    q = _dated(p).withColumn("_unknown", F.when(known, 0).otherwise(1))
    q = q.withColumn("_stretch", F.sum("_unknown").over(upto)).withColumn("_left", F.sum("_unknown").over(chunk) - F.col("_stretch"))
    part = q.where("_unknown = 0").select("user_id", F.col("session.raw_id").alias("begin"), "_day", "_stretch", "_left", "raw_id", "gps_ts", "lat", "lng")
    handed = handed_anchors(part, rules)
    if handed is None:
        part = part.withColumns({c: F.lit(None).cast("double") for c in ("in_ts", "in_lat", "in_lng")})
    else:
        part = part.join(handed, CHUNK, "left")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, anchor = None, None
        for batch in batches:
            g = batch.to_pandas()
            keys = g[[*CHUNK, "_stretch"]]
            edges = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())  # the first row is one
            begin = np.empty(len(g), np.int64)
            for a, b in zip(edges, [*edges[1:], len(g)], strict=True):
                stretch, key = g.iloc[a:b], tuple(keys.iloc[a])
                if key != before:
                    anchor = None if key[-1] else _handed(stretch)
                begin[a:b], anchor = _folded(stretch, rules.stay_radius_m, anchor)
                before = key
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), batch.column("raw_id"), pa.array(begin), pa.array(g["gps_ts"].to_numpy() - begin)], names=["user_id", "raw_id", "stay_start_time", "stay_duration"])

    ordered = part.repartition(*CHUNK).sortWithinPartitions(*CHUNK, "_stretch", "gps_ts", "raw_id")
    folded = ordered.mapInArrow(fold, "user_id string, raw_id long, stay_start_time long, stay_duration long")
    out = p.join(folded, ["user_id", "raw_id"], "left")
    duration = F.coalesce("stay_duration", F.lit(0)).cast("long")
    return out.withColumn("stay_duration", duration).withColumn("is_stay_point", F.col("stay_duration") >= rules.stay_min_s)


def processed_columns(p: DataFrame) -> DataFrame:
    """The columns of a processed point, rounded, of pings with their features, flags, session and trip number."""
    trip = F.when(F.col("trip_no").isNotNull(), F.concat_ws("_", "user_id", F.col("session.gps_ts").cast("string"), F.concat(F.lit("T"), F.col("trip_no").cast("string"))))
    return p.select(
        "raw_id", "user_id", "gps_ts", "lat", "lng", "activity_type", "activity_confidence", trip.alias("trip_id"), "is_stay_point", "stay_start_time", "stay_duration",
        F.round("distance", 2).alias("distance_from_prev"), "time_gap", F.round("speed_change", 2).alias("speed_change"), F.round("heading_change", 2).alias("heading_change"),
        F.round("calculated_kmph", 2).alias("calculated_speed_kmph"), "is_anomaly", "anomaly_reason", F.lit("v1").alias("processing_version"),
    )


def process_sessions(p: DataFrame, rules: PointRules = RULES) -> DataFrame:
    """Processed points of pings with their `prev` and `session`, by windows: a session is spread over its days."""
    p = at_rest(with_activity(with_anomaly(features(p), rules), rules), "sessions")
    return processed_columns(with_stays(at_rest(with_trips(p, rules), "trips"), rules))


def process(points: DataFrame, rules: PointRules = RULES) -> DataFrame:
    """Processed points by windows alone: every raw ping with its features, flags and ids. Repeated raw ids are taken once."""
    p = with_previous(points.dropDuplicates(["user_id", "raw_id"]))
    gap = F.when(F.col("prev").isNull(), 0).otherwise(F.col("gps_ts") - F.col("prev.gps_ts"))
    return process_sessions(with_sessions(p.withColumn("time_gap", gap), rules).drop("time_gap"), rules)
