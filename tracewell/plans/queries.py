"""Queries of the analytics engine by name, each with DuckDB SQL that states the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import geo as G
from tracewell.functions import timefn as T
from tracewell.operators import asof, clusters, feeds, near, patterns, points, predict, runs, track, trips, visits
from tracewell.plans import oracle as O
from tracewell.plans.fixture import movement, places
from tracewell.sources.tables import at_rest, ingest, last_logins, measured_broadcasts, merge_partials, no_broadcasts, pending, read_csv, recent, result_counts, shared_folder, upsert, write_csv, write_json
from tracewell.sources.versioned import VersionedTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_kept: dict[tuple, DataFrame] = {}


def version(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes when a file of the table events does: of its files' names, times and lengths, without reading them."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/events.parquet")
    return files.agg(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(20,0)"))).first()[0]


def stage(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the pipeline that several queries read, written once for each session and state of the input's files."""
    return _stage(measured_broadcasts(spark), sf_dir, version(spark, sf_dir), name)


def _stage(spark: SparkSession, sf_dir: str, state: int, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, state, name)
    if key not in _kept:
        get = lambda n: _stage(spark, sf_dir, state, n)
        make = {
            "gps": lambda: movement(spark, sf_dir),
            "processed": lambda: track.process(get("gps")),
            "cells": lambda: clusters.gated(clusters.cells(get("processed"))),
            "labelled": lambda: clusters.with_clusters(get("cells")),
            "clustered": lambda: clusters.clustered_points(get("processed"), get("labelled")),
            "islands": lambda: visits.islands(get("clustered")),
            "visits": lambda: visits.visits_from(get("islands")),
            "clusters": lambda: clusters.user_clusters(get("labelled"), get("visits")),
            "trips": lambda: trips.trip_segments(get("visits"), get("processed")),
            "patterns": lambda: patterns.patterns(get("trips"), get("clusters")),
        }[name]
        with no_broadcasts(spark):
            _kept[key] = at_rest(make(), name)
    return _kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def of_stage(name: str, source: str, columns: str, sql: str) -> None:
    """A query that selects columns of a stage."""
    register(name, sql)(lambda spark, sf_dir: stage(spark, sf_dir, source).selectExpr(*[c.strip() for c in columns.split(";")]))


P = "raw_id; user_id; "
of_stage("pp1_lag_features", "processed", P + "time_gap; distance_from_prev; speed_change; heading_change; calculated_speed_kmph", O.chain("calc", "select raw_id, user_id, time_gap, round(distance, 2) distance_from_prev, round(speed_change, 2) speed_change, round(heading_change, 2) heading_change, round(kmph, 2) calculated_speed_kmph from calc"))
of_stage("pp2_anomaly", "processed", P + "is_anomaly; anomaly_reason", O.chain("act", "select raw_id, user_id, is_anomaly, reason anomaly_reason from act"))
of_stage("pp3_activity", "processed", P + "activity_type; activity_confidence", O.chain("act", "select raw_id, user_id, activity activity_type, case when activity = 'UNKNOWN' then 0.0 else 1.0 end activity_confidence from act"))
of_stage("pp5_trip_state", "processed", P + "trip_id is not null as in_trip", O.chain("trip", "select raw_id, user_id, trip_no is not null in_trip from trip"))
of_stage("pp6_stay", "processed", P + "is_stay_point; stay_start_time; stay_duration", O.chain("proc", "select raw_id, user_id, is_stay_point, stay_start_time, stay_duration from proc"))
of_stage("pp7_processed", "processed", "*", O.chain("proc", "select raw_id, user_id, gps_ts, lat, lng, activity activity_type, case when activity = 'UNKNOWN' then 0.0 else 1.0 end activity_confidence, case when trip_no is not null then concat(user_id, '_', min(gps_ts) over (partition by user_id, session), '_T', trip_no) end trip_id, is_stay_point, stay_start_time, stay_duration, round(distance, 2) distance_from_prev, time_gap, round(speed_change, 2) speed_change, round(heading_change, 2) heading_change, round(kmph, 2) calculated_speed_kmph, is_anomaly, reason anomaly_reason, 'v1' processing_version from proc"))
of_stage("cl2_cells", "cells", "user_id; cell_lat; cell_lng; lat; lng; `count` as points; first_seen; last_seen", O.chain("gate", "select user_id, cell_lat, cell_lng, lat, lng, cnt points, first_seen, last_seen from gate"))
of_stage("cl5_weighted_dbscan", "labelled", "user_id; cell_lat; cell_lng; cluster_id", O.chain("lab", "select user_id, cell_lat, cell_lng, cluster_id from lab"))
of_stage("jn6_points_with_cluster", "clustered", P + "cluster_id", O.chain("cpts", "select raw_id, user_id, cluster_id from cpts"))
of_stage("vs1_islands", "islands", "user_id; cluster_id; visit_start; visit_end; duration_sec; point_count; prev_cluster_id; next_cluster_id", O.chain("isl", "select user_id, cluster_id, visit_start, visit_end, duration_sec, point_count, prev_cluster_id, next_cluster_id from isl"))
of_stage("vs5_visits", "visits", "user_id; cluster_id; visit_start; visit_end; point_count; prev_cluster_id; next_cluster_id; is_merged; duration_sec; arrival_hour; departure_hour; day_of_week; is_weekend; time_of_day; date", O.chain("vis", "select * from vis"))
of_stage("cl8_user_clusters", "clusters", "*", O.chain("clu", "select user_id, cluster_id, lat, lng, center_method, total_points, first_seen, last_seen, radius_meters, visit_count, total_duration_sec, avg_duration_sec, night_visit_ratio, day_visit_ratio, weekday_ratio, avg_arrival_hour, avg_departure_hour, place_type, place_type_confidence from clu"))
of_stage("tr3_trip_segments", "trips", "*", O.chain("trips", "select * from trips"))
of_stage("pa3_patterns", "patterns", "*", O.chain("pat", "select * from pat"))

ALL_PLACES = "select 'P' || i as label, case i % 4 when 0 then 'HOME' when 1 then 'OFFICE' when 2 then 'GYM' else 'PARK' end place_type, 28.5e0 + (i % 6) * 0.01e0 plat, 77.2e0 + cast((i - i % 6) / 6 as bigint) * 0.01e0 plng from range(29) t(i)"


@register("sf17_known_place", O.chain("cen", f"select user_id, cluster_id, max(case when d <= 180 then label end) known_place, max(case when d <= 180 then place_type end) known_type, max(case when d <= 180 then round(d, 2) end) known_distance from (select c.user_id, c.cluster_id, label, place_type, {O.hav('lat', 'lng', 'plat', 'plng')} d from cen c, ({ALL_PLACES}) qualify row_number() over (partition by c.user_id, c.cluster_id order by d, label) = 1) group by all"))
def sf17_known_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.nearest_place(stage(spark, sf_dir, "clusters").select("user_id", "cluster_id", "lat", "lng"), places(spark)).select("user_id", "cluster_id", "known_place", "known_type", "known_distance")


@register("jn5_interval_join", O.chain("tp", "select user_id, trip_start, trip_end, count(raw_id) pings from tp group by all"))
def jn5_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = trips.candidates(stage(spark, sf_dir, "visits")).where("skip_reason is null")
    return trips.windows_with_points(made, stage(spark, sf_dir, "processed")).groupBy("user_id", "trip_start", "trip_end").agg(F.count("raw_id").alias("pings"))


@register("tr6_skip_reasons", O.chain("cand", "select coalesce(skip_reason, filter_reason, 'kept') reason, count(*) n from cand group by 1"))
def tr6_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.candidates(stage(spark, sf_dir, "visits")).groupBy(F.coalesce("skip_reason", "filter_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@register("jn4_next_visit_as_of", O.chain("vis", "select a.user_id, a.visit_start, max(b.visit_start) before_start, min(c.visit_start) after_start from vis a left join vis b on b.user_id = a.user_id and b.visit_end <= a.visit_start left join vis c on c.user_id = a.user_id and c.visit_start >= a.visit_end and c.visit_start > a.visit_start group by all"))
def jn4_next_visit_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("visit_start")
    return stage(spark, sf_dir, "visits").select("user_id", "visit_start", F.lag("visit_start").over(w).alias("before_start"), F.lead("visit_start").over(w).alias("after_start"))


@register("pa4_common_mode", O.chain("mode", "select * from mode"))
def pa4_common_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.routes(stage(spark, sf_dir, "trips")).select(*patterns.ROUTE, "most_common_travel_mode")


SAMPLE_SQL = "select t.user_id, t.date, t.trip_start, from_cluster_id, coalesce(f.place_type, 'UNKNOWN') from_place_type, v.prev_cluster_id previous_cluster_id, t.day_of_week, coalesce(v.is_weekend, false) is_weekend, t.time_of_day, t.departure_hour, coalesce(v.duration_sec, 0) current_stay_duration_sec, coalesce(f.visit_count, 0) from_cluster_visit_count, coalesce(f.avg_duration_sec, 0) from_cluster_avg_duration_sec, coalesce(f.night_visit_ratio, 0) from_cluster_night_visit_ratio, coalesce(f.day_visit_ratio, 0) from_cluster_day_visit_ratio, coalesce(f.place_type_confidence, 0) from_cluster_place_type_confidence, travel_mode, avg_speed_kmph, to_cluster_id, coalesce(g.place_type, 'UNKNOWN') to_place_type, 'trip_segments' source from trips t left join clu f on f.user_id = t.user_id and f.cluster_id = from_cluster_id left join clu g on g.user_id = t.user_id and g.cluster_id = to_cluster_id left join (select * from vis qualify row_number() over (partition by user_id, visit_end order by visit_start, cluster_id) = 1) v on v.user_id = t.user_id and v.visit_end = t.trip_start"


@register("ml1_next_place_samples", O.chain("trips", SAMPLE_SQL))
def ml1_next_place_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.next_place_samples(*(stage(spark, sf_dir, n) for n in ("trips", "visits", "clusters")))


@register("ml2_trip_duration_samples", O.chain("trips", "select user_id, date, trip_start, from_cluster_id, to_cluster_id, distance_meters, travel_mode, day_of_week, departure_hour, duration_sec from trips where data_quality in ('GOOD', 'LOW_POINTS') and distance_meters > 0 and duration_sec > 0"))
def ml2_trip_duration_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.trip_duration_samples(stage(spark, sf_dir, "trips"))


@register("ml3_place_type_samples", O.chain("clu", "select user_id, cluster_id, avg_arrival_hour, avg_departure_hour, avg_duration_sec, night_visit_ratio, day_visit_ratio, weekday_ratio, visit_count, place_type from clu where place_type is not null and place_type not in ('UNKNOWN', 'OTHER')"))
def ml3_place_type_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.place_type_samples(stage(spark, sf_dir, "clusters"))


@register("pr2_visit_ranges", O.chain("rng", "select user_id, cluster_id, visit_start, s start_minute, e end_minute, round(ds, 6) duration_score from rng"))
def pr2_visit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.ranges(predict.history(stage(spark, sf_dir, "visits"), "Tuesday")).select("user_id", "cluster_id", "visit_start", "start_minute", "end_minute", F.round("duration_score", 6).alias("duration_score"))


@register("pr3_place_at_time", O.chain("sc2", "select user_id, match_level, row_number() over w rank, cluster_id, round(score / (floor(sum(score) over (partition by user_id) * 100 + 0.5 + 1e-7) / 100), 3) confidence, floor(score * 100 + 0.5 + 1e-7) / 100 support from sc2 window w as (partition by user_id order by round(score, 9) desc, f, cluster_id) qualify row_number() over w <= 3"))
def pr3_place_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.place_at(stage(spark, sf_dir, "visits"), "Tuesday", 600)


@register("pr4_day_schedule", O.chain("srun", "select user_id, match_level, row_number() over (partition by user_id order by no) rank, max(cluster_id) cluster_id, lpad((min(slot) * 30 // 60)::varchar, 2, '0') || ':' || lpad((min(slot) * 30 % 60)::varchar, 2, '0') start_time, lpad(((max(slot) + 1) * 30 // 60)::varchar, 2, '0') || ':' || lpad(((max(slot) + 1) * 30 % 60)::varchar, 2, '0') end_time, (max(slot) + 1 - min(slot)) * 30 duration_min, list_reduce(list(conf order by slot), lambda a, x: round((a + x) / 2, 3)) confidence, floor(sum(sup) * 100 + 0.5 + 1e-7) / 100 support from srun group by user_id, match_level, no"))
def pr4_day_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.day_schedule(stage(spark, sf_dir, "visits"), "Tuesday")


PR5 = "with_p as (select c.user_id, c.cluster_id from_here, p.*, p.from_cluster_id = c.cluster_id here from clu c join pat p on p.user_id = c.user_id), lv as (select *, case when here and day_of_week = 'Tuesday' and time_of_day = 'morning' then 1 when here and time_of_day = 'morning' then 2 when here then 3 else 4 end level from with_p), bs as (select * from lv qualify level = min(level) over (partition by user_id, from_here)), rk as (select *, row_number() over (partition by user_id, from_here order by case when level = 4 then transition_count else probability end desc, first_seen, to_cluster_id, day_of_week, time_of_day, from_cluster_id) rank from bs) select r.user_id, from_here from_cluster_id, rank, to_cluster_id next_cluster_id, to_place_type next_place_type, lat, lng, case when level = 4 then 0.1 else probability end confidence, cast(floor(avg_travel_duration_sec / 60 + 0.5) as bigint) expected_trip_duration_min, case when level = 4 then 'most_frequent' else 'rule_based_level_' || level end source from rk r left join clu c on c.user_id = r.user_id and c.cluster_id = to_cluster_id where rank <= 3 and (level < 4 or rank = 1)"


@register("pr5_next_place", O.chain("pat", "").rstrip() + ",\n" + PR5.replace("p.*", "p.* exclude (user_id)"))
def pr5_next_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = stage(spark, sf_dir, "clusters")
    return predict.next_place(known.select("user_id", F.col("cluster_id").alias("from_cluster_id")), stage(spark, sf_dir, "patterns"), known, "Tuesday", 10)


@register("ag8_user_totals", O.chain("proc", "select user_id, count(*) total, count(*) filter (is_stay_point) stays, count(*) filter (is_anomaly) anomalies, count(*) filter (trip_no is not null) in_trip from proc group by 1"))
def ag8_user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.count_if(c)
    return stage(spark, sf_dir, "processed").groupBy("user_id").agg(F.count("*").alias("total"), n(F.col("is_stay_point")).alias("stays"), n(F.col("is_anomaly")).alias("anomalies"), n(F.col("trip_id").isNotNull()).alias("in_trip"))


@register("ag3_quality_histogram", O.chain("trips", "select data_quality, travel_mode, count(*) n from trips group by all"))
def ag3_quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "trips").groupBy("data_quality", "travel_mode").agg(F.count("*").alias("n"))


@register("ag4_date_range", O.chain("vis", "select min(date) first_date, max(date) last_date, count(distinct date) dates, string_agg(distinct date, ',' order by date) all_dates from vis"))
def ag4_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "visits").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("dates"), F.array_join(F.sort_array(F.collect_set("date")), ",").alias("all_dates"))


@register("ag1_counts", "select count(*) total, count(*) filter (event_type = 'purchase') purchases, count(distinct user_id) users from events")
def ag1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.countDistinct("user_id").alias("users"))


@register("ag2_group_counts", "select event_type, count(*) n, min(value) lo, max(value) hi, round(avg(value), 6) mean from events group by 1")
def ag2_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


@register("so2_top_customers", "select n_name, c_custkey, round(c_acctbal, 2) balance, rank from (select n_name, c_custkey, c_acctbal, row_number() over (partition by n_name order by c_acctbal desc, c_custkey) rank from customer join nation on c_nationkey = n_nationkey) where rank <= 3")
def so2_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey")
    q = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return q.select("n_name", "c_custkey", F.round("c_acctbal", 2).alias("balance"), F.row_number().over(w).alias("rank")).where("rank <= 3")


@register("so3_latest_per_user", "select user_id, max(event_id) filter (true) last_event, count(*) n from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k = 1 group by user_id")
def so3_latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.lit(1).cast("long").alias("n"))


@register("io5_unprocessed", O.chain("gps", "select raw_id, user_id from gps where gps_ts >= 1704412800"))
def io5_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a processed table that ends at a time."""
    done = stage(spark, sf_dir, "processed").where("gps_ts < 1704412800")
    return pending(stage(spark, sf_dir, "gps"), done).select("raw_id", "user_id")


@register("io8_upsert", "select coalesce(n.o_custkey, o.o_custkey) o_custkey, coalesce(n.total, o.total) total, o.o_custkey is not null existed from (select o_custkey, round(sum(o_totalprice), 2) total from orders where o_orderdate < timestamp '1996-01-01' group by 1) o full join (select o_custkey, round(sum(o_totalprice), 2) total from orders where o_orderdate >= timestamp '1996-01-01' group by 1) n on o.o_custkey = n.o_custkey")
def io8_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    total = lambda c: orders.where(c).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    cut = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    return upsert(total(~cut).withColumn("existed", F.lit(True)), total(cut).withColumn("existed", F.lit(False)), ["o_custkey"], keep=["existed"])


@register("sf_geo", O.chain("lagged", f"select raw_id, round({O.hav('plat', 'plng', 'lat', 'lng')}, 3) metres, round(fmod(degrees(atan2(sin(radians(lng - plng)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lng - plng)))) + 360, 360), 3) bearing from lagged where plat is not null and (plat <> lat or plng <> lng)"))
def sf_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points.with_previous(stage(spark, sf_dir, "gps")).where("prev is not null and (prev.lat <> lat or prev.lng <> lng)")
    ends = (F.col("prev.lat"), F.col("prev.lng"), F.col("lat"), F.col("lng"))
    return p.select("raw_id", F.round(G.haversine_m(*ends), 3).alias("metres"), F.round(G.bearing(*ends), 3).alias("bearing"))


@register("sf9_time_fields", O.chain("gps", f"select raw_id, {O.hour('gps_ts')} as hour, {O.dow('gps_ts')} day_of_week, {O.day('gps_ts')} % 7 in (2, 3) is_weekend, {O.date(O.day('gps_ts'))} date, {O.tod(O.hour('gps_ts'), (6, 12, 17, 21))} a, {O.tod(O.hour('gps_ts'), (6, 12, 18, 22))} b, {O.tod(O.hour('gps_ts'), (5, 12, 17, 21))} c, {O.tod(O.hour('gps_ts'), (0, 12, 17, 21))} d from gps"))
def sf9_time_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, h = F.col("gps_ts"), T.hour(F.col("gps_ts"))
    return stage(spark, sf_dir, "gps").select("raw_id", h.alias("hour"), T.day_of_week(ts).alias("day_of_week"), T.is_weekend(ts).alias("is_weekend"), T.date_text(ts).alias("date"), *(T.time_of_day(h, v).alias(n) for n, v in zip("abcd", ("visit", "trip", "ping", "plain"), strict=True)))


@register("vs6_visits_without_split", O.chain("kept", "select user_id, cluster_id, visit_start, visit_end, point_count from (select user_id, max(cluster_id) cluster_id, min(gps_ts) visit_start, max(gps_ts) visit_end, count(*) point_count from (select *, sum(nw) over (partition by user_id order by gps_ts, raw_id) i from (select *, case when lag(cluster_id) over (partition by user_id order by gps_ts, raw_id) = cluster_id then 0 else 1 end nw from kept)) group by user_id, i)"))
def vs6_visits_without_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits.islands(stage(spark, sf_dir, "clustered"), None).select("user_id", "cluster_id", "visit_start", "visit_end", "point_count")


@register("jn8_visits_with_place", O.chain("clu", "select v.user_id, v.visit_start, v.cluster_id, coalesce(nullif(c.place_type, ''), v.cluster_id) shown from vis v left join clu c on c.user_id = v.user_id and c.cluster_id = v.cluster_id"))
def jn8_visits_with_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = stage(spark, sf_dir, "clusters").select("user_id", "cluster_id", "place_type")
    return stage(spark, sf_dir, "visits").join(named, ["user_id", "cluster_id"], "left").select("user_id", "visit_start", "cluster_id", F.coalesce(F.nullif("place_type", F.lit("")), "cluster_id").alias("shown"))


@register("jn11_clusters_of_visits", O.chain("clu", "select user_id, cluster_id, total_points from clu c where exists (select 1 from vis v where v.user_id = c.user_id and v.cluster_id = c.cluster_id and v.is_weekend)"))
def jn11_clusters_of_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.clusters_of_visits(stage(spark, sf_dir, "clusters"), stage(spark, sf_dir, "visits").where("is_weekend")).select("user_id", "cluster_id", "total_points")


@register("io6_users", O.chain("gps", "select distinct user_id from gps"))
def io6_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "gps").select("user_id").distinct()


@register("jn13_centre_and_densest_cell", O.chain("rad", f"select cen.user_id, cen.cluster_id, round({O.hav('cen.lat', 'cen.lng', 'alat', 'alng')}, 2) off_m from cen join anchor using (user_id, cluster_id)"))
def jn13_centre_and_densest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.struct("count", (-F.col("first_seen")).alias("f"), (-F.col("cell_lat")).alias("a"), (-F.col("cell_lng")).alias("b"))
    dense = stage(spark, sf_dir, "labelled").where("cluster_id <> '-1'").groupBy("user_id", "cluster_id").agg(F.max_by(F.struct("lat", "lng"), first).alias("cell"))
    return stage(spark, sf_dir, "clusters").join(dense, ["user_id", "cluster_id"]).select("user_id", "cluster_id", F.round(G.haversine_m(F.col("lat"), F.col("lng"), F.col("cell.lat"), F.col("cell.lng")), 2).alias("off_m"))


@register("wn5_share_of_total", "select o_custkey, o_orderstatus, n, round(n / sum(n) over (partition by o_custkey), 4) share from (select o_custkey, o_orderstatus, count(*) n from orders group by all)")
def wn5_share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_custkey")), 4))


@register("wn7_seen_before", "select event_id, user_id, count(*) over (partition by user_id, event_type order by ts, event_id) > 1 seen_before, row_number() over (partition by user_id, event_type order by ts, event_id) nth from events")
def wn7_seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.row_number().over(w) > 1).alias("seen_before"), F.row_number().over(w).alias("nth"))


ML6 = "user_id string, next_cluster_id string, date string, trip_start long, from_cluster_id string, day_of_week string, departure_hour int, rank int, confidence double, next_place_type string, lat double, lng double, expected_trip_duration_min double"


@register("ml6_next_place_model")
def ml6_next_place_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.operators import models

    samples = patterns.next_place_samples(*(stage(spark, sf_dir, n) for n in ("trips", "visits", "clusters")))
    if samples.count() < models.LEAST_ROWS:
        return spark.createDataFrame([], ML6)
    model, _ = models.fit_next_place(samples)
    duration = models.trip_duration_model(patterns.trip_duration_samples(stage(spark, sf_dir, "trips")))
    predicted = models.predict_next(model, samples, ["user_id", "date", "trip_start", "from_cluster_id", "day_of_week", "departure_hour"])
    return models.with_place_and_duration(predicted, duration, stage(spark, sf_dir, "clusters"))


@register("ml5_trip_duration_model")
def ml5_trip_duration_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.operators import models

    samples = patterns.trip_duration_samples(stage(spark, sf_dir, "trips"))
    return models.predict_duration(models.trip_duration_model(samples), samples).select("user_id", "date", "trip_start", "duration_sec", F.round("predicted_sec", 2).alias("predicted_sec"))


@register("cl6_point_dbscan", O.chain("spts", f",{O.POSITIONS}\nselect user_id, cluster_id, sum(cnt)::bigint points from lab6 group by all"))
def cl6_point_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.point_clusters(stage(spark, sf_dir, "processed"))


@register("sm5_session_visits", O.chain("kept", "select user_id, cluster_id, min(gps_ts) visit_start, max(gps_ts) visit_end, count(*) point_count from (select *, sum(nw) over (partition by user_id, cluster_id order by gps_ts, raw_id) i from (select *, case when gps_ts - lag(gps_ts) over (partition by user_id, cluster_id order by gps_ts, raw_id) < 1800 then 0 else 1 end nw from kept)) group by user_id, cluster_id, i"))
def sm5_session_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.streaming.pings import session_visits

    return session_visits(stage(spark, sf_dir, "clustered").where("cluster_id is not null and cluster_id <> '-1'"))


@register("gn3_generated_pings")
def gn3_generated_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.sources import generate

    return generate.pings(generate.users(spark, 6), 19_723, 2, every_s=3)


@register("cl12_point_features", O.chain("kept", f"select c.user_id, c.cluster_id, c.lat, c.lng, points, round(max({O.hav('c.lat', 'c.lng', 'k.lat', 'k.lng')}), 1) radius_meters from (select user_id, cluster_id, (2 * sum(round(lat * 1e7)::bigint) + count(*)) // (2 * count(*)) / 1e7 lat, (2 * sum(round(lng * 1e7)::bigint) + count(*)) // (2 * count(*)) / 1e7 lng, count(*) points from kept group by all) c join kept k using (user_id, cluster_id) group by all"))
def cl12_point_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.point_features(stage(spark, sf_dir, "clustered")).withColumn("radius_meters", F.round("radius_meters", 1))


@register("pr6_cluster_feed", O.chain("clu", "select user_id, row_number() over (partition by user_id order by visit_count desc, total_points desc, cluster_id) rank, cluster_id, place_type, lat, lng from clu"))
def pr6_cluster_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("visit_count"), F.desc("total_points"), "cluster_id")
    return stage(spark, sf_dir, "clusters").select("user_id", F.row_number().over(w).alias("rank"), "cluster_id", "place_type", "lat", "lng")


@register("jn3_visit_pairs", O.chain("cand", "select user_id, from_cluster_id, to_cluster_id, trip_start, trip_end, duration_sec from cand"))
def jn3_visit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.candidates(stage(spark, sf_dir, "visits")).select("user_id", "from_cluster_id", "to_cluster_id", "trip_start", "trip_end", "duration_sec")


@register("pf7_visits_of_a_day", O.chain("vis", "select user_id, cluster_id, visit_start, visit_end from vis where visit_start < 19725 * 86400 - 19800 and visit_end >= 19724 * 86400 - 19800"))
def pf7_visits_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = 19_724 * 86_400 - T.OFFSET
    return stage(spark, sf_dir, "visits").where((F.col("visit_start") < start + 86_400) & (F.col("visit_end") >= start)).select("user_id", "cluster_id", "visit_start", "visit_end")


@register("io17_ingest", O.chain("gps", f"select raw_id, user_id, {O.dow('gps_ts')} day_of_week, {O.day('gps_ts')} % 7 in (2, 3) is_weekend, {O.tod(O.hour('gps_ts'), (0, 12, 17, 21))} time_of_day from gps where {O.VALID.format('lat', 'lng')}"))
def io17_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(stage(spark, sf_dir, "gps")).select("raw_id", "user_id", "day_of_week", "is_weekend", "time_of_day")


@register("io18_recent_points", O.chain("gps", "select raw_id, gps_ts, lat, lng from gps where user_id = 'U7' order by gps_ts desc, raw_id desc limit 20"))
def io18_recent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent(stage(spark, sf_dir, "gps"), 20, user_id="U7").select("raw_id", "gps_ts", "lat", "lng")


@register("io19_last_logins", "select user_id, event_type device_id, max(ts) last_login, min(ts) created_at from events group by all")
def io19_last_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_logins(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("device_id"), F.col("ts").alias("login_ts")))


@register("sf8_grid_key", O.chain("gps", "select raw_id, (round(lat * 10000) / 10000)::varchar || '_' || (round(lng * 10000) / 10000)::varchar grid_key from gps"))
def sf8_grid_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "gps").select("raw_id", G.grid_key(F.col("lat"), F.col("lng")).alias("grid_key"))


GEOHASH = "select raw_id, list_aggregate(list_transform(range(7), lambda k: substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + cast(list_sum(list_transform(range(5), lambda j: (case when (5 * k + j) % 2 = 0 then (x >> (17 - (5 * k + j) // 2)) & 1 else (y >> (16 - (5 * k + j) // 2)) & 1 end) << (4 - j))) as int), 1)), 'string_agg', '') geohash from (select raw_id, cast(floor((lng + 180) / 360 * 262144) as bigint) x, cast(floor((lat + 90) / 180 * 131072) as bigint) y from gps)"


@register("sf7_geohash", O.chain("gps", GEOHASH))
def sf7_geohash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "gps").select("raw_id", G.geohash(F.col("lat"), F.col("lng"), 7).alias("geohash"))


@register("sf11_time_text", "select o_orderkey, case when h <= 23 and m <= 59 then h * 60 + m end minute_of_day from (select o_orderkey, cast(o_orderkey % 27 as int) h, cast(o_orderkey % 65 as int) m from orders)")
def sf11_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("o_orderkey") % 27).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 65).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_minutes(text).alias("minute_of_day"))


@register("pf8_location", O.chain("clu", "select user_id, cluster_id, round(lat, 7) lat, round(lng, 7) lng from clu"))
def pf8_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster stores its position in one of three ways."""
    at, null = F.col("total_points") % 3, F.lit(None)
    q = stage(spark, sf_dir, "clusters").select("user_id", "cluster_id", F.when(at == 0, F.struct("lat", "lng")).alias("center"), F.when(at == 1, F.col("lat")).alias("a"), F.when(at == 1, F.col("lng")).otherwise(null).alias("o"), F.when(at == 2, F.array("lng", "lat")).alias("p"))
    q = q.withColumn("l", feeds.location(F.col("center"), F.col("a"), F.col("o"), F.col("p")))
    return q.select("user_id", "cluster_id", F.round("l.lat", 7).alias("lat"), F.round("l.lng", 7).alias("lng"))


@register("pf9_display_name", O.chain("clu", "select user_id, cluster_id, case when total_points % 3 = 2 then 'Place ' || cluster_id when total_points % 2 = 0 then place_type else cluster_id end shown from clu"))
def pf9_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("total_points") % 3 == 2, F.concat(F.lit("Place "), F.col("cluster_id"))).when(F.col("total_points") % 3 == 1, "")
    kind = F.when(F.col("total_points") % 2 == 0, F.col("place_type")).otherwise("")
    return stage(spark, sf_dir, "clusters").select("user_id", "cluster_id", feeds.display_name(name, kind, F.col("cluster_id")).alias("shown"))


@register("pf11_aliases", "select o_orderkey, case when o_orderkey % 3 = 0 then 'key ' || o_orderkey when o_orderstatus = 'O' then o_orderpriority else 'unknown' end shown from orders")
def pf11_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("key "), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, "")
    return table(spark, sf_dir, "orders").select("o_orderkey", feeds.first_non_empty(own, F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")), F.lit("unknown")).alias("shown"))


@register("sf10_infer_activity", O.chain("gps", "select raw_id, case when speed = 0 then 'STAY' when speed <= 7 then 'WALK' when speed > 7 then 'DRIVE' else 'UNKNOWN' end activity from gps"))
def sf10_infer_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "gps").select("raw_id", feeds.infer_activity(F.col("speed")).alias("activity"))


@register("sf21_marker_spread", O.chain("clu", "select user_id, cluster_id, round(lat + case when n > 1 then cos(i / n * 2 * pi()) * (8 + (i // 8) * 6) / 111320 else 0 end, 8) marker_lat, round(lng + case when n > 1 then sin(i / n * 2 * pi()) * (8 + (i // 8) * 6) / (111320 * cos(radians(lat))) else 0 end, 8) marker_lng from (select *, count(*) over (partition by lat, lng) n, row_number() over (partition by lat, lng order by user_id, cluster_id) - 1 i from (select user_id, cluster_id, round(lat, 2) lat, round(lng, 2) lng from clu))"))
def sf21_marker_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On positions of two decimals, so that many clusters share one."""
    coarse = stage(spark, sf_dir, "clusters").select("user_id", "cluster_id", F.round("lat", 2).alias("lat"), F.round("lng", 2).alias("lng"))
    return feeds.spread_markers(coarse, ["user_id", "cluster_id"]).select("user_id", "cluster_id", F.round("marker_lat", 8).alias("marker_lat"), F.round("marker_lng", 8).alias("marker_lng"))


@register("cl11_visit_centres", O.chain("clu", "select v.user_id, v.visit_start, v.cluster_id, c.lat, c.lng from vis v left join clu c on c.user_id = v.user_id and c.cluster_id = v.cluster_id"))
def cl11_visit_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.with_centres(stage(spark, sf_dir, "visits"), stage(spark, sf_dir, "clusters")).select("user_id", "visit_start", "cluster_id", "lat", "lng")


RUNS = "select o_custkey::varchar user_id, o_orderkey::varchar run_id, epoch(o_orderdate)::bigint started_at, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end status from orders"


@register("cl14_latest_run", f"select user_id, run_id, started_at from ({RUNS}) where status <> 'failed' qualify row_number() over (partition by user_id order by started_at desc, run_id desc) = 1")
def cl14_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of their customers."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', cast(o_orderdate as timestamp_ntz))")
    return runs.latest(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").cast("string").alias("run_id"), start.alias("started_at"), status.alias("status")))


@register("tr5_result_counts", O.chain("cand", "select user_id, count(*) filter (skip_reason is null and trip_start >= 1704240000) created, count(*) filter (skip_reason is null and trip_start < 1704240000) updated, count(*) filter (skip_reason is not null) skipped from cand group by rollup (user_id)"))
def tr5_result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over an old table that ends at a time."""
    made = trips.candidates(stage(spark, sf_dir, "visits"))
    return result_counts(made, made.where("trip_start < 1704240000"), ["user_id", "trip_start", "from_cluster_id"])


@register("tr6_skip_report_of_a_day", O.chain("cand", "select reason, count(*) n from (select coalesce(skip_reason, filter_reason, case when trip_start >= 19725 * 86400 - 19800 or trip_end < 19724 * 86400 - 19800 then 'outside_day_window' end) reason from cand) where reason is not null group by 1"))
def tr6_skip_report_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.skip_report(trips.candidates(stage(spark, sf_dir, "visits")), 19_724)


@register("io9_merged_partials", O.chain("spts", "select user_id, cell_lat, cell_lng, round(sum(lat), 6) lat_sum, round(sum(lng), 6) lng_sum, count(*) points, min(gps_ts) first_seen, max(gps_ts) last_seen from spts group by all"))
def io9_merged_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two runs over halves of the pings, added up."""
    done = stage(spark, sf_dir, "processed")
    merged = merge_partials(clusters.cells(done.where("raw_id % 2 = 0")).unionByName(clusters.cells(done.where("raw_id % 2 = 1"))))
    return merged.select("user_id", "cell_lat", "cell_lng", F.round("lat_sum", 6).alias("lat_sum"), F.round("lng_sum", 6).alias("lng_sum"), F.col("count").alias("points"), "first_seen", "last_seen")


@register("pr6_visit_feed", O.chain("clu", "select v.user_id, v.cluster_id, coalesce(nullif(c.place_type, ''), v.cluster_id) cluster_name, lat, lng, v.duration_sec, v.point_count, v.day_of_week, v.time_of_day, v.date, v.visit_start, v.visit_end, place_type_confidence, total_points total_cluster_points, visit_count from vis v join clu c on c.user_id = v.user_id and c.cluster_id = v.cluster_id"))
def pr6_visit_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.visit_feed(stage(spark, sf_dir, "visits"), stage(spark, sf_dir, "clusters"))


@register("pr6_prediction_feed", ORACLES["pr3_place_at_time"].replace("select user_id, match_level, row_number() over w rank", "select p.user_id, p.rank, p.cluster_id, coalesce(nullif(place_type, ''), p.cluster_id) cluster_name, confidence, lat, lng from (select user_id, match_level, row_number() over w rank") + ") p join clu c on c.user_id = p.user_id and c.cluster_id = p.cluster_id")
def pr6_prediction_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.prediction_feed(predict.place_at(stage(spark, sf_dir, "visits"), "Tuesday", 600), stage(spark, sf_dir, "clusters"))


DRIVES = "(select user_id, gps_ts, max(raw_id) raw_id from proc where activity = 'DRIVE' group by all)"


@register("jn4_as_of", O.chain("vis", f"select v.user_id, v.visit_start, b.gps_ts last_drive, b.raw_id last_drive_id, a.gps_ts next_drive, a.raw_id next_drive_id from vis v asof left join {DRIVES} b on v.user_id = b.user_id and v.visit_start >= b.gps_ts asof left join {DRIVES} a on v.user_id = a.user_id and v.visit_end <= a.gps_ts"))
def jn4_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with the last driven ping up to their begin and the first from their end on."""
    drives = stage(spark, sf_dir, "processed").where("activity_type = 'DRIVE'").groupBy("user_id", "gps_ts").agg(F.max("raw_id").alias("raw_id"))
    ends = stage(spark, sf_dir, "visits").select("user_id", "visit_start", "visit_end")
    ends = asof.as_of(ends, drives, ["user_id"], "visit_start", "gps_ts", {"gps_ts": "last_drive", "raw_id": "last_drive_id"})
    return asof.as_of(ends, drives, ["user_id"], "visit_end", "gps_ts", {"gps_ts": "next_drive", "raw_id": "next_drive_id"}, "forward").drop("visit_end")


SPOTS = "(select user_id, cluster_id, lat plat, lng plng, place_type from clu)"


@register("jn7_nearest_cluster", O.chain("clu", f"select s.raw_id, max(case when d <= 180 then label end) known_place, max(case when d <= 180 then kind end) known_type, max(case when d <= 180 then round(d, 2) end) known_distance from gps s left join (select raw_id, user_id || '/' || cluster_id as label, place_type as kind, d from (select g.raw_id, c.user_id, c.cluster_id, place_type, {O.hav('g.lat', 'g.lng', 'plat', 'plng')} d from gps g join {SPOTS.replace('user_id,', 'user_id, ')} c on abs(g.lat - plat) < 0.0017 and abs(g.lng - plng) < 0.002) where d <= 180 qualify row_number() over (partition by raw_id order by d, user_id || '/' || cluster_id) = 1) n on n.raw_id = s.raw_id group by s.raw_id"))
def jn7_nearest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ping with the nearest of all users' clusters: a table of places that grows with the users."""
    spots = stage(spark, sf_dir, "clusters").select(F.concat_ws("/", "user_id", "cluster_id").alias("label"), "place_type", "lat", "lng")
    return near.nearest_places(stage(spark, sf_dir, "gps"), spots).select("raw_id", "known_place", "known_type", "known_distance")


@register("sf12_polyline", O.chain("gps", "select user_id, day, cast(row_number() over (partition by user_id, day order by gps_ts, raw_id) - 1 as int) place, floor(lat * 1e5 + 0.5) / 1e5 lat, floor(lng * 1e5 + 0.5) / 1e5 lng from (select *, gps_ts // 86400 as day from gps)"))
def sf12_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day as a polyline, decoded again point by point."""
    days = stage(spark, sf_dir, "gps").withColumn("day", F.floor(F.col("gps_ts") / 86_400))
    lines = G.encode_polylines(days, ["user_id", "day"], ["gps_ts", "raw_id"])
    return lines.select("user_id", "day", F.posexplode(G.decode_polyline(F.col("polyline"))).alias("place", "p")).select("user_id", "day", "place", "p.lat", "p.lng")


@register("pp9_resumed_runs", ORACLES["pp7_processed"])
def pp9_resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed points by runs over spans of two days, each resumed from the stored states of the one before."""
    gps = stage(spark, sf_dir, "gps").withColumn("span", F.floor(F.col("gps_ts") / 172_800))
    done = states = None
    for (span,) in gps.select("span").distinct().orderBy("span").collect():  # a run for each span of days
        made, states = track.resume(gps.where(F.col("span") == span), done, states)
        made, states = at_rest(made, "made"), at_rest(states, "states")
        done = made if done is None else done.unionByName(made)
    return done if done is not None else track.process(gps.drop("span"))


@register("pr5_model_first")
def pr5_model_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next places from every cluster: the model's where its first is sure enough, else those of the rules."""
    from tracewell.operators import models

    known = stage(spark, sf_dir, "clusters")
    rules = predict.next_place(known.select("user_id", F.col("cluster_id").alias("from_cluster_id")), stage(spark, sf_dir, "patterns"), known, "Tuesday", 10)
    samples = patterns.next_place_samples(*(stage(spark, sf_dir, n) for n in ("trips", "visits", "clusters")))
    if samples.count() < models.LEAST_ROWS:
        return feeds.model_first(rules, rules.limit(0))
    model, _ = models.fit_next_place(samples)
    duration = models.trip_duration_model(patterns.trip_duration_samples(stage(spark, sf_dir, "trips")))
    asked = models.predict_next(model, models.requests_of(known, "Tuesday", 10), ["user_id", "from_cluster_id", "day_of_week", "departure_hour"])
    return feeds.model_first(rules, models.with_place_and_duration(asked, duration, known))


PR7 = "days as (select user_id, count(distinct date) d, max(visit_end) latest from vis group by 1), rule as (select user_id, from_cluster_id, to_cluster_id, max(to_place_type) pt, sum(transition_count) n, max(last_seen) last_seen from pat group by all), share as (select *, n / sum(n) over (partition by user_id, from_cluster_id) p from rule), scored as (select c.user_id, c.cluster_id from_cluster_id, to_cluster_id next_cluster_id, pt next_place_type, round(0.3 * p + 0.1 * pow(0.5, (latest - s.last_seen) / 604800.0), 6) score from clu c join days using (user_id) join share s on s.user_id = c.user_id and s.from_cluster_id = c.cluster_id where d >= 3), top as (select user_id, from_cluster_id, cast(row_number() over (partition by user_id, from_cluster_id order by score desc, next_cluster_id) as int) rank, next_cluster_id, next_place_type, score, 'blend' source from scored), gl as (select from_place_type, to_place_type, sum(transition_count) n from pat where from_place_type is not null and to_place_type is not null group by all), g as (select from_place_type, to_place_type, n / sum(n) over (partition by from_place_type) share from gl qualify row_number() over (partition by from_place_type order by n desc, to_place_type) = 1) select * from top where rank <= 3 union all select c.user_id, c.cluster_id, 1, null, to_place_type, round(0.1 * share, 6), case when to_place_type is null then 'not_enough_history' else 'global' end from clu c left join g on from_place_type = place_type where not exists (select 1 from top t where t.user_id = c.user_id and t.from_cluster_id = c.cluster_id)"


@register("pr7_blended_rules", O.chain("pat", "").rstrip() + ",\n" + PR7)
def pr7_blended_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend without a model: shares, recency, and what all users do."""
    asked = stage(spark, sf_dir, "clusters").select("user_id", F.col("cluster_id").alias("from_cluster_id"), F.col("place_type").alias("from_place_type"))
    return predict.blended(asked, stage(spark, sf_dir, "patterns"), stage(spark, sf_dir, "visits"))


SPLIT = "marked as (select *, row_number() over (partition by user_id order by trip_start, date, from_cluster_id, to_cluster_id) <= floor(count(*) over (partition by user_id) * 0.8) early from trips)"


@register("ml7_pattern_accuracy", O.chain("trips", "").rstrip() + f",\n{SPLIT}, best as (select user_id, from_cluster_id, to_cluster_id, row_number() over (partition by user_id, from_cluster_id order by count(*) desc, to_cluster_id) rank from marked where early group by user_id, from_cluster_id, to_cluster_id), judged as (select m.user_id, rank from marked m left join best b on b.user_id = m.user_id and b.from_cluster_id = m.from_cluster_id and b.to_cluster_id = m.to_cluster_id and rank <= 3 where not early) select user_id, count(*) trips, round(count(*) filter (rank = 1) / count(*), 6) accuracy, round(count(*) filter (rank <= 3) / count(*), 6) top3_accuracy from judged group by rollup (user_id) having count(*) > 0")
def ml7_pattern_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the commonest places of each user's first trips hold on the trips after."""
    from tracewell.operators import models

    key = ["user_id", "date", "trip_start", "from_cluster_id"]
    early, late = models.split_by_time(stage(spark, sf_dir, "trips"))
    return models.place_metrics(models.common_places(early, late, key), late, key)


@register("ml7_duration_errors", O.chain("trips", "").rstrip() + f",\n{SPLIT}, mean as (select user_id, from_cluster_id, to_cluster_id, avg(duration_sec) p from marked where early group by all), own as (select user_id, avg(duration_sec) p from marked where early group by all), off as (select m.user_id, abs(coalesce(r.p, o.p) - duration_sec) o from marked m left join mean r on r.user_id = m.user_id and r.from_cluster_id = m.from_cluster_id and r.to_cluster_id = m.to_cluster_id join own o on o.user_id = m.user_id where not early) select user_id, count(*) trips, round(avg(o), 4) mae, round(sqrt(avg(o * o)), 4) rmse, round(median(o), 4) median_error from off group by rollup (user_id) having count(*) > 0")
def ml7_duration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the mean durations of each user's first trips are off on the trips after."""
    from tracewell.operators import models

    early, late = models.split_by_time(stage(spark, sf_dir, "trips"))
    return models.duration_metrics(models.mean_durations(early, late))


@register("ml7_model_metrics")
def ml7_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by user of the next-place model that was fitted on the first days, on the days after."""
    from tracewell.operators import models

    key = ["user_id", "date", "trip_start", "from_cluster_id"]
    early, late = (at_rest(x, "days") for x in models.split_by_days(patterns.next_place_samples(*(stage(spark, sf_dir, n) for n in ("trips", "visits", "clusters")))))
    if early.count() < models.LEAST_ROWS:
        return models.place_metrics(models.common_places(early, late, key), late, key)
    model, _ = models.fit_next_place(early)
    return models.place_metrics(models.predict_next(model, late, key, least=0.0), late, key)


RUN_OF = "case when cast(substr(user_id, 2) as int) % 3 = 0 then 'A' else 'B' end"
LATEST = {n: O.STEPS[n].replace("from lab", "from lab2").replace("join lab ", "join lab2 ") for n in ("anchor", "near", "cen0", "cen")}


@register("cl14_rebuilt_centres", O.chain("lab", "").rstrip() + f",\nlab2 as (select * from lab where {RUN_OF} = 'A' or cnt >= 2),\n" + ",\n".join(f"{n} as materialized ({q})" for n, q in LATEST.items()) + "\nselect user_id, cluster_id, lat, lng, center_method, total_points from cen")
def cl14_rebuilt_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of each user's cells, the second without cells of one ping; it failed for every third user."""
    cells = stage(spark, sf_dir, "labelled")
    both = cells.withColumn("run_id", F.lit("A")).unionByName(cells.where("count >= 2").withColumn("run_id", F.lit("B")))
    failed = F.substring("user_id", 2, 10).cast("int") % 3 == 0
    users = cells.select("user_id").distinct()
    made = users.select("user_id", F.lit("A").alias("run_id"), F.lit(1).cast("long").alias("started_at"), F.lit("completed").alias("status")).unionByName(users.select("user_id", F.lit("B").alias("run_id"), F.lit(2).cast("long").alias("started_at"), F.when(failed, "failed").otherwise("running").alias("status")))
    return runs.rebuilt_clusters(both, made, stage(spark, sf_dir, "visits")).select("user_id", "cluster_id", "lat", "lng", "center_method", "total_points")


MOVED = "100e0 / 6371000.0"


@register("sf6_move_point", O.chain("gps", f"select raw_id, round(degrees(a), 7) lat, round(degrees(radians(lng) + atan2(sin(b) * sin({MOVED}) * cos(radians(lat)), cos({MOVED}) - sin(radians(lat)) * sin(a))), 7) lng from (select *, radians(heading) b, asin(sin(radians(lat)) * cos({MOVED}) + cos(radians(lat)) * sin({MOVED}) * cos(radians(heading))) a from gps)"))
def sf6_move_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ping a hundred metres on in its heading."""
    moved = stage(spark, sf_dir, "gps").withColumn("p", G.move_point(F.col("lat"), F.col("lng"), F.col("heading"), F.lit(100.0)))
    return moved.select("raw_id", F.round("p.lat", 7).alias("lat"), F.round("p.lng", 7).alias("lng"))


SECONDS = "duration_sec * case visit_start % 4 when 0 then 1 when 1 then 60 when 2 then 0.1 else 7 end"


@register("sf14_formatted_visits", O.chain("vis", f"select user_id, visit_start, case when h % 12 = 0 then 12 else h % 12 end || ':' || lpad((m % 60)::varchar, 2, '0') || case when h < 12 then 'AM' else 'PM' end shown_start, case when s >= 3600 and s % 3600 >= 60 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' when s >= 3600 then (s // 3600) || 'h' when s >= 60 then (s // 60) || 'm' else s || 's' end shown_duration, cast(floor(case when share <= 1 then share * 100 else share end + 0.5) as bigint) || '%' shown_share from (select user_id, visit_start, {O.hour('visit_start')} h, {O.minute('visit_start')} m, cast(floor({SECONDS}) as bigint) s, point_count / 64.0::double share from vis)"))
def sf14_formatted_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin, duration (also of seconds and days) and a share of every visit, as shown to people."""
    ts, way = F.col("visit_start"), F.col("visit_start") % 4
    seconds = F.floor(F.col("duration_sec") * F.when(way == 0, 1.0).when(way == 1, 60.0).when(way == 2, 0.1).otherwise(7.0))
    return stage(spark, sf_dir, "visits").select("user_id", "visit_start", T.format_clock(ts).alias("shown_start"), T.format_duration(seconds).alias("shown_duration"), T.format_confidence(F.col("point_count") / 64.0).alias("shown_share"))


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


ORDER_ROWS = "select o_orderkey, o_custkey, round(o_totalprice, 2) total from orders where o_orderdate {} timestamp '1996-01-01'"


@register("io10_stored_tables", f"select *, 'user' as made_by from ({ORDER_ROWS.format('>=')}) union all select *, 'user' from ({ORDER_ROWS.format('<')}) where o_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '1996-01-01') union all select coalesce(n.o_orderkey, o.o_orderkey), coalesce(n.o_custkey, o.o_custkey), coalesce(n.total, o.total), 'order' from ({ORDER_ROWS.format('<')}) o full join (select o_orderkey, o_custkey, -round(o_totalprice, 2) total from orders where o_orderkey % 3 = 0) n on n.o_orderkey = o.o_orderkey")
def io10_stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored tables of the early orders: one with the customers of later orders rebuilt, one with every third order put over the old ones."""
    orders = table(spark, sf_dir, "orders")
    rows = lambda c: orders.where(c).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("total"))
    late = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    store = VersionedTables(spark, own_folder(spark, "store"))
    store.commit([("user", "append", rows(~late), ["o_custkey"]), ("order", "append", rows(~late), ["o_orderkey"])], "load", 0)
    third = rows(F.col("o_orderkey") % 3 == 0).withColumn("total", -F.col("total"))
    changes = [("user", "users", rows(late), ["o_custkey"]), ("order", "upsert", third, ["o_orderkey"])]
    store.commit(changes, "load", 1)
    store.commit(changes, "load", 1)  # given again, it changes nothing
    return store.read("user").withColumn("made_by", F.lit("user")).unionByName(store.read("order").withColumn("made_by", F.lit("order")))


@register("io12_text_files", O.chain("clu", "select user_id, cluster_id, place_type || ', \"' || cluster_id || '\"' note, case when total_points % 5 = 0 then null else lat end lat, total_points, f as format from clu, (values ('csv'), ('json')) t(f)"))
def io12_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters written as CSV and as JSON lines, with quotes, commas and missing values, and read back."""
    note = F.concat("place_type", F.lit(', "'), "cluster_id", F.lit('"'))
    rows = stage(spark, sf_dir, "clusters").select("user_id", "cluster_id", note.alias("note"), F.when(F.col("total_points") % 5 != 0, F.col("lat")).alias("lat"), "total_points")
    schema, csv, json = "user_id string, cluster_id string, note string, lat double, total_points long", own_folder(spark, "csv"), own_folder(spark, "json")
    write_csv(rows, csv)
    write_json(rows, json)
    return read_csv(spark, csv, schema).withColumn("format", F.lit("csv")).unionByName(spark.read.schema(schema).json(json).withColumn("format", F.lit("json")))
