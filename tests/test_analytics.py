"""Operators against hand-made cases, sequential models, and DuckDB on the movement view."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracewell.functions import geo, timefn
from tracewell.operators import clusters, feeds, models, patterns, points, predict, runs, trips, visits
from tracewell.plans import queries as plan_queries
from tracewell.sources import generate, tables
from tracewell.streaming import pings

SF = "/root/testdata/sf0.001"
GPS = "raw_id long, user_id string, gps_ts long, lat double, lng double, speed double, heading double, accuracy double"


def ping_frame(spark, rows):
    return spark.createDataFrame(rows, GPS)


def flagged(spark, rows):
    got = points.with_activity(points.with_anomaly(points.with_features(ping_frame(spark, rows)))).orderBy("raw_id").collect()
    return [r["anomaly_reason"] for r in got], [r["activity_type"] for r in got]


def north(lat, metres):
    return lat + math.degrees(metres / geo.EARTH_M)


def test_anomaly_rules(spark):
    at = lambda i, u, ts, lat=28.0, acc=8.0: (i, u, ts, lat, 77.0, 0.0, 0.0, acc)
    rows = [at(1, "a", 0, 91.0), at(2, "b", 0), at(3, "c", 100, acc=None), at(4, "d", 100, acc=0.0), at(5, "e", 100, acc=100.0), at(6, "f", 100, acc=100.1), at(7, "g", 100), at(8, "g", 100), at(9, "h", 100), at(10, "h", 159, north(28.0, 2500)), at(11, "i", 100), at(12, "i", 160, north(28.0, 2500)), at(13, "j", None)]
    assert flagged(spark, rows)[0] == ["INVALID_LAT_LNG", "INVALID_TIMESTAMP", None, None, None, "LOW_GPS_ACCURACY", None, "NON_INCREASING_TIMESTAMP", None, "IMPOSSIBLE_DISTANCE_JUMP", None, None, "INVALID_TIMESTAMP"]


def test_activity_rules(spark):
    def pair(i, user, speed, metres, gap):
        return [(i, user, 1000, 28.0, 77.0, 0.0, 0.0, 8.0), (i + 1, user, 1000 + gap, north(28.0, metres), 77.0, speed, 0.0, 8.0)]

    rows = pair(1, "a", 1.5, 29.9, 60) + pair(3, "b", 10.0, 27.0, 10) + pair(5, "c", 5.0, 6.0, 31) + pair(7, "d", 5.0, 6.0, 30) + pair(9, "e", 13.0, 50.0, 30) + pair(11, "f", 0.0, 1.0, 61)
    assert flagged(spark, rows)[1][1::2] == ["STAY", "UNKNOWN", "UNKNOWN", "WALK", "DRIVE", "UNKNOWN"]


def sequential(rows):
    """Trip and stay state of one user's rows (ts, lat, lng, speed, activity, anomaly), one by one."""
    out, trip, stop, anchor, last, n = [], None, None, None, None, 0
    for ts, lat, lng, speed, activity, anomaly in rows:
        if last is not None and ts - last > 60:
            trip = stop = anchor = None
        last = ts
        state = None
        if not anomaly:
            if trip is None and speed > 5 and activity != "UNKNOWN":
                n += 1
                trip, stop = n, None
            if trip is not None:
                if speed < 1:
                    stop = ts if stop is None else stop
                    if ts - stop >= 300:
                        trip = stop = None
                else:
                    stop = None
            state = trip
        if anomaly or activity == "UNKNOWN":
            anchor, stay = None, (False, None, 0)
        else:
            a = 0 if anchor is None else math.sin(math.radians(lat - anchor[0]) / 2) ** 2 + math.cos(math.radians(anchor[0])) * math.cos(math.radians(lat)) * math.sin(math.radians(lng - anchor[1]) / 2) ** 2
            if anchor is None or 2 * geo.EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a)) > 50:
                anchor = (lat, lng, ts)
            stay = (ts - anchor[2] >= 120, anchor[2], ts - anchor[2])
        out.append((state is not None, *stay))
    return out


def test_trips_and_stays_match_a_sequential_model(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for u in range(12):
        ts, lat, lng, speed = 1_704_060_000 + rng.randint(0, 80_000), 28.5, 77.2, 0.0
        for _ in range(150):
            ts += rng.choice([10, 30, 30, 30, 60, 61, 300]) if rng.random() < 0.3 else 30
            speed = rng.choice([0.0, 0.5, 3.0, 6.0, 30.0]) if rng.random() < 0.15 else speed
            lat, lng = lat + rng.gauss(0, 1) * 1e-5 * (1 + speed * 3), lng + rng.gauss(0, 1) * 1e-5 * (1 + speed * 3)
            i += 1
            rows.append((i, f"U{u}", ts, lat, lng, speed, 0.0, 150.0 if rng.random() < 0.03 else 8.0))
    got = points.process(ping_frame(spark, rows)).toPandas().sort_values("raw_id")
    speed = {r[0]: r[5] for r in rows}
    for _, g in got.groupby("user_id"):
        want = sequential([(r.gps_ts, r.lat, r.lng, speed[r.raw_id], r.activity_type, r.is_anomaly) for r in g.itertuples()])
        assert [(r.trip_id is not None and r.trip_id == r.trip_id, bool(r.is_stay_point), None if pd.isna(r.stay_start_time) else int(r.stay_start_time), int(r.stay_duration)) for r in g.itertuples()] == want


def days_without_gap(days, seed=5):
    """Pings of one device every minute without a gap: it rests for days, drifts, drives, and loses its fix now and then."""
    rng = random.Random(seed)
    ts, lat, lng, speed, rows = 1_704_060_000, 28.5, 77.2, 0.0, []
    for i in range(days * 1440):
        hour = i // 60
        if hour % 40 == 7:
            speed = rng.choice([0.5, 6.0, 30.0]) if rng.random() < 0.2 else speed
        else:
            speed = 0.4
        drift = 4 if hour % 100 > 70 else 0.3
        lat, lng = lat + rng.gauss(0, 1) * 1e-6 * (drift + speed * 30), lng + rng.gauss(0, 1) * 1e-6 * (drift + speed * 30)
        lost = hour % 300 > 250 and rng.random() < 0.01
        rows.append((i + 1, "U", ts + 60 * i, lat, lng, speed, 0.0, 150.0 if lost else 8.0))
    return rows


def test_a_session_of_many_days_equals_a_sequential_model(spark):
    rows = days_without_gap(20)
    got = points.process(ping_frame(spark, rows)).toPandas().sort_values("raw_id")
    want = sequential([(r.gps_ts, r.lat, r.lng, rows[r.raw_id - 1][5], r.activity_type, r.is_anomaly) for r in got.itertuples()])
    assert [(isinstance(r.trip_id, str), bool(r.is_stay_point), None if pd.isna(r.stay_start_time) else int(r.stay_start_time), int(r.stay_duration)) for r in got.itertuples()] == want
    numbers = [int(x.rsplit("T", 1)[1]) for x in got["trip_id"].dropna()]
    assert numbers == sorted(numbers) and set(numbers) == set(range(1, max(numbers) + 1)) and len(set(numbers)) > 5
    assert got["stay_duration"].max() > 86_400


def test_stay_fold_re_anchors():
    ts = np.array([0, 119, 120, 150])
    lat = np.array([0.0, math.degrees(49 / geo.EARTH_M), math.degrees(49 / geo.EARTH_M), math.degrees(51 / geo.EARTH_M)])
    assert list(points.stay_fold(ts, lat, np.zeros(4), 50)) == [0, 0, 0, 150]


def test_dbscan():
    assert list(clusters.dbscan_labels(np.array([28.0]), np.array([77.0]), np.array([8]), 50, 8)) == [0]
    assert list(clusters.dbscan_labels(np.array([28.0]), np.array([77.0]), np.array([7]), 50, 8)) == [-1]
    rng = np.random.default_rng(0)
    lat, lng, w = 28 + rng.random(200) * 0.01, 77 + rng.random(200) * 0.01, rng.integers(1, 5, 200)
    got = clusters.dbscan_labels(lat, lng, w, 60, 8)
    a = np.sin(np.radians(lat[:, None] - lat) / 2) ** 2 + np.cos(np.radians(lat))[:, None] * np.cos(np.radians(lat)) * np.sin(np.radians(lng[:, None] - lng) / 2) ** 2
    near = 2 * geo.DBSCAN_EARTH_M * np.arcsin(np.sqrt(a)) <= 60
    core = near @ w >= 8
    assert ((got >= 0) == (near & core).any(axis=1)).all()
    for i in range(200):
        for j in range(200):
            if core[i] and core[j] and near[i, j]:
                assert got[i] == got[j]


@pytest.mark.parametrize("lat", [28.0, -61.0])
def test_clusters_by_joins_equal_one_group(spark, monkeypatch, lat):
    monkeypatch.setattr(clusters, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = []
    for user in "ab":
        spots = [(lat + y, 77 + x) for y, x in rng.normal(0, 1, (150, 2)) * 0.0002] + [(lat + y, 77 + x) for y, x in rng.random((250, 2)) * 0.012]
        rows += [(user, k, -k, float(y), float(x), int(rng.integers(1, 4)), int(rng.integers(0, 90))) for k, (y, x) in enumerate(spots)]
    frame = spark.createDataFrame(rows, "user_id string, cell_lat long, cell_lng long, lat double, lng double, count long, first_seen long")
    made = clusters.with_clusters(frame, 60, 6)
    assert "InPandas" not in made._jdf.queryExecution().toString()
    got = {(r["user_id"], r["cell_lat"]): r["cluster_id"] for r in made.collect()}
    assert len(got) == len(rows)
    for user in "ab":
        own = sorted((r for r in rows if r[0] == user), key=lambda r: (r[6], r[1], r[2]))
        want = clusters.dbscan_labels(*(np.array([r[c] for r in own]) for c in (3, 4, 5)), 60, 6)
        assert len(set(want)) > 3
        assert [got[user, r[1]] for r in own] == ["-1" if k < 0 else f"C{k}" for k in want]


def island_frame(spark, runs):
    rows, k = [], 0
    for cluster, start, end in runs:
        for ts in range(start, end + 1, 60):
            k += 1
            rows.append((k, "U", ts, cluster))
    return spark.createDataFrame(rows, "raw_id long, user_id string, gps_ts long, cluster_id string")


def test_visits_split_filter_and_merge(spark):
    one = visits.visits(island_frame(spark, [("A", 0, 600), ("A", 2400, 3000)])).collect()
    assert len(one) == 1 and one[0]["visit_end"] == 3000
    two = visits.visits(island_frame(spark, [("A", 0, 600), ("A", 2401, 3001)])).orderBy("visit_start").collect()
    assert [(r["prev_cluster_id"], r["next_cluster_id"]) for r in two] == [(None, "A"), ("A", None)]
    merged = visits.visits(island_frame(spark, [("A", 0, 600), ("B", 660, 720), ("A", 780, 1380)])).collect()
    assert len(merged) == 1 and merged[0]["is_merged"] and merged[0]["point_count"] == 22 and merged[0]["next_cluster_id"] is None


def visit_rows(spark, rows):
    q = spark.createDataFrame(rows, "user_id string, cluster_id string, visit_start long, visit_end long").withColumn("duration_sec", F.col("visit_end") - F.col("visit_start"))
    s, h = F.col("visit_start"), timefn.hour(F.col("visit_start"))
    return q.withColumns({"day_of_week": timefn.day_of_week(s), "is_weekend": timefn.is_weekend(s), "time_of_day": timefn.time_of_day(h, "visit"), "prev_cluster_id": F.lit(None).cast("string"), "arrival_hour": h, "departure_hour": timefn.hour(F.col("visit_end")), "date": timefn.date_text(s)})


def test_trip_filters_and_midnight(spark):
    v = visit_rows(spark, [("a", "A", 0, 1000), ("a", "A", 1119, 2000), ("a", "B", 2059, 3000), ("a", "B", 3130, 4000)])
    got = trips.candidates(v).orderBy("trip_start").collect()
    assert [r["filter_reason"] for r in got] == ["same_cluster_small_gap", "below_min_duration", None]
    midnight = 19_800 * 0 + 86_400 * 10 - timefn.OFFSET
    late = visit_rows(spark, [("a", "A", midnight - 3600, midnight - 600), ("a", "B", midnight + 600, midnight + 4000)])
    none = spark.createDataFrame([], "user_id string, gps_ts long, raw_id long, lat double, lng double, activity_type string")
    assert [r["date"] for r in trips.trip_segments(late, none).orderBy("date").collect()] == ["1970-01-10", "1970-01-11"]
    assert trips.trip_segments(late, none, once=True).count() == 1
    assert trips.trip_segments(late, none).first()["data_quality"] == "NO_POINTS"


def test_modes_and_quality(spark):
    rows = spark.createDataFrame([(4, 6), (5, 5), (6, 4), (0, 0)], "walk long, drive long")
    assert [r[0] for r in rows.select(trips.travel_mode()).collect()] == ["DRIVE", "MIXED", "WALK", "UNKNOWN"]
    rows = spark.createDataFrame([(0, 0, 0), (4, 1, 3), (5, 1, 3), (5, 4, 0)], "point_count long, gps_jump_count long, valid_segment_count long")
    assert [r[0] for r in rows.select(trips.data_quality()).collect()] == ["NO_POINTS", "LOW_POINTS", "GPS_JUMP_FILTERED", "GOOD"]


def test_common_mode_takes_the_first_seen(spark):
    base = ("U", "A", "B", "Monday", "night", 1, 60, "GOOD", 10.0, 5.0, 9.0)
    rows = [(*base, m, 100 + k, 160 + k) for k, m in enumerate(["WALK", "DRIVE", "DRIVE", "WALK"])]
    q = spark.createDataFrame(rows, "user_id string, from_cluster_id string, to_cluster_id string, day_of_week string, time_of_day string, departure_hour int, duration_sec long, data_quality string, distance_meters double, avg_speed_kmph double, max_speed_kmph double, travel_mode string, trip_start long, trip_end long")
    assert patterns.routes(q).first()["most_common_travel_mode"] == "WALK"


def test_place_rules(spark):
    rows = [(16644.0, 0.0, 0.5, 1.0, 5), (100.0, 0.5, 0.0, 1.0, 4), (2888.0, 0.0, 0.1, 1.0, 22), (50.0, 0.0, 0.0, 1.0, 1)]
    q = spark.createDataFrame(rows, "avg_duration_sec double, night_visit_ratio double, day_visit_ratio double, weekday_ratio double, visit_count long")
    assert [r[0] for r in q.select(clusters.place_type()[0]).collect()] == ["OFFICE", "HOME", "GYM", "OTHER"]


def test_prediction_ranges_and_place(spark):
    base = 86_400 * 19_723 - timefn.OFFSET  # local midnight
    v = visit_rows(spark, [("U", "A", base + 1410 * 60, base + 1470 * 60), ("U", "B", base + 2 * 86_400 + 540 * 60, base + 2 * 86_400 + 700 * 60)])
    r = sorted((x["start_minute"], x["end_minute"]) for x in predict.ranges(v.where("cluster_id = 'A'")).collect())
    assert r == [(0, 30), (1410, 1440)]
    top = predict.place_at(v, "Sunday", 600).where("rank = 1").first()
    assert (top["cluster_id"], top["match_level"]) == ("B", "all_days_fallback")
    day = predict.day_schedule(v, "Sunday").orderBy("rank").collect()
    assert [(x["cluster_id"], x["start_time"], x["end_time"]) for x in day] == [("A", "00:00", "00:30"), ("B", "09:00", "12:00"), ("A", "23:30", "24:00")]


def test_time_functions(spark):
    q = spark.createDataFrame([("9:05PM",), ("12:00AM",), ("24:00",), ("7:5",), ("07:45",), (None,)], "t string")
    assert [r[0] for r in q.select(timefn.parse_minutes(F.col("t"))).collect()] == [1265, 0, None, None, 465, None]
    r = spark.range(1).select(timefn.hour(F.lit(1777926492)), timefn.day_of_week(F.lit(1777926492)), timefn.time_of_day(timefn.hour(F.lit(1777926492)), "trip"), timefn.format_duration(F.lit(7500)), timefn.format_duration(F.lit(9)), timefn.format_clock(F.lit(0)), timefn.format_minutes(F.lit(1440), True), timefn.format_minutes(F.lit(1440)), timefn.format_confidence(F.lit(0.625))).first()
    assert list(r) == [1, "Tuesday", "night", "2h 5m", "9s", "5:30AM", "24:00", "00:00", "63%"]


def test_geo_functions(spark):
    r = spark.range(1).select(geo.heading_diff(F.lit(350.0), F.lit(10.0)), geo.heading_diff(F.lit(10.0), F.lit(200.0)), geo.haversine_m(F.lit(91.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), geo.geohash(F.lit(57.64911), F.lit(10.40744), 8), geo.decode_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")), geo.decode_polyline(F.lit("")), geo.move_point(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(111_194.9266))).first()
    assert list(r)[:4] == [20.0, 170.0, 0.0, "u4pruydq"]
    assert [(round(p["lat"], 5), round(p["lng"], 5)) for p in r[4]] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)] and r[5] == []
    assert abs(r[6]["lng"] - 1) < 1e-6 and abs(r[6]["lat"]) < 1e-9


def test_upsert_and_files(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, v string, created long")
    new = spark.createDataFrame([(2, "B", 99), (3, "C", 99)], "k long, v string, created long")
    got = tables.upsert(old, new, ["k"], keep=["created"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 10), (2, "B", 20), (3, "C", 99)]
    assert sorted(map(tuple, tables.upsert(got, new, ["k"], keep=["created"]).collect())) == sorted(map(tuple, got.collect()))
    tables.write_csv(spark.createDataFrame([(1, 'say "hi", all', None)], "k long, v string, w string"), str(tmp_path / "c"))
    assert tuple(tables.read_csv(spark, str(tmp_path / "c"), "k long, v string, w string").first()) == (1, 'say "hi", all', None)


def test_append_rebuild_json_and_partials(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "user_id string, x long")
    tables.append(rows, str(tmp_path / "t"))
    tables.append(rows.limit(0), str(tmp_path / "t"))
    tables.append(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    for _ in range(2):  # the same rebuild twice leaves the same table, and b alone
        tables.rebuild_users(rows, str(tmp_path / "u")) if not (tmp_path / "u").exists() else tables.rebuild_users(rows.where("user_id = 'a' and x = 2"), str(tmp_path / "u"))
    assert sorted((r["user_id"], r["x"]) for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [("a", 2), ("b", 3)]
    tables.write_json(rows, str(tmp_path / "j"))
    assert sorted((r["user_id"], r["x"]) for r in spark.read.json(str(tmp_path / "j")).collect()) == [("a", 1), ("a", 2), ("b", 3)]
    part = lambda n, first: ("u", 1, 2, n * 1.5, n * 2.5, n, first, first + 9)
    parts = spark.createDataFrame([part(2, 50), part(3, 40)], "user_id string, cell_lat long, cell_lng long, lat_sum double, lng_sum double, count long, first_seen long, last_seen long")
    assert tuple(tables.merge_partials(parts).first()) == ("u", 1, 2, 7.5, 12.5, 5, 40, 59)


def test_run_table(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs.record(spark, path, "r1", "u", "running", 10)
    runs.record(spark, path, "r1", "u", "completed", 10, 20)
    runs.record(spark, path, "r2", "u", "running", 30)
    runs.record(spark, path, "r2", "u", "failed", 30, 31, "no room")
    runs.record(spark, path, "r3", "v", "running", 5)
    now = runs.current(spark.read.parquet(path))
    assert sorted((r["run_id"], r["status"], r["error"]) for r in now.collect()) == [("r1", "completed", None), ("r2", "failed", "no room"), ("r3", "running", None)]
    assert sorted(map(tuple, runs.latest(now).collect())) == [("u", "r1", 10), ("v", "r3", 5)]
    with pytest.raises(ValueError):
        runs.record(spark, path, "r4", "v", "lost", 1)


def test_model_first(spark):
    columns = "user_id string, from_cluster_id string, rank int, next_cluster_id string, confidence double, expected_trip_duration_min double"
    model = spark.createDataFrame([("u", "A", 1, "B", 0.7, 12.4), ("u", "A", 2, "C", 0.2, 3.0), ("v", "A", 1, "B", 0.69, 9.0)], columns)
    rules = spark.createDataFrame([(u, "A", 1, "D", 0.4, 7, "rule_based_level_1") for u in "uvw"], columns.replace("min double", "min long") + ", source string")
    got = feeds.model_first(rules, model).collect()
    assert sorted((r["user_id"], r["rank"], r["next_cluster_id"], r["source"]) for r in got) == [("u", 1, "B", "ml_model"), ("u", 2, "C", "ml_model"), ("v", 1, "D", "rule_based_level_1"), ("w", 1, "D", "rule_based_level_1")]


def test_models_are_saved_and_read(spark, tmp_path):
    rows = [("u", "2024-01-01", i, "A", "BC"[i % 2], 1000.0 * (i % 5), "DRIVE", "Monday", i % 24, 60 * (i % 5)) for i in range(60)]
    samples = spark.createDataFrame(rows, "user_id string, date string, trip_start long, from_cluster_id string, to_cluster_id string, distance_meters double, travel_mode string, day_of_week string, departure_hour int, duration_sec long")
    model, error, _ = models.fit_trip_duration(samples, trees=3, depth=3)
    assert error >= 0 and models.load_model(str(tmp_path / "none")) is None
    for _ in range(2):
        models.save_model(model, str(tmp_path / "m"))
    again = models.predict_duration(models.load_model(str(tmp_path / "m")), samples)
    assert text(again.toPandas()) == text(models.predict_duration(model, samples).toPandas())


def test_streams_drop_repeats_and_close_visits(spark, tmp_path):
    rows = [(i, "U", 1_704_060_000 + 60 * i + (7_200 if i >= 10 else 0), 28.0, 77.0, 0.0, 0.0, 8.0) for i in range(20)] + [(99, "U", 1_704_080_000, 28.0, 77.0, 0.0, 0.0, 8.0)]
    src = str(tmp_path / "in")
    for part in (rows[:12], rows[5:20], rows[20:]):
        ping_frame(spark, part).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(GPS).option("maxFilesPerTrigger", 1).parquet(src)

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    assert sorted(r["raw_id"] for r in run(pings.distinct_pings(read()), "once").collect()) == [*range(20), 99]
    clustered = pings.distinct_pings(read()).drop("ts").withColumn("cluster_id", F.lit("C0"))
    visits_seen = run(pings.session_visits(spark.readStream.schema(GPS).option("maxFilesPerTrigger", 1).parquet(src).withColumn("cluster_id", F.lit("C0"))), "visits_seen")
    assert clustered.isStreaming and {(r["visit_start"], r["visit_end"]) for r in visits_seen.collect()} >= {(1_704_060_000, 1_704_060_540)}


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Cluster:
        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Cluster)


def test_entry_without_a_library(monkeypatch):
    import importlib
    import sys

    for name in [n for n in sys.modules if n.startswith("tracewell.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    entry = importlib.reload(__spark_entry__)
    assert "pipeline" not in entry.queries() and "pa3_patterns" in entry.queries()
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_stage_follows_its_input(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.limit(50).write.parquet(str(tmp_path / "events.parquet"))
    before = plan_queries.stage(spark, str(tmp_path), "gps").count()
    events.limit(80).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert (before, plan_queries.stage(spark, str(tmp_path), "gps").count()) == (50, 80)


def test_generated_pings_and_journey(spark):
    g = generate.pings(generate.users(spark, 2), 19_723, 1, every_s=600)
    assert g.count() == 2 * (510 + 500 + 70 + 280) // 10 and g.exceptAll(generate.pings(generate.users(spark, 2), 19_723, 1, every_s=600)).count() == 0
    j = generate.journey(spark, (28.0, 77.0), (28.01, 77.0), 36.0, 20, 1000).orderBy("gps_ts").toPandas()
    assert list(dict.fromkeys(j.phase)) == ["stop", "go", "return"] or set(j.phase) == {"stop", "go", "return"}
    assert (np.diff(j.gps_ts) == 5).all() and j.lat.between(28.0, 28.01).all()


def test_streaming_stays_equal_batch(spark, tmp_path):
    rows = [(i, "U", 1_704_060_000 + 30 * i, 28.0 + (0.01 if i > 20 else 0) + 1e-6 * i, 77.0, 0.0, 0.0, 8.0) for i in range(40)]
    src = str(tmp_path / "in")
    for part in (rows[:13], rows[13:27], rows[27:]):
        ping_frame(spark, part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(GPS).option("maxFilesPerTrigger", 1).parquet(src)
    q = pings.streaming_stays(stream).writeStream.format("memory").queryName("stays").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("stays").toPandas().sort_values("raw_id")
    assert len(got) == 40 and got.is_stay_point.sum() > 20


def text(df):
    """Rows as sorted tuples of text, columns by name, numbers at five decimals, nulls empty."""

    def one(v):
        if pd.isna(v):
            return ""
        return f"{float(v):.5f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", ["pp7_processed", "cl8_user_clusters", "tr3_trip_segments", "pa3_patterns", "pr3_place_at_time", "pr4_day_schedule", "pr5_next_place", "io8_upsert"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = plan_queries.QUERIES[name](spark, SF).toPandas(), con.execute(plan_queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert text(got) == text(want)


def test_model_queries_do_the_whole_job(spark, monkeypatch):
    from tracewell.operators import models

    sf, asked = SF.replace("0.001", "0.01"), []
    for name in ("fit_next_place", "fit_trip_duration"):
        fit = getattr(models, name)
        assert fit.__defaults__ == (100, 12)

        def small(samples, fit=fit, **given):
            asked.append(given)
            return fit(samples, trees=3, depth=3)

        monkeypatch.setattr(models, name, small)
    got = plan_queries.QUERIES["ml6_next_place_model"](spark, sf).toPandas()
    assert asked == [{}, {}] and len(got)
    assert {"next_place_type", "lat", "lng", "expected_trip_duration_min"} <= set(got.columns) and got.expected_trip_duration_min.gt(0).all()
    known = plan_queries.stage(spark, sf, "clusters").toPandas()
    assert set(zip(got.user_id, got.next_cluster_id, strict=True)) <= set(zip(known.user_id, known.cluster_id, strict=True))
    assert got["rank"].between(1, 3).all() and got.confidence.ge(0.01).all()
    timed = plan_queries.QUERIES["ml5_trip_duration_model"](spark, sf)
    assert timed.count() == plan_queries.QUERIES["ml2_trip_duration_samples"](spark, sf).count() and timed.where("predicted_sec is null").isEmpty()
    seconds = plan_queries.QUERIES["gn3_generated_pings"](spark, sf).where("user_id = 'U001'").orderBy("gps_ts").limit(3).toPandas().gps_ts
    assert list(np.diff(seconds)) == [3, 3]


def test_probabilities_add_up(spark):
    p = plan_queries.stage(spark, SF, "patterns").groupBy("user_id", "from_cluster_id", "day_of_week", "time_of_day").agg(F.sum("probability").alias("p"))
    assert p.where(F.abs(F.col("p") - 1) > 0.01).count() == 0


def test_contract(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(plan_queries.QUERIES) > 40
    assert __spark_entry__.entry(spark).columns
