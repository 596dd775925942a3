"""Blend, evaluation and rebuilding against small hand-made cases and brute force."""

import math
import random
import statistics

import pytest

from tracewell.operators import models, predict, runs

PATTERNS = "user_id string, from_cluster_id string, to_cluster_id string, from_place_type string, to_place_type string, day_of_week string, time_of_day string, transition_count long, probability double, avg_travel_duration_sec long, first_seen long, last_seen long"


def pattern(user, a, b, n, seen=1000, kinds=("HOME", "OFFICE"), day="Monday"):
    return (user, a, b, *kinds, day, "morning", n, 0.5, 600, seen, seen)


def test_blend_of_model_share_and_recency(spark):
    week = 7 * 86_400
    pats = spark.createDataFrame([pattern("a", "C0", "C1", 3, seen=10 * week), pattern("a", "C0", "C2", 1, seen=9 * week), pattern("a", "C0", "C1", 1, day="Friday", seen=8 * week), pattern("b", "C5", "C6", 2, kinds=("GYM", "HOME"))], PATTERNS)
    visits = spark.createDataFrame([("a", f"d{k}", 10 * week) for k in range(3)] + [("b", "d1", 5), ("d", "d1", 5), ("d", "d2", 5), ("d", "d3", 9)], "user_id string, date string, visit_end long")
    requests = spark.createDataFrame([("a", "C0", "HOME"), ("a", "C0", "HOME"), ("b", "C5", "GYM"), ("c", "C0", "PARK"), ("d", "C0", "HOME")], "user_id string, from_cluster_id string, from_place_type string")
    model = spark.createDataFrame([("a", "C0", "C2", 0.9), ("a", "C0", "C3", 0.1), ("zz", "C0", "C1", 1.0)], "user_id string, from_cluster_id string, next_cluster_id string, confidence double")
    got = {(r["user_id"], r["rank"]): (r["next_cluster_id"], r["next_place_type"], r["score"], r["source"]) for r in predict.blended(requests, pats, visits, model).collect()}
    assert got == {
        ("a", 1): ("C2", "OFFICE", round(0.6 * 0.9 + 0.3 * 0.2 + 0.1 * 0.5, 6), "blend"), ("a", 2): ("C1", "OFFICE", round(0.3 * 0.8 + 0.1, 6), "blend"), ("a", 3): ("C3", None, 0.06, "blend"),
        ("b", 1): (None, "HOME", 0.1, "global"), ("c", 1): (None, None, None, "not_enough_history"), ("d", 1): (None, "OFFICE", 0.1, "global"),
    }
    rules = predict.blended(requests, pats, visits)
    assert rules.where("user_id = 'a'").orderBy("rank").first()["next_cluster_id"] == "C1"
    assert predict.blended(requests.limit(0), pats, visits).count() == 0
    assert predict.blended(requests, pats.limit(0), visits.limit(0)).where("source <> 'not_enough_history'").count() == 0


def test_next_place_levels(spark):
    pats = spark.createDataFrame([pattern("a", "C0", "C1", 3), pattern("a", "C0", "C2", 4, day="Tuesday"), pattern("a", "C3", "C4", 9)], PATTERNS)
    clusters = spark.createDataFrame([("a", c, 1.0, 2.0) for c in ("C0", "C1", "C2", "C9")], "user_id string, cluster_id string, lat double, lng double")
    requests = spark.createDataFrame([("a", "C0"), ("a", "C9"), ("x", "C0")], "user_id string, from_cluster_id string")
    got = [(r["from_cluster_id"], r["rank"], r["next_cluster_id"], r["confidence"], r["source"]) for r in predict.next_place(requests, pats, clusters, "Tuesday", 10).orderBy("from_cluster_id").collect()]
    assert got == [("C0", 1, "C2", 0.5, "rule_based_level_1"), ("C9", 1, "C4", 0.1, "most_frequent")]


def test_metrics_by_hand(spark):
    rng = random.Random(1)
    actual = [(f"u{i % 3}", i, rng.choice("ABCD")) for i in range(60)]
    guesses = [(u, i, k + 1, p) for u, i, _ in actual if i % 7 for k, p in enumerate(rng.sample("ABCD", 4))]
    got = {r["user_id"]: (r["trips"], r["accuracy"], r["top3_accuracy"]) for r in models.place_metrics(spark.createDataFrame(guesses, "user_id string, i int, rank int, next_cluster_id string"), spark.createDataFrame(actual, "user_id string, i int, to_cluster_id string"), ["user_id", "i"]).collect()}
    place = {(u, i, p): k for u, i, k, p in guesses}
    for user in ("u0", "u1", "u2", None):
        ranks = [place.get((u, i, p), 99) for u, i, p in actual if user in (u, None)]
        assert got[user] == (len(ranks), round(sum(r == 1 for r in ranks) / len(ranks), 6), round(sum(r <= 3 for r in ranks) / len(ranks), 6))
    off = [(rng.choice("ab"), rng.randint(0, 900), rng.choice([None, 300.5, 500.0])) for _ in range(50)]
    got = {r["user_id"]: r for r in models.duration_metrics(spark.createDataFrame(off, "user_id string, duration_sec long, predicted_sec double")).collect()}
    for user in ("a", "b", None):
        e = [abs(p - d) for u, d, p in off if p is not None and user in (u, None)]
        assert got[user]["trips"] == len(e) and math.isclose(got[user]["mae"], statistics.mean(e), abs_tol=1e-4)
        assert math.isclose(got[user]["rmse"], math.sqrt(statistics.mean([x * x for x in e])), abs_tol=1e-4) and math.isclose(got[user]["median_error"], statistics.median(e), abs_tol=1e-4)


def test_splits_learn_from_nothing_later(spark):
    rows = [(f"u{i % 2}", f"2024-01-{1 + i // 4:02d}", i, "C0", "C1") for i in range(40)] + [("u0", None, 3, "C0", "C1")]
    frame = spark.createDataFrame(rows, "user_id string, date string, trip_start long, from_cluster_id string, to_cluster_id string")
    early, late = models.split_by_days(frame)
    assert (early.count(), late.count()) == (32, 8) and early.agg({"date": "max"}).first()[0] < late.agg({"date": "min"}).first()[0]
    early, late = models.split_by_time(frame)
    for user in ("u0", "u1"):
        one, two = ([r["trip_start"] for r in x.where(f"user_id = '{user}'").collect()] for x in (early, late))
        assert max(one) <= min(two) and len(one) == int((len(one) + len(two)) * 0.8)


def test_models_take_any_number_of_users(spark):
    """More users than a tree has bins; held-out trips of known habits are predicted."""
    rng = random.Random(2)
    day = ("Monday", "Tuesday", "Wednesday")
    rows = [(f"u{i}", f"2024-01-{1 + t:02d}", 86_400 * t + i, "C0", "HOME", None, day[t % 3], False, "morning", 8, 3600, 5, 100.0, 0.5, 0.5, "C1" if i % 2 else "C2") for i in range(400) for t in range(5)]
    schema = "user_id string, date string, trip_start long, from_cluster_id string, from_place_type string, previous_cluster_id string, day_of_week string, is_weekend boolean, time_of_day string, departure_hour int, current_stay_duration_sec long, from_cluster_visit_count long, from_cluster_avg_duration_sec double, from_cluster_night_visit_ratio double, from_cluster_day_visit_ratio double, to_cluster_id string"
    rng.shuffle(rows)
    samples = spark.createDataFrame(rows, schema)
    early, late = models.split_by_days(samples)
    model, _ = models.fit_next_place(early, trees=5, depth=10)
    key = ["user_id", "date", "trip_start"]
    scores = models.place_metrics(models.predict_next(model, late, key, least=0.0), late, key).where("user_id is null").first()
    assert scores["trips"] == 400 and scores["top3_accuracy"] == 1.0 and scores["accuracy"] >= 0.5
    clusters = spark.createDataFrame([("u1", "C0", None, 5, 100.0, 0.5, 0.5), ("new", "C0", "HOME", 5, 100.0, 0.5, 0.5)], "user_id string, cluster_id string, place_type string, visit_count long, avg_duration_sec double, night_visit_ratio double, day_visit_ratio double")
    assert models.predict_next(model, models.requests_of(clusters, "Monday", 8), ["user_id", "from_cluster_id"]).select("user_id").distinct().count() == 2
    with pytest.raises(ValueError):
        models.fit_next_place(samples.limit(3))


def test_rebuilt_clusters_are_those_of_the_latest_good_run(spark):
    cell = lambda run, user, cluster, k, n: (run, user, cluster, k, k, 10.0 + k / 1e4, 20.0, n, 1, 2)
    cells = spark.createDataFrame([cell("r1", "a", "C0", 1, 9), cell("r1", "a", "C1", 90, 9), cell("r2", "a", "C0", 1, 9), cell("r1", "b", "C0", 3, 4), cell("r3", "b", "C0", 5, 8), cell("r9", "c", "C0", 5, 8)], "run_id string, user_id string, cluster_id string, cell_lat long, cell_lng long, lat double, lng double, count long, first_seen long, last_seen long")
    made = spark.createDataFrame([("a", "r1", 1, "completed"), ("a", "r2", 2, "running"), ("b", "r1", 1, "completed"), ("b", "r3", 5, "failed"), ("c", "r9", 1, "failed")], "user_id string, run_id string, started_at long, status string")
    visits = spark.createDataFrame([], "user_id string, cluster_id string, duration_sec long, arrival_hour int, departure_hour int, is_weekend boolean, visit_start long, visit_end long")
    got = sorted((r["user_id"], r["cluster_id"], round(r["lat"], 4)) for r in runs.rebuilt_clusters(cells, made, visits).collect())
    assert got == [("a", "C0", 10.0001), ("b", "C0", 10.0003)]
