"""Carried state, streams, versioned tables, as-of and nearest joins against one pass, brute force and failures in between."""

import glob
import math
import os
import random
import shutil
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.functions import geo
from tracewell.operators import asof, near, points, track, visits
from tracewell.sources import versioned
from tracewell.sources.tables import at_rest
from tracewell.streaming import state

PINGS = "raw_id long, user_id string, gps_ts long, lat double, lng double, speed double, heading double, accuracy double"


def random_pings(seed, users=5, n=160, odd=True):
    """Walks with stays, drives, gaps, jumps and, if odd, missing or impossible values."""
    rng, rows = random.Random(seed), []
    for u in range(users):
        ts, lat, lng = 1_704_000_000 + rng.randrange(200_000), 28.5, 77.2
        for _ in range(n if u else 2 * n):
            pace = rng.choice([0, 0, 0, 1, 4, 30])
            for _ in range(rng.randint(1, 12)):
                ts += rng.choice([0, 5, 30, 30, 59, 60, 61, 400]) if rng.random() < 0.3 else 30
                lat, lng = lat + pace * rng.uniform(0, 4e-5), lng + rng.uniform(-1, 1) * (1e-5 + pace * 2e-5)
                rows.append([len(rows), f"u{u}", ts, lat, lng, float(pace), rng.uniform(0, 360), 8.0])
        rows = rows[: (u + 1) * 3 * n]
    if odd:
        for r in rng.sample(rows, len(rows) // 15):
            k = rng.choice([3, 4, 5, 6, 7])
            r[k] = rng.choice([None, 500.0, 0.0]) if k != 5 else None
        for r in rng.sample(rows, 4):
            r[2] = None
    return rows


def same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("long", [2_000_000, 20])
def test_folded_sessions_are_those_of_windows(spark, long):
    pings = at_rest(spark.createDataFrame(random_pings(1), PINGS).repartition(3), "pings")
    same(at_rest(track.process(pings, long=long), "a"), at_rest(points.process(pings), "b"))
    assert track.process(pings.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [7, 300])
def test_sessions_over_batches_are_those_of_windows(spark, rows):
    pings = at_rest(spark.createDataFrame(random_pings(6), PINGS).repartition(3), "pings")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    try:
        spark.conf.set(name, str(rows))
        same(at_rest(track.process(pings), "a"), at_rest(points.process(pings), "b"))
    finally:
        spark.conf.set(name, kept)


def test_sessions_of_a_batch_are_folded_as_single_pings():
    rng, rows, first = random.Random(7), [], []
    for s in range(300):
        ts, lat, mode = 1_700_000_000 + s * 10_000, 28.5 + rng.random(), rng.random()
        prev = None if s % 7 == 0 else (ts - rng.choice([61, 500]), -s - 1, lat, 77.2, rng.choice([None, 1.0]), rng.choice([None, 350.0]))
        for k in range(rng.choice([1, 2, 20, 60, 200])):
            mode = rng.random() if rng.random() < 0.05 else mode
            ts += rng.choice([0, 1, 20, 30, 30, 30, 60, -3]) if k else 0
            lat += rng.gauss(0, 1e-5 if mode < 0.5 else 3e-3 if mode > 0.95 else 1e-3)
            at = lat if rng.random() > 0.02 else rng.choice([95.0, math.nan, lat + 0.5])
            ping = (ts, s * 1000 + k, at, 77.2, rng.choice([0.2, 0.5]) if mode < 0.5 else rng.choice([None, 0.0, 0.4, 0.9, 5.5, 30.0]), rng.choice([None, 10.0, 350.0]), rng.choice([None, 8.0, 8.0, 8.0, 150.0]))
            rows.append((ping, prev))
            first.append(k == 0)
            prev = ping[:6]
    made = []
    for (ping, prev), new in zip(rows, first, strict=True):
        one = track.Track((*(prev or (None,) * 6), *track.FRESH[6:])) if new else one
        made.append(one.add(*ping))
    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 5]
    columns = [pa.array(c, k) for side in ([p for p, _ in rows], [q or (None,) * 6 for _, q in rows]) for c, k in zip(zip(*side, strict=True), kinds, strict=False)]
    names = [*track.PING, *(f"_{n}" for n in ("gps_ts", "raw_id", "lat", "lng", "speed", "heading"))]
    got = track.whole_sessions(pa.RecordBatch.from_arrays(columns, names=names), np.array(first), track.RULES)
    assert repr([c.to_pylist() for c in got]) == repr([list(c) for c in zip(*made, strict=True)])  # repr: NaN is NaN


def test_what_makes_pings_runs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [r for r in random_pings(8) if r[2] is not None]
    track.process(spark.createDataFrame(rows, PINGS).mapInArrow(seen, PINGS)).collect()
    assert read.value == len(rows)


def test_islands_take_few_exchanges(spark):
    held = at_rest(spark.createDataFrame([(k, f"u{k % 3}", 1_704_000_000 + 500 * k, f"C{k // 50}") for k in range(600)], "raw_id long, user_id string, gps_ts long, cluster_id string"), "held")
    runs = visits.islands(held)
    assert len(runs.collect()) == 36
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 4


def test_resumed_runs_are_one_pass(spark):
    rows = [r for r in random_pings(2) if r[2] is not None]
    pings = at_rest(spark.createDataFrame(rows, PINGS), "pings")
    whole = at_rest(track.process(pings), "whole")
    rng, cuts = random.Random(3), sorted({r[2] for r in rows})
    cuts = sorted(rng.sample(cuts, 3)) + [1 << 40]
    done = states = None
    for low, high in zip([0, *cuts], cuts, strict=False):
        seen = pings.where((F.col("gps_ts") >= low) & (F.col("gps_ts") < high))
        made, states = track.resume(seen.unionByName(seen.limit(3)), done, states)
        made, states = at_rest(made, "made"), at_rest(states, "states")
        done = made if done is None else at_rest(done.unionByName(made), "done")
    same(done, whole)
    again, unchanged = track.resume(pings, done, states)
    assert again.count() == 0
    same(unchanged, states)
    late = spark.createDataFrame([(10**6, "u1", 1_704_000_001, 28.5, 77.2, 1.0, 0.0, 5.0), (10**6 + 1, "new", 5, 28.5, 77.2, None, None, None)], PINGS)
    made, after = track.resume(late, done, states)
    assert {(r["raw_id"], r["anomaly_reason"]) for r in made.collect()} == {(10**6, track.LATE), (10**6 + 1, None)}
    same(after.where("user_id <> 'new'"), states)


def feed(frame, folder, k):
    """Writes one file of a stream's source."""
    frame.coalesce(1).write.parquet(f"{folder}/tmp{k}")
    os.makedirs(f"{folder}/src", exist_ok=True)
    time.sleep(0.02)
    shutil.move(glob.glob(f"{folder}/tmp{k}/part*")[0], f"{folder}/src/{k:03d}.parquet")


def run_stream(spark, schema, build, folder, late):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/src")
    query = build(source, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_streams_are_one_pass(spark, tmp_path):
    """Pings in random splits, out of order within the delay, repeated, with a restart in between."""
    state.use_rocksdb(spark)
    rows = [r for r in random_pings(4, users=3, n=40) if r[2] is not None and r[2] > 0]
    pings = at_rest(spark.createDataFrame(rows, PINGS), "pings")
    begin = min(r[2] for r in rows)
    parts = [pings.where(f"pmod(hash(raw_id), 2) + 2 * floor((gps_ts - {begin}) / 150000) = {k}") for k in range(4)]
    end = spark.createDataFrame([(-1, "end", 4_000_000_000, 1.0, 1.0, 0.0, 0.0, 1.0)], PINGS)
    folder = str(tmp_path)
    for k, part in enumerate([parts[0], parts[1].unionByName(parts[0].limit(5)), *parts[2:], pings.where(f"gps_ts >= {begin} + 300000"), end]):
        feed(part, folder, k)
        if k in (1, 3):
            run_stream(spark, pings.schema, state.streaming_points, folder, "3 days")
    run_stream(spark, pings.schema, state.streaming_points, folder, "3 days")
    same(spark.read.parquet(f"{folder}/out").where("raw_id >= 0"), at_rest(track.process(pings), "whole"))


def test_stream_flags_what_is_late_for_its_user(spark):
    """The processor itself, with its state held in lists."""
    made = track.Track()
    first = made.add_all([(100, 1, 1.0, 1.0, 0.0, 0.0, 5.0), (130, 2, 1.0, 1.0, 0.0, 0.0, 5.0)])
    before = made.state()
    late = made.add_all([(110, 3, 1.0, 1.0, 9.0, 0.0, 5.0)])
    assert late[0][-1] == track.LATE and made.state() == before and first[1][-1] is None
    assert track.Track(before).state() == before


def test_stream_of_visits(spark, tmp_path):
    state.use_rocksdb(spark)
    rng, rows = random.Random(6), []
    for u in range(3):
        ts = 1_704_000_000
        for _ in range(60):
            place = rng.choice(["C0", "C1", "C2", None, "-1"])
            for _ in range(rng.randint(1, 5)):
                ts += rng.choice([30, 600, 1800, 1801, 4000])
                rows.append((len(rows), f"u{u}", ts, place))
    schema = "raw_id long, user_id string, gps_ts long, cluster_id string"
    held = at_rest(spark.createDataFrame(rows, schema), "points")
    folder = str(tmp_path)
    for k in range(3):
        feed(held.where(f"pmod(hash(raw_id), 2) + 2 * floor((gps_ts - 1704000000) / 200000) in ({2 * k}, {2 * k + 1})" if k else "gps_ts < 1704200000"), folder, k)
        if k == 1:
            run_stream(spark, held.schema, state.streaming_visits, folder, "2 days")
    # two late points of another user move the watermark: past the last gaps, then past what is remembered
    for k, ts in ((3, 1_720_000_000), (4, 1_730_000_000)):
        feed(spark.createDataFrame([(-k, "end", ts, "C9")], schema), folder, k)
    query = run_stream(spark, held.schema, state.streaming_visits, folder, "2 days")
    got = spark.read.parquet(f"{folder}/out").where("user_id <> 'end'")
    columns = ["user_id", "cluster_id", "visit_start", "visit_end", "duration_sec", "point_count", "prev_cluster_id"]
    same(got.select(columns), visits.islands(held).select(columns))
    held_rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held_rows and held_rows[-1] <= 6  # nothing of the three users is left


@pytest.fixture
def store(spark, tmp_path):
    return versioned.VersionedTables(spark, f"file://{tmp_path}/store", buckets=4)


def test_versions(spark, store, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "k long, user_id string, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert store.read("t") is None
    assert store.commit([("t", "append", frame([(i, f"u{i % 3}", "a") for i in range(10)]), ["k"])]) == {"t": {"created": 10, "updated": 0, "removed": 0}}
    old = store.read("t")
    assert store.commit([("t", "upsert", frame([(3, "u0", "b"), (11, "u9", "b")]), ["k"])])["t"] == {"created": 1, "updated": 1, "removed": 0}
    assert rows(store.read("t")) == sorted([(i, f"u{i % 3}", "b" if i == 3 else "a") for i in range(10)] + [(11, "u9", "b")])
    assert rows(old) == rows(store.read("t", version=1)) == [(i, f"u{i % 3}", "a") for i in range(10)]
    untouched = set(map(str, range(4))) - {str(r[0]) for r in frame([(3, "", ""), (11, "", "")]).select(store._bucket(["k"])).collect()}
    first, second = (store.manifest(v)["tables"]["t"]["buckets"] for v in (1, 2))
    assert all(first.get(b) == second.get(b) for b in untouched)

    # a writer that dies before its manifest is whole, or in the middle of writing it
    monkeypatch.setattr(store, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        store.commit([("t", "replace", frame([(1, "x", "x")]), ["k"])])
    monkeypatch.undo()
    with open(store.path.removeprefix("file://") + "/manifest/000000000003.json", "w") as f:
        f.write('{"version": 3, "tables": {')
    assert len(rows(store.read("t"))) == 11
    assert store.commit([("t", "append", frame([(20, "u1", "c")]), ["k"])])["t"]["created"] == 1
    assert store.manifest()["version"] == 4 and len(rows(store.read("t"))) == 12

    # another writer in between
    publish = store._publish
    monkeypatch.setattr(store, "_publish", lambda m: (publish(m | {"batches": {"other": 1}}), publish(m)))
    with pytest.raises(versioned.Conflict):
        store.commit([("t", "append", frame([(21, "u1", "c")]), ["k"])])
    monkeypatch.undo()
    by_user = [("s", "users", frame([(1, "u0", "n"), (2, "u0", "n")]), ["user_id"])]
    store.commit([("s", "append", frame([(i, f"u{i % 3}", "a") for i in range(9)]), ["user_id"])])
    assert store.commit(by_user)["s"] == {"created": 2, "updated": 0, "removed": 3}
    assert rows(store.read("s").where("user_id = 'u0'")) == [(1, "u0", "n"), (2, "u0", "n")] and store.read("s").count() == 8
    store.vacuum(keep=1)
    assert len(glob.glob(store.path.removeprefix("file://") + "/manifest/*.json")) == 1 and store.read("s").count() == 8
    store.commit([("s", "replace", frame([]), ["user_id"])])
    assert store.read("s").count() == 0


def test_ledger_sink_writes_each_batch_once(spark, store, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "raw_id long, v long")
    sink = versioned.ledger_sink(store, "points", ["raw_id"], "ingest")
    batches = [[(1, 1), (2, 1), (2, 1)], [(2, 2), (3, 2)], [(4, 3)]]
    sink(frame(batches[0]), 0)
    publish = versioned.VersionedTables._publish
    monkeypatch.setattr(versioned.VersionedTables, "_publish", lambda self, m: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        sink(frame(batches[1]), 1)
    monkeypatch.setattr(versioned.VersionedTables, "_publish", publish)
    assert store.committed("ingest") == 0 and store.read("points").count() == 2
    for k, batch in ((1, batches[1]), (0, batches[0]), (1, batches[1]), (2, batches[2]), (2, [(9, 9)])):
        sink(frame(batch), k)
    assert sorted(map(tuple, store.read("points").collect())) == [(1, 1), (2, 2), (3, 2), (4, 3)] and store.committed("ingest") == 2


def test_stream_into_the_ledger(spark, store, tmp_path):
    folder = str(tmp_path / "feed")
    for k in range(3):
        feed(spark.createDataFrame([(10 * k + i, k) for i in range(5)] + [(0, k)], "raw_id long, v long"), folder, k)
    for _ in range(2):  # the second time with a new checkpoint: all batches are given again
        source = spark.readStream.schema("raw_id long, v long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/src")
        query = source.writeStream.foreachBatch(versioned.ledger_sink(store, "points", ["raw_id"], "feed")).option("checkpointLocation", f"{folder}/check{_}").trigger(availableNow=True).start()
        query.awaitTermination()
    got = store.read("points").collect()
    assert len(got) == 15 and {r["raw_id"]: r["v"] for r in got}[0] == 2


def test_pending_runs_on_stored_tables(spark, store):
    rows = [r for r in random_pings(7, users=3, n=30) if r[2] is not None]
    pings = at_rest(spark.createDataFrame(rows, PINGS), "pings")
    middle = sorted(r[2] for r in rows)[len(rows) // 2]
    assert versioned.process_pending(store, pings.where(F.col("gps_ts") < middle))["processed"]["created"] > 0
    assert versioned.process_pending(store, pings.where(F.col("gps_ts") < middle)) == {}
    versioned.process_pending(store, pings)
    same(store.read("processed"), at_rest(track.process(pings), "whole"))
    version = store.manifest()["version"]
    assert versioned.process_pending(store, pings) == {} and store.manifest()["version"] == version


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_as_of_matches_brute_force(spark, direction):
    rng = random.Random(9)
    users = ["a"] * 6 + ["b", "c", None]
    lefts = [(i, rng.choice(users), rng.choice([None, *range(0, 3000, 7)])) for i in range(300)]
    rights = [(rng.choice(users), rng.choice([None, *range(0, 3000, 13)]), rng.choice([None, 1, 2, 3])) for _ in range(250)]
    left, right = spark.createDataFrame(lefts, "id int, user_id string, ts long"), spark.createDataFrame(rights, "user_id string, ts long, v int")
    for within in (None, 40):
        got = {r["id"]: (r["r_ts"], r["r_v"]) for r in asof.as_of(left, right, ["user_id"], "ts", "ts", {"ts": "r_ts", "v": "r_v"}, direction, within, bucket_s=100).collect()}
        for i, user, ts in lefts:
            fits = [(t, v is not None, v) for u, t, v in rights if u == user and user is not None and None not in (t, ts) and (t <= ts if direction == "backward" else t >= ts) and (within is None or abs(t - ts) <= within)]
            key = lambda x: (x[0], x[1], x[2] or 0)
            best = (max if direction == "backward" else min)(fits, key=key, default=(None, 0, None))
            assert got[i] == (best[0], best[2]), (i, user, ts)
    assert asof.as_of(left.limit(0), right, ["user_id"], "ts", "ts", {"v": "r"}).count() == 0
    assert asof.as_of(left, right.limit(0), ["user_id"], "ts", "ts", {"v": "r"}).where("r is null").count() == 300


def test_nearest_places_match_brute_force(spark):
    rng = random.Random(10)
    centres = [(28.5, 77.2), (89.99, 10.0), (-89.995, -170.0), (0.0, 179.9995), (0.0, -179.9995), (60.0, 0.0)]
    place = [(f"p{i:05d}", "X", a + rng.uniform(-3e-3, 3e-3), b + rng.uniform(-3e-3, 3e-3)) for i in range(3000) for a, b in [rng.choice(centres)]]
    place = [(n, k, max(-90.0, min(90.0, a)), (b + 180) % 360 - 180) for n, k, a, b in place] + [("q", "Y", 28.5, 77.2), ("b", "Z", 28.5, 77.2), (None, "Z", 28.5, 77.2), ("bad", "Z", None, 77.2)]
    spot = [(i, max(-90.0, min(90.0, a + rng.uniform(-3e-3, 3e-3))), (b + rng.uniform(-3e-3, 3e-3) + 180) % 360 - 180) for i in range(300) for a, b in [rng.choice(centres)]] + [(900, 28.5, 77.2), (901, None, 1.0), (902, 28.5, 77.2), (903, 10.0, 10.0)]
    got = {r["id"]: r for r in near.nearest_places(spark.createDataFrame(spot, "id int, lat double, lng double"), spark.createDataFrame(place, "label string, place_type string, lat double, lng double"), first_m=20.0).collect()}
    assert len(got) == len(spot)
    for i, lat, lng in spot:
        best = min(((track.metres(lat, lng, a, b), n, k) for n, k, a, b in place if n and a is not None), default=None) if lat is not None else None
        r = got[i]
        if best and best[0] <= 180:
            assert (r["known_place"], r["known_type"]) == best[1:] and math.isclose(r["known_distance"], best[0], abs_tol=0.006)
        else:
            assert r["known_place"] is None
    assert got[900]["known_place"] == "b"


def test_polylines(spark):
    rng = random.Random(11)
    line = [(1, k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(20_000)] + [(2, 0, 0.0, 0.0), (2, 1, -0.00001, 0.00001), (3, 0, 90.0, -180.0)]
    frame = spark.createDataFrame(line, "line int, k int, lat double, lng double")
    coded = at_rest(geo.encode_polylines(frame, ["line"], ["k"]), "lines")
    assert coded.where("line = 2").first()["polyline"] == "??@A"
    got = coded.select("line", F.posexplode(geo.decode_polyline(F.col("polyline"))).alias("k", "p")).select("line", "k", "p.lat", "p.lng").collect()
    want = {(i, k): (math.floor(a * 1e5 + 0.5) / 1e5, math.floor(b * 1e5 + 0.5) / 1e5) for i, k, a, b in line}
    assert {(r["line"], r["k"]): (r["lat"], r["lng"]) for r in got} == want
    odd = spark.createDataFrame([(None,), ("",), ("_p~iF~ps|U_ulL",), ("_p~iF~ps|U_",), ("?",), ("_p~iF~ps|U",)], "t string").select(geo.decode_polyline(F.col("t")).alias("p")).collect()
    one = [Row(lat=38.5, lng=-120.2)]
    assert [r["p"] for r in odd] == [None, [], one, one, [], one]
    assert spark.range(0).select(geo.decode_polyline(F.lit("??"))).count() == 0
    begin = time.time()
    deep = geo.polyline_points(__import__("pyarrow").array(["_p~iF~ps|U" * 100_000]))
    assert len(deep[0]) == 100_000 and time.time() - begin < 5


def test_broadcasts_go_by_the_size_of_rows(spark):
    from tracewell.operators import clusters
    from tracewell.plans import queries

    kept = {name: spark.conf.get(name, None) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        queries.stage(spark, "/root/testdata/sf0.001", "gps")
        labelled = at_rest(spark.range(400_000).selectExpr("concat('U', id div 40) as user_id", "id % 40 as cell_lat", "id % 7 as cell_lng", "'C0' as cluster_id"), "wide_rows")
        assert labelled._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10 << 20  # its files are small, its rows are not
        stays = spark.range(2000).selectExpr("concat('U', id div 4) as user_id", "id % 40 * 0.0001D as lat", "id % 7 * 0.0001D as lng", "true as is_stay_point", "false as is_anomaly")
        joined = clusters.clustered_points(stays, labelled)
        assert len(joined.collect()) == 2000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        few = at_rest(stays.limit(10), "few")
        small = labelled.join(few.select("user_id"), "user_id", "left_semi")
        assert small.collect() and "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_broadcasts_of_stage_tables_are_small(spark):
    from tracewell.operators import clusters
    from tracewell.sources.tables import measured_broadcasts

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    kept = {name: spark.conf.get(name, None) for name in names}
    try:
        spark.conf.set(names[0], "10MB")
        spark.conf.unset(names[1])
        measured_broadcasts(spark)
        labelled = at_rest(spark.range(80_000).selectExpr("concat('U', id div 40) as user_id", "id % 40 as cell_lat", "id % 7 as cell_lng", "'C0' as cluster_id"), "some_rows")
        stays = spark.range(2000).selectExpr("concat('U', id div 4) as user_id", "id % 40 * 0.0001D as lat", "id % 7 * 0.0001D as lng", "true as is_stay_point", "false as is_anomaly")
        joined = clusters.clustered_points(stays, labelled)
        assert len(joined.collect()) == 2000
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()  # about 5 MB of rows
        spark.conf.set(names[0], "256k")
        spark.conf.unset(names[1])
        measured_broadcasts(spark)
        assert spark.conf.get(names[1]) == str(256 << 10)  # a smaller limit of the session stays
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_components_of_stars_take_no_round(spark, monkeypatch):
    from tracewell.operators import components

    written = []
    monkeypatch.setattr(components, "at_rest", lambda df, name, **more: written.append(name) or at_rest(df, name, **more))
    stars = [(5, 1), (1, 6), (7, 2), (6, 1), (3, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 6: 1, 2: 2, 7: 2} and written == ["edges", "components"]
    chain = [(9, 4), (4, 8), (8, 0), (30, 20), (20, 10)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {0: 0, 4: 0, 8: 0, 9: 0, 10: 10, 20: 10, 30: 10}


def test_stage_tables_are_made_without_broadcasts(spark):
    from tracewell.sources.tables import no_broadcasts

    name = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    kept = {n: spark.conf.get(n, None) for n in (name, "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        few = at_rest(spark.range(10), "few")
        for limit, inside in (("1MB", False), ("1MB", True)):
            spark.conf.set(name, limit)
            joined = few.join(few.withColumnRenamed("id", "other"), F.col("id") == F.col("other"))
            if inside:
                with no_broadcasts(spark):
                    assert len(joined.collect()) == 10
            else:
                assert len(joined.collect()) == 10
            assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) != inside
            assert spark.conf.get(name) == limit
    finally:
        for n, value in kept.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
