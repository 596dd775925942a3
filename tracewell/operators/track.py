"""Points processed in order with a state carried from run to run: the same rows as one unbroken pass, for batches and streams.

A user's state is one row: the last point, the session and its trips, since when the
user is slow, and the stay anchor. A run reads the pending pings and the states, sorted
by user and time, and streams each user's pings through the state, so memory doesn't
grow with a user's history. A run's cost is that of its pings, not of what was processed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.geo import EARTH_M
from tracewell.operators.points import RULES, PointRules, process_sessions, processed_columns, with_previous_and_begin
from tracewell.sources.tables import at_rest, importable, pending

PING = ("gps_ts", "raw_id", "lat", "lng", "speed", "heading", "accuracy")
PING_TYPE = "gps_ts long, raw_id long, lat double, lng double, speed double, heading double, accuracy double"
#: The state of a user: columns and their types. No last_raw_id means that nothing was seen yet.
STATE_TYPE = "last_ts long, last_raw_id long, last_lat double, last_lng double, last_speed double, last_heading double, session_ts long, session_raw_id long, trips long, in_trip boolean, slow_since long, anchor_lat double, anchor_lng double, anchor_ts long"
STATE = tuple(c.split()[0] for c in STATE_TYPE.split(", "))
FRESH = (None,) * 8 + (0, False, None, None, None, None)
MADE_TYPE = "activity_type string, session_start long, trip_no long, stay_start_time long, stay_duration long, distance double, time_gap long, speed_change double, heading_change double, calculated_kmph double, anomaly_reason string"
MADE = tuple(c.split()[0] for c in MADE_TYPE.split(", "))
#: Pings of a session that one task folds at most.
LONG = 2_000_000
#: A ping that came after the state had moved beyond it; it changes nothing.
LATE = "LATE"


def valid(lat: float | None, lng: float | None) -> bool:
    return lat is not None and lng is not None and -90 <= lat <= 90 and -180 <= lng <= 180


def metres(lat1, lng1, lat2, lng2) -> float:
    """Great-circle distance; 0 where a point is invalid."""
    if not (valid(lat1, lng1) and valid(lat2, lng2)):
        return 0.0
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


class Track:
    """One user's state; add() takes the next ping and gives the values of MADE."""

    def __init__(self, state: tuple | None = None, rules: PointRules = RULES):
        self.rules = rules
        self.last, self.session, (self.trips, self.in_trip, self.slow_since), self.anchor = self.parts(state or FRESH)

    @staticmethod
    def parts(state: tuple) -> tuple:
        last, session, trip, anchor = state[:6], state[6:8], state[8:11], state[11:]
        return last if last[1] is not None else None, session, trip, anchor if anchor[2] is not None else None

    def state(self) -> tuple:
        return (*(self.last or (None,) * 6), *self.session, self.trips, self.in_trip, self.slow_since, *(self.anchor or (None,) * 3))

    def is_late(self, ts: int | None, raw_id: int) -> bool:
        """Whether a ping lies before the last one by (time, id); pings without a time come first."""
        low = -math.inf
        return self.last is not None and (low if ts is None else ts, raw_id) < (low if self.last[0] is None else self.last[0], self.last[1])

    def anomaly(self, ts, lat, lng, accuracy, gap, distance, kmph) -> str | None:
        r = self.rules
        if not valid(lat, lng):
            return "INVALID_LAT_LNG"
        if ts is None or ts <= 0:
            return "INVALID_TIMESTAMP"
        if accuracy is not None and accuracy > r.max_accuracy_m:
            return "LOW_GPS_ACCURACY"
        if self.last is None:
            return None
        if gap is not None and gap <= 0:
            return "NON_INCREASING_TIMESTAMP"
        if gap is not None and gap < r.reset_gap_s and distance > r.jump_m:
            return "IMPOSSIBLE_DISTANCE_JUMP"
        return "IMPOSSIBLE_SPEED" if kmph > r.max_kmph else None

    def activity(self, speed: float, kmph: float, distance: float, gap: int | None) -> str:
        r = self.rules
        if gap is not None and gap > r.reset_gap_s:
            return "UNKNOWN"
        if speed <= r.stay_kmph and distance <= r.stay_step_m:
            return "STAY"
        if speed > r.drive_kmph or kmph > r.drive_kmph:
            return "DRIVE"
        if r.stay_kmph < speed <= r.walk_kmph and distance > r.walk_step_m and gap is not None and gap <= r.walk_gap_s:
            return "WALK"
        return "UNKNOWN"

    def trip(self, ts: int, speed: float, known: bool) -> int | None:
        """The session's running trip, after this regular ping."""
        r = self.rules
        if speed < r.trip_stop_kmph:
            self.slow_since = ts if self.slow_since is None else self.slow_since
        else:
            self.slow_since = None
        if speed > r.trip_start_kmph and known:
            self.trips += not self.in_trip
            self.in_trip = True
        elif self.slow_since is not None and ts - self.slow_since >= r.trip_stop_s:
            self.in_trip = False
        return self.trips if self.in_trip else None

    def add(self, ts, raw_id, lat, lng, speed, heading, accuracy) -> tuple:
        r, last = self.rules, self.last
        now, turn = speed or 0.0, heading or 0.0
        if last is None:
            gap, distance, kmph, faster, turned = 0, 0.0, 0.0, 0.0, 0.0
        else:
            gap = None if ts is None or last[0] is None else ts - last[0]
            distance = metres(last[2], last[3], lat, lng)
            kmph = distance / gap * 3.6 if gap is not None and gap > 0 else 0.0
            faster = now - (last[4] or 0.0)
            turned = math.fmod(abs(turn - (last[5] or 0.0)), 360)
            turned = 360 - turned if turned > 180 else turned
        reason = self.anomaly(ts, lat, lng, accuracy, gap, distance, kmph)
        if last is None or (gap is not None and gap > r.reset_gap_s):
            self.session, self.trips, self.in_trip, self.slow_since, self.anchor = (ts, raw_id), 0, False, None, None
        activity = "UNKNOWN" if reason else self.activity(now, kmph, distance, gap)
        known = activity != "UNKNOWN"
        trip = None if reason else self.trip(ts, now, known)
        if not known:
            self.anchor = None
        elif self.anchor is None or metres(self.anchor[0], self.anchor[1], lat, lng) > r.stay_radius_m:
            self.anchor = (lat, lng, ts)
        self.last = (ts, raw_id, lat, lng, speed, heading)
        start = self.anchor[2] if self.anchor else None
        return activity, self.session[0], trip, start, ts - start if self.anchor else 0, distance, gap, faster, turned, kmph, reason

    def flagged(self) -> tuple:
        """The values of a late ping."""
        return "UNKNOWN", self.session[0], None, None, 0, 0.0, 0, 0.0, 0.0, 0.0, LATE

    def add_all(self, pings: Iterable[tuple]) -> list[tuple]:
        """(ping, its values) of pings in order; those behind the state are flagged."""
        return [(*p, *(self.flagged() if self.is_late(p[0], p[1]) else self.add(*p))) for p in pings]


def tracked(pings: DataFrame, states: DataFrame | None, rules: PointRules = RULES) -> DataFrame:
    """(user_id, PING, MADE, state): every ping with what the state makes of it, and for each user a row without raw_id that holds the state after all of them.

    One exchange by user and one sort; each partition is read once from front to back.
    """
    importable(pings.sparkSession)
    fields = [(name, kind) for name, kind in (c.split() for c in f"{PING_TYPE}, {STATE_TYPE}".split(", "))]
    null = lambda kind: F.lit(None).cast(kind)
    rows = pings.select("user_id", F.lit(1).alias("_kind"), *(F.col(n).cast(k).alias(n) if n in PING else null(k).alias(n) for n, k in fields))
    if states is not None:
        users = pings.select("user_id").distinct()
        old = states.join(users, "user_id", "left_semi")
        rows = rows.unionByName(old.select("user_id", F.lit(0).alias("_kind"), *(null(k).alias(n) if n in PING else F.col(n) for n, k in fields)))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "_kind", "gps_ts", "raw_id")
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = [("user_id", "string"), *(tuple(c.split()) for c in f"{PING_TYPE}, {MADE_TYPE}, {STATE_TYPE}".split(", "))]
    made_nothing, no_ping, no_state = (None,) * len(MADE), (None,) * len(PING), (None,) * len(STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])

        user, track, begun = None, Track(None, rules), False
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for name, kind, *rest in zip(*columns, strict=True):
                if not begun or name != user:
                    if begun:
                        out.append((user, *no_ping, *made_nothing, *track.state()))
                    user, track, begun = name, Track(None, rules), True
                if kind == 0:
                    track = Track(tuple(rest[len(PING) :]), rules)
                else:
                    ping = tuple(rest[: len(PING)])
                    out.append((user, *ping, *(track.flagged() if track.is_late(ping[0], ping[1]) else track.add(*ping)), *no_state))
            yield batch_of(out)
        if begun:
            yield batch_of([(user, *no_ping, *made_nothing, *track.state())])

    return ordered.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in schema))


def far(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """metres() of arrays of valid points; Arrow's functions are those of libm, as Python's are, numpy's are not."""
    sin, cos = (lambda x, f=f: f(pa.array(x)).to_numpy() for f in (pc.sin, pc.cos))
    a = sin(np.radians(lat2 - lat1) / 2) ** 2 + cos(np.radians(lat1)) * cos(np.radians(lat2)) * sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_M * pc.atan2(pa.array(np.sqrt(a)), pa.array(np.sqrt(1 - a))).to_numpy()


def trip_numbers(ts: np.ndarray, speed: np.ndarray, known: np.ndarray, first: np.ndarray, r: PointRules) -> tuple[np.ndarray, np.ndarray]:
    """(number, whether in it) of the running trip after each of some sessions' regular pings, as Track.trip() gives it."""
    at, before = np.arange(len(ts)), np.zeros(len(ts), bool)
    begin = np.maximum.accumulate(np.where(first, at, 0))
    slow = speed < r.trip_stop_kmph
    before[1:] = slow[:-1]
    since = ts[np.maximum.accumulate(np.where(slow & (first | ~before), at, 0))]
    start = (speed > r.trip_start_kmph) & known
    event = np.where(start, 1, np.where(slow & (ts - since >= r.trip_stop_s), 2, 0))
    last = np.maximum.accumulate(np.where(event > 0, at, -1))
    inside = (last >= begin) & (event[last] == 1)
    before[1:] = inside[:-1]
    starts = (start & (first | ~before)).astype(np.int64)
    upto = np.cumsum(starts)
    return upto - (upto - starts)[begin], inside


def anchors(ts: np.ndarray, lat: np.ndarray, lng: np.ndarray, known: np.ndarray, first: np.ndarray, radius_m: float, steps: int = 64) -> np.ndarray:
    """Time of the stay anchor of each known ping, all unbroken stretches at once; what is longer than `steps` goes on ping by ping."""
    out, at = np.zeros(len(ts), np.int64), np.flatnonzero(known)
    before = np.concatenate([[False], known[:-1]])
    starts = np.flatnonzero(known & (first | ~before))
    length = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    anchor = starts.copy()
    out[starts] = ts[starts]
    for k in range(1, min(steps, int(length.max(initial=0)))):
        n = int(np.searchsorted(-length, -k))
        now, a = starts[:n] + k, anchor[:n]
        anchor[:n] = np.where(far(lat[a], lng[a], lat[now], lng[now]) > radius_m, now, a)
        out[now] = ts[anchor[:n]]
    for s, n, a in zip(starts[length > steps].tolist(), length[length > steps].tolist(), anchor[length > steps].tolist(), strict=True):
        for now in range(s + steps, s + n):
            a = now if metres(float(lat[a]), float(lng[a]), float(lat[now]), float(lng[now])) > radius_m else a
            out[now] = ts[a]
    return out


def whole_sessions(batch: pa.RecordBatch, first: np.ndarray, r: PointRules) -> list[pa.Array]:
    """The values of MADE of whole sessions, one after the other, as Track.add() gives them; positions and times are not null."""
    real = lambda n: batch.column(n).fill_null(0.0).to_numpy()
    whole = lambda n: batch.column(n).fill_null(0).to_numpy()
    lost = batch.column("_raw_id").is_null().to_numpy(zero_copy_only=False)  # a user's first
    ts, lat, lng, now, turn = whole("gps_ts"), real("lat"), real("lng"), real("speed"), real("heading")
    lat0, lng0 = real("_lat"), real("_lng")
    ok = lambda y, x: (y >= -90) & (y <= 90) & (x >= -180) & (x <= 180)
    gap, distance, valid_now = np.where(lost, 0, ts - whole("_gps_ts")), np.zeros(len(ts)), ok(lat, lng)
    both = np.flatnonzero(valid_now & ok(lat0, lng0) & ~lost)
    distance[both] = far(lat0[both], lng0[both], lat[both], lng[both])
    kmph = np.where(gap > 0, distance / np.maximum(gap, 1) * 3.6, 0.0)
    faster, turned = np.where(lost, 0.0, now - real("_speed")), np.where(lost, 0.0, np.fmod(np.abs(turn - real("_heading")), 360))
    turned = np.where(turned > 180, 360 - turned, turned)
    rules = (~valid_now, ts <= 0, real("accuracy") > r.max_accuracy_m, lost, gap <= 0, (gap < r.reset_gap_s) & (distance > r.jump_m), kmph > r.max_kmph)
    reason = np.select(rules, (0, 1, 2, -1, 3, 4, 5), -1)
    regular = reason < 0
    stay = (now <= r.stay_kmph) & (distance <= r.stay_step_m)
    drive = (now > r.drive_kmph) | (kmph > r.drive_kmph)
    walk = (now > r.stay_kmph) & (now <= r.walk_kmph) & (distance > r.walk_step_m) & (gap <= r.walk_gap_s)
    activity = np.select((~regular | (gap > r.reset_gap_s), stay, drive, walk), (0, 1, 2, 3), 0)
    known = activity > 0
    trip, inside, at = np.zeros(len(ts), np.int64), np.zeros(len(ts), bool), np.flatnonzero(regular)
    session = np.cumsum(first)
    if len(at):
        begins = np.concatenate([[True], session[at][1:] != session[at][:-1]])
        trip[at], inside[at] = trip_numbers(ts[at], now[at], known[at], begins, r)
    anchor = anchors(ts, lat, lng, known, first, r.stay_radius_m)
    texts = lambda codes, names: pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32(), mask=codes < 0), names).cast(pa.string())
    return [
        texts(activity, ["UNKNOWN", "STAY", "DRIVE", "WALK"]), pa.array(ts[first][session - 1]), pa.array(trip, mask=~inside), pa.array(anchor, mask=~known), pa.array(np.where(known, ts - anchor, 0)),
        *map(pa.array, (distance, gap, faster, turned, kmph)), texts(reason, ["INVALID_LAT_LNG", "INVALID_TIMESTAMP", "LOW_GPS_ACCURACY", "NON_INCREASING_TIMESTAMP", "IMPOSSIBLE_DISTANCE_JUMP", "IMPOSSIBLE_SPEED"]),
    ]


def by_sessions(begun: DataFrame, rules: PointRules = RULES) -> DataFrame:
    """(user_id, PING, MADE) of pings with their `prev` and `session`: sessions are folded each for itself, from the last point before them.

    The sessions that lie within a batch are folded all at once; the first and the last of
    a batch, which may go on in others, and those with missing positions or times go ping by ping.
    """
    importable(begun.sparkSession)
    fields = [tuple(c.split()) for c in f"{PING_TYPE}, {MADE_TYPE}".split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    before = ("gps_ts", "raw_id", "lat", "lng", "speed", "heading")
    types = dict(fields)
    rows = begun.select("user_id", F.col("session.raw_id").alias("_session"), *(F.col(n).cast(types[n]).alias(n) for n in PING), *(F.col(f"prev.{n}").cast(types[n]).alias(f"_{n}") for n in before))
    ordered = rows.repartition("user_id", "_session").sortWithinPartitions("user_id", "_session", "gps_ts", "raw_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_of = lambda batch, made: pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2 : 2 + len(PING)], *made], names=["user_id", *PING, *MADE])
        key, track = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in batch.columns[:2]]
            first = np.concatenate([[True], (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])])
            number = np.cumsum(first) - 1
            null = lambda c, b=batch: b.column(c).is_null().to_numpy(zero_copy_only=False)
            alone = np.zeros(number[-1] + 1, bool)
            odd = null("gps_ts") | null("raw_id") | null("lat") | null("lng") | (~null("_raw_id") & (null("_gps_ts") | null("_lat") | null("_lng")))
            alone[number[odd]] = alone[0] = alone[-1] = True
            single = alone[number]
            if not single.all():
                some = batch.filter(pa.array(~single))
                yield made_of(some, whole_sessions(some, first[~single], rules))
            some = batch.filter(pa.array(single))
            users, sessions, *rest = (c.to_pylist() for c in some.columns)
            pings, prev = zip(*rest[: len(PING)], strict=True), zip(*rest[len(PING) :], strict=True)
            made = []
            for user, session, ping, last in zip(users, sessions, pings, prev, strict=True):
                if track is None or key != (user, session):
                    key, track = (user, session), Track((*last, *FRESH[6:]), rules)
                made.append(track.add(*ping))
            yield made_of(some, [pa.array(c, kinds[types[n]]) for c, n in zip(zip(*made, strict=True), MADE, strict=True)])

    return ordered.mapInArrow(run, "user_id string, " + ", ".join(f"{n} {k}" for n, k in fields))


def process(points: DataFrame, rules: PointRules = RULES, long: int = LONG) -> DataFrame:
    """Processed points: every raw ping with its features, flags and ids. Repeated raw ids are taken once.

    A gap resets all but the last point, so sessions are independent: one exchange by
    (user, day) finds them, one by session folds them in order. Sessions of over `long`
    pings, which no gap ends, go through the windows of points.process(), which spread
    one session over its days.
    """
    after_gap = lambda prev, now: now["gps_ts"] - prev["gps_ts"] > rules.reset_gap_s
    begun = with_previous_and_begin(points.dropDuplicates(["user_id", "raw_id"]), after_gap, "session")
    key = ["user_id", F.col("session.raw_id").alias("_session")]
    endless = at_rest(begun.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > long).select("user_id", "_session"), "endless")
    if endless.isEmpty():
        return formed(by_sessions(begun, rules), rules)
    marked = begun.withColumn("_session", F.col("session.raw_id"))
    short = formed(by_sessions(marked.join(endless, ["user_id", "_session"], "left_anti"), rules), rules)
    return short.unionByName(process_sessions(marked.join(endless, ["user_id", "_session"], "left_semi").drop("_session"), rules))


def resume(raw: DataFrame, processed: DataFrame | None, states: DataFrame | None, rules: PointRules = RULES) -> tuple[DataFrame, DataFrame]:
    """(processed points of the pings that aren't in `processed` yet, the new states of all users).

    Repeated raw ids are taken once; pings before a user's last processed one are flagged
    LATE. Without pending pings the first is empty and the states stay as they are.
    """
    todo = pending(raw, processed) if processed is not None else raw
    done = at_rest(tracked(todo.dropDuplicates(["raw_id"]), states, rules), "tracked")
    new = done.where("raw_id is null").select("user_id", *STATE)
    if states is not None:
        new = new.unionByName(states.join(new.select("user_id"), "user_id", "left_anti").select("user_id", *STATE))
    return formed(done.where("raw_id is not null"), rules), new


def formed(done: DataFrame, rules: PointRules = RULES) -> DataFrame:
    """Processed points, as points.process() gives them, of pings with the values of MADE."""
    p = done.withColumns({"is_anomaly": F.col("anomaly_reason").isNotNull(), "session": F.struct(F.col("session_start").alias("gps_ts")), "is_stay_point": F.col("stay_duration") >= rules.stay_min_s})
    return processed_columns(p.withColumn("activity_confidence", F.when(F.col("activity_type") == "UNKNOWN", 0.0).otherwise(1.0)))
