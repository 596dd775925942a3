"""Streams with own state by transformWithState: processed points, and visits that close by event time.

Both keep a user's pings until the watermark has passed them and then take them in order
of time, so neither the borders of micro-batches nor the order of arrival within the
watermark's delay change a row. State is held by RocksDB, so the session needs
spark.sql.streaming.stateStore.providerClass set to its provider (use_rocksdb()).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators.points import RULES, PointRules
from tracewell.operators.track import FRESH, LATE, MADE, MADE_TYPE, PING, PING_TYPE, STATE_TYPE, Track, formed
from tracewell.operators.visits import SPLIT_S
from tracewell.sources.tables import importable

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACKED_TYPE = f"user_id string, {PING_TYPE}, {MADE_TYPE}"
VISIT_TYPE = "user_id string, cluster_id string, visit_start long, visit_end long, duration_sec long, point_count long, prev_cluster_id string"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return importable(spark)


def plain(value):
    """A pandas value as Python's own; missing ones as None."""
    return None if pd.isna(value) else value.item() if hasattr(value, "item") else value


def rows_of(frame: pd.DataFrame, columns: tuple[str, ...]) -> list[tuple]:
    return [tuple(map(plain, r)) for r in frame[list(columns)].itertuples(index=False, name=None)]


class Points(StatefulProcessor):
    """Pings to processed points. The state is kept in parts: last point, session, trip, anchor, and the pings that wait.

    A ping behind the last point that was taken is flagged and changes nothing. Timers
    take the waiting pings when the watermark has passed them.
    """

    PARTS = {"last": (0, 6), "session": (6, 8), "trip": (8, 11), "anchor": (11, 14)}

    def __init__(self, rules: PointRules = RULES):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = STATE_TYPE.split(", ")
        self.handle = handle
        self.kept = {name: handle.getValueState(name, ", ".join(fields[a:b])) for name, (a, b) in self.PARTS.items()}
        self.waiting = handle.getListState("waiting", PING_TYPE)

    def track(self) -> Track:
        parts = [tuple(self.kept[n].get()) if self.kept[n].exists() else FRESH[a:b] for n, (a, b) in self.PARTS.items()]
        return Track(tuple(v for part in parts for v in part), self.rules)

    def keep(self, track: Track) -> None:
        whole = track.state()
        for name, (a, b) in self.PARTS.items():
            if whole[a:b] == FRESH[a:b]:
                self.kept[name].clear()
            else:
                self.kept[name].update(whole[a:b])

    @staticmethod
    def frame(user: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(user, *r) for r in rows], columns=["user_id", *PING, *MADE]).astype(object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        track, late, times = self.track(), [], []
        for frame in rows:
            wait = []
            for ping in rows_of(frame, PING):
                if ping[0] is None or track.is_late(ping[0], ping[1]):
                    late.append((*ping, *track.flagged()))
                else:
                    wait.append(ping)
                    times.append(ping[0])
            if wait:
                self.waiting.appendList(wait)
        for ts in {t for t in (min(times, default=None), max(times, default=None)) if t is not None}:
            self.handle.registerTimer(ts * 1000 + 1)
        if late:
            yield self.frame(key[0], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((p for p in held if p[0] * 1000 < passed), key=lambda p: p[:2])
        if not ready:
            return
        rest = [p for p in held if p[0] * 1000 >= passed]
        track = self.track()
        made = track.add_all(ready)
        self.keep(track)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(p[0] for p in rest) * 1000 + 1)
        else:
            self.waiting.clear()
        yield self.frame(key[0], made)

    def close(self) -> None:
        pass


def streaming_points(pings: DataFrame, late: str = "1 hour", rules: PointRules = RULES) -> DataFrame:
    """Processed points of a stream of pings (user_id, PING): the rows of one unbroken pass over all of them, however they are split.

    Pings come out when the watermark, `late` behind the newest ping of the stream, has
    passed them. A ping that comes later than that is left out by Spark where the
    watermark has passed it, and flagged LATE where only its own user's state has. Repeated
    raw ids within the delay count once. Pings without a time are flagged.
    """
    importable(pings.sparkSession)
    timed = pings.withColumn("ts", F.timestamp_seconds("gps_ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "raw_id"])
    types = dict(c.split() for c in PING_TYPE.split(", "))
    typed = timed.select("user_id", "ts", *(F.col(c).cast(types[c]).alias(c) for c in PING))
    made = typed.groupBy("user_id").transformWithStateInPandas(Points(rules), TRACKED_TYPE, "Append", "EventTime")
    return formed(made, rules)


class Visits(StatefulProcessor):
    """Runs of pings of one place; a run ends where the place changes or a gap is over split_s, the last one when the watermark has passed that gap.

    A user's state is the open run, the pings that wait, and the place of the run before;
    when `forget_s` have passed without a ping it is all freed.
    """

    def __init__(self, split_s: int = SPLIT_S, forget_s: int = 7 * 86_400):
        self.split_s, self.forget_s = split_s, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "cluster_id string, first long, last long, n long")
        self.before = handle.getValueState("before", "cluster_id string, ended long")
        self.waiting = handle.getListState("waiting", "gps_ts long, raw_id long, cluster_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            found = [r for r in rows_of(frame, ("gps_ts", "raw_id", "cluster_id")) if r[0] is not None and r[2] not in (None, "-1")]
            if found:
                self.waiting.appendList(found)
                for ts in {min(r[0] for r in found), max(r[0] for r in found)}:
                    self.handle.registerTimer(ts * 1000 + 1)
        yield from ()

    def closed(self, user: str, run: tuple) -> tuple:
        """The row of a run that has ended."""
        place, first, last, n = run
        prev = self.before.get()[0] if self.before.exists() else None
        self.before.update((place, last))
        return user, place, first, last, last - first, n, prev

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted(p for p in held if p[0] * 1000 < passed)
        rest = [p for p in held if p[0] * 1000 >= passed]
        run, out = tuple(self.open.get()) if self.open.exists() else None, []
        for ts, _, place in ready:
            if run and (place != run[0] or ts - run[2] > self.split_s):
                out.append(self.closed(key[0], run))
                run = None
            run = (place, run[1], ts, run[3] + 1) if run else (place, ts, ts, 1)
        if run and not rest and (run[2] + self.split_s) * 1000 < passed:
            out.append(self.closed(key[0], run))
            run = None
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(p[0] for p in rest) * 1000 + 1)
        else:
            self.waiting.clear()
        if run:
            self.open.update(run)
            self.handle.registerTimer((run[2] + self.split_s) * 1000 + 1)
        else:
            self.open.clear()
            if self.before.exists():
                last = self.before.get()[1]
                if not rest and (last + self.forget_s) * 1000 < passed:
                    self.before.clear()
                else:
                    self.handle.registerTimer((last + self.forget_s) * 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in VISIT_TYPE.split(", ")]).astype(object)

    def close(self) -> None:
        pass


def streaming_visits(points: DataFrame, late: str = "1 hour", split_s: int = SPLIT_S) -> DataFrame:
    """Runs (user_id, cluster_id, visit_start, visit_end, duration_sec, point_count, prev_cluster_id) of a stream of clustered points, as visits.islands() finds them.

    A run comes out when the next one begins or the watermark has passed its gap; points
    without a place don't count.
    """
    importable(points.sparkSession)
    timed = points.withColumn("ts", F.timestamp_seconds("gps_ts")).withWatermark("ts", late)
    return timed.select("user_id", "ts", "gps_ts", "raw_id", "cluster_id").groupBy("user_id").transformWithStateInPandas(Visits(split_s), VISIT_TYPE, "Append", "EventTime")


__all__ = ["LATE", "Points", "Visits", "streaming_points", "streaming_visits", "use_rocksdb"]
