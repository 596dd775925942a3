"""Seeded test data: user profiles, day schedules as pings, and straight journeys. Everything comes from ranges, nothing from the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import geo, timefn

#: Centres of the cities that users are dealt to in turn.
CITIES = (("Delhi", 28.6139, 77.209), ("Mumbai", 19.076, 72.8777), ("Bengaluru", 12.9716, 77.5946), ("Pune", 18.5204, 73.8567), ("Hyderabad", 17.385, 78.4867), ("Chennai", 13.0827, 80.2707))
#: (place, first minute of the day, minutes there) of weekdays and weekends.
WEEKDAY = (("home", 0, 510), ("office", 550, 500), ("gym", 1070, 70), ("home", 1160, 280))
WEEKEND = (("home", 0, 600), ("market", 630, 120), ("home", 780, 660))


def users(spark: SparkSession, n: int) -> DataFrame:
    """(user_id, city, lat, lng, device_type) of n users."""
    cities = F.array(*(F.struct(F.lit(c).alias("city"), F.lit(a).alias("lat"), F.lit(b).alias("lng")) for c, a, b in CITIES))
    q = spark.range(n).withColumn("c", F.element_at(cities, (F.col("id") % len(CITIES)).cast("int") + 1))
    return q.select(F.concat(F.lit("U"), F.lpad((F.col("id") + 1).cast("string"), 3, "0")).alias("user_id"), "c.city", "c.lat", "c.lng", F.when(F.col("id") % 2 == 0, "android").otherwise("ios").alias("device_type"))


def pings(profiles: DataFrame, first_day: int, days: int, every_s: int = 30, seed: int = 42) -> DataFrame:
    """(user_id, gps_ts, lat, lng, speed, accuracy, time_of_day): each user's pings at the places of each day's schedule, with seeded noise.

    first_day counts days since 1970 in local time. One row of the schedule explodes into
    its own pings, so the work spreads over users and days.
    """
    plan = lambda rows: F.array(*(F.struct(F.lit(p).alias("place"), F.lit(m).alias("minute"), F.lit(n).alias("minutes")) for p, m, n in rows))
    day = profiles.withColumn("day", F.explode(F.sequence(F.lit(first_day), F.lit(first_day + days - 1))))
    weekend = F.pmod(F.col("day"), F.lit(7)).isin(2, 3)
    at = day.withColumn("s", F.explode(F.when(weekend, plan(WEEKEND)).otherwise(plan(WEEKDAY))))
    away = F.pmod(F.xxhash64("user_id", "s.place"), F.lit(1000)) / 1000
    spot = at.withColumn("p", geo.move_point(F.col("lat"), F.col("lng"), away * 360, away * 5000 + 500))
    start = F.col("day") * 86_400 - timefn.OFFSET + F.col("s.minute") * 60
    q = spot.withColumn("gps_ts", F.explode(F.sequence(start.cast("long"), (start + F.col("s.minutes") * 60 - every_s).cast("long"), F.lit(every_s).cast("long"))))
    noise = lambda salt: (F.pmod(F.xxhash64("user_id", "gps_ts", F.lit(seed), F.lit(salt)), F.lit(2001)) - 1000) / 1000 * 1.5e-5
    return q.select("user_id", "gps_ts", (F.col("p.lat") + noise(1)).alias("lat"), (F.col("p.lng") + noise(2)).alias("lng"), F.lit(0.5).alias("speed"), F.lit(8.0).alias("accuracy"), timefn.time_of_day(timefn.hour(F.col("gps_ts")), "ping").alias("time_of_day"))


def journey(spark: SparkSession, start: tuple[float, float], end: tuple[float, float], kmph: float, stop_s: int, begin_ts: int, every_s: int = 5) -> DataFrame:
    """(phase, gps_ts, lat, lng): stop, go, stop, return along a straight line at constant speed."""
    line = geo.haversine_m(*(F.lit(float(v)) for v in (*start, *end)))
    drive = F.greatest(F.lit(1), F.ceil(line / (kmph / 3.6) / every_s)).cast("int")
    rest = max(1, stop_s // every_s)
    n = spark.range(1).select(drive.alias("drive"))
    phases = [("stop", F.lit(rest), 0.0, 0.0), ("go", F.col("drive"), 0.0, 1.0), ("stop", F.lit(rest), 1.0, 1.0), ("return", F.col("drive"), 1.0, 0.0)]
    parts = n.select("drive", F.posexplode(F.array(*(F.struct(F.lit(p).alias("phase"), k.alias("steps"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, k, a, b in phases))).alias("no", "x"))
    offset = F.when(F.col("no") == 0, 0).when(F.col("no") == 1, rest).when(F.col("no") == 2, rest + F.col("drive")).otherwise(2 * rest + F.col("drive"))
    steps = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("x.steps") - 1)))
    f = F.col("x.a") + (F.col("x.b") - F.col("x.a")) * F.col("k") / F.col("x.steps")
    return steps.select("x.phase", (begin_ts + (offset + F.col("k")) * every_s).cast("long").alias("gps_ts"), (start[0] + (end[0] - start[0]) * f).alias("lat"), (start[1] + (end[1] - start[1]) * f).alias("lng"))
