"""Prediction queries: the place at a time, the schedule of a day, the next place. All users of a request table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import timefn as T

SLOT_MIN = 30


def hundredths(column: str) -> Column:
    """Rounded half up to two decimals; sums that differ in their last bits round alike."""
    return F.floor(F.col(column) * 100 + 0.5 + 1e-7) / 100


def history(visits: DataFrame, day: str) -> DataFrame:
    """Each user's visits of a weekday, or all of them where there are none, with match_level."""
    same = F.col("day_of_week") == day
    any_same = F.max(same).over(Window.partitionBy("user_id"))
    q = visits.withColumn("_any", any_same).where(same | ~F.col("_any"))
    return q.withColumn("match_level", F.when(F.col("_any"), "same_day_of_week").otherwise("all_days_fallback")).drop("_any")


def ranges(visits: DataFrame) -> DataFrame:
    """A row for each range of minutes of a day that a visit covers: two where it passes midnight. duration_score is 1 to 6."""
    a, b = T.minute_of_day(F.col("visit_start")), T.minute_of_day(F.col("visit_end"))
    span = lambda x, y: F.struct(x.alias("start_minute"), y.alias("end_minute"))
    both = F.when(b >= a, F.array(span(a, b))).otherwise(F.array(span(a, F.lit(1440)), span(F.lit(0), b)))
    return visits.withColumns({"_r": F.explode(both), "duration_score": F.greatest(F.lit(1.0), F.least(F.col("duration_sec") / 1800, F.lit(6.0)))}).select("*", "_r.*").drop("_r")


def place_at(visits: DataFrame, day: str, minute: int, top: int = 3) -> DataFrame:
    """(user_id, match_level, rank, cluster_id, confidence, support): the likely places of every user at a minute of a weekday."""
    past = history(visits, day)
    r = ranges(past)
    inside = F.lit(minute).between(F.col("start_minute"), F.col("end_minute"))
    away = F.abs(minute - (F.col("start_minute") + F.col("end_minute")) / 2)
    near = F.when(~inside & (away <= 90), F.col("duration_score") * (1 - away / 120))
    by_range = r.select("user_id", "match_level", "cluster_id", "visit_start", F.when(inside, F.col("duration_score")).alias("direct"), near.alias("nearby"))
    bucket = T.time_of_day(F.lit(minute // 60), "plain")
    same = past.where(F.col("time_of_day") == bucket).select("user_id", "match_level", "cluster_id", "visit_start", F.lit(None).cast("double").alias("direct"), F.lit(0.35).cast("double").alias("nearby"))
    sums = by_range.unionByName(same).groupBy("user_id", "match_level", "cluster_id").agg(
        F.sum("direct").alias("direct"), F.sum("nearby").alias("nearby"), F.min(F.when(F.col("direct").isNotNull(), F.col("visit_start"))).alias("first_direct"), F.min(F.when(F.col("nearby").isNotNull(), F.col("visit_start"))).alias("first_nearby")
    )
    user = Window.partitionBy("user_id")
    q = sums.withColumn("_any", F.count("direct").over(user) > 0)
    q = q.withColumns({"score": F.when(F.col("_any"), F.col("direct")).otherwise(F.col("nearby")), "first": F.when(F.col("_any"), F.col("first_direct")).otherwise(F.col("first_nearby"))}).where("score > 0")
    q = q.withColumns({"total": F.sum("score").over(user), "rank": F.row_number().over(user.orderBy(F.desc(F.round("score", 9)), "first", "cluster_id"))}).where(F.col("rank") <= top)
    return q.select("user_id", "match_level", "rank", "cluster_id", F.round(F.col("score") / hundredths("total"), 3).alias("confidence"), hundredths("score").alias("support"))


def day_schedule(visits: DataFrame, day: str) -> DataFrame:
    """(user_id, match_level, rank, cluster_id, start_time, end_time, duration_min, confidence, support): half-hour slots by their top place, equal neighbours merged.

    The confidence of merged slots is the pairwise running mean, rounded at each step.
    """
    last = F.floor(F.greatest(F.col("end_minute") - 1, F.lit(0)) / SLOT_MIN)
    every = F.sequence(F.lit(0), F.lit(1440 // SLOT_MIN - 1))
    slots = ranges(history(visits, day)).withColumn("slot", F.explode(F.filter(every, lambda s: (s >= F.floor(F.col("start_minute") / SLOT_MIN)) & (s <= last))))
    scores = slots.groupBy("user_id", "match_level", "slot", "cluster_id").agg(F.sum("duration_score").alias("score"), F.min("visit_start").alias("first"))
    w = Window.partitionBy("user_id", "slot")
    top = scores.withColumns({"total": F.sum("score").over(w), "_k": F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "first", "cluster_id"))}).where("_k = 1")
    top = top.select("user_id", "match_level", "slot", "cluster_id", F.round(F.col("score") / F.col("total"), 3).alias("confidence"), hundredths("score").alias("support"))
    user = Window.partitionBy("user_id").orderBy("slot")
    new = F.when((F.lag("cluster_id").over(user) == F.col("cluster_id")) & (F.lag("slot").over(user) == F.col("slot") - 1), 0).otherwise(1)
    runs = top.withColumn("_new", new).withColumn("_no", F.sum("_new").over(user.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy("user_id", "match_level", "_no").agg(F.max("cluster_id").alias("cluster_id"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.sort_array(F.collect_list(F.struct("slot", "confidence"))).alias("c"), F.sum("support").alias("support"))
    mean = F.aggregate(F.slice("c", 2, 48), F.element_at("c", 1)["confidence"], lambda a, x: F.round((a + x["confidence"]) / 2, 3))
    start, end = F.col("a") * SLOT_MIN, (F.col("b") + 1) * SLOT_MIN
    return grouped.select("user_id", "match_level", F.row_number().over(Window.partitionBy("user_id").orderBy("_no")).alias("rank"), "cluster_id", T.format_minutes(start).alias("start_time"), T.format_minutes(end, True).alias("end_time"), (end - start).alias("duration_min"), mean.alias("confidence"), hundredths("support").alias("support"))


def next_place(requests: DataFrame, patterns: DataFrame, clusters: DataFrame, day: str, hour: int, top: int = 3) -> DataFrame:
    """The likely next places of every request (user_id, from_cluster_id), by staged fallback.

    Level 1 looks at the weekday and time of day, 2 at the time of day, 3 at the place
    alone, 4 at the user's most frequent transition with confidence 0.1; the lowest level
    that has rows answers. Requests that no level answers give no rows. A request meets
    the patterns of its own place only, and one row of its user for level 4.
    """
    tod = T.time_of_day(F.lit(hour), "ping")
    p = patterns.select("user_id", "from_cluster_id", "to_cluster_id", "to_place_type", "day_of_week", "time_of_day", "probability", "transition_count", "avg_travel_duration_sec", "first_seen")
    asked = requests.select("user_id", "from_cluster_id").distinct()
    level = F.when((F.col("day_of_week") == day) & (F.col("time_of_day") == tod), 1).when(F.col("time_of_day") == tod, 2).otherwise(3)
    key = Window.partitionBy("user_id", "from_cluster_id")
    here = asked.join(p, ["user_id", "from_cluster_id"]).withColumn("level", level)
    here = here.withColumn("best", F.min("level").over(key)).where("level = best")
    here = here.withColumn("rank", F.row_number().over(key.orderBy(F.desc("probability"), "first_seen", "to_cluster_id", "day_of_week", "time_of_day"))).where(F.col("rank") <= top)
    order = F.struct((-F.col("transition_count")).alias("n"), "first_seen", "to_cluster_id", "day_of_week", "time_of_day", "from_cluster_id")
    common = p.groupBy("user_id").agg(F.min_by(F.struct("to_cluster_id", "to_place_type", "avg_travel_duration_sec"), order).alias("c"))
    columns = ["user_id", "from_cluster_id", "rank", "level", "to_cluster_id", "to_place_type", "avg_travel_duration_sec", "probability"]
    rest = asked.join(here.select("user_id", "from_cluster_id").distinct(), ["user_id", "from_cluster_id"], "left_anti").join(common, "user_id")
    rest = rest.select("user_id", "from_cluster_id", F.lit(1).alias("rank"), F.lit(4).alias("level"), "c.*", F.lit(0.1).alias("probability"))
    where = clusters.select("user_id", F.col("cluster_id").alias("to_cluster_id"), "lat", "lng")
    return here.select(columns).unionByName(rest.select(columns)).join(where, ["user_id", "to_cluster_id"], "left").select(
        "user_id", "from_cluster_id", "rank", F.col("to_cluster_id").alias("next_cluster_id"), F.col("to_place_type").alias("next_place_type"), "lat", "lng",
        F.col("probability").alias("confidence"), F.floor(F.col("avg_travel_duration_sec") / 60 + 0.5).cast("long").alias("expected_trip_duration_min"), F.when(F.col("level") == 4, "most_frequent").otherwise(F.concat(F.lit("rule_based_level_"), F.col("level").cast("string"))).alias("source"),
    )


#: Weights of the model, the transition's share and its recency; days in which recency halves; days of visits below which a user is new.
BLEND, HALF_LIFE_DAYS, COLD_DAYS = (0.6, 0.3, 0.1), 7, 3


def global_patterns(patterns: DataFrame) -> DataFrame:
    """(from_place_type, next_place_type, share) of all users' transitions: the commonest kind of place after each kind, ties to the least name."""
    n = patterns.where("from_place_type is not null and to_place_type is not null").groupBy("from_place_type", F.col("to_place_type").alias("next_place_type")).agg(F.sum("transition_count").alias("n"))
    w = Window.partitionBy("from_place_type")
    ranked = n.withColumns({"share": F.col("n") / F.sum("n").over(w), "k": F.row_number().over(w.orderBy(F.desc("n"), "next_place_type"))})
    return ranked.where("k = 1").select("from_place_type", "next_place_type", "share")


def blended(requests: DataFrame, patterns: DataFrame, visits: DataFrame, model: DataFrame | None = None, top: int = 3) -> DataFrame:
    """(user_id, from_cluster_id, rank, next_cluster_id, next_place_type, score, source) for requests (user_id, from_cluster_id, from_place_type).

    A place's score is 0.6 times the model's confidence (user_id, from_cluster_id,
    next_cluster_id, confidence), 0.3 times its share of the transitions from there, and
    0.1 times its recency, which halves with each HALF_LIFE_DAYS since it was last seen,
    counted from the user's last visit. What the model or the patterns don't know counts
    0. Users with visits on fewer than COLD_DAYS days, and requests without a place, get the
    commonest kind of place of all users (source `global`, score a tenth of its share),
    or else one row of source `not_enough_history`.
    """
    key = ["user_id", "from_cluster_id"]
    asked = requests.select(*key, "from_place_type").dropDuplicates(key)
    known = visits.groupBy("user_id").agg(F.count_distinct("date").alias("days"), F.max("visit_end").alias("latest"))
    warm = asked.join(known.where(F.col("days") >= COLD_DAYS), "user_id")
    routes = patterns.groupBy(*key, F.col("to_cluster_id").alias("next_cluster_id")).agg(F.max("to_place_type").alias("next_place_type"), F.sum("transition_count").alias("n"), F.max("last_seen").alias("last_seen"))
    routes = routes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))
    if model is None:
        routes = routes.withColumn("confidence", F.lit(0.0))
    else:
        routes = routes.join(model.select(*key, "next_cluster_id", "confidence"), [*key, "next_cluster_id"], "full")
    age = (F.col("latest") - F.col("last_seen")) / (HALF_LIFE_DAYS * 86_400.0)
    parts = (F.coalesce("confidence", F.lit(0.0)), F.coalesce("share", F.lit(0.0)), F.coalesce(F.pow(F.lit(0.5), age), F.lit(0.0)))
    scored = warm.join(routes, key).withColumn("score", F.round(sum(w * x for w, x in zip(BLEND, parts, strict=True)), 6))
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "next_cluster_id")
    columns = [*key, "rank", "next_cluster_id", "next_place_type", "score", "source"]
    scored = scored.withColumns({"rank": F.row_number().over(w), "source": F.lit("blend")}).where(F.col("rank") <= top).select(columns)
    rest = asked.join(scored.select(*key).distinct(), key, "left_anti").join(global_patterns(patterns), "from_place_type", "left")
    found = F.col("next_place_type").isNotNull()
    rest = rest.withColumns({"rank": F.lit(1), "next_cluster_id": F.lit(None).cast("string"), "score": F.when(found, F.round(F.col("share") * 0.1, 6)), "source": F.when(found, "global").otherwise("not_enough_history")})
    return scored.unionByName(rest.select(columns))
