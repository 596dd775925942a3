"""Places of a user: grid cells of stay pings, weighted DBSCAN over cells, and summaries."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.geo import DBSCAN_EARTH_M, haversine_m, valid_lat_lng
from tracewell.operators.components import connected_components
from tracewell.sources.tables import at_rest

EPS_M, MIN_WEIGHT, LEAST_POINTS, LEAST_CELLS = 50.0, 8, 8, 8
CORE_RADIUS_M, CORE_SHARE = 120.0, 0.5
#: Points of a block of a full square.
BLOCK = 256


def mean_degrees(total: str, n: str) -> Column:
    """total / n, rounded half up, of a sum of whole 1e-7 degrees; integers, so the order of addition doesn't matter."""
    return F.expr(f"(2 * `{total}` + `{n}`) div (2 * `{n}`) / 1e7")


def stay_points(processed: DataFrame) -> DataFrame:
    return processed.where(F.col("is_stay_point") & ~F.col("is_anomaly") & valid_lat_lng(F.col("lat"), F.col("lng")))


def with_cell(points: DataFrame) -> DataFrame:
    """Adds the cell as two integers of a ten-thousandth degree."""
    return points.withColumns({"cell_lat": F.round(F.col("lat") * 10000).cast("long"), "cell_lng": F.round(F.col("lng") * 10000).cast("long")})


def cells(processed: DataFrame) -> DataFrame:
    """One row for each user's cell of stay pings: sums, count, first and last time, centre at 7 decimals."""
    grouped = with_cell(stay_points(processed)).groupBy("user_id", "cell_lat", "cell_lng").agg(
        F.sum("lat").alias("lat_sum"), F.sum("lng").alias("lng_sum"), *(F.sum(F.round(F.col(c) * 1e7).cast("long")).alias(f"_{c}") for c in ("lat", "lng")), F.count("*").alias("count"), F.min("gps_ts").alias("first_seen"), F.max("gps_ts").alias("last_seen")
    )
    return grouped.withColumns({c: mean_degrees(f"_{c}", "count") for c in ("lat", "lng")}).drop("_lat", "_lng")


def gated(cell_rows: DataFrame, least_points: int = LEAST_POINTS, least_cells: int = LEAST_CELLS) -> DataFrame:
    """Cells of the users with enough pings and cells."""
    enough = cell_rows.groupBy("user_id").agg(F.sum("count").alias("p"), F.count("*").alias("c")).where((F.col("p") >= least_points) & (F.col("c") >= least_cells)).select("user_id")
    return cell_rows.join(enough, "user_id", "left_semi")


def dbscan_labels(lat: np.ndarray, lng: np.ndarray, weight: np.ndarray, eps_m: float, min_weight: float) -> np.ndarray:
    """Cluster number of each row, -1 for noise; rows are in canonical order.

    A row is core if the weights within eps_m of it, its own included, add up to
    min_weight. Clusters are numbered by their first core row; a border row joins the
    lowest of its neighbours' clusters. Neighbours are looked up in squares of eps_m.
    """
    rlat, rlng = np.radians(lat), np.radians(lng)
    high = np.degrees(eps_m / DBSCAN_EARTH_M) * 1.001
    wide = high / max(0.01, float(np.cos(np.abs(rlat).max(initial=0)))) if len(lat) else high
    bx, by = np.floor(lat / high).astype(np.int64), np.floor(lng / wide).astype(np.int64)
    squares: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, key in enumerate(zip(bx.tolist(), by.tolist(), strict=True)):
        squares[key].append(i)
    near: list[np.ndarray] = []
    for i in range(len(lat)):
        around = np.array([j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in squares.get((int(bx[i]) + dx, int(by[i]) + dy), ())])
        a = np.sin((rlat[around] - rlat[i]) / 2) ** 2 + np.cos(rlat[i]) * np.cos(rlat[around]) * np.sin((rlng[around] - rlng[i]) / 2) ** 2
        near.append(around[2 * DBSCAN_EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a)) <= eps_m])
    core = np.array([weight[n].sum() >= min_weight for n in near], bool)
    label, number = np.full(len(lat), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], todo = number, [i]
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = number
                        todo.append(j)
            number += 1
    for i in np.flatnonzero(~core):
        found = [label[j] for j in near[i] if core[j]]
        if found:
            label[i] = min(found)
    return label


def square_width(row: Column, side: float) -> Column:
    """Degrees of longitude of a row's squares: `side` degrees of latitude where the row is widest."""
    return side / F.greatest(F.cos(F.radians(F.greatest(row * side, -(row + 1) * side))), F.lit(1e-4))


def squares_around(lat: Column, west: Column, east: Column, row: Column, rows: tuple[int, int], eps_m: float, side: float) -> Column:
    """Array of (row, col) of the squares that may hold a point within eps_m of the points at lat from west to east."""
    share = F.sin(F.lit(eps_m / DBSCAN_EARTH_M)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    far = F.when(share < 1, F.degrees(F.asin(F.least(share, F.lit(1.0)))) * 1.001).otherwise(180.0)
    cols = lambda r: F.sequence(F.floor((west - far) / square_width(r, side)), F.floor((east + far) / square_width(r, side)))
    return F.flatten(F.transform(F.sequence(row + rows[0], row + rows[1]), lambda r: F.transform(cols(r), lambda c: F.struct(r.alias("row"), c.alias("col")))))


def _full_links(spots: DataFrame, eps_m: float, side: float) -> DataFrame:
    """(a, b): units of full squares with points within eps_m of each other, once for each such pair of blocks of about BLOCK points."""
    spots.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    full = spots.where("full")
    box = full.groupBy("user_id", "row", "col", "unit").agg(F.count("*").alias("n"), F.min("lng").alias("west"), F.max("lng").alias("east"), F.max(F.abs("lat")).alias("high"))
    box = at_rest(box.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "squares")
    to = box.select("unit", "user_id", F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(squares_around(F.col("high"), F.col("west"), F.col("east"), F.col("row"), (0, 2), eps_m, side)).alias("s"))
    to = to.select(F.col("unit").alias("a"), "user_id", "r0", "c0", "s.row", "s.col")
    pairs = to.join(box.select("user_id", "row", "col", F.col("unit").alias("b")), ["user_id", "row", "col"]).where("row > r0 or col > c0").select("a", "b")
    part = full.join(box.select("unit", "blocks"), "unit").withColumn("part", F.pmod(F.xxhash64("id"), "blocks"))
    part = at_rest(part.groupBy("unit", "part").agg(F.collect_list("lat").alias("lat"), F.collect_list("lng").alias("lng")), "blocks")
    side_of = lambda x: part.select(F.col("unit").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lng").alias(f"lng_{x}"))
    rows = pairs.join(side_of("a"), "a").join(side_of("b"), "b").select("a", "b", "lat_a", "lng_a", "lat_b", "lng_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                y, x, v, u = (np.radians(batch.column(c)[k].values.to_numpy()) for c in range(2, 6))
                a = np.sin((v - y[:, None]) / 2) ** 2 + np.cos(y)[:, None] * np.cos(v) * np.sin((u - x[:, None]) / 2) ** 2
                keep.append(bool((2 * DBSCAN_EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a)) <= eps_m).any()))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def with_clusters(cell_rows: DataFrame, eps_m: float = EPS_M, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """Adds cluster_id C0, C1, .. or -1 to cells, as dbscan_labels() gives them, by joins.

    Rows are put into squares in which all are within eps_m of each other. Where a
    square's weights reach min_weight it is full: all its rows are core and of one
    cluster. Other squares have fewer than min_weight rows, so the pairs of these with
    what is near grow with the rows. No user's rows are gathered.
    """
    side = float(np.degrees(eps_m / DBSCAN_EARTH_M)) * 0.7
    row = F.floor(F.col("lat") / side)
    key = ["user_id", "cell_lat", "cell_lng"]
    rest = F.struct(F.lit(True).alias("_"), *(c for c in cell_rows.columns if c not in (*key, "lat", "lng", "count", "first_seen"))).alias("rest")
    rows = cell_rows.select(*key, "lat", "lng", "count", "first_seen", rest).withColumn("row", row).withColumn("col", F.floor(F.col("lng") / square_width(F.col("row"), side)))
    rows = at_rest(rows.withColumn("id", F.monotonically_increasing_id()), "rows")
    squares = rows.groupBy("user_id", "row", "col").agg((F.sum("count") >= min_weight).alias("full"), F.min("id").alias("least"))
    spots = at_rest(rows.join(squares, ["user_id", "row", "col"]).withColumn("unit", F.when(F.col("full"), F.col("least")).otherwise(F.col("id"))).drop("least"), "spots")
    ask = spots.where("not full").select("id", "user_id", F.col("lat").alias("y"), F.col("lng").alias("x"), F.explode(squares_around(F.col("lat"), F.col("lng"), F.col("lng"), F.col("row"), (-2, 2), eps_m, side)).alias("s"))
    met = ask.select("id", "user_id", "y", "x", "s.row", "s.col").join(spots.select("user_id", "row", "col", "lat", "lng", "count", "full", F.col("unit").alias("unit"), F.col("id").alias("near")), ["user_id", "row", "col"])
    near = at_rest(met.where(haversine_m(F.col("y"), F.col("x"), F.col("lat"), F.col("lng"), DBSCAN_EARTH_M) <= eps_m).select("id", "near", "unit", "full", "count"), "near")
    core = at_rest(near.groupBy("id").agg(F.sum("count").alias("w")).where(F.col("w") >= min_weight).select("id"), "core")
    hit = near.join(core.select(F.col("id").alias("near"), F.lit(True).alias("hit")), "near", "left").where("full or hit").select("id", "unit")
    to_core = hit.join(core.withColumn("core", F.lit(True)), "id", "left").select("id", "unit", F.coalesce("core", F.lit(False)).alias("core")).distinct()
    to_core = at_rest(to_core, "to_core")
    links = to_core.where("core").select(F.col("id").alias("a"), F.col("unit").alias("b")).unionByName(_full_links(spots, eps_m, side))
    parts = connected_components(links).withColumnsRenamed({"node": "unit", "component": "part"})
    first = F.struct("first_seen", "cell_lat", "cell_lng").alias("first")
    cores = spots.where("full").unionByName(spots.join(core, "id", "left_semi")).select("id", "unit", "user_id", first)
    members = cores.unionByName(to_core.where("not core").select("id", "unit"), allowMissingColumns=True).join(parts, "unit", "left")
    members = at_rest(members.select("id", F.coalesce("part", "unit").alias("part"), "user_id", "first"), "members")
    by_part = members.where("first is not null").groupBy("user_id", "part").agg(F.min("first").alias("first"))
    number = at_rest(by_part.select("part", (F.row_number().over(Window.partitionBy("user_id").orderBy("first")) - 1).alias("number")), "number")
    lowest = members.select("id", "part").join(number, "part").groupBy("id").agg(F.min("number").alias("number"))
    names = [f"rest.{c}" if c not in (*key, "lat", "lng", "count", "first_seen") else c for c in cell_rows.columns if c not in key]
    return spots.join(lowest, "id", "left").select(*key, *names, F.coalesce(F.concat(F.lit("C"), F.col("number").cast("string")), F.lit("-1")).alias("cluster_id"))


def point_clusters(processed: DataFrame, eps_m: float = 80.0, min_points: int = 5) -> DataFrame:
    """(user_id, cluster_id, points): DBSCAN without weights over single stay pings; equal positions count together first."""
    spots = stay_points(processed).groupBy("user_id", "lat", "lng").agg(F.count("*").alias("count"), F.min("gps_ts").alias("first_seen"))
    spots = spots.withColumns({"cell_lat": F.round(F.col("lat") * 1e9).cast("long"), "cell_lng": F.round(F.col("lng") * 1e9).cast("long")})
    return with_clusters(spots, eps_m, min_points).groupBy("user_id", "cluster_id").agg(F.sum("count").alias("points"))


def clustered_points(processed: DataFrame, labelled: DataFrame) -> DataFrame:
    """Stay pings with their cell's cluster_id; null where the user has none."""
    return with_cell(stay_points(processed)).join(labelled.select("user_id", "cell_lat", "cell_lng", "cluster_id"), ["user_id", "cell_lat", "cell_lng"], "left")


def centres(labelled: DataFrame) -> DataFrame:
    """(user_id, cluster_id, lat, lng, center_method, total_points, first_seen, last_seen, radius_meters).

    The densest cell is the anchor. Where the cells within CORE_RADIUS_M of it hold
    CORE_SHARE of the pings, their weighted mean is the centre, else that of all cells.
    """
    kept = labelled.where("cluster_id <> '-1'")
    by = Window.partitionBy("user_id", "cluster_id")
    anchor = by.orderBy(F.desc("count"), "first_seen", "cell_lat", "cell_lng").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    q = kept.withColumns({"a_lat": F.first("lat").over(anchor), "a_lng": F.first("lng").over(anchor)})
    q = q.withColumn("near", haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("lat"), F.col("lng")) <= CORE_RADIUS_M)
    weigh = lambda c, all_cells: F.sum(F.when(F.lit(all_cells) | F.col("near"), F.round(F.col(c) * 1e7).cast("long") * F.col("count")))
    sums = q.groupBy("user_id", "cluster_id").agg(
        F.sum("count").alias("total_points"), F.sum(F.when(F.col("near"), F.col("count"))).alias("core"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *(weigh(c, whole).alias(f"{c}_{'all' if whole else 'core'}") for c in ("lat", "lng") for whole in (True, False)),
    )
    core = F.col("core") >= F.greatest(F.floor(F.col("total_points") * CORE_SHARE), F.lit(1))
    pick = lambda c: F.when(core, mean_degrees(f"{c}_core", "core")).otherwise(mean_degrees(f"{c}_all", "total_points"))
    made = sums.select("user_id", "cluster_id", pick("lat").alias("lat"), pick("lng").alias("lng"), F.when(core, "weighted_mean_core_120m").otherwise("weighted_mean_all").alias("center_method"), "total_points", "first_seen", "last_seen")
    far = kept.select("user_id", "cluster_id", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng")).join(made, ["user_id", "cluster_id"])
    radius = far.groupBy("user_id", "cluster_id").agg(F.round(F.max(haversine_m(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))), 2).alias("radius_meters"))
    return made.join(radius, ["user_id", "cluster_id"])


def point_features(clustered: DataFrame) -> DataFrame:
    """(user_id, cluster_id, lat, lng, points, radius_meters) of single pings: their mean, and the farthest of them."""
    kept = clustered.where("cluster_id is not null and cluster_id <> '-1'").select("user_id", "cluster_id", "lat", "lng")
    sums = kept.groupBy("user_id", "cluster_id").agg(*(F.sum(F.round(F.col(c) * 1e7).cast("long")).alias(f"_{c}") for c in ("lat", "lng")), F.count("*").alias("points"))
    mean = sums.select("user_id", "cluster_id", mean_degrees("_lat", "points").alias("m_lat"), mean_degrees("_lng", "points").alias("m_lng"), "points")
    far = kept.join(mean, ["user_id", "cluster_id"]).groupBy("user_id", "cluster_id", "m_lat", "m_lng", "points")
    return far.agg(F.max(haversine_m(F.col("m_lat"), F.col("m_lng"), F.col("lat"), F.col("lng"))).alias("radius_meters")).withColumnsRenamed({"m_lat": "lat", "m_lng": "lng"})


def visit_stats(visits: DataFrame) -> DataFrame:
    """Counts, durations, ratios at 3 decimals and mean hours of each cluster's visits."""
    share = lambda c: F.round(F.sum(F.when(c, 1).otherwise(0)) / F.count("*"), 3)
    h = F.col("arrival_hour")
    return visits.groupBy("user_id", "cluster_id").agg(
        F.count("*").alias("visit_count"), F.round(F.avg("duration_sec"), 2).alias("avg_duration_sec"), F.sum("duration_sec").alias("total_duration_sec"),
        share((h >= 22) | (h < 6)).alias("night_visit_ratio"), share(h.between(9, 18)).alias("day_visit_ratio"), share(~F.col("is_weekend")).alias("weekday_ratio"),
        F.round(F.avg("arrival_hour"), 2).alias("avg_arrival_hour"), F.round(F.avg("departure_hour"), 2).alias("avg_departure_hour"),
    )


def place_type() -> tuple[Column, Column]:
    """(place type, confidence) by ordered rules over the visit statistics."""
    visits, night, day, week, avg = (F.col(c) for c in ("visit_count", "night_visit_ratio", "day_visit_ratio", "weekday_ratio", "avg_duration_sec"))
    rules = (("HOME", (night >= 0.45) & (visits >= 2), 0.95), ("OFFICE", (day >= 0.45) & (week >= 0.6) & (avg >= 10_800), 0.9), ("GYM", avg.between(1800, 7200) & (visits >= 2), 0.65))
    kind, sure = F.lit("OTHER"), F.lit(0.5)
    for name, holds, p in reversed(rules):
        kind, sure = F.when(holds, name).otherwise(kind), F.when(holds, p).otherwise(sure)
    return kind, sure


def user_clusters(labelled: DataFrame, visits: DataFrame) -> DataFrame:
    """Every cluster with its centre, visit statistics (zeros without visits) and place type."""
    joined = centres(labelled).join(visit_stats(visits), ["user_id", "cluster_id"], "left")
    counts, ratios = ("visit_count", "total_duration_sec"), ("avg_duration_sec", "night_visit_ratio", "day_visit_ratio", "weekday_ratio", "avg_arrival_hour", "avg_departure_hour")
    filled = joined.withColumns({**{c: F.coalesce(c, F.lit(0)).cast("long") for c in counts}, **{c: F.coalesce(c, F.lit(0.0)) for c in ratios}})
    kind, sure = place_type()
    return filled.withColumns({"place_type": kind, "place_type_confidence": sure})


def nearest_place(points: DataFrame, places: DataFrame, limit_m: float = 180.0) -> DataFrame:
    """points (lat, lng, ..) with the label, type and distance of the nearest known place within limit_m, else nulls.

    places is a fixed dimension of a few dozen rows, held as one literal array, so no join takes part.
    """
    rows = places.select("label", "place_type", "lat", "lng").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("known places must be a small dimension")
    near = F.array(*(F.struct(haversine_m(F.col("lat"), F.col("lng"), F.lit(r["lat"]), F.lit(r["lng"])).alias("distance"), F.lit(r["label"]).alias("label"), F.lit(r["place_type"]).alias("kind")) for r in rows))
    q = points.withColumn("_near", F.array_min(near))
    ok = F.col("_near.distance") <= limit_m
    return q.withColumns({"known_place": F.when(ok, F.col("_near.label")), "known_type": F.when(ok, F.col("_near.kind")), "known_distance": F.when(ok, F.round("_near.distance", 2))}).drop("_near")
