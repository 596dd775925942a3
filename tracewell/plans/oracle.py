"""DuckDB SQL that states each query independently, as a chain of common table expressions over the movement view."""

from __future__ import annotations

from tracewell.plans.fixture import CTES

VALID = "({0} is not null and {1} is not null and {0} between -90 and 90 and {1} between -180 and 180)"


def hav(a: str, b: str, c: str, d: str, r: float = 6371000.0) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(case when {VALID.format(a, b)} and {VALID.format(c, d)} then 2 * {r} * atan2(sqrt({h}), sqrt(1 - {h})) else 0.0 end)"


def hour(ts: str) -> str:
    return f"cast(((({ts}) + 19800) % 86400) // 3600 as int)"


def minute(ts: str) -> str:
    return f"cast(((({ts}) + 19800) % 86400) // 60 as int)"


def day(ts: str) -> str:
    return f"cast((({ts}) + 19800) // 86400 as int)"


def date(d: str) -> str:
    return f"strftime(date '1970-01-01' + {d}, '%Y-%m-%d')"


def dow(ts: str) -> str:
    return f"(['Thursday','Friday','Saturday','Sunday','Monday','Tuesday','Wednesday'])[{day(ts)} % 7 + 1]"


def tod(h: str, b: tuple[int, int, int, int]) -> str:
    return f"case when {h} >= {b[0]} and {h} < {b[1]} then 'morning' when {h} >= {b[1]} and {h} < {b[2]} then 'afternoon' when {h} >= {b[2]} and {h} < {b[3]} then 'evening' else 'night' end"


W = "over (partition by user_id order by gps_ts, raw_id)"
S = "partition by user_id, session, is_anomaly order by gps_ts, raw_id"

STEPS: dict[str, str] = {
    "lagged": f"select *, lag(gps_ts) {W} pts, lag(lat) {W} plat, lag(lng) {W} plng, lag(speed) {W} pspeed, lag(heading) {W} phead from gps",
    "feat": f"select *, coalesce(gps_ts - pts, 0) time_gap, case when pts is null then 0.0 else {hav('plat', 'plng', 'lat', 'lng')} end distance, case when pts is null then 0.0 else coalesce(speed, 0) - coalesce(pspeed, 0) end speed_change, case when pts is null then 0.0 when abs(heading - phead) % 360 > 180 then 360 - abs(heading - phead) % 360 else abs(heading - phead) % 360 end heading_change from lagged",
    "calc": "select *, case when time_gap > 0 then distance / time_gap * 3.6 else 0.0 end kmph from feat",
    "anom": f"select *, case when not {VALID.format('lat', 'lng')} then 'INVALID_LAT_LNG' when gps_ts is null or gps_ts <= 0 then 'INVALID_TIMESTAMP' when accuracy > 100 then 'LOW_GPS_ACCURACY' when pts is null then null when time_gap <= 0 then 'NON_INCREASING_TIMESTAMP' when distance > 2000 and time_gap < 60 then 'IMPOSSIBLE_DISTANCE_JUMP' when kmph > 180 then 'IMPOSSIBLE_SPEED' end reason from calc",
    "act": "select *, reason is not null is_anomaly, case when reason is not null or time_gap > 60 then 'UNKNOWN' when speed <= 1.5 and distance <= 30 then 'STAY' when speed > 12 or kmph > 12 then 'DRIVE' when speed > 1.5 and speed <= 7 and distance > 5 and time_gap <= 30 then 'WALK' else 'UNKNOWN' end activity from anom",
    "sess": f"select *, sum(case when pts is null or time_gap > 60 then 1 else 0 end) {W} session from act",
    "run": f"select *, sum(case when speed < 1 then 0 else 1 end) over ({S}) rn from sess",
    "since": "select *, min(case when speed < 1 then gps_ts end) over (partition by user_id, session, is_anomaly, rn order by gps_ts, raw_id) since from run",
    "ev": "select *, case when speed > 5 and activity <> 'UNKNOWN' then 'S' when speed < 1 and gps_ts - since >= 300 then 'E' end e from since",
    "st": f"select *, last_value(e ignore nulls) over ({S}) state from ev",
    "trip0": f"select *, case when state = 'S' and coalesce(lag(state) over ({S}), 'E') <> 'S' then 1 else 0 end starts from st",
    "trip": f"select *, case when state = 'S' and not is_anomaly then sum(starts) over ({S}) end trip_no from trip0",
    "stretch0": "select *, not is_anomaly and activity <> 'UNKNOWN' known, sum(case when not is_anomaly and activity <> 'UNKNOWN' then 0 else 1 end) over (partition by user_id, session order by gps_ts, raw_id) stretch from trip",
    "stretch": "select *, row_number() over (partition by user_id, session, stretch order by gps_ts, raw_id) k from stretch0 where known",
    "fold": f"select user_id, session, stretch, k, raw_id, gps_ts, lat alat, lng alng, gps_ts ats from stretch where k = 1 union all select n.user_id, n.session, n.stretch, n.k, n.raw_id, n.gps_ts, case when {hav('f.alat', 'f.alng', 'n.lat', 'n.lng')} <= 50 then f.alat else n.lat end, case when {hav('f.alat', 'f.alng', 'n.lat', 'n.lng')} <= 50 then f.alng else n.lng end, case when {hav('f.alat', 'f.alng', 'n.lat', 'n.lng')} <= 50 then f.ats else n.gps_ts end from fold f join stretch n on n.user_id = f.user_id and n.session = f.session and n.stretch = f.stretch and n.k = f.k + 1",
    "proc": "select t.*, f.ats stay_start_time, coalesce(t.gps_ts - f.ats, 0) stay_duration, coalesce(t.gps_ts - f.ats, 0) >= 120 is_stay_point from stretch0 t left join fold f on t.user_id = f.user_id and t.raw_id = f.raw_id",
    "spts": f"select *, cast(round(lat * 10000) as bigint) cell_lat, cast(round(lng * 10000) as bigint) cell_lng from proc where is_stay_point and not is_anomaly and {VALID.format('lat', 'lng')}",
    "cell": "select user_id, cell_lat, cell_lng, (2 * sum(round(lat * 1e7)::bigint) + count(*)) // (2 * count(*)) / 1e7 lat, (2 * sum(round(lng * 1e7)::bigint) + count(*)) // (2 * count(*)) / 1e7 lng, count(*) cnt, min(gps_ts) first_seen, max(gps_ts) last_seen from spts group by all",
    "gate": "select * from cell where user_id in (select user_id from cell group by 1 having sum(cnt) >= 8 and count(*) >= 8)",
    "pair": f"select a.user_id, a.cell_lat x, a.cell_lng y, b.cell_lat x2, b.cell_lng y2, b.cnt from gate a join gate b on a.user_id = b.user_id and abs(a.cell_lat - b.cell_lat) < 12 where {hav('a.lat', 'a.lng', 'b.lat', 'b.lng', 6371008.8)} <= 50",
    "core": "select g.user_id, cell_lat x, cell_lng y, row_number() over (partition by g.user_id order by first_seen, cell_lat, cell_lng) o from gate g join (select user_id, x, y from pair group by all having sum(cnt) >= 8) c on g.user_id = c.user_id and cell_lat = x and cell_lng = y",
    "reach": "select user_id, x, y, o from core union select p.user_id, p.x2, p.y2, r.o from reach r join pair p on p.user_id = r.user_id and p.x = r.x and p.y = r.y join core c on c.user_id = p.user_id and c.x = p.x2 and c.y = p.y2",
    "root": "select user_id, x, y, min(o) o from reach group by all",
    "num": "select user_id, x, y, dense_rank() over (partition by user_id order by o) - 1 no from root",
    "lab": "select g.*, coalesce('C' || n.no, (select 'C' || min(m.no) from pair p join num m on m.user_id = p.user_id and m.x = p.x2 and m.y = p.y2 where p.user_id = g.user_id and p.x = g.cell_lat and p.y = g.cell_lng), '-1') cluster_id from gate g left join num n on n.user_id = g.user_id and n.x = g.cell_lat and n.y = g.cell_lng",
    "cpts": "select s.*, l.cluster_id from spts s left join lab l using (user_id, cell_lat, cell_lng)",
    "kept": "select * from cpts where cluster_id is not null and cluster_id <> '-1'",
    "flag": f"select *, case when lag(cluster_id) {W} is null or lag(cluster_id) {W} <> cluster_id or gps_ts - lag(gps_ts) {W} > 1800 then 1 else 0 end nw from kept",
    "isl0": f"select *, sum(nw) {W} i from flag",
    "isl1": "select user_id, i, max(cluster_id) cluster_id, min(gps_ts) visit_start, max(gps_ts) visit_end, count(*) point_count from isl0 group by user_id, i",
    "isl": "select *, visit_end - visit_start duration_sec, lag(cluster_id) over (partition by user_id order by i) prev_cluster_id, lead(cluster_id) over (partition by user_id order by i) next_cluster_id from isl1",
    "mrg0": "select *, case when lag(cluster_id) over w = cluster_id and visit_start - lag(visit_end) over w between 0 and 300 then 0 else 1 end nw from isl where duration_sec >= 300 window w as (partition by user_id order by visit_start)",
    "mrg": "select *, sum(nw) over (partition by user_id order by visit_start) m from mrg0",
    "vis0": "select user_id, m, max(cluster_id) cluster_id, min(visit_start) visit_start, max(visit_end) visit_end, sum(point_count)::bigint point_count, arg_min(prev_cluster_id, visit_start) prev_cluster_id, arg_max(next_cluster_id, visit_start) next_cluster_id, count(*) > 1 is_merged from mrg group by user_id, m",
    "vis": f"select user_id, cluster_id, visit_start, visit_end, point_count, prev_cluster_id, next_cluster_id, is_merged, visit_end - visit_start duration_sec, {hour('visit_start')} arrival_hour, {hour('visit_end')} departure_hour, {dow('visit_start')} day_of_week, {day('visit_start')} % 7 in (2, 3) is_weekend, {tod(hour('visit_start'), (6, 12, 17, 21))} time_of_day, {date(day('visit_start'))} date from vis0",
    "anchor": "select user_id, cluster_id, lat alat, lng alng from lab where cluster_id <> '-1' qualify row_number() over (partition by user_id, cluster_id order by cnt desc, first_seen, cell_lat, cell_lng) = 1",
    "near": f"select l.*, {hav('alat', 'alng', 'lat', 'lng')} <= 120 near from lab l join anchor using (user_id, cluster_id)",
    "cen0": "select user_id, cluster_id, sum(cnt)::bigint total_points, min(first_seen) first_seen, max(last_seen) last_seen, coalesce(sum(cnt) filter (near), 0) >= greatest(floor(sum(cnt) * 0.5), 1) use_core, (2 * sum(round(lat * 1e7)::bigint * cnt) filter (near) + sum(cnt) filter (near)) // (2 * sum(cnt) filter (near)) / 1e7 clat, (2 * sum(round(lng * 1e7)::bigint * cnt) filter (near) + sum(cnt) filter (near)) // (2 * sum(cnt) filter (near)) / 1e7 clng, (2 * sum(round(lat * 1e7)::bigint * cnt) + sum(cnt)) // (2 * sum(cnt)) / 1e7 alat, (2 * sum(round(lng * 1e7)::bigint * cnt) + sum(cnt)) // (2 * sum(cnt)) / 1e7 alng from near group by user_id, cluster_id",
    "cen": "select user_id, cluster_id, case when use_core then clat else alat end lat, case when use_core then clng else alng end lng, case when use_core then 'weighted_mean_core_120m' else 'weighted_mean_all' end center_method, total_points, first_seen, last_seen from cen0",
    "rad": f"select c.user_id, c.cluster_id, round(max({hav('c.lat', 'c.lng', 'l.lat', 'l.lng')}), 2) radius_meters from cen c join lab l using (user_id, cluster_id) group by all",
    "vst": "select user_id, cluster_id, count(*) visit_count, round(avg(duration_sec), 2) avg_duration_sec, sum(duration_sec)::bigint total_duration_sec, round(count(*) filter (arrival_hour >= 22 or arrival_hour < 6) / count(*), 3) night_visit_ratio, round(count(*) filter (arrival_hour between 9 and 18) / count(*), 3) day_visit_ratio, round(count(*) filter (not is_weekend) / count(*), 3) weekday_ratio, round(avg(arrival_hour), 2) avg_arrival_hour, round(avg(departure_hour), 2) avg_departure_hour from vis group by all",
    "clu0": "select c.*, radius_meters, coalesce(visit_count, 0) visit_count, coalesce(total_duration_sec, 0) total_duration_sec, coalesce(avg_duration_sec, 0) avg_duration_sec, coalesce(night_visit_ratio, 0) night_visit_ratio, coalesce(day_visit_ratio, 0) day_visit_ratio, coalesce(weekday_ratio, 0) weekday_ratio, coalesce(avg_arrival_hour, 0) avg_arrival_hour, coalesce(avg_departure_hour, 0) avg_departure_hour from cen c join rad using (user_id, cluster_id) left join vst using (user_id, cluster_id)",
    "clu1": "select *, case when night_visit_ratio >= 0.45 and visit_count >= 2 then 'HOME' when day_visit_ratio >= 0.45 and weekday_ratio >= 0.6 and avg_duration_sec >= 10800 then 'OFFICE' when avg_duration_sec between 1800 and 7200 and visit_count >= 2 then 'GYM' else 'OTHER' end place_type from clu0",
    "clu": "select *, case place_type when 'HOME' then 0.95 when 'OFFICE' then 0.9 when 'GYM' then 0.65 else 0.5 end place_type_confidence from clu1",
    "cand0": "select user_id, cluster_id from_cluster_id, lead(cluster_id) over w to_cluster_id, visit_start from_start, visit_end trip_start, lead(visit_start) over w trip_end from vis window w as (partition by user_id order by visit_start, cluster_id)",
    "cand": "select *, trip_end - trip_start duration_sec, case when coalesce(trip_start, 0) = 0 or coalesce(trip_end, 0) = 0 then 'missing_fields' when trip_end - trip_start <= 0 then 'non_positive_duration' end skip_reason, case when from_cluster_id = to_cluster_id and trip_end - trip_start < 120 then 'same_cluster_small_gap' when trip_end - trip_start < 60 then 'below_min_duration' end filter_reason from cand0 where to_cluster_id is not null",
    "tp": "select c.user_id, c.trip_start, c.trip_end, p.raw_id, p.gps_ts, p.lat, p.lng, p.activity, lag(p.gps_ts) over w qt, lag(p.lat) over w qlat, lag(p.lng) over w qlng from (select distinct user_id, trip_start, trip_end from cand where skip_reason is null) c left join proc p on p.user_id = c.user_id and p.gps_ts between c.trip_start and c.trip_end window w as (partition by c.user_id, c.trip_start, c.trip_end order by p.gps_ts, p.raw_id)",
    "tseg": f"select *, {hav('qlat', 'qlng', 'lat', 'lng')} d, case when gps_ts - qt > 0 and {VALID.format('lat', 'lng')} and {VALID.format('qlat', 'qlng')} then {hav('qlat', 'qlng', 'lat', 'lng')} / (gps_ts - qt) * 3.6 end kmph from tp",
    "tsum": "select user_id, trip_start, trip_end, count(raw_id) point_count, count(*) filter (kmph <= 180) valid_segment_count, count(*) filter (kmph > 180) gps_jump_count, coalesce(sum(d) filter (kmph <= 180), 0.0) m, coalesce(max(kmph) filter (kmph <= 180), 0.0) top, count(*) filter (activity = 'WALK') walk, count(*) filter (activity = 'DRIVE') drive from tseg group by all",
    "tmet": "select user_id, trip_start, trip_end, floor(m * 100 + 0.5) / 100 distance_meters, floor(m / 1000 * 10000 + 0.5) / 10000 distance_km, floor(m / (trip_end - trip_start) * 3.6 * 100 + 0.5) / 100 avg_speed_kmph, floor(top * 100 + 0.5) / 100 max_speed_kmph, case when walk + drive = 0 then 'UNKNOWN' when drive / (walk + drive) >= 0.6 then 'DRIVE' when walk / (walk + drive) >= 0.6 then 'WALK' else 'MIXED' end travel_mode, point_count, valid_segment_count, gps_jump_count, case when point_count = 0 then 'NO_POINTS' when point_count < 5 then 'LOW_POINTS' when gps_jump_count > 0 and valid_segment_count > 0 then 'GPS_JUMP_FILTERED' else 'GOOD' end data_quality from tsum",
    "cdays": f"select *, unnest(list_distinct([{day('from_start')}, {day('trip_end')}])) dd from cand where skip_reason is null",
    "trips": f"select c.user_id, {date('dd')} date, from_cluster_id, to_cluster_id, c.trip_start, c.trip_end, duration_sec, filter_reason, filter_reason is not null is_filtered, 'cluster_visits' source, distance_meters, distance_km, avg_speed_kmph, max_speed_kmph, travel_mode, point_count, valid_segment_count, gps_jump_count, data_quality, {hour('c.trip_start')} departure_hour, {dow('c.trip_start')} day_of_week, {tod(hour('c.trip_start'), (6, 12, 18, 22))} time_of_day from cdays c join tmet using (user_id, trip_start, trip_end) where c.trip_start < (dd + 1) * 86400 - 19800 and c.trip_end >= dd * 86400 - 19800",
    "route": "select user_id, from_cluster_id, to_cluster_id, day_of_week, time_of_day, count(*) transition_count, round(avg(departure_hour), 2) avg_departure_hour, cast(floor(avg(duration_sec) + 0.5) as bigint) avg_travel_duration_sec, round(sum(distance_meters) filter (data_quality in ('GOOD', 'LOW_POINTS')) / nullif(count(*) filter (data_quality in ('GOOD', 'LOW_POINTS')), 0), 2) avg_distance_meters, round(avg(avg_speed_kmph), 2) avg_speed_kmph, round(max(max_speed_kmph), 2) max_speed_kmph, count(*) filter (data_quality in ('GOOD', 'LOW_POINTS')) reliable_trip_count, count(*) filter (data_quality not in ('GOOD', 'LOW_POINTS')) unreliable_trip_count, min(trip_start) first_seen, max(trip_end) last_seen from trips group by all",
    "mode": "select user_id, from_cluster_id, to_cluster_id, day_of_week, time_of_day, travel_mode most_common_travel_mode from trips group by user_id, from_cluster_id, to_cluster_id, day_of_week, time_of_day, travel_mode qualify row_number() over (partition by user_id, from_cluster_id, to_cluster_id, day_of_week, time_of_day order by count(*) desc, min(trip_start), travel_mode desc) = 1",
    "pat": "select r.*, most_common_travel_mode, (sum(transition_count) over (partition by r.user_id, from_cluster_id, day_of_week, time_of_day))::bigint total_transitions_from_cluster, round(transition_count / sum(transition_count) over (partition by r.user_id, from_cluster_id, day_of_week, time_of_day), 4) probability, f.place_type from_place_type, t.place_type to_place_type from route r join mode using (user_id, from_cluster_id, to_cluster_id, day_of_week, time_of_day) left join clu f on f.user_id = r.user_id and f.cluster_id = from_cluster_id left join clu t on t.user_id = r.user_id and t.cluster_id = to_cluster_id",
    "hist0": "select *, bool_or(day_of_week = 'Tuesday') over (partition by user_id) a from vis",
    "hist": "select * exclude (a), case when a then 'same_day_of_week' else 'all_days_fallback' end match_level, greatest(1.0, least(duration_sec / 1800, 6.0)) ds from hist0 where day_of_week = 'Tuesday' or not a",
    "rng0": f"select *, {minute('visit_start')} ma, {minute('visit_end')} mb from hist",
    "rng": "select * exclude (ma, mb), ma s, case when mb >= ma then mb else 1440 end e from rng0 union all select * exclude (ma, mb), 0, mb from rng0 where mb < ma",
    "sc0": "select user_id, match_level, cluster_id, visit_start, case when 600 between s and e then ds end direct, case when not (600 between s and e) and abs(600 - (s + e) / 2) <= 90 then ds * (1 - abs(600 - (s + e) / 2) / 120) end nearby from rng union all select user_id, match_level, cluster_id, visit_start, null, 0.35 from hist where time_of_day = 'morning'",
    "sc1": "select user_id, match_level, cluster_id, sum(direct) direct, sum(nearby) nearby, min(visit_start) filter (direct is not null) fd, min(visit_start) filter (nearby is not null) fn, count(sum(direct)) over (partition by user_id) > 0 a from sc0 group by user_id, match_level, cluster_id",
    "sc2": "select *, case when a then direct else nearby end score, case when a then fd else fn end f from sc1 where case when a then direct else nearby end > 0",
    "slot": "select user_id, match_level, cluster_id, visit_start, ds, unnest(range(s // 30, least(greatest(e - 1, 0) // 30, 47) + 1)) slot from rng",
    "ssc": "select user_id, match_level, slot, cluster_id, sum(ds) score, min(visit_start) f from slot group by all",
    "stop": "select *, sum(score) over (partition by user_id, slot) total from ssc qualify row_number() over (partition by user_id, slot order by round(score, 9) desc, f, cluster_id) = 1",
    "srun0": "select *, round(score / total, 3) conf, floor(score * 100 + 0.5 + 1e-7) / 100 sup, case when lag(cluster_id) over w = cluster_id and lag(slot) over w = slot - 1 then 0 else 1 end nw from stop window w as (partition by user_id order by slot)",
    "srun": "select *, sum(nw) over (partition by user_id order by slot) no from srun0",
}

RECURSIVE = {"fold", "reach"}


#: Steps of the unweighted search over single positions, after those of the stay pings.
POSITIONS = f"""
p6 as materialized (select user_id, lat, lng, count(*) cnt, min(gps_ts) first_seen from spts group by all),
pair6 as materialized (select a.user_id, a.lat x, a.lng y, b.lat x2, b.lng y2, b.cnt from p6 a join p6 b on a.user_id = b.user_id and abs(a.lat - b.lat) < 0.002 where {hav('a.lat', 'a.lng', 'b.lat', 'b.lng', 6371008.8)} <= 80),
core6 as materialized (select p.user_id, lat x, lng y, row_number() over (partition by p.user_id order by first_seen, round(lat * 1e9)::bigint, round(lng * 1e9)::bigint) o from p6 p join (select user_id, x, y from pair6 group by all having sum(cnt) >= 5) c on p.user_id = c.user_id and lat = x and lng = y),
reach6 as (select user_id, x, y, o from core6 union select p.user_id, p.x2, p.y2, r.o from reach6 r join pair6 p on p.user_id = r.user_id and p.x = r.x and p.y = r.y join core6 c on c.user_id = p.user_id and c.x = p.x2 and c.y = p.y2),
root6 as materialized (select user_id, x, y, min(o) o from reach6 group by all),
num6 as materialized (select user_id, x, y, dense_rank() over (partition by user_id order by o) - 1 no from root6),
lab6 as materialized (select g.user_id, g.cnt, coalesce('C' || n.no, 'C' || b.no, '-1') cluster_id from p6 g left join num6 n on n.user_id = g.user_id and n.x = g.lat and n.y = g.lng left join (select p.user_id, p.x, p.y, min(m.no) no from pair6 p join num6 m on m.user_id = p.user_id and m.x = p.x2 and m.y = p.y2 group by all) b on b.user_id = g.user_id and b.x = g.lat and b.y = g.lng)"""


def chain(last: str, query: str) -> str:
    """The steps up to `last`, then query."""
    names = list(STEPS)
    if last == "gps":
        return f"with {CTES.format(events='events')}\n{query}"
    parts = [f"{name} as materialized ({STEPS[name]})" if name not in RECURSIVE else f"{name} as ({STEPS[name]})" for name in names[: names.index(last) + 1]]
    return f"with recursive {CTES.format(events='events')},\n" + ",\n".join(parts) + "\n" + query
