"""The movement view: a table of events read as pings of people moving between places.

Each user's k-th event is the k-th ping: blocks of 18 pings, 15 at a place and 3 on the
way, half a minute apart, with a hole of two hours after every third block. Only integer
arithmetic and + * / on doubles, so two engines give the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CTES = """
e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as n from {events}),
b as (select *, cast((n - n % 18) / 18 as bigint) as blk, n % 18 as k from e),
q as (select *, cast((blk - blk % 2) / 2 as bigint) as h0, cast((blk + 1 - (blk + 1) % 2) / 2 as bigint) as h1 from b),
p as (select *,
  (user_id * 7 + (case when blk % 2 = 0 then 0 else 1 + h0 % 3 end) * 13) % 29 as pi,
  (user_id * 7 + (case when (blk + 1) % 2 = 0 then 0 else 1 + h1 % 3 end) * 13) % 29 as qi,
  case when user_id % 5 = 0 then 0.001e0 else 0.01e0 end as step from q),
c as (select *,
  28.5e0 + (pi % 6) * step as la, 77.2e0 + cast((pi - pi % 6) / 6 as bigint) * step as lo,
  28.5e0 + (qi % 6) * step as la2, 77.2e0 + cast((qi - qi % 6) / 6 as bigint) * step as lo2,
  case when k < 15 then 0e0 else (k - 14) / 4e0 end as f from p),
gps as (select event_id as raw_id, concat('U', user_id) as user_id,
  cast(1704047400 + (user_id % 7) * 86400 + (user_id % 24) * 3600 + n * 30 + cast((blk - blk % 3) / 3 as bigint) * 7200 as bigint) as gps_ts,
  la + (la2 - la) * f + ((event_id * 37) % 21 - 10) * 1e-5 + (case when event_id % 101 = 0 then 0.03e0 else 0e0 end) as lat,
  lo + (lo2 - lo) * f + ((event_id * 53) % 19 - 9) * 1e-5 as lng,
  case when k < 15 then 0.4e0 when user_id % 5 = 0 then 5e0 else 30e0 end as speed,
  cast((event_id * 11) % 360 as double) as heading,
  case when event_id % 97 = 0 then 150e0 else 8e0 end as accuracy from c)"""


def movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings (raw_id, user_id, gps_ts, lat, lng, speed, heading, accuracy)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(f"with {CTES} select * from gps", events=events)


def places(spark: SparkSession) -> DataFrame:
    """The 29 places of the movement view as a dimension of known places."""
    return spark.range(29).selectExpr("concat('P', id) as label", "case id % 4 when 0 then 'HOME' when 1 then 'OFFICE' when 2 then 'GYM' else 'PARK' end as place_type", "28.5e0 + (id % 6) * 0.01e0 as lat", "77.2e0 + cast((id - id % 6) / 6 as bigint) * 0.01e0 as lng")
