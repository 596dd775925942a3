"""As-of joins of two tables: each left row with the right row that was last, or comes next, at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of a bucket of time; a key's rows of one bucket are sorted together.
BUCKET_S = 86_400


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, take: dict[str, str], direction: str = "backward", within_s: int | None = None, bucket_s: int = BUCKET_S) -> DataFrame:
    """left and the columns take {right column: name} of the right row of equal `by` that is nearest in time: at or before a left row (backward), or at or after it (forward).

    Of right rows of one time the greatest by `take` counts when looking backward, the
    least when forward. Without such a row, or one no more than within_s away, the
    columns are null; so they are for left rows without a time. Null keys match nothing.

    Both sides are put into one table and carried along within (by, bucket) by a window;
    what goes over from bucket to bucket comes from a table of one row for each (by,
    bucket). So one key with a third of all rows is spread over as many tasks as it has
    buckets, and nothing is multiplied out.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction}")
    back = direction == "backward"
    bucket = lambda ts: F.coalesce(F.floor(F.col(ts) / bucket_s), F.lit(-(1 << 62)))
    found = F.struct(F.col(right_ts).alias("ts"), *(F.col(c).alias(n) for c, n in take.items()))
    keyed = right.dropna(subset=[*by, right_ts])
    rights = keyed.select(*by, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), bucket(right_ts).alias("_bucket"), found.alias("_right"))
    rights = rights.withColumn("_left", F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType))
    lefts = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), bucket(left_ts).alias("_bucket"), F.lit(None).cast(rights.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"))
    rows = rights.unionByName(lefts)
    way = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
    inside = Window.partitionBy(*by, "_bucket").orderBy(way("_ts"), F.col("_side").asc(), way("_right")).rowsBetween(Window.unboundedPreceding, 0)
    ends = rights.groupBy(*by, "_bucket").agg((F.max if back else F.min)("_right").alias("_end"))
    buckets = rows.select(*by, "_bucket").distinct().join(ends, [*by, "_bucket"], "left")
    over = Window.partitionBy(*by).orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(over).alias("_carried"))
    rows = rows.withColumn("_own", F.last("_right", ignorenulls=True).over(inside)).where("_side = 1").join(carried, [*by, "_bucket"], "left")
    match = F.when(F.col("_ts").isNotNull(), F.coalesce("_own", "_carried"))
    if within_s is not None:
        match = F.when(F.abs(match["ts"] - F.col("_ts")) <= within_s, match)
    return rows.select("_left.*", match.alias("_match")).select(*left.columns, *(F.col(f"_match.{n}").alias(n) for n in take.values()))
