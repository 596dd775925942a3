"""Reading and writing tables: upsert, rebuild of users, JSON and CSV at the edge."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows up to which a join of stage tables broadcasts a side; each costs the driver several times as much, and several are under way at once.
BROADCAST_ROWS = 2 << 20

_folders: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers that start from now on import this package where it isn't installed."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local session gets a temporary folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tracewell-{spark.sparkContext.applicationId}"


def measured_broadcasts(spark: SparkSession) -> SparkSession:
    """Lets joins broadcast a side by the size of its rows, which AQE measures, no longer by the size of the files it comes from.

    A compressed file of 10 MB may hold rows of 200 MB, which the driver would gather. The session's limit stays, for the rows, but not beyond BROADCAST_ROWS.
    """
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not limit.startswith("-"):
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(min(own, BROADCAST_ROWS)))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return spark


@contextmanager
def no_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside shuffle both sides: each broadcast, however few its rows, costs the driver a page of memory and a thread."""
    name = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if limit is None else spark.conf.set(name, limit)


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear_tables(spark: SparkSession) -> None:
    """Delete every table that this application wrote with at_rest(); results that read them must be consumed before."""
    remove_folder(spark, shared_folder(spark))


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that at_rest() writes inside are deleted at the end, except those written with outside."""
    path = f"{shared_folder(spark)}/passing-{uuid.uuid4().hex}"
    token = _folders.set((*_folders.get(), path))
    try:
        yield
    finally:
        _folders.reset(token)
        remove_folder(spark, path)


def at_rest(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read back: later steps plan from the files, not from what made them.

    With outside the table outlives the innermost passing_tables().
    """
    spark = df.sparkSession
    folders = (shared_folder(spark), *_folders.get())
    path = f"{folders[-2] if outside and len(folders) > 1 else folders[-1]}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """The new rows, and the old rows whose key isn't among them; columns in `keep` stay as they were where the key existed.

    One full join on the key; keys are unique on both sides, null keys match nothing.
    Write the result to another path than the one `old` is read from, then swap.
    """
    keep = keep or []
    a, b = old.select(*key, F.struct(*old.columns).alias("_old")), new.select(*key, F.struct(*new.columns).alias("_new"))
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    kept = lambda c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
    return a.join(b, key, "full").select(*key, *((kept if c in keep else value)(c).alias(c) for c in new.columns if c not in key))


def append(df: DataFrame, path: str) -> None:
    """Add the rows of df to the table at path. Spark commits a write as a whole, so a failed one adds nothing; readers drop repeats by key."""
    df.write.mode("append").parquet(path)


def pending(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """The raw pings that aren't in the processed table yet, by raw_id."""
    return raw.join(processed.select("raw_id"), "raw_id", "left_anti")


def result_counts(candidates: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """(user_id, created, updated, skipped) of writing candidates over old: skipped have a skip_reason; the row of null user_id adds up all users."""
    known = old.select(*key).distinct().withColumn("known", F.lit(True))
    q = candidates.join(known, key, "left").withColumn("keep", F.col("skip_reason").isNull())
    counts = (F.count_if(F.col("keep") & F.col("known").isNull()).alias("created"), F.count_if(F.col("keep") & F.col("known").isNotNull()).alias("updated"), F.count_if(~F.col("keep")).alias("skipped"))
    return q.rollup("user_id").agg(*counts)


def merge_partials(parts: DataFrame) -> DataFrame:
    """Cells added up from partial cells of several runs: sums and counts added, first and last times widened."""
    return parts.groupBy("user_id", "cell_lat", "cell_lng").agg(F.sum("lat_sum").alias("lat_sum"), F.sum("lng_sum").alias("lng_sum"), F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def rebuild_users(df: DataFrame, path: str) -> None:
    """Replace the partitions of the users in df and leave those of others."""
    df.write.partitionBy("user_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, strings quoted, quotes doubled, nulls empty."""
    df.write.mode("overwrite").options(header=True, quoteAll=True, escape='"', nullValue="").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, escape='"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def ingest(points: DataFrame) -> DataFrame:
    """Points of the ingest interface: rows without ids or with a bad position are left out, local time fields and geohash added."""
    from tracewell.functions import geo, timefn

    ok = (F.coalesce("user_id", F.lit("")) != "") & geo.valid_lat_lng(F.col("lat"), F.col("lng"))
    ts = F.col("gps_ts")
    return points.where(ok).withColumns({"geohash": geo.geohash(F.col("lat"), F.col("lng"), 8), "day_of_week": timefn.day_of_week(ts), "is_weekend": timefn.is_weekend(ts), "time_of_day": timefn.time_of_day(timefn.hour(ts), "plain"), "processed": F.lit(False)})


def recent(points: DataFrame, limit: int = 100, **equal: str) -> DataFrame:
    """The latest points of a user or device, 1 to 1000 of them."""
    for column, value in equal.items():
        points = points.where(F.col(column) == value)
    return points.orderBy(F.desc("gps_ts"), F.desc("raw_id")).limit(min(1000, max(1, limit)))


def last_logins(logins: DataFrame) -> DataFrame:
    """The latest login of each (user, device), with the time of the first."""
    return logins.groupBy("user_id", "device_id").agg(F.max("login_ts").alias("last_login"), F.min("login_ts").alias("created_at"))
