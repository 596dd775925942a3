"""Runs of a clustering job: an append-only table of their states, and what is read off it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.tables import append

SCHEMA = "run_id string, user_id string, status string, started_at long, ended_at long, error string"


def record(spark: SparkSession, path: str, run_id: str, user_id: str, status: str, started_at: int, ended_at: int | None = None, error: str | None = None) -> None:
    """Append a state of a run: running, completed or failed; times are given by the caller, so a repeat writes the same."""
    if status not in ("running", "completed", "failed"):
        raise ValueError(f"unknown status {status}")
    append(spark.createDataFrame([(run_id, user_id, status, started_at, ended_at, error)], SCHEMA), path)


def current(states: DataFrame) -> DataFrame:
    """The last state of each run: one that has ended beats one that is running."""
    order = F.struct(F.col("ended_at").isNotNull(), F.coalesce("ended_at", "started_at"), "status")
    last = states.groupBy("run_id", "user_id").agg(F.max_by(F.struct("status", "started_at", "ended_at", "error"), order).alias("s"))
    return last.select("run_id", "user_id", "s.*")


def latest(runs: DataFrame) -> DataFrame:
    """(user_id, run_id, started_at): each user's latest run that is running or completed; of runs begun together that of the greatest id."""
    good = runs.where(F.col("status").isin("running", "completed"))
    return good.groupBy("user_id").agg(F.max(F.struct("started_at", "run_id")).alias("s")).select("user_id", "s.run_id", "s.started_at")


def of_latest(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows (user_id, run_id, ..) of each user's latest run, without their run_id; of users without a good run none."""
    return rows.join(latest(runs).select("user_id", "run_id"), ["user_id", "run_id"], "left_semi").drop("run_id")


def rebuilt_clusters(cells: DataFrame, runs: DataFrame, visits: DataFrame) -> DataFrame:
    """user_clusters() of the labelled cells (run_id, ..) of each user's latest run, as a whole: clusters that only an older run has are gone."""
    from tracewell.operators.clusters import user_clusters

    return user_clusters(of_latest(cells, runs), visits)
