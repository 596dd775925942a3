"""What the text operators share: scratch tables, Arrow text buffers, components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.components import connected_components as connected_components
from tracewell.sources.tables import at_rest as materialise
from tracewell.sources.tables import passing_tables

#: Bytes of one Arrow batch sent to a Python worker, and of the slice of it that
#: a vectorised kernel works on at once. Both bound a worker's memory.
BATCH_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
#: Strings of one generation of a worker's memory; it keeps two.
REMEMBERED = 150_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that every operator here relies on.

    Bounds Arrow batches by bytes, so very long texts never add up in a worker, and
    lets executors import this package when it isn't installed on them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of batch whose texts add up to limit bytes at most, or that have one row."""
    _, at = utf8(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings, nulls as empty ones."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def forest_roots(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): each node's root over links (a, b), where every b has one parent a, less than b.

    Pointer jumping: each round doubles the distance that a node looks up, by one join.
    Roots themselves aren't listed. Repeated links give repeated nodes; no links give no rows.
    """
    with passing_tables(links.sparkSession):
        known = materialise(links.select(F.col("b").alias("node"), F.col("a").alias("component")), "roots")
        for _ in range(max_rounds):
            up = known.select(F.col("node").alias("component"), F.col("component").alias("higher"))
            moved = materialise(known.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component"), F.col("higher").isNotNull().alias("moved")), "roots")
            known = moved.select("node", "component")
            if moved.where("moved").isEmpty():
                return materialise(known, "roots", outside=True)
    raise RuntimeError(f"roots did not settle in {max_rounds} rounds")


def first_by_hash(df: DataFrame, column: str, most: int) -> DataFrame:
    """The `most` first rows of df by the hash of a column: a sample that is bounded at any size and alike whatever the partitions."""
    return df.orderBy(F.xxhash64(column), column).limit(most)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


class Remembered:
    """A function of a string with a bounded memory of two generations; strings of over 64 characters aren't kept."""

    def __init__(self, function: Callable[[str], Any]):
        self.function, self.young, self.old = function, {}, {}

    def __call__(self, key: str):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.function(key)
            if len(key) <= 64:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[key] = found
        return found

    def all(self, keys: list[str]) -> list:
        recent = self.young.get
        return [recent(k) or self(k) for k in keys]
