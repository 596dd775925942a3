"""Bounded samples of labelled documents, and models that are fitted on them in a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import prepare

Model = TypeVar("Model")

#: Characters of whole texts that a sample brings to the driver at most, and of one text that is learned from.
MOST_CHARACTERS, LONGEST = 64_000_000, 1_000_000


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int], characters: int = MOST_CHARACTERS) -> DataFrame:
    """(text, y) in one partition: bounds[y] rows at most of each label y, in the order of their hash.

    Held-out rows are left out, null labels and ids too; of several labels of one
    document the least counts, of several texts the least, null texts are empty. The
    first ids by hash are taken, so the same rows are picked whatever the partitions and
    however many there are; then whole texts in that order while they add up to
    `characters` at most, leaving out those of over LONGEST.
    """
    known = labels.where(labels["doc_id"].isNotNull() & labels[label].isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    picked = reduce(DataFrame.unionAll, [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(most) for y, most in sorted(bounds.items())])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).where(F.length("text") <= LONGEST)
    place = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over the few rows of the sample
    within = texts.withColumn("h", F.xxhash64("doc_id", "y")).withColumn("size", F.sum(F.length("text")).over(place)).where(F.col("size") <= characters)
    return within.coalesce(1).sortWithinPartitions("h", "doc_id").select("text", "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int], characters: int = MOST_CHARACTERS) -> list[tuple[str, int]]:
    """The rows of sample_rows() as a list on the driver."""
    found = sample_rows(docs, labels, label, bounds, characters).toArrow()
    return list(zip(found.column("text").to_pylist(), found.column("y").to_pylist(), strict=True))


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], Model]) -> Model:
    """What fit makes of the rows of sample_rows(), in one task: the driver holds neither the texts nor what the fit needs, only the model."""
    prepare(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    found = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([])
