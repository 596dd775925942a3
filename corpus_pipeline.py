"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept;
all but the last return the columns of documents. Models are fitted on the labelled
rows among the stage's own documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import neardup, packing, quality, secret_scan, toxicity
from tracewell.llm.common import materialise, passing_tables
from tracewell.llm.queries import BYTE_BPE, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic; null and empty texts stay, repeated rows are judged alike, no rows give none."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality the byte network scores one half or more; null texts are scored as empty ones, repeated rows alike, no rows give none."""
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each component of documents that share four fifths of their five-word shingles.

    Rows without words stay, of repeated rows one stays, no rows give none.
    """
    return neardup.drop_near_duplicates(docs, shingle=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; null texts stay null, repeated rows stay, no rows give none."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences in the order of the space-filling curve; null texts are one end token, repeated rows are packed each, no rows give none."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack)]

#: No stage's model can be stated in SQL; tests hold the pipeline against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again before the next; what lies between is deleted at the end."""
    docs = table(spark, sf_dir, "documents")
    with passing_tables(spark):
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return materialise(stage(spark, docs, sf_dir), name, outside=True)
