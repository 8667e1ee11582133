"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import crc_rest


def held_out(n: int, rest: int) -> F.Column:
    """Rows that no model may learn from; a null doc_id is never held out."""
    return F.coalesce(crc_rest("doc_id", n) == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, n: int, rest: int, rows: int) -> DataFrame:
    """(text, label) of about ``rows`` labelled documents that are not held out, chosen by a hash of doc_id.

    Only labels 0 and 1 count; of repeated labels of a document the largest holds,
    of repeated rows of a document the one with the smallest text, a null being
    empty.  The chosen ids are at most ``rows``, so they are broadcast; the rows of
    an id become one before the driver sees them, first inside each task.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(n, rest))
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toArrow()
    ids = spark.createDataFrame(chosen.to_pandas(), "doc_id long, label int")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
