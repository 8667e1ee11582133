"""From raw documents to tokens: five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import bpe, mixing, pii, shingles, toxicity
from veilspan.llm.common import small_batches, table
from veilspan.session import shared_folder


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; the model learns from the labelled documents of the table."""
    small_batches(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id."""
    small_batches(spark)
    return shingles.without_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    small_batches(spark)
    return _counted(pii.scrub(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken; the last one of a source is cut at its budget."""
    return _counted(mixing.written(mixing.mix(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the packed token ids, their number, and digests of ids and decoded text."""
    import public_tokenizers

    small_batches(spark)
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the texts are now."""
    chars = F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))
    return docs.select(*[chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: Shingle sets, the field's scores and merges are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``; the stages between are written to the shared folder."""
    folder = shared_folder(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
