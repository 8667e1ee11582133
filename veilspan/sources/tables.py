"""Read the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspan.session import cores, path_of


#: Bytes of files whose rows are one task's, and tasks at most.
TASK, MOST_TASKS = 2 << 20, 10_000
#: Rows with long texts that are one task's, some seconds of work: files may hold many pages in few bytes.
ROWS = {"pages": 200, "documents": 2000, "conversations": 2000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(path_of(sf_dir, name))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Give a costly scan enough tasks.

    A row group is read by one task, and some hundred megabytes of pages take that task
    an hour.  The round-robin shuffle moves the rows once and needs no listing of splits;
    a task gets about ``TASK`` bytes of files, by the estimate of the plan, and no
    more than a core's share; with ``rows``, also about as many rows at most.  They are
    counted from the footers of the files.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(-(-size // TASK), -(-df.count() // rows) if rows else 1)
    return df.repartition(max(cores(df.sparkSession), min(MOST_TASKS, tasks)))


def text_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Chosen columns of a table with long texts, spread over the cores."""
    df = table(spark, sf_dir, name)
    return spread(df.select(*columns) if columns else df, ROWS.get(name))
