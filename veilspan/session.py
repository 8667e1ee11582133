"""Session defaults and the shared folder for checkpoints and streaming tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "veilspan") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor can reach.

    It lies under ``spark.checkpoint.dir``.  Only a local master may do without
    that setting; a cluster would lose what it wrote to one machine's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_LOCAL: list[str] = []


def _local_root() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="veilspan-"))
    return _LOCAL[0]


def checkpoints_on(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable; the cluster's own setting wins."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoint"))


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


#: Rows of a partition below which a checkpoint is not cut further.
ROWS = 1 << 16


def few(df: DataFrame, rows: int) -> DataFrame:
    """The same in no more partitions than about so many rows need, one a core at least.

    A checkpoint writes a file for each partition, and without Hadoop's native library the local file system
    starts two processes for a file.
    """
    return df.coalesce(max(cores(df.sparkSession), -(-rows // ROWS)))


def path_of(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
