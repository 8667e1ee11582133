"""Structured Streaming jobs: scrub what passes, log it, count it, and follow sessions.

Every job writes to files in a shared folder, one sub-folder per micro-batch
where a batch may be repeated, so a restart after a lost executor or driver
neither loses nor doubles rows.  Nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions import scrub
from veilspan.operators import sessions
from veilspan.session import cores, shared_folder

WATERMARK = "10 minutes"
TICK = f"{fv.POLL_MS // 1000} seconds"
#: Files a micro-batch takes at most; None: all there are.
FILES_PER_BATCH: int | None = None


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table, a file or a folder of files, as a file stream; the schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch or FILES_PER_BATCH:
        reader = reader.option("maxFilesPerTrigger", files_per_batch or FILES_PER_BATCH)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def span_of(history: DataFrame, ts: str = "ts") -> str:
    """A watermark under which no row of a finished table is late, in whatever order its files come.

    A replay of a table in files knows no order of time.  A live stream keeps
    ``WATERMARK``; what it drops is counted by :func:`rows_dropped`.
    """
    seconds = history.agg((F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts))).alias("s")).first()["s"]
    return f"{(seconds or 0) + 1} seconds"


def rows_dropped(query) -> int:
    """Rows that came behind the watermark, over the batches a query still reports."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def _start(writer, drain: bool):
    """Drain what is there and stop, or keep polling."""
    return writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=TICK)


def append_to(stream: DataFrame, folder: str, drain: bool = True):
    """Append-only sink with exactly-once files.  Returns the query, finished when drained."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/_state")
    query = _start(writer, drain).start(f"{folder}/rows")
    if drain:
        query.awaitTermination()
    return query


def each_batch(
    stream: DataFrame, folder: str, write: Callable[[DataFrame, str], None] | None = None,
    mode: str = "append", drain: bool = True,
):
    """Runs ``write(batch, target)`` per micro-batch; by default a parquet folder per batch.

    A repeated batch overwrites its own folder.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        target = f"{folder}/rows/batch={batch_id}"
        if write:
            write(batch, target)
        else:
            batch.write.mode("overwrite").parquet(target)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/_state").foreachBatch(sink)
    query = _start(writer, drain).start()
    if drain:
        query.awaitTermination()
    return query


def written(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows")


def last_update(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Newest version of each key of an update-mode log."""
    rows = written(spark, folder)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("_v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_v.*")


# --- scrubbing --------------------------------------------------------------------------------

def scrubbed(stream: DataFrame, text: str = "text") -> DataFrame:
    """Each outgoing text, scrubbed; stateless."""
    return stream.withColumn("scrubbed", scrub.scrub_text(text))


def scrub_counts(stream: DataFrame, by: str = "source") -> DataFrame:
    """Running counters of scrubbed bodies."""
    return scrubbed(stream).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_bodies"),
        F.sum((F.col("scrubbed") != F.col("text")).cast("long")).alias("n_scrubbed"),
    )


# --- sessions ------------------------------------------------------------------------------------

def step_windows(steps: DataFrame, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Steps per session in tumbling windows."""
    return (
        steps.withWatermark("ts", watermark)
        .groupBy("session", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_steps"), F.max("ms").alias("max_ms"))
        .select("session", F.col("w.start").alias("started"), "n_steps", "max_ms")
    )


def idle_sessions(steps: DataFrame, timeout_s: int = fv.TASK_TIMEOUT_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """Sessions that end after ``timeout_s`` without a step."""
    return (
        steps.withWatermark("ts", watermark)
        .groupBy("session", F.session_window("ts", f"{timeout_s} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_steps"))
        .select("session", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_steps")
    )


def without_repeats(steps: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """One row per (session, step) although a step may be sent again."""
    return steps.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session", "event_id"])


def session_parts(steps: DataFrame, folder: str, drain: bool = True):
    """Writes the events of each micro-batch by session and second; ``states`` composes them.

    Nothing is folded in order of arrival, so a late event takes its place in time.
    """
    def write(batch: DataFrame, target: str) -> None:
        sessions.per_second(batch, "session", ["ts", "event_id"], "event").write.mode("overwrite").parquet(target)

    return each_batch(steps, folder, write, drain=drain)


def states(spark: SparkSession, folder: str) -> DataFrame:
    """session, state, n_events, and n_late: events that came in a later batch than one of a later second."""
    parts = written(spark, folder)
    ends = parts.groupBy("session", "batch").agg(F.max("_ts").alias("_end"))
    earlier = Window.partitionBy("session").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_end", F.max("_end").over(earlier))
    late = parts.join(ends, ["session", "batch"]).groupBy("session").agg(
        F.sum(F.when(F.col("_ts") < F.col("_end"), F.size("_rows")).otherwise(0)).alias("n_late"))
    return sessions.states_of(parts.drop("batch"), "session").join(late, "session")


# --- drained runs: a finite replay to a finished table ------------------------------------------------

@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """What a drained run sets, and sets back: sessions merge inside each partition before the shuffle, so a busy one
    arrives merged; a local master keeps one state store per core."""
    wanted = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}
    if spark.sparkContext.master.startswith("local["):
        key = "spark.sql.shuffle.partitions"
        wanted[key] = str(min(int(spark.conf.get(key)), cores(spark)))
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def drained(spark: SparkSession, stream: DataFrame, name: str, finish: Callable[[], None] | None = None) -> DataFrame:
    """The rows of a stream run to its end; ``finish`` may then add a last file, which is drained too."""
    folder = shared_folder(spark, name)
    with _settings(spark):
        append_to(stream, folder)
        if finish:
            finish()
            append_to(stream, folder)
    return written(spark, folder)


def drained_updates(spark: SparkSession, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    folder = shared_folder(spark, name)
    with _settings(spark):
        each_batch(stream, folder, mode="update")
    return last_update(spark, folder, keys)


def with_end_mark(spark: SparkSession, steps: DataFrame, history: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """A replayed stream, and what adds one late row to it that lets the watermark close everything.

    A live stream needs none: later events move its watermark.  The row has
    session -1 and must come last, after all files of the replay.
    """
    folder = shared_folder(spark, name)
    after = F.make_interval(days=F.lit(1), secs=2.0 * (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))))
    mark = history.agg((F.max("ts") + after).alias("ts")).select(
        *[
            F.col("ts") if f.name == "ts"
            else (F.lit(-1) if f.name in ("session", "event_id") else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in steps.schema.fields
        ]
    )
    mark.limit(0).write.parquet(folder)

    def finish() -> None:
        mark.coalesce(1).write.mode("append").parquet(folder)

    return steps.unionByName(spark.readStream.schema(steps.schema).parquet(folder)), finish
