"""Streams over folders of files out of time order, in many micro-batches, against DuckDB on the whole tables."""

import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.compare import TABLES, check, duck
from veilspan.plans import registry, session_queries
from veilspan.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQLS = registry.queries(), registry.oracle_sql()
NAMES = [n for n in QUERIES if n.startswith("stream_")]


@pytest.fixture(scope="module")
def split_dir(tmp_path_factory):
    """The tables as folders of 20 files; rows are dealt out so that every file spans all of the time."""
    top = tmp_path_factory.mktemp("split")
    for name in TABLES:
        if name not in ("events", "documents", "pages"):
            os.symlink(f"{SF_DIR}/{name}.parquet", top / f"{name}.parquet")
            continue
        rows = pq.read_table(f"{SF_DIR}/{name}.parquet")
        os.makedirs(top / f"{name}.parquet")
        for i in range(20):
            pq.write_table(rows.take([k for k in range(rows.num_rows) if k * 7 % 20 == i][::-1]), top / f"{name}.parquet/part-{19 - i:02}.parquet")
    return str(top)


@pytest.mark.parametrize("name", NAMES)
def test_many_batches_out_of_order(spark, monkeypatch, split_dir, name):
    monkeypatch.setattr(jobs, "FILES_PER_BATCH", 7 if name in ("stream_sessions", "stream_dedupe") else 3)
    assert check(spark, duck(SF_DIR), name, QUERIES[name], SQLS[name], split_dir) is None


def test_late_events_are_counted(spark, tmp_path, monkeypatch, split_dir):
    monkeypatch.setattr(jobs, "FILES_PER_BATCH", 5)
    jobs.session_parts(session_queries.steps_stream(spark, split_dir), str(tmp_path))
    rows = jobs.states(spark, str(tmp_path)).agg(F.sum("n_late").alias("late"), F.sum("n_events").alias("n")).first()
    assert 0 < rows.late < rows.n == spark.read.parquet(f"{SF_DIR}/events.parquet").count()


def test_polled_query_runs_until_stopped(spark, tmp_path, split_dir):
    stream = jobs.scrubbed(jobs.table_stream(spark, split_dir, "documents", 5).select("doc_id", "text"))
    monkey_tick, jobs.TICK = jobs.TICK, "200 milliseconds"
    try:
        query = jobs.append_to(stream.select("doc_id", "scrubbed"), str(tmp_path), drain=False)
        until = time.time() + 60
        while time.time() < until and len([p for p in query.recentProgress if p["numInputRows"]]) < 4:
            time.sleep(0.2)
        assert query.isActive
        query.stop()
    finally:
        jobs.TICK = monkey_tick
    assert jobs.written(spark, str(tmp_path)).count() == 200


def test_rows_behind_the_watermark_are_reported(spark, tmp_path, monkeypatch, split_dir):
    monkeypatch.setattr(jobs, "FILES_PER_BATCH", 2)
    windows = jobs.step_windows(session_queries.steps_stream(spark, split_dir), watermark="1 second")
    query = jobs.each_batch(windows, str(tmp_path), mode="update")
    kept = jobs.last_update(spark, str(tmp_path), ["session", "started"]).agg(F.sum("n_steps")).first()[0]
    everything = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    assert jobs.rows_dropped(query) > 0 and kept < everything
