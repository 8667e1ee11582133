"""Queries over agent sessions, streams, and the overall score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.operators import evaluate, redact, sessions
from veilspan.plans import box_queries, derived, duck, field_queries, page_queries, text_queries
from veilspan.sources import payloads
from veilspan.sources.tables import table
from veilspan.session import shared_folder
from veilspan.streaming import jobs

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


STEPS_SQL = f"steps AS (SELECT {', '.join(derived.STEPS)} FROM events)"
ORDER = ["ts", "event_id"]


# --- per session --------------------------------------------------------------------------------

@query(
    "session_telemetry",
    f"WITH {STEPS_SQL} SELECT session, count(*) AS n_steps, {duck.rounded('avg(ms)', 6)} AS avg_ms, max(ms) AS max_ms, min(ms) AS min_ms, "
    "quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms FROM steps GROUP BY 1",
)
def session_telemetry(spark, d):
    out = sessions.telemetry(derived.steps(spark, d), "session", "ms")
    return out.withColumn("avg_ms", F.round("avg_ms", 6))


@query(
    "running_best",
    f"WITH {STEPS_SQL} SELECT event_id, session, max(ms) OVER w AS best_ms, "
    "arg_max(event_type, {'ms': ms, 'ts': ts, 'e': event_id}) OVER w AS best_event_type FROM steps "
    "WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def running_best(spark, d):
    best = sessions.running_best(derived.steps(spark, d), "session", ORDER, "ms", "event_type")
    return best.select("event_id", "session", "best_ms", "best_event_type")


@query(
    "latest_status",
    f"WITH {STEPS_SQL} SELECT session, event_id, event, ms FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS n FROM steps) WHERE n = 1",
)
def latest_status(spark, d):
    return sessions.latest(derived.steps(spark, d), "session", ORDER, "event_id", "event", "ms")


@query(
    "recent_log",
    f"WITH {STEPS_SQL} SELECT session, event_id, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS n FROM steps) WHERE n <= 40",
)
def recent_log(spark, d):
    return sessions.newest(derived.steps(spark, d), "session", ORDER, 40).select("session", "event_id", "place")


@query(
    "step_sequence",
    f"WITH {STEPS_SQL} SELECT session, event_id, n AS step FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n FROM steps) WHERE n <= 40",
)
def step_sequence(spark, d):
    return sessions.first_steps(derived.steps(spark, d), "session", ORDER).select("session", "event_id", "step")


@query(
    "step_gaps",
    f"WITH {STEPS_SQL} SELECT event_id, session, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, event_id) AS gap_us, "
    "greatest(CAST(200 AS DOUBLE), CAST(2000 AS DOUBLE) - ms * 5) AS pause_ms FROM steps",
)
def step_gaps(spark, d):
    gaps = sessions.step_gaps(derived.steps(spark, d), "session", ORDER, c("ms") * 5)
    return gaps.select("event_id", "session", "gap_us", "pause_ms")


@query(
    "warm_latency",
    f"WITH {STEPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM steps) "
    f"SELECT event_type, count(*) AS n_runs, {duck.rounded('avg(ms)', 6)} AS warm_ms FROM r WHERE n > 1 GROUP BY 1",
)
def warm_latency(spark, d):
    out = sessions.warm_mean(derived.steps(spark, d), "event_type", ORDER, "ms")
    return out.withColumn("warm_ms", F.round("warm_ms", 6))


# The state machine in closed form, so that the check does not repeat the fold:
# what counts is the last pause, stop or fail, and what follows it.
_STATE_SQL = f"""WITH {STEPS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n FROM steps),
k AS (SELECT session, max(n) FILTER (WHERE event IN ('pause', 'stop', 'fail')) AS n0, count(*) AS n_events FROM o GROUP BY 1),
b AS (SELECT k.session, k.n_events, CASE x.event WHEN 'pause' THEN 'paused' WHEN 'stop' THEN 'done' WHEN 'fail' THEN 'error' ELSE 'idle' END AS base, coalesce(n0, 0) AS n0
  FROM k LEFT JOIN o x ON x.session = k.session AND x.n = k.n0),
a AS (SELECT b.session, b.base, b.n_events, min(o.n) FILTER (WHERE o.event = 'start') AS first_start, max(o.n) FILTER (WHERE o.event = 'ready') AS last_ready
  FROM b LEFT JOIN o ON o.session = b.session AND o.n > b.n0 GROUP BY 1, 2, 3)
SELECT session, CASE WHEN base = 'paused' AND last_ready IS NOT NULL THEN 'running' WHEN first_start IS NULL THEN base
  WHEN last_ready > first_start THEN 'running' ELSE 'loading' END AS state, n_events FROM a"""


@query("session_state", _STATE_SQL)
def session_state(spark, d):
    return sessions.final_states(derived.steps(spark, d), "session", ORDER, "event")


def _gap_sql(seconds: int) -> str:
    return f"""WITH {STEPS_SQL}, g AS (SELECT session, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, event_id) AS before, ts, event_id FROM steps),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before > {seconds * 1000000} THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT session, min(us) AS started_us, max(us) + {seconds * 1000000} AS ended_us, count(*) AS n_steps FROM n GROUP BY session, run"""


def _in_micros(df: DataFrame) -> DataFrame:
    return df.select(
        "session", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n_steps"
    )


@query("gap_sessions", _gap_sql(6 * 3600))
def gap_sessions(spark, d):
    return _in_micros(sessions.gap_sessions(derived.steps(spark, d), "session", ORDER, 6 * 3600))


# --- scores -------------------------------------------------------------------------------------------

_TARGETS = {"click": 300, "error": 50, "purchase": 600, "signup": 1500, "view": 1024}
_TARGET_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _TARGETS.items()) + " END"
_RESOURCE_SQL = f"""parts AS (SELECT event_type, avg(value) AS measured FROM events GROUP BY 1),
scored AS (SELECT event_type, measured, greatest(0, least(1, 1 - measured / {_TARGET_CASE})) AS score FROM parts)"""


def resource_parts(spark, d) -> DataFrame:
    """Mean of each measure against its target."""
    parts = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("measured"))
    score = F.lit(None).cast("double")
    for name, target in _TARGETS.items():
        score = F.when(c("event_type") == name, evaluate.under_target(c("measured"), target)).otherwise(score)
    return parts.withColumn("score", score)


@query(
    "resource_score",
    f"WITH {_RESOURCE_SQL} SELECT count(*) AS n_parts, {duck.rounded('avg(score)', 6)} AS score, {duck.rounded('avg(measured)', 6)} AS measured FROM scored",
)
def resource_score(spark, d):
    return resource_parts(spark, d).agg(
        F.count(F.lit(1)).alias("n_parts"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("measured"), 6).alias("measured")
    )


def metric_rows(spark, d) -> DataFrame:
    """The five metrics (0..100) as rows; each is a one-row aggregate."""
    def one(df: DataFrame, name: str, value) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), value.cast("double").alias("part"))

    quality = box_queries.quality(spark, d)
    text = evaluate.with_scores(evaluate.totals(text_queries.matched(spark, d), "category")).where("category = '(all)'")
    leak = text_queries.QUERIES["redaction_leakage"](spark, d)
    latency = table(spark, d, "events").agg(F.avg("value").alias("ms"))
    rows = [
        # one pass over the boxes serves two metrics
        quality.select(F.explode(F.array(
            F.struct(F.lit("M1").alias("metric"), (50 * c("category_accuracy") + 50 * c("box_recall")).alias("part")),
            F.struct(F.lit("M3").alias("metric"), (50 * c("box_precision")).alias("part")))).alias("m")).select("m.*"),
        one(text, "M2", 60 * c("f1")),
        one(field_queries.field_scores(spark, d), "M2", 40 * c("f1")),
        one(leak, "M3", 50 * F.least(F.lit(1.0), c("inside_share") / 0.95)),
        one(resource_parts(spark, d).agg(F.avg("score").alias("s")), "M4", 100 * c("s")),
        one(latency, "M5", 100 * evaluate.under_target(c("ms"), fv.ROUND_TRIP_TARGET_MS)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("metric").agg(F.sum("part").alias("score"))


_METRICS_SQL = f"""quality_row AS ({box_queries.ORACLES['box_quality']}),
text_row AS ({text_queries.ORACLES['eval_prf']}), field_row AS ({field_queries.ORACLES['field_prf']}),
leak_row AS ({text_queries.ORACLES['redaction_leakage']}), {_RESOURCE_SQL},
metric_parts AS (SELECT 'M1' AS metric, 50 * category_accuracy + 50 * box_recall AS part FROM quality_row
  UNION ALL SELECT 'M2', 60 * f1 FROM text_row WHERE category = '(all)' UNION ALL SELECT 'M2', 40 * f1 FROM field_row
  UNION ALL SELECT 'M3', 50 * box_precision FROM quality_row UNION ALL SELECT 'M3', 50 * least(1, inside_share / 0.95) FROM leak_row
  UNION ALL SELECT 'M4', 100 * avg(score) FROM scored
  UNION ALL SELECT 'M5', 100 * greatest(0, least(1, 1 - avg(value) / 8000)) FROM events),
metrics AS (SELECT metric, sum(part) AS score FROM metric_parts GROUP BY 1),
weights(metric, weight) AS (VALUES {', '.join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in fv.METRIC_WEIGHTS.items())})"""


def _pivoted(spark, d) -> DataFrame:
    metrics = metric_rows(spark, d)
    return metrics.agg(*[F.max(F.when(c("metric") == m, c("score"))).alias(m) for m in fv.METRIC_WEIGHTS])


@query(
    "composite_score",
    f"WITH {_METRICS_SQL} SELECT {duck.rounded('sum(score * weight)', 4)} AS overall FROM metrics JOIN weights USING (metric)",
)
def composite_score(spark, d):
    scores = {m: c(m) for m in fv.METRIC_WEIGHTS}
    return _pivoted(spark, d).select(F.round(evaluate.composite(scores), 4).alias("overall"))


@query(
    "eval_report",
    f"WITH {_METRICS_SQL} SELECT " + ", ".join(
        f"{duck.rounded(f'max(CASE WHEN metric = {chr(39)}{m}{chr(39)} THEN score END)', 4)} AS {m.lower()}" for m in fv.METRIC_WEIGHTS
    ) + f", {duck.rounded('sum(score * weight)', 4)} AS overall FROM metrics JOIN weights USING (metric)",
)
def eval_report(spark, d):
    """All scores in one row, written as a JSON report and read back."""
    scores = {m: c(m) for m in fv.METRIC_WEIGHTS}
    row = _pivoted(spark, d).select(
        *[F.round(m, 4).alias(m.lower()) for m in fv.METRIC_WEIGHTS],
        F.round(evaluate.composite(scores), 4).alias("overall"),
    )
    folder = shared_folder(spark, "report")
    payloads.write_report(row, folder)
    return spark.read.schema(row.schema).json(folder)


# --- streams ------------------------------------------------------------------------------------------------

def steps_stream(spark, d) -> DataFrame:
    events = jobs.table_stream(spark, d, "events").selectExpr(*derived.STEPS)
    return events.withColumn("ts", c("ts").cast("timestamp"))


def steps_history(spark, d) -> DataFrame:
    return derived.steps(spark, d).withColumn("ts", c("ts").cast("timestamp"))


@query("stream_scrub", text_queries.ORACLES["scrub_text"])
def stream_scrub(spark, d):
    stream = jobs.scrubbed(jobs.table_stream(spark, d, "documents").select("doc_id", "text"))
    return jobs.drained(spark, stream.select("doc_id", "scrubbed"), "stream-scrub")


@query(
    "stream_scrub_stats",
    f"WITH {duck.scrub_ctes('documents', 'doc_id, source', 'text')} SELECT source, count(*) AS n_bodies, "
    "CAST(sum(CASE WHEN scrubbed <> text THEN 1 ELSE 0 END) AS BIGINT) AS n_scrubbed FROM scrubbed GROUP BY 1",
)
def stream_scrub_stats(spark, d):
    stream = jobs.scrub_counts(jobs.table_stream(spark, d, "documents").select("source", "text"))
    return jobs.drained_updates(spark, stream, "stream-stats", ["source"])


@query("stream_log", page_queries.ORACLES["agent_log"])
def stream_log(spark, d):
    """Payloads of streamed pages; only their log lines are kept."""
    pages = jobs.table_stream(spark, d, "pages").selectExpr(*derived.FORM_PAGES)
    built = payloads.build(payloads.audited_rows(pages), ["page_id"], task="Fill the form")
    folder = shared_folder(spark, "stream-log")

    def write(batch: DataFrame, target: str) -> None:
        payloads.log_rows(batch, ["page_id"]).write.mode("overwrite").parquet(target)

    jobs.each_batch(built, folder, write)
    return page_queries.shown_log(jobs.written(spark, folder).drop("batch"))


@query(
    "stream_step_window",
    f"WITH {STEPS_SQL} SELECT session, epoch_us(date_trunc('hour', ts)) AS started_us, count(*) AS n_steps, max(ms) AS max_ms FROM steps GROUP BY 1, 2",
)
def stream_step_window(spark, d):
    windows = jobs.step_windows(steps_stream(spark, d), watermark=jobs.span_of(steps_history(spark, d)))
    out = jobs.drained_updates(spark, windows, "stream-windows", ["session", "started"])
    return out.select("session", F.unix_micros("started").alias("started_us"), "n_steps", "max_ms")


@query("stream_sessions", _gap_sql(fv.TASK_TIMEOUT_SECONDS))
def stream_sessions(spark, d):
    history = steps_history(spark, d)
    marked, finish = jobs.with_end_mark(spark, steps_stream(spark, d).select("session", "ts"), history, "stream-end")
    out = jobs.drained(spark, jobs.idle_sessions(marked, watermark=jobs.span_of(history)), "stream-sessions", finish)
    return _in_micros(out.where("session >= 0"))


@query("stream_session_state", _STATE_SQL)
def stream_session_state(spark, d):
    folder = shared_folder(spark, "stream-states")
    jobs.session_parts(steps_stream(spark, d), folder)
    return jobs.states(spark, folder).drop("n_late")


@query("stream_dedupe", f"WITH {STEPS_SQL} SELECT session, event_id FROM steps")
def stream_dedupe(spark, d):
    """Every step sent twice, kept once."""
    steps = steps_stream(spark, d).select("session", "event_id", "ts")
    repeated = steps.unionByName(steps_stream(spark, d).select("session", "event_id", "ts"))
    once = jobs.without_repeats(repeated, watermark=jobs.span_of(steps_history(spark, d)))
    return jobs.drained(spark, once.select("session", "event_id"), "stream-dedupe")


@query(
    "redacted_labels",
    f"""WITH {text_queries._REGIONS}, r AS (SELECT doc_id, sum(r_end - r_start) AS altered FROM regions GROUP BY 1)
SELECT CAST(l.quality AS BIGINT) AS quality, count(*) AS n_docs, CAST(coalesce(sum(altered), 0) AS BIGINT) AS altered_chars FROM labels l LEFT JOIN r ON r.doc_id = l.doc_id GROUP BY 1""",
)
def redacted_labels(spark, d):
    """Masked characters by quality label; only the counts travel to the join."""
    docs = derived.planted_documents(spark, d)
    altered = redact.audit(redact.redacted(docs, "doc_id", style="solid"), "doc_id").select("doc_id", "altered_chars")
    joined = table(spark, d, "labels").join(altered, "doc_id", "left")
    return joined.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("altered_chars"), F.lit(0)).alias("altered_chars")
    )
