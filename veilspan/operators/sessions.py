"""Ordered work per session that survives a session with a large part of all rows.

A session's timeline is cut into fixed time slices.  Windows run inside
(session, slice); one small summary row per slice carries what the next slices
need.  A window over a whole session only ever sees its summary rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv

SLICE = "10 minutes"
LEVELS = ("1 second", "1 hour")
PERCENTILES = (0.5, 0.95)


def sliced(df: DataFrame, ts: str = "ts", width: str = SLICE) -> DataFrame:
    """Adds the start of the fixed time slice (``_slice``)."""
    return df.withColumn("_slice", F.window(F.col(ts).cast("timestamp"), width)["start"])


def _in_slice(session: str, order: Sequence[str]) -> Window:
    return Window.partitionBy(session, "_slice").orderBy(*order)


def _earlier(session: str) -> Window:
    return Window.partitionBy(session).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def with_previous(
    df: DataFrame, session: str, order: Sequence[str], column: str, name: str, width: str = SLICE
) -> DataFrame:
    """Adds the previous row's ``column`` within the session (a lag).

    The first row of a slice takes the last value of the slice before it.
    """
    rows = sliced(df, order[0], width)
    last = rows.groupBy(session, "_slice").agg(
        F.max_by(F.col(column), F.struct(*order)).alias("_last")
    )
    carried = last.select(
        session, "_slice", F.lag("_last").over(Window.partitionBy(session).orderBy("_slice")).alias("_carry")
    )
    return (
        rows.withColumn("_lag", F.lag(column).over(_in_slice(session, order)))
        .join(carried, [session, "_slice"])
        .withColumn(name, F.coalesce("_lag", "_carry"))
        .drop("_lag", "_carry", "_slice")
    )


def step_gaps(df: DataFrame, session: str, order: Sequence[str], took_ms: Column, width: str = SLICE) -> DataFrame:
    """Time since the previous step, and the pause a polled loop would make."""
    micros = F.unix_micros(F.col(order[0]).cast("timestamp"))
    rows = with_previous(df.withColumn("_us", micros), session, order, "_us", "_before", width)
    pause = F.greatest(F.lit(float(fv.MIN_PAUSE_MS)), F.lit(float(fv.POLL_MS)) - took_ms)
    return rows.withColumn("gap_us", F.col("_us") - F.col("_before")).withColumn("pause_ms", pause).drop("_us", "_before")


def running_best(
    df: DataFrame, session: str, order: Sequence[str], score: str, kept: str, width: str = SLICE
) -> DataFrame:
    """Best row so far by ``score``; of equal scores the latest.  Adds ``best_<kept>``."""
    entry = F.struct(F.col(score).alias("s"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(kept).alias("v"))
    rows = sliced(df, order[0], width).withColumn("_e", entry)
    slices = rows.groupBy(session, "_slice").agg(F.max("_e").alias("_top"))
    carried = slices.select(session, "_slice", F.max("_top").over(_earlier(session)).alias("_carry"))
    within = _in_slice(session, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.greatest(F.col("_here"), F.col("_carry"))
    return (
        rows.withColumn("_here", F.max("_e").over(within))
        .join(carried, [session, "_slice"])
        .withColumn("_b", best)
        .withColumn(f"best_{score}", F.col("_b.s"))
        .withColumn(f"best_{kept}", F.col("_b.v"))
        .drop("_e", "_here", "_carry", "_b", "_slice")
    )


def latest(df: DataFrame, session: str, order: Sequence[str], *kept: str) -> DataFrame:
    """Newest row per session, as a plain aggregate with partial maxima."""
    newest = F.max(F.struct(*order, *[k for k in kept if k not in order])).alias("_n")
    return df.groupBy(session).agg(newest).select(session, *[F.col(f"_n.{k}").alias(k) for k in kept])


def newest(df: DataFrame, session: str, order: Sequence[str], n: int, name: str = "place") -> DataFrame:
    """Newest ``n`` rows per session; each partition is limited before the shuffle."""
    place = Window.partitionBy(session).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn(name, F.row_number().over(place)).where(F.col(name) <= n)


def first_steps(df: DataFrame, session: str, order: Sequence[str], n: int = fv.MAX_STEPS, name: str = "step") -> DataFrame:
    """Steps numbered from 1, cut where a run would stop."""
    place = Window.partitionBy(session).orderBy(*order)
    return df.withColumn(name, F.row_number().over(place)).where(F.col(name) <= n)


# --- session state ------------------------------------------------------------------------

STATES = ["idle", "loading", "running", "paused", "done", "error"]
# event -> state reached from each of STATES, in that order
TRANSITIONS = {
    "start": ["loading", "loading", "running", "loading", "loading", "loading"],
    "ready": ["idle", "running", "running", "running", "done", "error"],
    "pause": ["paused"] * 6,
    "stop": ["done"] * 6,
    "fail": ["error"] * 6,
}


def _function_of(event: Column) -> Column:
    """The state each of the six states goes to, as an array of indexes."""
    identity = F.array(*[F.lit(i) for i in range(len(STATES))])
    out = None
    for name, targets in TRANSITIONS.items():
        vector = F.array(*[F.lit(STATES.index(t)) for t in targets])
        out = F.when(event == name, vector) if out is None else out.when(event == name, vector)
    return out.otherwise(identity)


def _compose(functions: Column) -> Column:
    identity = F.array(*[F.lit(i) for i in range(len(STATES))])
    return F.aggregate(
        functions, identity, lambda acc, f: F.transform(acc, lambda s: F.get(f, s))
    )


def per_second(df: DataFrame, session: str, order: Sequence[str], event: str) -> DataFrame:
    """(session, _ts, _rows): the events of each second as functions from state to state, each with its place in the order."""
    second = F.window(F.col(order[0]).cast("timestamp"), LEVELS[0])["start"].alias("_ts")
    row = F.struct(F.struct(*order).alias("_at"), _function_of(F.col(event)).alias("_f"))
    return df.groupBy(session, second).agg(F.collect_list(row).alias("_rows"))


def states_of(parts: DataFrame, session: str, levels: Sequence[str] = LEVELS[1:]) -> DataFrame:
    """State of each session after all its events; parts of one second may come in several rows."""
    in_order = F.transform(F.array_sort(F.flatten(F.collect_list("_rows"))), lambda r: r["_f"])
    rows = parts.groupBy(session, "_ts").agg(_compose(in_order).alias("_f"), F.sum(F.size("_rows")).cast("long").alias("_n"))
    composed = [
        _compose(F.transform(F.array_sort(F.collect_list(F.struct("_ts", "_f"))), lambda r: r["_f"])).alias("_f"), F.sum("_n").alias("_n")]
    for width in levels:
        rows = rows.groupBy(session, F.window("_ts", width)["start"].alias("_slice")).agg(*composed).withColumnRenamed("_slice", "_ts")
    names = F.array(*[F.lit(s) for s in STATES])
    return rows.groupBy(session).agg(*composed).select(
        session, F.get(names, F.get("_f", F.lit(0))).alias("state"), F.col("_n").alias("n_events")
    )


def final_states(df: DataFrame, session: str, order: Sequence[str], event: str) -> DataFrame:
    """State of each session after all its events.

    A run of events is a function from state to state, and such functions
    compose.  Events are composed per second, seconds per hour, hours per
    session: every list is bounded by its time level, also in a session that
    holds a large part of all rows.
    """
    return states_of(per_second(df, session, order, event), session)


def gap_sessions(
    df: DataFrame, session: str, order: Sequence[str],
    timeout_s: int = fv.TASK_TIMEOUT_SECONDS, width: str = SLICE,
) -> DataFrame:
    """Runs of steps with no pause above ``timeout_s``: start, end, number of steps.

    One sorted pass cuts each slice into runs; the runs, one or a few a slice, are
    then joined up along the session where no long pause lies between.
    """
    pause = timeout_s * 1_000_000
    rows = sliced(df.select(session, *order, F.unix_micros(F.col(order[0]).cast("timestamp")).alias("_us")), order[0], width)
    here = _in_slice(session, order)
    opens = F.coalesce(F.col("_us") - F.lag("_us").over(here) > pause, F.lit(False)).cast("long")
    rows = rows.withColumn("_opens", opens)
    rows = rows.withColumn("_run", F.sum("_opens").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy(session, "_slice", "_run").agg(F.min("_us").alias("_from"), F.max("_us").alias("_to"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(session).orderBy("_from")
    runs = runs.withColumn("_opens", F.coalesce(F.col("_from") - F.lag("_to").over(along) > pause, F.lit(True)).cast("long"))
    runs = runs.withColumn("_run", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (
        runs.groupBy(session, "_run")
        .agg(F.timestamp_micros(F.min("_from")).alias("started"), F.timestamp_micros(F.max("_to") + pause).alias("ended"),
             F.sum("_n").alias("n_steps"))
        .drop("_run")
    )


def telemetry(df: DataFrame, session: str, value: str) -> DataFrame:
    return df.groupBy(session).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.avg(value).alias("avg_ms"),
        F.max(value).alias("max_ms"),
        F.min(value).alias("min_ms"),
        *[F.percentile_approx(value, p, 10_000).alias(f"p{round(p * 100)}_ms") for p in PERCENTILES],
    )


def warm_mean(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Mean without each key's first run: totals minus the first, one aggregate."""
    first = F.min_by(F.col(value), F.struct(*order))
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(n.alias("_n"), F.sum(value).alias("_s"), first.alias("_f")).select(
        key, (F.col("_n") - 1).alias("n_runs"),
        F.when(F.col("_n") > 1, (F.col("_s") - F.col("_f")) / (F.col("_n") - 1)).alias("warm_ms"),
    )
