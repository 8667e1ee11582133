"""JSON payloads: intake, the outgoing payload of a page, its log line, and the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions import fixed_values as fv
from veilspan.functions import scrub
from veilspan.functions.spans import let_sql
from veilspan.operators import detect, redact
from veilspan.sources import pages as pg

SCHEMA_TAG = "veilspan/1"
REPORT_VERSION = "1.0"

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PAYLOAD = struct(
    schema=_S,
    redaction=struct(
        scheme=_S, version=_S, categories=T.MapType(_S, _L), faceCount=_L,
        audit=struct(pixelDelta=_D, byteDelta=_D, redactionCoverage=_D),
    ),
    viewport=struct(w=_I, h=_I, scale=_D),
    elements=T.ArrayType(
        struct(
            role=_S, id=_I, rect=struct(x=_I, y=_I, w=_I, h=_I), text=_S, inputType=_S,
            interactive=_B, piiCategory=_S,
        )
    ),
    task=_S, step=_I, image=_S,
)


def within_size(body: Column, limit: int = fv.MAX_BODY_BYTES) -> Column:
    return F.octet_length(body) <= limit


def intake(
    df: DataFrame, body: str, schema: T.StructType, tag: str = SCHEMA_TAG, limit: int = fv.MAX_BODY_BYTES
) -> DataFrame:
    """Adds ``payload`` and ``rejected`` (``too large``, ``invalid JSON``, ``unrecognized payload schema`` or null)."""
    text = F.col(body)
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    ok_json = F.try_parse_json(text).isNotNull()
    rows = df.withColumn("payload", F.when(within_size(text, limit) & ok_json, parsed))
    reason = (
        F.when(~within_size(text, limit), "too large")
        .when(~ok_json, "invalid JSON")
        .when(~F.coalesce(F.col("payload.schema") == tag, F.lit(False)), "unrecognized payload schema")
    )
    return rows.withColumn("rejected", reason)


def audited_rows(pages: DataFrame, keys: Sequence[str] = ("page_id",), style: str = "blur") -> DataFrame:
    """``detect.page_rows`` with the audit of redacting the page's body text; narrow."""
    bodies = pages.select(*keys, "html", pg.body_text("html").alias("_body"))
    told = redact.audit(redact.redacted(bodies, *keys, "html", text="_body", style=style), *keys, "html")
    return detect.page_rows(told, (*keys, "char_delta", "size_ratio", "coverage"))


def build(
    rows: DataFrame, keys: Sequence[str], scheme: str = "blur", task: str | None = None,
    viewport: tuple[int, int, float] = (640, 1100, 1.0), step: int = 1,
) -> DataFrame:
    """One outgoing payload per page, already scrubbed; a narrow step over ``detect.page_rows``.

    Lists the elements a single-page walk would return.  When the rows have the
    columns of a redaction audit (``char_delta``, ``size_ratio``, ``coverage``),
    the payload reports them.
    """
    w, h, scale = viewport
    told = {"pixelDelta": "char_delta", "byteDelta": "size_ratio", "redactionCoverage": "coverage"}
    audit = F.struct(*[
        (F.col(source) if source in rows.columns else F.lit(None)).cast("double").alias(name)
        for name, source in told.items()
    ])
    names = "array_sort(array_distinct(transform(detections, _d -> _d.category)))"
    counts = "map_from_arrays(_names, transform(_names, _c -> CAST(size(filter(detections, _d -> _d.category = _c)) AS BIGINT)))"
    categories = F.expr(let_sql(names, "_names", counts))
    listed = F.expr(detect.summaries_sql("filter(elements, _e -> _e.in_cap)", "detections"))
    described = rows.select(*keys, audit.alias("_audit"), categories.alias("_counts"), listed.alias("_listed"))
    payload = F.struct(
        F.lit(SCHEMA_TAG).alias("schema"),
        F.struct(
            F.lit(scheme).alias("scheme"), F.lit(REPORT_VERSION).alias("version"),
            F.col("_counts").alias("categories"),
            F.coalesce(F.try_element_at("_counts", F.lit("face")), F.lit(0)).alias("faceCount"),
            F.col("_audit").alias("audit"),
        ).alias("redaction"),
        F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(scale).alias("scale")).alias("viewport"),
        F.col("_listed").alias("elements"), F.lit(task).cast("string").alias("task"), F.lit(step).alias("step"),
        F.lit(None).cast("string").alias("image"),
    ).cast(PAYLOAD)
    return described.select(*keys, payload.alias("payload")).withColumn(
        "payload", scrub.scrub_value("payload", PAYLOAD)
    )


def log_line(payload: Column) -> Column:
    """What may be logged about a payload: sizes and counts, no content."""
    red = payload["redaction"]
    task = F.left(F.coalesce(payload["task"], F.lit("")), F.lit(80))
    return F.struct(
        task.alias("task"),
        F.coalesce(payload["step"], F.lit(1)).alias("step"),
        payload["viewport"]["w"].alias("w"), payload["viewport"]["h"].alias("h"),
        red["scheme"].alias("scheme"),
        red["categories"].alias("categories"),
        F.coalesce(red["faceCount"], F.lit(0)).alias("face_count"),
        F.round(F.coalesce(red["audit"]["pixelDelta"], F.lit(0.0)), 4).alias("pixel_delta"),
        F.round(F.coalesce(red["audit"]["byteDelta"], F.lit(0.0)), 4).alias("byte_delta"),
        F.coalesce(F.floor(F.length(payload["image"]) / 1024 + 0.5), F.lit(0)).cast("int").alias("image_kb"),
        F.coalesce(F.size(payload["elements"]), F.lit(0)).alias("element_count"),
    )


def log_rows(payloads: DataFrame, keys: Sequence[str], at: Column | None = None) -> DataFrame:
    line = payloads.select(*keys, log_line(F.col("payload")).alias("_l")).select(*keys, "_l.*")
    return line.withColumn("ts", at if at is not None else F.current_timestamp())


# --- sinks -----------------------------------------------------------------------------------


def write_payloads(payloads: DataFrame, folder: str, before_send=None) -> None:
    """Payloads as JSON lines.  ``before_send`` is a ``DataFrame -> DataFrame`` hook."""
    out = payloads.transform(before_send) if before_send else payloads
    out.select(F.to_json("payload").alias("value")).write.mode("append").text(folder)


def append_log(payloads: DataFrame, keys: Sequence[str], folder: str) -> None:
    log_rows(payloads, keys).write.mode("append").parquet(folder)


def write_report(report: DataFrame, folder: str) -> None:
    """A report is one row, so one file is right."""
    report.coalesce(1).write.mode("overwrite").json(folder)
