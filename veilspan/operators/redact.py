"""Redact spans in texts and measure what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions import spans as sp
from veilspan.functions import text as tx

REGIONS = "array<struct<start:int,end:int>>"
BLUR_KEEPS = 2


def strategy(category: Column, general: str | Column = "blur", face: str | Column = "blur") -> Column:
    """``solid`` or ``blur`` for a detection.

    Faces follow their own setting; passwords and one-time codes are always solid.
    """
    general = general if isinstance(general, Column) else F.lit(general)
    face = face if isinstance(face, Column) else F.lit(face)
    return (
        F.when(category == "face", F.when(face == "solid", "solid").otherwise("blur"))
        .when(category.isin("password", "otp"), "solid")
        .when(general == "solid", "solid")
        .otherwise("blur")
    )


def regions(found: str) -> Column:
    """Overlapping spans (an array column) merged into disjoint, ordered ``[start, end)`` regions.

    A region opens where a span starts at or behind everything before it; it
    ends at the furthest end reached before the next one opens.
    """
    ordered = f"array_sort(transform({found}, _s -> struct(_s.start AS start, _s.start + length(_s.match) AS end)))"
    furthest = sp.running_max("transform(_sorted, _s -> _s.end)")
    opens = (
        "filter(sequence(0, size(_sorted) - 1),"
        " _i -> _i = 0 OR get(_sorted, _i).start >= get(_reach, _i - 1))"
    )
    cut = (
        "transform(_opens, (_i, _k) -> struct(get(_sorted, _i).start AS start,"
        " get(_reach, coalesce(get(_opens, _k + 1), size(_sorted)) - 1) AS end))"
    )
    merged = sp.let_sql(ordered, "_sorted", sp.let_sql(furthest, "_reach", sp.let_sql(opens, "_opens", cut)))
    return F.expr(
        f"CASE WHEN size({found}) > 0 THEN CAST({merged} AS {REGIONS}) ELSE CAST(array() AS {REGIONS}) END"
    )


def _mask_sql(text: str, style: str) -> str:
    if style == "solid":
        return f"repeat('{tx.BLOCK}', _r.end - _r.start)"
    shown = f"least({BLUR_KEEPS}, _r.end - _r.start)"
    return (
        f"concat(repeat('{tx.BULLET}', greatest(_r.end - _r.start - {BLUR_KEEPS}, 0)),"
        f" substring({text}, _r.end - {shown} + 1, {shown}))"
    )


def apply(text: str, areas: str, style: str = "blur") -> Column:
    """Text with each region masked; its length in characters does not change."""
    before = f"coalesce(get({areas}, _k - 1).end, 0)"
    piece = f"concat(substring({text}, {before} + 1, _r.start - {before}), {_mask_sql(text, style)})"
    pieces = f"array_join(transform({areas}, (_r, _k) -> {piece}), '')"
    tail = f"substring({text}, element_at({areas}, -1).end + 1, length({text}))"
    return F.expr(f"CASE WHEN size({areas}) > 0 THEN concat({pieces}, {tail}) ELSE {text} END")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + v)


def region_chars(areas: Column) -> Column:
    return _total(F.transform(areas, lambda r: (r["end"] - r["start"]).cast("long")))


def span_chars(found: Column) -> Column:
    return _total(F.transform(found, lambda s: F.length(s["match"]).cast("long")))


def chars_within(areas: Column, start: Column, end: Column) -> Column:
    """How many region characters lie in ``[start, end)``."""
    return _total(
        F.transform(
            areas,
            lambda r: F.greatest(
                F.lit(0), F.least(r["end"], end) - F.greatest(r["start"], start)
            ).cast("long"),
        )
    )


def redacted(df: DataFrame, *keys: str, text: str = "text", style: str = "blur") -> DataFrame:
    """Texts with their spans, regions and redacted form; narrow."""
    return (
        df.select(*keys, F.col(text).alias("text"), sp.scan(text).alias("spans"))
        .withColumn("regions", regions("spans"))
        .withColumn("redacted", apply("text", "regions", style))
    )


def audit(done: DataFrame, *keys: str) -> DataFrame:
    """Share of characters altered, size ratio, and coverage by spans (overlaps count twice)."""
    chars = F.length("text").cast("long")
    altered = region_chars(F.col("regions"))
    covered = span_chars(F.col("spans"))
    return done.select(
        *keys,
        chars.alias("n_chars"),
        altered.alias("altered_chars"),
        covered.alias("span_chars"),
        F.size("regions").cast("long").alias("n_regions"),
        F.when(chars > 0, altered / chars).otherwise(0.0).alias("char_delta"),
        F.when(chars > 0, covered / chars).otherwise(0.0).alias("coverage"),
        F.least(F.lit(1.0), F.octet_length("redacted") / F.octet_length("text")).alias("size_ratio"),
    )


def leakage(done: DataFrame, truth_start: str, truth_end: str) -> DataFrame:
    """Mean share masked inside true spans; share masked outside them.

    A guard of 3 characters around each true span counts as inside.
    """
    start, end = F.col(truth_start), F.col(truth_end)
    guard_start = F.greatest(F.lit(0), start - fv.LEAK_GUARD)
    guard_end = F.least(F.length("text"), end + fv.LEAK_GUARD)
    areas = F.col("regions")
    measured = done.select(
        F.when(end > start, chars_within(areas, start, end) / (end - start)).alias("inside"),
        (F.length("text") - (guard_end - guard_start)).cast("long").alias("outside_chars"),
        (region_chars(areas) - chars_within(areas, guard_start, guard_end)).alias("outside_masked"),
    )
    return measured.agg(
        F.count("inside").alias("n_spans"),
        F.avg("inside").alias("inside_share"),
        F.sum("outside_masked").alias("outside_masked"),
        F.sum("outside_chars").alias("outside_chars"),
        (F.sum("outside_masked") / F.sum("outside_chars")).alias("outside_share"),
    )
