"""Axis-aligned boxes as ``struct<x,y,w,h>`` columns; plain arithmetic, all in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x, y, w, h) -> Column:
    return F.struct(
        F.lit(x).alias("x") if not isinstance(x, Column) else x.alias("x"),
        y.alias("y"), w.alias("w"), h.alias("h"),
    )


def half_up(value: Column) -> Column:
    """Round to the nearest integer, halves towards +infinity."""
    return F.floor(value + F.lit(0.5)).cast("int")


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def right(r: Column) -> Column:
    return r["x"] + r["w"]


def bottom(r: Column) -> Column:
    return r["y"] + r["h"]


def area(r: Column) -> Column:
    return r["w"] * r["h"]


def pad(r: Column, by: int) -> Column:
    return rect(r["x"] - by, r["y"] - by, r["w"] + 2 * by, r["h"] + 2 * by)


def pad_rounded(r: Column, by: float) -> Column:
    """Padding by a fraction, each part rounded."""
    return rect(
        half_up(r["x"] - F.lit(by)), half_up(r["y"] - F.lit(by)),
        half_up(r["w"] + F.lit(2.0 * by)), half_up(r["h"] + F.lit(2.0 * by)),
    )


def fit_origin(r: Column, width: int, height: int) -> Column:
    """Move the origin inside the canvas, then limit the size to what is left."""
    x, y = clamp(r["x"], 0, width), clamp(r["y"], 0, height)
    return rect(x, y, clamp(r["w"], F.lit(0), F.lit(width) - x), clamp(r["h"], F.lit(0), F.lit(height) - y))


def fit_corners(r: Column, width: int, height: int) -> Column:
    """Move both corners inside the canvas."""
    x, y = clamp(r["x"], 0, width), clamp(r["y"], 0, height)
    x2 = F.greatest(x, F.least(F.lit(width), right(r)))
    y2 = F.greatest(y, F.least(F.lit(height), bottom(r)))
    return rect(x, y, x2 - x, y2 - y)


def in_viewport(r: Column, width: int, height: int) -> Column:
    """The visible part of a box; null when none is visible."""
    x, y = F.greatest(F.lit(0), r["x"]), F.greatest(F.lit(0), r["y"])
    x2, y2 = F.least(F.lit(width), right(r)), F.least(F.lit(height), bottom(r))
    return F.when((x2 > x) & (y2 > y), rect(x, y, x2 - x, y2 - y))


def scaled(r: Column, scale: float) -> Column:
    """Page pixels to image pixels."""
    return rect(*[half_up(r[k] * F.lit(scale)) for k in ("x", "y", "w", "h")])


def intersection(a: Column, b: Column) -> Column:
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w = F.least(right(a), right(b)) - x
    h = F.least(bottom(a), bottom(b)) - y
    apart = (w <= 0) | (h <= 0)
    return rect(x, y, F.when(apart, 0).otherwise(w), F.when(apart, 0).otherwise(h))


def shared_area(a: Column, b: Column) -> Column:
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def apart(a: Column, b: Column) -> Column:
    """Whether two boxes share no area; stops at the first side that tells."""
    return (a["x"] >= right(b)) | (b["x"] >= right(a)) | (a["y"] >= bottom(b)) | (b["y"] >= bottom(a))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for disjoint or empty boxes."""
    both = shared_area(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller box; 0 when either is empty."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, shared_area(a, b) / smaller).otherwise(F.lit(0.0))


def overlap_sql(a: str, b: str) -> str:
    """:func:`overlap` in SQL text, for use inside a lambda."""
    def side(at: str, size: str) -> str:
        far = f"least({a}.{at} + {a}.{size}, {b}.{at} + {b}.{size})"
        return f"greatest(0, {far} - greatest({a}.{at}, {b}.{at}))"

    smaller = f"least({a}.w * {a}.h, {b}.w * {b}.h)"
    return f"CASE WHEN {smaller} > 0 THEN {side('x', 'w')} * {side('y', 'h')} / {smaller} ELSE 0D END"


def hull(a: Column, b: Column) -> Column:
    """Bounding box of two boxes; its far corner never lies left of or above the origin."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    x2 = F.greatest(F.lit(0), right(a), right(b))
    y2 = F.greatest(F.lit(0), bottom(a), bottom(b))
    return rect(x, y, x2 - x, y2 - y)


def head_score(objectness: Column, cls: Column) -> Column:
    return F.sqrt(clamp(objectness, 0.0, 1.0) * clamp(cls, 0.0, 1.0))
