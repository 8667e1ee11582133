"""Operators over box tables: suppression, merging, matching.

A box table has key columns (the image or page), an order, and a ``rect``
struct.  Boxes of one image may be a large part of the table, so

* order-dependent merges read a bounded number of boxes per image and round,
  in order, until none is left (one round unless an image is overfull);
* matches between two box tables go through distinct boxes and are reduced
  before anything is joined back; boxes of an image meet where the image lies if
  they are few, and in a grid if the image is crowded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions import geometry as geo
from veilspan.functions.spans import let
from veilspan.session import checkpoints_on

CHUNK = 1024
#: Side of a grid cell, and boxes of an image, in either table, that meet without a grid.
CELL, FEW = 64, 128


# --- top-k and suppression ------------------------------------------------------------


def head(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key.  Spark limits each partition before the shuffle."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= n)


def _suppress(kept: Column, item: Column, threshold: float) -> Column:
    # Most boxes of an image lie apart, which is cheaper to see than an IoU.
    return F.exists(
        kept,
        lambda k: ~geo.apart(k["rect"], item["rect"]) & (geo.iou(k["rect"], item["rect"]) > threshold),
    )


def _keep_best(items: Column, threshold: float) -> Column:
    """Greedy suppression over a sorted, bounded array."""
    empty = F.slice(items, 1, 0)
    return F.aggregate(
        items, empty,
        lambda kept, b: F.when(_suppress(kept, b, threshold), kept).otherwise(F.concat(kept, F.array(b))),
    )


def _gather(heads: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Bounded heads as one sorted array per key, with the last order value."""
    item = F.struct("_rn", *payload)
    return heads.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_items"), F.max("_ord").alias("_last")
    )


def nms_top(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column],
    top: int = fv.NMS_TOP, threshold: float = fv.NMS_THRESHOLD,
) -> DataFrame:
    """Suppression among the ``top`` best boxes of an image; one bounded fold each."""
    payload = [c for c in df.columns if c not in keys]
    heads = head(df, keys, order, top).withColumn("_ord", F.col("_rn"))
    return (
        _gather(heads, keys, payload)
        .select(*keys, F.inline(_keep_best(F.col("_items"), threshold)))
        .drop("_rn")
    )


def _ordered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One struct column whose ascending order is the processing order."""
    return df.withColumn("_ord", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))


def _overfull(df: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    return df.groupBy(*keys).count().where(F.col("count") > chunk).select(*keys)


def nms(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column],
    threshold: float, chunk: int = CHUNK,
) -> DataFrame:
    """Suppression over all boxes of an image, however many.

    ``order`` is ascending (use ``-score``) and must be unique within an image.
    Each round settles the first ``chunk`` open boxes of every image and drops
    the later ones they suppress.  An image within ``chunk`` takes one round;
    a larger one about (kept boxes / chunk) more.
    """
    payload = [c for c in df.columns if c not in keys]
    ordered = _ordered(df, order)

    def settle(rows: DataFrame) -> DataFrame:
        heads = head(rows, keys, [F.col("_ord")], chunk)
        return _gather(heads, keys, [*payload, "_ord"]).select(
            *keys, "_last", _keep_best(F.col("_items"), threshold).alias("_kept")
        )

    big = _overfull(ordered, keys, chunk)
    if big.isEmpty():
        return settle(ordered).select(*keys, F.inline("_kept")).select(*keys, *payload)
    checkpoints_on(df.sparkSession)
    big = big.checkpoint()
    out = settle(ordered.join(big, list(keys), "left_anti")).select(*keys, F.inline("_kept"))
    left = ordered.join(big, list(keys), "left_semi").checkpoint()
    while not left.isEmpty():
        settled = settle(left).checkpoint()
        out = out.unionByName(settled.select(*keys, F.inline("_kept")))
        left = (
            left.join(settled, list(keys))
            .where((F.col("_ord") > F.col("_last")) & ~_suppress(F.col("_kept"), F.struct("rect"), threshold))
            .select(*left.columns)
            .checkpoint()
        )
    return out.select(*keys, *payload)


# --- order-dependent merging --------------------------------------------------------------


def strips(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Split an image at empty columns and rows: boxes in different strips never meet.

    Works on one row per distinct coordinate, which the canvas size bounds.
    """
    for axis, size, name in (("x", "w", "_sx"), ("y", "h", "_sy")):
        by = [*keys, *(["_sx"] if name == "_sy" else [])]
        at = f"_{axis}"
        df = df.withColumn(at, F.col(f"rect.{axis}"))
        reach = F.greatest(F.lit(0), F.col(at) + F.col(f"rect.{size}"))
        ends = df.groupBy(*by, at).agg(F.max(reach).alias("_reach"))
        line = Window.partitionBy(*by).orderBy(at)
        before = F.max("_reach").over(line.rowsBetween(Window.unboundedPreceding, -1))
        opened = ends.withColumn("_open", F.coalesce((F.col(at) >= before).cast("int"), F.lit(1)))
        numbered = opened.withColumn(name, F.sum("_open").over(line)).select(*by, at, name)
        df = df.join(numbered, [*by, at]).drop(at)
    return df


def fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column],
    state_type: str, step: Callable[[Column, Column], Column], chunk: int = CHUNK,
) -> DataFrame:
    """Fold the boxes of each key in order into an array of ``state_type``.

    Images within ``chunk`` boxes take one pass.  Of an overfull image, each
    round folds the next ``chunk`` boxes into the state so far, after the
    image has been split into independent strips; no task ever holds more than
    the state and one chunk.
    """
    payload = [c for c in df.columns if c not in keys]
    ordered = _ordered(df, order)
    zero = F.array().cast(f"array<{state_type}>")

    def run(items: Column, state: Column) -> Column:
        return F.aggregate(items, state, lambda s, b: step(s, b).cast(f"array<{state_type}>"))

    big = _overfull(ordered, keys, chunk)
    if big.isEmpty():
        return _gather(head(ordered, keys, [F.col("_ord")], chunk), keys, payload).select(
            *keys, run(F.col("_items"), zero).alias("state")
        )
    checkpoints_on(df.sparkSession)
    big = big.checkpoint()
    small = ordered.join(big, list(keys), "left_anti")
    out = _gather(head(small, keys, [F.col("_ord")], chunk), keys, payload).select(
        *keys, run(F.col("_items"), zero).alias("state")
    )
    hot = strips(ordered.join(big, list(keys), "left_semi"), keys).checkpoint()
    part = [*keys, "_sx", "_sy"]
    state, left = None, hot
    while not left.isEmpty():
        items = _gather(head(left, part, [F.col("_ord")], chunk), part, payload)
        if state is None:
            folded = items.select(*part, "_last", run(F.col("_items"), zero).alias("state"))
        else:
            merged = state.withColumnRenamed("_last", "_old").join(items, part, "left")
            folded = merged.select(
                *part, F.coalesce("_last", "_old").alias("_last"),
                F.when(F.col("_items").isNull(), F.col("state"))
                .otherwise(run(F.col("_items"), F.col("state"))).alias("state"),
            )
        state = folded.checkpoint()
        left = (
            left.join(state.select(*part, "_last"), part)
            .where(F.col("_ord") > F.col("_last")).select(*hot.columns).checkpoint()
        )
    return out.unionByName(state.select(*keys, "state"))


def _first_match(state: Column, test: Callable[[Column], Column]) -> Column:
    """1-based place of the first state entry that passes; 0 for none."""
    return F.array_position(F.transform(state, test), True)


def cluster(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column],
    threshold: float, chunk: int = CHUNK,
) -> DataFrame:
    """Greedy merge: a box joins the first cluster it overlaps by more than ``threshold``."""
    entry = "struct<rect:struct<x:int,y:int,w:int,h:int>,n:int>"

    def step(state: Column, b: Column) -> Column:
        new = F.struct(b["rect"].alias("rect"), F.lit(1).alias("n")).cast(entry)
        return let(
            _first_match(
                state, lambda c: ~geo.apart(c["rect"], b["rect"]) & (geo.overlap(c["rect"], b["rect"]) > threshold)
            ),
            lambda at: F.when(at == 0, F.concat(state, F.array(new))).otherwise(
                F.transform(
                    state,
                    lambda c, i: F.when(
                        i + 1 == at,
                        F.struct(geo.hull(c["rect"], b["rect"]).alias("rect"), (c["n"] + 1).alias("n")).cast(entry),
                    ).otherwise(c),
                )
            ),
        )

    folded = fold(df.select(*keys, "rect", *_order_inputs(df, keys)), keys, order, entry, step, chunk)
    return folded.select(*keys, F.inline("state"))


def _order_inputs(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in (*keys, "rect")]


def dedupe(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: int = CHUNK
) -> DataFrame:
    """Same-category detections of one box become one detection.

    ``keys`` should hold page and category.  The tighter of two boxes wins; a
    box that is neither tighter nor contained widens the earlier one.
    Detections with and without landmarks do not mix (``has_landmarks``).
    """
    entry = (
        "struct<rect:struct<x:int,y:int,w:int,h:int>,confidence:double,source:string,"
        "match:string,has_landmarks:boolean>"
    )
    fields = ("rect", "confidence", "source", "match", "has_landmarks")

    def as_entry(d: Column, box: Column | None = None) -> Column:
        parts = [(box if box is not None and f == "rect" else d[f]).alias(f) for f in fields]
        return F.struct(*parts).cast(entry)

    def step(state: Column, d: Column) -> Column:
        def merged(p: Column) -> Column:
            tighter = geo.area(d["rect"]) < geo.area(p["rect"])
            widen = geo.overlap(p["rect"], d["rect"]) < fv.CONTAINED_OVERLAP
            return (
                F.when(tighter, as_entry(d))
                .when(widen, as_entry(p, geo.hull(p["rect"], d["rect"])))
                .otherwise(p)
            )

        same = _first_match(
            state,
            lambda p: ~geo.apart(p["rect"], d["rect"])
            & (geo.overlap(p["rect"], d["rect"]) > fv.SAME_BOX_OVERLAP)
            & (p["has_landmarks"] == d["has_landmarks"]),
        )
        return let(
            same,
            lambda at: F.when(at == 0, F.concat(state, F.array(as_entry(d)))).otherwise(
                F.transform(state, lambda p, i: F.when(i + 1 == at, merged(p)).otherwise(p))
            ),
        )

    folded = fold(df, keys, order, entry, step, chunk)
    return folded.select(*keys, F.inline("state"))


# --- matching of two box tables ------------------------------------------------------------


def _in_cells(df: DataFrame, name: str, size: int) -> DataFrame:
    """One row per grid cell a box touches (``_cx``, ``_cy``); a box without area touches none."""
    r = F.col(name)

    def axis(low: Column, length: Column) -> Column:
        return F.explode(
            F.sequence(F.floor(low / size).cast("int"), F.floor((low + length - 1) / size).cast("int"))
        )

    filled = df.where((r["w"] > 0) & (r["h"] > 0))
    columns = filled.select("*", axis(r["x"], r["w"]).alias("_cx"))
    return columns.select("*", axis(r["y"], r["h"]).alias("_cy"))


def meeting(a: DataFrame, b: DataFrame, keys: Sequence[str], size: int | None = CELL) -> DataFrame:
    """Pairs of boxes that share area, each once.

    Both sides have ``keys`` and a box (``a_rect``, ``b_rect``) and should be
    distinct boxes.  A pair is produced only in the cell that holds the corner
    of its intersection, so no ``distinct`` is needed afterwards.  Without a size all
    boxes of an image meet.
    """
    if size is None:
        def filled(name: str) -> Column:
            return (F.col(name)["w"] > 0) & (F.col(name)["h"] > 0)

        return a.where(filled("a_rect")).join(b.where(filled("b_rect")), list(keys)).where(~geo.apart(F.col("a_rect"), F.col("b_rect")))
    both = _in_cells(a, "a_rect", size).join(_in_cells(b, "b_rect", size), [*keys, "_cx", "_cy"])
    ra, rb = F.col("a_rect"), F.col("b_rect")
    corner = (
        (F.floor(F.greatest(ra["x"], rb["x"]) / size) == F.col("_cx"))
        & (F.floor(F.greatest(ra["y"], rb["y"]) / size) == F.col("_cy"))
    )
    return both.where(~geo.apart(ra, rb) & corner).drop("_cx", "_cy")


def distinct_boxes(df: DataFrame, keys: Sequence[str], name: str, *aggs: Column) -> DataFrame:
    """One row per distinct box of an image; copies are combined before the shuffle."""
    grouped = df.withColumn(name, F.col("rect")).groupBy(*keys, name)
    return grouped.agg(*aggs) if aggs else grouped.agg(F.count(F.lit(1)).alias("_copies"))


def _matched(
    boxes: DataFrame, others: DataFrame, keys: Sequence[str], match: Callable[[DataFrame, DataFrame, int | None], DataFrame], size: int
) -> DataFrame:
    """``match`` of two box tables: images with few boxes are dealt once, by image; crowded images go through the grid.

    Copies count as boxes here, so that one box a million times is combined before its shuffle.
    """
    counts = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(*keys) for t in (boxes, others)]
    crowded = counts[0].union(counts[1]).distinct()
    if crowded.isEmpty():
        return match(boxes.repartition(*keys), others.repartition(*keys), None)
    checkpoints_on(boxes.sparkSession)
    crowded = crowded.checkpoint()
    few = [t.join(crowded, list(keys), "left_anti").repartition(*keys) for t in (boxes, others)]
    many = [t.join(crowded, list(keys), "left_semi") for t in (boxes, others)]
    return match(*few, None).unionByName(match(*many, size))


def first_overlapping(
    boxes: DataFrame, others: DataFrame, keys: Sequence[str], order: Column,
    value: str, threshold: float = fv.SAME_BOX_OVERLAP, size: int = CELL,
) -> DataFrame:
    """Adds ``value`` of the first of ``others`` that overlaps a box by more than ``threshold``."""
    def match(boxes: DataFrame, others: DataFrame, size: int | None) -> DataFrame:
        a = distinct_boxes(boxes, keys, "a_rect").drop("_copies")
        b = distinct_boxes(others, keys, "b_rect", F.min(F.struct("o", F.col(value).alias("v"))).alias("_first"))
        return (
            meeting(a, b, keys, size)
            .where(geo.overlap(F.col("a_rect"), F.col("b_rect")) > threshold)
            .groupBy(*keys, "a_rect")
            .agg(F.min("_first").alias("_first"))
            .select(*keys, F.col("a_rect").alias("rect"), F.col("_first.v").alias(value))
        )

    best = _matched(boxes.select(*keys, "rect"), others.select(*keys, "rect", order.alias("o"), value), keys, match, size)
    return boxes.join(best, [*keys, "rect"], "left")


def best_partner(
    boxes: DataFrame, others: DataFrame, keys: Sequence[str],
    category: str | None = None, threshold: float = fv.MATCH_IOU, size: int = CELL,
) -> DataFrame:
    """For each distinct box (and category): best IoU, and whether a matching partner agrees.

    ``copies`` says how many boxes a row stands for.
    """
    extra = [category] if category else []
    by = [*keys, *extra, "a_rect", "copies"]

    def match(boxes: DataFrame, others: DataFrame, size: int | None) -> DataFrame:
        a = distinct_boxes(boxes, [*keys, *extra], "a_rect", F.count(F.lit(1)).alias("copies"))
        # A partner of two categories is two rows; sets of categories would be sorted, not hashed.
        b = distinct_boxes(others.withColumnRenamed(category, "_cat") if category else others, [*keys, *(["_cat"] if category else [])], "b_rect")
        overlap = geo.iou(F.col("a_rect"), F.col("b_rect"))
        agrees = (F.col("_cat") == F.col(category)) if category else F.lit(False)
        pairs = meeting(a, b, keys, size).select(*by, overlap.alias("_iou"), ((overlap >= threshold) & agrees).alias("_agrees"))
        # A row per box on its own keeps boxes without a partner; no join back is needed.
        alone = a.select(*by, F.lit(0.0).alias("_iou"), F.lit(False).alias("_agrees"))
        return pairs.unionByName(alone).groupBy(*by).agg(F.max("_iou").alias("best_iou"), F.max("_agrees").alias("agrees"))

    held = [*keys, "rect", *extra]
    best = _matched(boxes.select(*held), others.select(*held), keys, match, size)
    return best.select(
        *keys, *extra, F.col("a_rect").alias("rect"), "copies", "best_iou",
        (F.col("best_iou") >= threshold).alias("matched"), "agrees",
    )


def coverage(boxes: DataFrame, covers: DataFrame, keys: Sequence[str], size: int = CELL) -> DataFrame:
    """Share of each distinct box under ``covers``: intersections summed, at most 1."""
    by = [*keys, "a_rect", "copies"]

    def match(boxes: DataFrame, covers: DataFrame, size: int | None) -> DataFrame:
        a = distinct_boxes(boxes, keys, "a_rect", F.count(F.lit(1)).alias("copies"))
        b = distinct_boxes(covers, keys, "b_rect", F.count(F.lit(1)).alias("_n"))
        shared = geo.shared_area(F.col("a_rect"), F.col("b_rect")).cast("long") * F.col("_n")
        pairs = meeting(a, b, keys, size).select(*by, shared.alias("_hit"))
        alone = a.select(*by, F.lit(0).cast("long").alias("_hit"))
        return pairs.unionByName(alone).groupBy(*by).agg(F.sum("_hit").alias("_hit"))

    hit = _matched(boxes.select(*keys, "rect"), covers.select(*keys, "rect"), keys, match, size)
    area = geo.area(F.col("a_rect"))
    return hit.select(
        *keys, F.col("a_rect").alias("rect"), "copies",
        F.when(area > 0, F.least(F.lit(1.0), F.col("_hit") / area)).otherwise(0.0).alias("covered"),
    )


def bounding(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box per image; its far corner never lies left of or above the origin."""
    r = F.col("rect")
    ends = df.groupBy(*keys).agg(
        F.min(r["x"]).alias("x"), F.min(r["y"]).alias("y"),
        F.greatest(F.lit(0), F.max(geo.right(r))).alias("x2"),
        F.greatest(F.lit(0), F.max(geo.bottom(r))).alias("y2"),
    )
    return ends.select(
        *keys, geo.rect(F.col("x"), F.col("y"), F.col("x2") - F.col("x"), F.col("y2") - F.col("y")).alias("rect")
    )


# --- decoding of model heads -----------------------------------------------------------------


def decode(
    heads: DataFrame, keys: Sequence[str], stride: Column, shift_x: Column, shift_y: Column,
    scale: Column, threshold: float = fv.SCORE_THRESHOLD,
) -> DataFrame:
    """Boxes and landmarks from head cells.

    Input: ``row``, ``col``, ``obj``, ``cls``, ``bbox array<double>`` of 4 and
    ``kps array<double>`` of 10.  The score filter runs before any exponential.
    """
    c = F.col
    cell = heads.withColumn("score", geo.head_score(c("obj"), c("cls"))).where(c("score") >= threshold)
    cx = (c("col") + c("bbox")[0]) * stride
    cy = (c("row") + c("bbox")[1]) * stride
    w, h = F.exp(c("bbox")[2]) * stride, F.exp(c("bbox")[3]) * stride
    corners = cell.select(
        *keys, "row", "col", "score", "kps", stride.alias("_s"), shift_x.alias("_dx"),
        shift_y.alias("_dy"), scale.alias("_k"),
        ((cx - w / 2 - shift_x) * scale).alias("x1"), ((cy - h / 2 - shift_y) * scale).alias("y1"),
        ((cx + w / 2 - shift_x) * scale).alias("x2"), ((cy + h / 2 - shift_y) * scale).alias("y2"),
    ).where((c("x2") > c("x1")) & (c("y2") > c("y1")))
    landmarks = F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda k: F.struct(
            (((F.get(c("kps"), k * 2) + c("col")) * c("_s") - c("_dx")) * c("_k")).alias("x"),
            (((F.get(c("kps"), k * 2 + 1) + c("row")) * c("_s") - c("_dy")) * c("_k")).alias("y"),
        ),
    )
    box = geo.rect(
        geo.half_up(c("x1")), geo.half_up(c("y1")),
        geo.half_up(c("x2") - c("x1")), geo.half_up(c("y2") - c("y1")),
    )
    return corners.select(*keys, "row", "col", "score", box.alias("rect"), landmarks.alias("landmarks"))
