"""Detections: PII spans of texts, and of the elements of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions import classify, spans
from veilspan.functions import fixed_values as fv
from veilspan.functions import geometry as geo
from veilspan.functions import text as tx
from veilspan.sources import pages as pg

DETECTION = (
    "struct<category:string,confidence:double,source:string,match:string>"
)


def hits(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per span of a text, in category order (``hit_no``).

    Narrow: scan and explode happen where the row lies.
    """
    found = df.select(*keys, spans.scan(text).alias("_spans"))
    return spans.unnest(found, "_spans", *keys, numbered="hit_no")


def category_counts(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Adds ``counts``: spans per category of one text, as a map without zeros.

    Counted inside the row, so no document is shuffled.
    """
    counts = (
        "map_from_arrays(_names, transform(_names, _n -> size(filter(_spans, _s -> _s.category = _n))))"
    )
    names = "array_distinct(transform(_spans, _s -> _s.category))"
    return df.select(*keys, spans.scan(text).alias("_spans")).select(
        *keys, F.expr(spans.let_sql(names, "_names", counts)).alias("counts")
    )


def counted_rows(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, category, n) from ``counts`` maps."""
    return counted.select(*keys, F.explode_outer("counts").alias("category", "n")).where(F.col("n").isNotNull())


def detections_sql(
    of: str = "", extra_labels: Sequence[classify.Rule] = (), extra_hints: Sequence[classify.Rule] = (),
    extra_images: Sequence[classify.Rule] = (), whole: str | None = None,
) -> str:
    """SQL array of an element's detections: text hits, field class, image class.

    ``of`` is put in front of each element column (``"_n."`` inside a lambda).
    ``whole`` names the column with the uncut text, which is then scanned
    instead of the shown text.
    """
    none = f"CAST(array() AS array<{DETECTION}>)"
    hit = (
        f"named_struct('category', _h.category, 'confidence', {fv.SOURCE_CONFIDENCE['value']}D, "
        "'source', 'text', 'match', _h.match)"
    )
    source = tx.scan_source_sql(of)
    if whole:
        source = f"CASE WHEN {of}input_type = 'password' THEN NULL WHEN {of}value <> '' THEN {of}value ELSE {of}{whole} END"
    scanned = spans.let_sql(source, "_text", spans.scan_sql("_text"))
    texts = f"transform({scanned}, _h -> {hit})"

    def one(verdict: str, match: str, when: str) -> str:
        detection = (
            "named_struct('category', _v.category, 'confidence', _v.confidence, 'source', _v.source, "
            f"'match', {match})"
        )
        found = spans.let_sql(verdict, "_v", f"CASE WHEN _v IS NOT NULL THEN array({detection}) ELSE {none} END")
        return f"CASE WHEN {when} THEN {found} ELSE {none} END"

    field = one(
        classify.field_sql(of, extra_labels, extra_hints), tx.first_filled_sql(of + "label", of + "placeholder"),
        f"{of}role IN ('input', 'textarea', 'select')",
    )
    image = one(classify.image_sql(of, extra_images), of + "alt", f"{of}role = 'img'")
    return f"CAST(concat({texts}, {field}, {image}) AS array<{DETECTION}>)"


def _padded(rect: str) -> str:
    pad = fv.BOX_PAD
    return (
        f"named_struct('x', {rect}.x - {pad}, 'y', {rect}.y - {pad}, "
        f"'w', {rect}.w + {2 * pad}, 'h', {rect}.h + {2 * pad})"
    )


def element_detections(
    elements: DataFrame,
    keys: Sequence[str] = ("page_id",),
    extra_labels: Sequence[classify.Rule] = (),
    extra_hints: Sequence[classify.Rule] = (),
    extra_images: Sequence[classify.Rule] = (),
) -> DataFrame:
    """Text hits, field class and image class of every row of an element table.

    The feeds are concatenated in the row, so nothing is shuffled.  ``det_no``
    is the order within the element.  Expects a ``rect`` column; the box is
    padded by 2.
    """
    c = F.col
    found = F.expr(detections_sql("", extra_labels, extra_hints, extra_images))
    return (
        elements.select(*keys, "uid", F.expr(_padded("rect")).alias("rect"), found.alias("_all"))
        .select(*keys, "uid", "rect", F.posexplode_outer("_all"))
        .where(c("col").isNotNull())
        .select(*keys, "uid", (c("pos") + 1).alias("det_no"), "col.*", "rect")
    )


# --- whole pages in one row -------------------------------------------------------------------

def page_rows(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """Pages with their ``elements`` and ``detections`` as arrays.

    A page is parsed and scanned once, inside its row; elements, detections,
    summaries and payloads are all read from these two arrays.  Every element
    has a stacked ``rect``.
    """
    per_element = (
        f"transform({detections_sql('_n.', whole='full')}, (_d, _k) -> named_struct('uid', _n.uid, 'det_no', CAST(_k + 1 AS INT), "
        "'category', _d.category, 'confidence', _d.confidence, 'source', _d.source, 'match', _d.match, "
        f"'rect', {_padded('_n.rect')}))"
    )
    return pg.element_arrays(pages, tuple(keys), html).withColumn(
        "detections", F.expr(f"flatten(transform(elements, _n -> {per_element}))")
    )


def page_detections(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Detections of raw HTML pages, with stacked boxes."""
    rows = page_rows(pages, keys).select(*keys, F.expr("inline_outer(detections)"))
    return rows.where("uid IS NOT NULL")


def body_hit_owners(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """Spans of the whole body text, each given to the first element that shows it.

    Hits and elements of a page meet inside its row: no join, no pairs.
    ``in_cap`` marks the 61 hits a single-page run would use; hits without an
    owner are left out.
    """
    owners = pages.select(*keys, html, pg.body_text(html).alias("_body"))
    owners = pg.with_nodes(owners, (*keys, "_body"), html).select(*keys, spans.scan("_body").alias("_hits"), pg.shown_texts("_nodes").alias("_shown"))
    attributed = (
        "transform(_hits, (_h, _i) -> named_struct('hit_no', _i + 1, 'category', _h.category, 'match', _h.match, "
        "'uid', get(filter(_texts, _e -> contains(_e.text, _h.match)), 0).uid))"
    )
    attributed = spans.let_sql("_shown", "_texts", attributed)
    return (
        owners.select(*keys, F.expr(f"inline_outer({attributed})"))
        .where(F.col("uid").isNotNull())
        .withColumn("confidence", F.lit(fv.SOURCE_CONFIDENCE["text"]))
        .withColumn("source", F.lit("text"))
        .withColumn("in_cap", F.col("hit_no") <= fv.BODY_SCAN_HITS)
    )


def summaries_sql(elements: str, detections: str) -> str:
    """SQL array of what may leave of a page: controls, and at most 60 short texts; never values.

    Elements come in the order of their uid.
    A row takes the category of the first detection that covers more than half of it.
    """
    own = tx.first_filled_sql("_n.label", "_n.placeholder")
    shown = tx.first_filled_sql("_n.text", "_n.label")
    label = f"coalesce(CASE WHEN _n.role IN ('input', 'textarea') THEN {own} ELSE {shown} END, '')"
    labelled = (
        f"transform(filter({elements}, _n -> _n.role <> 'link'), _n -> named_struct('n', _n, 'label', {label}, "
        "'control', _n.role <> 'element'))"
    )
    short = f"length(trim(_x.label)) BETWEEN 2 AND {fv.SUMMARY_TEXT_CHARS}"
    last = f"get(filter(_all, _x -> NOT _x.control AND {short}), {fv.SUMMARY_TEXT_ROWS} - 1).n.uid"
    chosen = spans.let_sql(last, "_last", f"filter(_all, _x -> _x.control OR (coalesce(_x.n.uid <= _last, TRUE) AND {short}))")
    # most boxes lie above or below each other, which two comparisons tell
    covering = (
        "get(filter(_dets, _d -> _d.rect.y < _x.n.rect.y + _x.n.rect.h AND _x.n.rect.y < _d.rect.y + _d.rect.h "
        f"AND _d.source <> 'face-model' AND {geo.overlap_sql('_d.rect', '_x.n.rect')} > {fv.SAME_BOX_OVERLAP}), 0).category"
    )
    limit = fv.SUMMARY_LABEL_CHARS
    row = (
        "named_struct('role', _x.n.role, 'id', _x.n.uid, 'rect', _x.n.rect, "
        f"'text', CASE WHEN length(_x.label) > {limit} THEN concat(left(_x.label, {limit}), '{tx.ELLIPSIS}') ELSE _x.label END, "
        f"'inputType', _x.n.input_type, 'interactive', _x.n.interactive, 'piiCategory', {covering})"
    )
    # Spark may inline a column into the lambda that uses it; bound here, it is computed once a page.
    return spans.let_sql(detections, "_dets", spans.let_sql(labelled, "_all", f"transform({chosen}, _x -> {row})"))


def summaries(rows: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Summary rows of :func:`page_rows`."""
    listed = rows.select(*keys, F.expr(f"inline_outer({summaries_sql('elements', 'detections')})"))
    return listed.where("id IS NOT NULL")
