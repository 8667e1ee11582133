"""Queries over box tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions import geometry as geo
from veilspan.operators import boxes, detect, redact
from veilspan.plans import derived, duck
from veilspan.plans.page_queries import _DETECTIONS
from veilspan.sources.tables import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
c = F.col
WIDTH, HEIGHT = 380, 280


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


KEYS = ", ".join(derived.BOX_ORDER)
_LONG_KEYS = "CAST(box_no AS BIGINT) AS box_no, l_orderkey, l_partkey, l_suppkey, l_extendedprice"
PAIRS_SQL = f"pairs AS (SELECT {', '.join(derived.PAIRS)} FROM lineitem)"
BOXES_SQL = f"boxes AS (SELECT {', '.join(derived.BOXES)} FROM lineitem)"
PREDICTED_SQL = f"predicted AS (SELECT {', '.join(derived.PREDICTED)} FROM lineitem)"


def _flat(column: Column, prefix: str = "") -> list[Column]:
    return [column[k].alias(prefix + k) for k in "xywh"]


def _longs(**values: str) -> str:
    return ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in values.items())


def _per_pair(name: str, sql: str, build: Callable[[], list[Column]]) -> None:
    def run(spark, d):
        return derived.box_pairs(spark, d).select(*derived.BOX_ORDER, *build())

    QUERIES[name] = run
    ORACLES[name] = f"WITH {PAIRS_SQL} SELECT {_LONG_KEYS}, {sql} FROM pairs"


_IW = "(least(x + w, px + pw) - greatest(x, px))"
_IH = "(least(y + h, py + ph) - greatest(y, py))"
_SHARED = f"(greatest(0, {_IW}) * greatest(0, {_IH}))"
_IOU = f"(CASE WHEN {_SHARED} > 0 THEN {_SHARED} / (w * h + pw * ph - {_SHARED}) ELSE CAST(0 AS DOUBLE) END)"

_per_pair("geo_clamp", _longs(cx="greatest(0, least(380, px))", cy="greatest(0, least(280, py))"),
          lambda: [geo.clamp(c("b.x"), 0, WIDTH).alias("cx"), geo.clamp(c("b.y"), 0, HEIGHT).alias("cy")])
_per_pair(
    "geo_expand",
    _longs(x="x - 2", y="y - 2", w="w + 4", h="h + 4", rx="floor(x - 1.5 + 0.5)", rw="floor(w + 3.0 + 0.5)"),
    lambda: [*_flat(geo.pad(c("a"), 2)), geo.pad_rounded(c("a"), 1.5)["x"].alias("rx"), geo.pad_rounded(c("a"), 1.5)["w"].alias("rw")],
)
_CX, _CY = "greatest(0, least(380, px))", "greatest(0, least(280, py))"
_per_pair(
    "geo_clamp_to",
    _longs(
        ox=_CX, oy=_CY, ow=f"greatest(0, least(380 - {_CX}, pw))", oh=f"greatest(0, least(280 - {_CY}, ph))",
        cx=_CX, cy=_CY, cw=f"greatest({_CX}, least(380, px + pw)) - {_CX}", ch=f"greatest({_CY}, least(280, py + ph)) - {_CY}",
    ),
    lambda: [*_flat(geo.fit_origin(c("b"), WIDTH, HEIGHT), "o"), *_flat(geo.fit_corners(c("b"), WIDTH, HEIGHT), "c")],
)
_per_pair("geo_area", _longs(area="w * h", other="pw * ph"),
          lambda: [geo.area(c("a")).alias("area"), geo.area(c("b")).alias("other")])
_per_pair(
    "geo_intersection",
    _longs(
        x="greatest(x, px)", y="greatest(y, py)",
        w=f"CASE WHEN {_IW} <= 0 OR {_IH} <= 0 THEN 0 ELSE {_IW} END", h=f"CASE WHEN {_IW} <= 0 OR {_IH} <= 0 THEN 0 ELSE {_IH} END",
    ),
    lambda: _flat(geo.intersection(c("a"), c("b"))),
)
_per_pair("geo_iou", f"{_IOU} AS iou", lambda: [geo.iou(c("a"), c("b")).alias("iou")])
_per_pair("geo_overlap_ratio", f"{_SHARED} / least(w * h, pw * ph) AS overlap",
          lambda: [geo.overlap(c("a"), c("b")).alias("overlap")])
_per_pair(
    "geo_scale",
    ", ".join(f"CAST(floor({k} * CAST(0.75 AS DOUBLE) + 0.5) AS BIGINT) AS {k}" for k in ("px", "py", "pw", "ph")),
    lambda: _flat(geo.scaled(c("b"), 0.75), "p"),
)
_VX, _VY = "greatest(0, px)", "greatest(0, py)"
_VISIBLE = f"least(380, px + pw) > {_VX} AND least(280, py + ph) > {_VY}"
_per_pair(
    "geo_viewport",
    f"{_VISIBLE} AS visible, " + _longs(
        seen_w=f"CASE WHEN {_VISIBLE} THEN least(380, px + pw) - {_VX} ELSE 0 END",
        seen_h=f"CASE WHEN {_VISIBLE} THEN least(280, py + ph) - {_VY} ELSE 0 END",
    ),
    lambda: [
        geo.in_viewport(c("b"), WIDTH, HEIGHT).isNotNull().alias("visible"),
        F.coalesce(geo.in_viewport(c("b"), WIDTH, HEIGHT)["w"], F.lit(0)).alias("seen_w"),
        F.coalesce(geo.in_viewport(c("b"), WIDTH, HEIGHT)["h"], F.lit(0)).alias("seen_h"),
    ],
)
_per_pair(
    "geo_hull",
    _longs(x="least(x, px)", y="least(y, py)", w="greatest(0, x + w, px + pw) - least(x, px)", h="greatest(0, y + h, py + ph) - least(y, py)"),
    lambda: _flat(geo.hull(c("a"), c("b"))),
)
_CW = f"(greatest({_CX}, least(380, px + pw)) - {_CX})"
_CH = f"(greatest({_CY}, least(280, py + ph)) - {_CY})"


@query("min_box", f"WITH {PAIRS_SQL} SELECT {_LONG_KEYS}, {_longs(w=_CW, h=_CH)} FROM pairs WHERE {_CW} >= 2 AND {_CH} >= 2")
def min_box(spark, d):
    """Boxes that are still at least 2 by 2 inside the canvas."""
    fitted = derived.box_pairs(spark, d).withColumn("r", geo.fit_corners(c("b"), WIDTH, HEIGHT))
    kept = fitted.where((c("r.w") >= fv.MIN_BOX_SIDE) & (c("r.h") >= fv.MIN_BOX_SIDE))
    return kept.select(*derived.BOX_ORDER, c("r.w").alias("w"), c("r.h").alias("h"))


@query(
    "score_filter",
    f"WITH {PAIRS_SQL}, s AS (SELECT *, sqrt(greatest(0, least(1, score * 1.05)) * greatest(0, least(1, score - l_extendedprice / 120000))) AS sc FROM pairs) "
    f"SELECT {_LONG_KEYS}, {duck.rounded('sc')} AS score FROM s WHERE sc >= 0.55 AND w > 0 AND h > 0",
)
def score_filter(spark, d):
    score = geo.head_score(c("score") * 1.05, c("score") - c("l_extendedprice") / 120000)
    rows = derived.boxes(spark, d).select(*derived.BOX_ORDER, "rect", score.alias("score"))
    kept = rows.where((c("score") >= fv.SCORE_THRESHOLD) & (c("rect.w") > 0) & (c("rect.h") > 0))
    return kept.select(*derived.BOX_ORDER, F.round("score", 9).alias("score"))


_GENERAL = "CASE WHEN l_partkey % 2 = 0 THEN 'solid' ELSE 'blur' END"
_FACE = "CASE WHEN l_partkey % 3 = 0 THEN 'solid' ELSE 'blur' END"
_KIND = derived.pick("l_suppkey", ["password", "otp", "face", "email", "name"])


@query(
    "redact_strategy",
    f"WITH {BOXES_SQL}, k AS (SELECT *, {_KIND} AS kind FROM boxes) SELECT {_LONG_KEYS}, kind, CASE WHEN kind = 'face' THEN {_FACE} "
    f"WHEN kind IN ('password', 'otp') THEN 'solid' ELSE {_GENERAL} END AS strategy FROM k",
)
def redact_strategy(spark, d):
    rows = derived.boxes(spark, d).withColumn("kind", F.expr(_KIND))
    return rows.select(
        *derived.BOX_ORDER, "kind", redact.strategy(c("kind"), F.expr(_GENERAL), F.expr(_FACE)).alias("strategy")
    )


# --- per image ------------------------------------------------------------------------------------

@query(
    "geo_union",
    f"WITH {BOXES_SQL}, e AS (SELECT img, min(x) AS x, min(y) AS y, greatest(0, max(x + w)) AS x2, greatest(0, max(y + h)) AS y2 FROM boxes GROUP BY 1) "
    f"SELECT img, {_longs(x='x', y='y', w='x2 - x', h='y2 - y')} FROM e",
)
def geo_union(spark, d):
    return boxes.bounding(derived.boxes(spark, d), ["img"]).select("img", *_flat(c("rect")))


@query(
    "coverage_sum",
    f"WITH {BOXES_SQL} SELECT img, CAST(sum(w * h) AS BIGINT) AS redacted_area, CAST(sum(w * h) AS BIGINT) / 120000 AS coverage FROM boxes GROUP BY 1",
)
def coverage_sum(spark, d):
    area = F.sum(geo.area(c("rect")))
    return derived.boxes(spark, d).groupBy("img").agg(area.alias("redacted_area"), (area / 120000).alias("coverage"))


def _nms_order() -> list[Column]:
    return [-c("score"), *[c(k) for k in derived.BOX_ORDER]]


@query(
    "topk_boxes",
    f"WITH {BOXES_SQL} SELECT img, {_LONG_KEYS}, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, {KEYS}) AS n FROM boxes) WHERE n <= 50",
)
def topk_boxes(spark, d):
    best = boxes.head(derived.boxes(spark, d), ["img"], _nms_order(), fv.NMS_TOP)
    return best.select("img", *derived.BOX_ORDER, c("_rn").alias("place"))


def _pair_iou(a: str, b: str) -> str:
    w = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    h = f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"({w} * {h} / ({a}.w * {a}.h + {b}.w * {b}.h - {w} * {h}))"


def _pair_overlap(a: str, b: str) -> str:
    w = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    h = f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"(CASE WHEN least({a}.w * {a}.h, {b}.w * {b}.h) > 0 THEN {w} * {h} / least({a}.w * {a}.h, {b}.w * {b}.h) ELSE 0 END)"


def _nms_sql(source: str, threshold: float) -> str:
    item = "{'box_no': box_no, 'l_orderkey': l_orderkey, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_extendedprice': l_extendedprice, 'x': x, 'y': y, 'w': w, 'h': h}"
    return f"""g AS (SELECT img, list([{item}] ORDER BY score DESC, {KEYS}) AS items FROM {source} GROUP BY 1),
f AS (SELECT img, unnest(list_reduce(items, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k: {_pair_iou('k', 'b[1]')} > {threshold})) > 0
  THEN kept ELSE list_concat(kept, b) END)) AS k FROM g)
SELECT img, CAST(k.box_no AS BIGINT) AS box_no, k.l_orderkey AS l_orderkey, k.l_partkey AS l_partkey, k.l_suppkey AS l_suppkey, k.l_extendedprice AS l_extendedprice FROM f"""


@query(
    "nms_top",
    f"WITH {BOXES_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, {KEYS}) AS n FROM boxes) WHERE n <= 50), {_nms_sql('top', 0.3)}",
)
def nms_top(spark, d):
    return boxes.nms_top(derived.boxes(spark, d), ["img"], _nms_order()).select("img", *derived.BOX_ORDER)


@query("nms", f"WITH {BOXES_SQL}, {_nms_sql('boxes', 0.1)}")
def nms(spark, d):
    return boxes.nms(derived.boxes(spark, d), ["img"], _nms_order(), 0.1).select("img", *derived.BOX_ORDER)


def _union_fields(a: str, b: str) -> str:
    return (
        f"'x': least({a}.x, {b}.x), 'y': least({a}.y, {b}.y), "
        f"'w': greatest(0, {a}.x + {a}.w, {b}.x + {b}.w) - least({a}.x, {b}.x), 'h': greatest(0, {a}.y + {a}.h, {b}.y + {b}.h) - least({a}.y, {b}.y)"
    )


def _first(state: str, test: str) -> str:
    return f"coalesce(list_position(list_transform({state}, lambda p: {test}), true), 0)"


_CLUSTER_AT = _first("s", _pair_overlap("p", "b[1]") + " > 0.3")


@query(
    "box_cluster",
    f"""WITH {BOXES_SQL}, g AS (SELECT img, list([{{'x': x, 'y': y, 'w': w, 'h': h, 'n': 1}}] ORDER BY {KEYS}) AS items FROM boxes GROUP BY 1),
f AS (SELECT img, unnest(list_reduce(items, lambda s, b: CASE WHEN {_CLUSTER_AT} = 0 THEN list_concat(s, b)
  ELSE list_transform(s, lambda q, i: CASE WHEN i = {_CLUSTER_AT} THEN {{{_union_fields('q', 'b[1]')}, 'n': q.n + 1}} ELSE q END) END)) AS k FROM g)
SELECT img, {_longs(x='k.x', y='k.y', w='k.w', h='k.h', n='k.n')} FROM f""",
)
def box_cluster(spark, d):
    rows = derived.boxes(spark, d).select("img", "rect", *derived.BOX_ORDER)
    found = boxes.cluster(rows, ["img"], [c(k) for k in derived.BOX_ORDER], 0.3)
    return found.select("img", *_flat(c("rect")), "n")


_DEDUPE_AT = _first("s", _pair_overlap("p", "b[1]") + " > 0.5 AND p.lm = b[1].lm")
_ENTRY = "'confidence': {v}.confidence, 'source': {v}.source, 'match': {v}.match, 'lm': {v}.lm"


@query(
    "dedupe_detections",
    f"""WITH {BOXES_SQL}, g AS (SELECT img, category, list([{{'x': x, 'y': y, 'w': w, 'h': h, 'confidence': score, 'source': source, 'match': CAST(l_partkey AS VARCHAR), 'lm': source = 'face-model'}}]
  ORDER BY {KEYS}) AS items FROM boxes GROUP BY 1, 2),
f AS (SELECT img, category, unnest(list_reduce(items, lambda s, b: CASE WHEN {_DEDUPE_AT} = 0 THEN list_concat(s, b)
  ELSE list_transform(s, lambda q, i: CASE WHEN i <> {_DEDUPE_AT} THEN q WHEN b[1].w * b[1].h < q.w * q.h THEN b[1]
    WHEN {_pair_overlap('q', 'b[1]')} < 0.99 THEN {{{_union_fields('q', 'b[1]')}, {_ENTRY.format(v='q')}}} ELSE q END) END)) AS k FROM g)
SELECT img, category, {_longs(x='k.x', y='k.y', w='k.w', h='k.h')}, k.confidence AS confidence, k.source AS source, k.match AS match FROM f""",
)
def dedupe_detections(spark, d):
    rows = derived.boxes(spark, d).select(
        "img", "category", "rect", c("score").alias("confidence"), "source",
        c("l_partkey").cast("string").alias("match"), (c("source") == "face-model").alias("has_landmarks"),
        *derived.BOX_ORDER,
    )
    found = boxes.dedupe(rows, ["img", "category"], [c(k) for k in derived.BOX_ORDER])
    return found.select("img", "category", *_flat(c("rect")), "confidence", "source", "match")


# --- two box tables --------------------------------------------------------------------------------

def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    return derived.boxes(spark, d), derived.predicted_boxes(spark, d)


@query(
    "element_pii_tag",
    f"""WITH {BOXES_SQL}, {PREDICTED_SQL}, m AS (SELECT a.img, a.x, a.y, a.w, a.h, b.category,
  row_number() OVER (PARTITION BY a.img, a.x, a.y, a.w, a.h ORDER BY b.box_no, b.l_orderkey, b.l_partkey, b.l_suppkey, b.l_extendedprice) AS n
  FROM (SELECT DISTINCT img, x, y, w, h FROM boxes) a JOIN predicted b ON b.img = a.img AND b.source <> 'face-model' AND {_pair_overlap('a', 'b')} > 0.5)
SELECT b.img, CAST(b.box_no AS BIGINT) AS box_no, b.l_orderkey, b.l_partkey, b.l_suppkey, b.l_extendedprice, m.category AS pii_category FROM boxes b LEFT JOIN m
  ON m.img = b.img AND m.x = b.x AND m.y = b.y AND m.w = b.w AND m.h = b.h AND m.n = 1""",
)
def element_pii_tag(spark, d):
    elements, found = _both(spark, d)
    found = found.where(c("source") != "face-model").withColumnRenamed("category", "pii_category")
    tagged = boxes.first_overlapping(
        elements, found, ["img"], F.struct(*derived.BOX_ORDER), "pii_category"
    )
    return tagged.select("img", *derived.BOX_ORDER, "pii_category")


_BEST_SQL = f"""{BOXES_SQL}, {PREDICTED_SQL},
a AS (SELECT img, x, y, w, h, category, count(*) AS copies FROM boxes GROUP BY ALL),
best AS (SELECT a.img, a.x, a.y, a.w, a.h, a.category, a.copies, coalesce(max({_pair_iou('a', 'b')}), 0) AS best_iou,
  coalesce(bool_or({_pair_iou('a', 'b')} >= 0.5 AND a.category = b.category), false) AS agrees
  FROM a LEFT JOIN predicted b ON b.img = a.img GROUP BY ALL)"""
_BEST_COLUMNS = f"img, {_longs(x='x', y='y', w='w', h='h')}, category, copies"


def _best(spark, d) -> DataFrame:
    truth, found = _both(spark, d)
    return boxes.best_partner(truth, found, ["img"], "category")


def _best_out(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("img", *_flat(c("rect")), "category", "copies", *more)


@query("match_boxes", f"WITH {_BEST_SQL} SELECT {_BEST_COLUMNS}, best_iou >= 0.5 AS matched FROM best")
def match_boxes(spark, d):
    return _best_out(_best(spark, d), "matched")


@query("match_category", f"WITH {_BEST_SQL} SELECT {_BEST_COLUMNS}, best_iou >= 0.5 AS matched, agrees FROM best")
def match_category(spark, d):
    return _best_out(_best(spark, d), "matched", "agrees")


@query("best_iou", f"WITH {_BEST_SQL} SELECT {_BEST_COLUMNS}, best_iou FROM best")
def best_iou(spark, d):
    return _best_out(_best(spark, d), "best_iou")


QUALITY_SQL = """quality AS (SELECT CAST(sum(copies) AS BIGINT) AS n_truth, CAST(sum(CASE WHEN best_iou >= 0.5 THEN copies ELSE 0 END) AS BIGINT) AS n_matched,
  CAST(sum(CASE WHEN agrees THEN copies ELSE 0 END) AS BIGINT) AS n_agree, (SELECT count(*) FROM predicted) AS n_pred FROM best)"""


def quality(spark, d) -> DataFrame:
    """Recall, precision (matched truth over predictions) and category accuracy."""
    none = F.lit(0).cast("long")
    best = _best(spark, d).select("copies", "matched", "agrees", none.alias("predicted"))
    predicted = derived.predicted_boxes(spark, d).select(none.alias("copies"), F.lit(False).alias("matched"), F.lit(False).alias("agrees"), (none + 1).alias("predicted"))
    joined = best.union(predicted).agg(
        F.sum("copies").alias("n_truth"), F.sum(F.when(c("matched"), c("copies")).otherwise(0)).alias("n_matched"),
        F.sum(F.when(c("agrees"), c("copies")).otherwise(0)).alias("n_agree"), F.sum("predicted").alias("n_pred"),
    )
    return joined.select(
        "n_truth", "n_matched", "n_agree", "n_pred",
        (c("n_matched") / c("n_truth")).alias("box_recall"),
        (c("n_matched") / F.greatest(c("n_pred"), F.lit(1))).alias("box_precision"),
        F.when(c("n_matched") > 0, c("n_agree") / c("n_matched")).otherwise(1.0).alias("category_accuracy"),
    )


@query(
    "box_quality",
    f"WITH {_BEST_SQL}, {QUALITY_SQL} SELECT n_truth, n_matched, n_agree, n_pred, n_matched / n_truth AS box_recall, "
    "n_matched / greatest(n_pred, 1) AS box_precision, CASE WHEN n_matched > 0 THEN n_agree / n_matched ELSE 1 END AS category_accuracy FROM quality",
)
def box_quality(spark, d):
    return quality(spark, d)


@query(
    "mean_iou",
    f"WITH {_BEST_SQL} SELECT CAST(sum(copies) AS BIGINT) AS n_boxes, {duck.rounded('sum(best_iou * copies) / sum(copies)')} AS mean_iou FROM best",
)
def mean_iou(spark, d):
    total = F.sum(c("best_iou") * c("copies")) / F.sum("copies")
    return _best(spark, d).agg(F.sum("copies").alias("n_boxes"), F.round(total, 9).alias("mean_iou"))


@query(
    "geo_coverage",
    f"""WITH {BOXES_SQL}, {PREDICTED_SQL}, a AS (SELECT img, x, y, w, h, count(*) AS copies FROM boxes GROUP BY ALL)
SELECT a.img, {_longs(x='a.x', y='a.y', w='a.w', h='a.h')}, copies, least(1, coalesce(sum(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))
  * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))), 0) / (a.w * a.h)) AS covered FROM a LEFT JOIN predicted b ON b.img = a.img
GROUP BY a.img, a.x, a.y, a.w, a.h, copies""",
)
def geo_coverage(spark, d):
    truth, found = _both(spark, d)
    return boxes.coverage(truth, found, ["img"]).select("img", *_flat(c("rect")), "copies", "covered")


# --- model heads -----------------------------------------------------------------------------------------

_CELLS = 4
_STRIDE = "(CASE cell WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 8 END)"
_SHIFT = 40


def heads(spark, d) -> DataFrame:
    """Each vector read as four head cells: objectness, class, box (4) and landmarks (10)."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    cells = rows.select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(_CELLS - 1))).alias("cell"))
    at = c("cell") * 16
    return cells.select(
        "vec_id", "cell", (c("vec_id") % 20).cast("int").alias("row"), (c("vec_id") % 17).cast("int").alias("col"),
        (F.get("e", at) + 0.6).alias("obj"), (F.get("e", at + 1) + 0.6).alias("cls"),
        F.slice("e", at + 3, 4).alias("bbox"), F.slice("e", at + 7, 10).alias("kps"),
    )


def decoded(spark, d) -> DataFrame:
    return boxes.decode(
        heads(spark, d), ["vec_id", "cell"], F.expr(_STRIDE), F.lit(0), F.lit(_SHIFT), F.lit(0.8)
    )


def _e(offset: int) -> str:
    return f"CAST(embedding[cell * 16 + {offset + 1}] AS DOUBLE)"


_HEADS_SQL = f"""h AS (SELECT vec_id, CAST(cell AS BIGINT) AS cell, vec_id % 20 AS r, vec_id % 17 AS c, {_STRIDE} AS s,
  sqrt(greatest(0, least(1, {_e(0)} + 0.6)) * greatest(0, least(1, {_e(1)} + 0.6))) AS score,
  {', '.join(f'{_e(2 + i)} AS b{i}' for i in range(4))}, {', '.join(f'{_e(6 + i)} AS k{i}' for i in range(10))}
  FROM embeddings, range(0, {_CELLS}) t(cell)),
x AS (SELECT *, ((c + b0) * s - exp(b2) * s / 2) * 0.8::DOUBLE AS x1, ((r + b1) * s - exp(b3) * s / 2 - 40) * 0.8::DOUBLE AS y1,
  ((c + b0) * s + exp(b2) * s / 2) * 0.8::DOUBLE AS x2, ((r + b1) * s + exp(b3) * s / 2 - 40) * 0.8::DOUBLE AS y2 FROM h WHERE score >= 0.55),
decoded AS (SELECT *, floor(x1 + 0.5) AS x, floor(y1 + 0.5) AS y, floor(x2 - x1 + 0.5) AS w, floor(y2 - y1 + 0.5) AS h FROM x WHERE x2 > x1 AND y2 > y1)"""


@query(
    "box_decode",
    f"WITH {_HEADS_SQL} SELECT vec_id, cell, {duck.rounded('score', 6)} AS score, {_longs(x='x', y='y', w='w', h='h')}, "
    f"{duck.rounded('(k0 + c) * s * 0.8::DOUBLE', 6)} AS first_x, {duck.rounded('((k9 + r) * s - 40) * 0.8::DOUBLE', 6)} AS last_y FROM decoded",
)
def box_decode(spark, d):
    marks = c("landmarks")
    return decoded(spark, d).select(
        "vec_id", "cell", F.round("score", 6).alias("score"), *_flat(c("rect")),
        F.round(marks[0]["x"], 6).alias("first_x"), F.round(marks[4]["y"], 6).alias("last_y"),
    )


@query(
    "detections_union",
    f"""WITH {_DETECTIONS}, {_HEADS_SQL.replace('x AS (', 'hx AS (').replace('FROM x WHERE', 'FROM hx WHERE')}
SELECT page_id, category, confidence, source, match, {_longs(x='x', y='y', w='w', h='h')}, false AS has_landmarks FROM detections
UNION ALL SELECT vec_id, 'face', {duck.rounded('score', 6)}, 'face-model', NULL, {_longs(x='x', y='y', w='w', h='h')}, true FROM decoded""",
)
def detections_union(spark, d):
    """Text, field and image detections of the pages, and faces of the image with the same number."""
    dom = detect.page_detections(derived.form_pages(spark, d)).drop("uid", "det_no")
    faces = decoded(spark, d).select(
        c("vec_id").alias("page_id"), F.lit("face").alias("category"), F.round("score", 6).alias("confidence"),
        F.lit("face-model").alias("source"), "rect", "landmarks",
    )
    both = dom.unionByName(faces, allowMissingColumns=True)
    return both.select(
        "page_id", "category", "confidence", "source", "match", *_flat(c("rect")),
        c("landmarks").isNotNull().alias("has_landmarks"),
    )
