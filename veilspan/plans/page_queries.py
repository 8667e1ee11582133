"""Queries over raw pages, JSON bodies and agent commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions import fixed_values as fv
from veilspan.functions import classify, scrub
from veilspan.functions import text as tx
from veilspan.functions.spans import let_sql
from veilspan.operators import agent, detect
from veilspan.plans import derived, duck
from veilspan.plans.field_queries import image_sql, verdict_sql
from veilspan.sources import pages as pg
from veilspan.sources import payloads
from veilspan.sources.tables import spread, table, text_table

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


def raw_pages(spark, d) -> DataFrame:
    return text_table(spark, d, "pages")


# --- SQL of the page walk --------------------------------------------------------------------

def _unescape(value: str) -> str:
    for entity, char in tx.ENTITIES:
        value = f"replace({value}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return value


def _markup(html: str) -> str:
    text = f"regexp_replace({html}, '{pg.COMMENT}', '', 'g')"
    for tag in pg.RAW_TEXT_TAGS:
        text = f"regexp_replace({text}, '(?is)(<{tag}\\b[^>]*>).*?(</{tag}\\s*>)', '\\1\\2', 'g')"
    cut = f"string_split_regex({text}, '{pg.BODY_TAG}')"
    return f"coalesce(list_extract({cut}, 2), list_extract({cut}, 1))"


def _attr(name: str, attrs: str = "attrs") -> str:
    raw = f"""regexp_extract({attrs}, '(?i)\\s{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)"""
    return f"""nullif({_unescape(f"regexp_replace({raw}, '^[''\"]|[''\"]$', '', 'g')")}, '')"""


# Inside a tag, quoted values hold any sign (a doubled quote is one in SQL).
_INSIDE = """(?:[^<>"'']|"[^"]*"|''[^'']*'')*"""
_FORMATTING = "b|i|em|strong|u|s|small|mark|sub|sup|font|code|abbr|cite|q|kbd|samp|var|time|del|ins|big|tt|bdi|bdo|wbr"
_TOKEN = f"</?[A-Za-z]{_INSIDE}>?"
_WRAPPED = f'(?is)<label\\b([^>]*)>((?:[^<"]|</?(?:{_FORMATTING}|span)(?:[\\s/][^<>"]*)?>)*)<(input|select|textarea)\\b'
_FOR = f'(?is)<label\\b[^>]*\\sfor="([^"]*)"[^>]*>((?:[^<]|</?(?:{_FORMATTING}|span)(?:[\\s/][^<>"]*)?>)*)'
_SKIP = duck.quoted(fv.SKIPPED_TAGS)
_CONTAINERS = duck.quoted(fv.CONTAINER_TAGS)
_COLLAPSED = f"trim(regexp_replace({_unescape('text')}, '\\s+', ' ', 'g'))"


def body_text_sql(html: str) -> str:
    markup = f"regexp_replace({_markup(html)}, '{pg.BLOCK_END}', chr(10), 'g')"
    plain = _unescape(f"regexp_replace({markup}, '</?[A-Za-z]{_INSIDE}>', '', 'g')")
    lines = f"regexp_replace({plain}, '[ \\t\\r\\f]+', ' ', 'g')"
    lines = f"regexp_replace({lines}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({lines}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def nodes_ctes(source: str) -> str:
    """CTE ``nodes(page_id, node_no, tag, attrs, text, own, inside_hidden, for_ids, for_texts)``."""
    return f"""marked AS (
  SELECT page_id, regexp_replace(regexp_replace({_markup('html')}, '{pg.OPTION}', '\\1 ', 'g'),
    '{_WRAPPED}', '<label\\1>\\2<\\3 data-wrapped-label="\\2"', 'g') AS mk FROM {source}),
tag_tokens AS (SELECT page_id, for_ids, for_texts, ts, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (
  SELECT page_id, regexp_extract_all(mk, '{_TOKEN}') AS ps, string_split_regex(mk, '{_TOKEN}') AS ts,
    regexp_extract_all(mk, '{_FOR}', 1) AS for_ids, regexp_extract_all(mk, '{_FOR}', 2) AS for_texts FROM marked)),
tag_parts AS (SELECT page_id, for_ids, for_texts, p, pos, ts[pos + 1] AS t, lower(regexp_extract(p, '^</?([A-Za-z][A-Za-z0-9-]*)', 1)) AS tag,
  regexp_extract(p, '^<[A-Za-z][A-Za-z0-9-]*({_INSIDE})', 1) AS attrs FROM tag_tokens),
tag_kinds AS (SELECT *, CASE WHEN tag IN ({duck.quoted(pg.VOID)}) THEN 0 WHEN starts_with(p, '</') THEN -1 ELSE 1 END AS kind, tag NOT IN ({duck.quoted(pg.IN_LINE)}) AS block,
  regexp_matches(coalesce({_attr('style')}, ''), '{pg.HIDING_STYLE}') OR regexp_matches(regexp_replace(attrs, '"[^"]*"|''[^'']*''', '', 'g'), '{pg.HIDDEN_ATTR}') AS hides FROM tag_parts),
tag_levels AS (SELECT *, sum(kind) OVER (PARTITION BY page_id, tag ORDER BY pos) + CASE WHEN kind = -1 THEN 1 ELSE 0 END AS level FROM tag_kinds),
tag_paired AS (SELECT *, CASE WHEN kind = 1 AND lead(kind) OVER w = -1 THEN lead(pos) OVER w END AS closed, coalesce(kind = -1 AND lag(kind) OVER w = 1, FALSE) AS closes, lag(hides) OVER w AS hid
  FROM tag_levels WINDOW w AS (PARTITION BY page_id, tag, kind = 0, level ORDER BY pos)),
tag_placed AS (SELECT *, sum(CASE WHEN closed IS NOT NULL AND hides THEN 1 WHEN closes AND hid THEN -1 ELSE 0 END) OVER d AS cover,
  sum(CASE WHEN closed IS NOT NULL THEN 1 WHEN closes THEN -1 ELSE 0 END) OVER d AS depth, count(*) OVER (PARTITION BY page_id) AS n,
  min(CASE WHEN block THEN pos END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead,
  min(CASE WHEN block OR (kind = 1 AND closed IS NULL) THEN pos END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS near
  FROM tag_paired WINDOW d AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
tag_shown AS (SELECT *, CASE WHEN cover > 0 THEN '' ELSE t END AS v FROM tag_placed),
tag_opened AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS node_no, CASE WHEN kind = 0 THEN pos ELSE coalesce(closed, CASE WHEN block THEN ahead ELSE near END, n + 1) END AS until
  FROM tag_shown WHERE NOT starts_with(p, '</')),
tag_inside AS (SELECT o.page_id, o.node_no, string_agg(CASE WHEN s.pos > o.pos AND s.block THEN ' ' ELSE '' END || s.v, '' ORDER BY s.pos) AS text,
  bool_or(s.depth = o.depth AND regexp_matches(s.v, '\\S')) AS own
  FROM tag_opened o JOIN tag_shown s ON s.page_id = o.page_id AND s.pos >= o.pos AND s.pos < o.until GROUP BY 1, 2),
nodes AS (SELECT o.page_id, o.node_no, for_ids, for_texts, tag, attrs, coalesce(i.text, '') AS text, coalesce(i.own, FALSE) AS own, cover > 0 AS inside_hidden
  FROM tag_opened o LEFT JOIN tag_inside i ON i.page_id = o.page_id AND i.node_no = o.node_no)"""


_VISIBLE = (
    f"NOT (inside_hidden OR regexp_matches(coalesce({_attr('style')}, ''), '{pg.HIDDEN_STYLE}') OR regexp_matches(regexp_replace(attrs, '\"[^\"]*\"|''[^'']*''', '', 'g'), '{pg.HIDDEN_ATTR}')"
    f" OR coalesce(lower({_attr('type')}) = 'hidden', FALSE))"
)
_ROLE = (
    "CASE WHEN tag IN ('input', 'textarea', 'select') THEN tag WHEN tag = 'button' THEN 'button' "
    f"WHEN tag = 'a' AND {_attr('href')} IS NOT NULL THEN 'link' WHEN tag = 'img' THEN 'img' ELSE 'element' END"
)


def elements_ctes(source: str) -> str:
    """CTE ``elements`` with the columns of ``pages.elements``."""
    aria, title = _attr("aria-label"), _attr("title")
    wrapped, own_id = _attr("data-wrapped-label"), _attr("id")
    for_label = f"list_extract(for_texts, list_position(for_ids, {own_id}))"
    own = f"regexp_replace(coalesce({wrapped}, {_unescape(for_label)}), '</?[A-Za-z]{_INSIDE}>', '', 'g')"
    label = f"coalesce(nullif(left(trim({own}), 80), ''), {aria}, {title})"
    control = "role IN ('input', 'textarea', 'select')"
    return f"""{nodes_ctes(source)},
candidates AS (
  SELECT * FROM (SELECT *, {_ROLE} AS role, nullif({_COLLAPSED}, '') AS whole, nullif(left({_COLLAPSED}, 120), '') AS short FROM nodes
    WHERE tag NOT IN ({_SKIP}) AND {_VISIBLE})
  WHERE role IN ('input', 'textarea', 'select', 'button', 'img') OR (role = 'link' AND short IS NOT NULL)
    OR (role = 'element' AND (tag IN ({_CONTAINERS}) OR (own AND short IS NOT NULL)))),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY node_no) AS place FROM candidates),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY node_no) AS kept_no FROM placed
  WHERE role <> 'element' OR (own AND short IS NOT NULL) OR place <= 201),
elements AS (SELECT page_id, node_no AS uid, kept_no, node_no <= 2000 AND kept_no <= 500 AS in_cap, tag, role,
  CASE role WHEN 'input' THEN coalesce(lower({_attr('type')}), 'text') WHEN 'textarea' THEN 'textarea' WHEN 'select' THEN 'select-one' END AS input_type,
  CASE WHEN {control} THEN {_attr('name')} END AS name,
  CASE WHEN {control} OR role = 'img' THEN {own_id} END AS id,
  CASE WHEN {control} THEN {_attr('autocomplete')} END AS autocomplete,
  CASE WHEN {control} THEN {label} END AS label,
  CASE WHEN {control} THEN {_attr('placeholder')} END AS placeholder,
  CASE WHEN {control} THEN {aria} END AS aria_label,
  left({_attr('class')}, CASE WHEN role = 'element' THEN 40 ELSE 60 END) AS class_name,
  CASE role WHEN 'input' THEN {_attr('value')} WHEN 'textarea' THEN nullif({_unescape('text')}, '') END AS value,
  CASE WHEN role IN ('select', 'button', 'link') THEN left(short, 60) WHEN role = 'element' THEN short END AS text,
  CASE WHEN role = 'element' AND NOT own THEN short WHEN role IN ('select', 'button', 'link', 'element') THEN whole END AS "full",
  CASE WHEN role = 'img' THEN left({_attr('src')}, 120) END AS src,
  CASE WHEN role = 'img' THEN {_attr('alt')} END AS alt,
  {control} OR role IN ('button', 'link') AS interactive, own AND short IS NOT NULL AS has_text
  FROM kept)"""


_FORM_SQL = f"form_pages AS (SELECT {', '.join(derived.FORM_PAGES)} FROM pages)"
_ELEMENTS = f"{_FORM_SQL}, {elements_ctes('form_pages')}"


# --- nodes and elements ------------------------------------------------------------------------

@query("pages_scan", f"WITH {nodes_ctes('pages')} SELECT page_id, node_no, tag, node_no <= 2000 AS in_cap FROM nodes")
def pages_scan(spark, d):
    return pg.nodes(raw_pages(spark, d)).select("page_id", "node_no", "tag", "in_cap")


_ELEMENT_COLUMNS = (
    "page_id, uid, kept_no, in_cap, role, input_type, name, id, autocomplete, label, placeholder, aria_label, "
    "class_name, value, text, src, alt, interactive"
)


@query("html_elements", f"WITH {_ELEMENTS} SELECT {_ELEMENT_COLUMNS} FROM elements")
def html_elements(spark, d):
    return pg.elements(derived.form_pages(spark, d)).select(*_ELEMENT_COLUMNS.split(", "))


@query("raw_page_elements", f"WITH {elements_ctes('pages')} SELECT {_ELEMENT_COLUMNS} FROM elements")
def raw_page_elements(spark, d):
    return pg.elements(raw_pages(spark, d)).select(*_ELEMENT_COLUMNS.split(", "))


@query(
    "page_body_text",
    f"SELECT page_id, body, length(body) AS n_chars, length(body) > 30000 AS beyond_snapshot FROM (SELECT page_id, {body_text_sql('html')} AS body FROM pages)",
)
def page_body_text(spark, d):
    rows = raw_pages(spark, d).select("page_id", pg.body_text("html").alias("body"))
    size = F.length("body")
    return rows.select("page_id", "body", size.alias("n_chars"), (size > fv.BODY_SNAPSHOT_CHARS).alias("beyond_snapshot"))


@query(
    "skip_tags",
    f"WITH {_FORM_SQL}, {nodes_ctes('form_pages')} SELECT tag, tag IN ({_SKIP}) AS skipped, count(*) AS n FROM nodes GROUP BY 1, 2",
)
def skip_tags(spark, d):
    counted = pg.nodes(derived.form_pages(spark, d)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("tag", pg.is_skipped().alias("skipped"), "n")


@query(
    "visible_elements",
    f"WITH {_FORM_SQL}, {nodes_ctes('form_pages')} SELECT page_id, node_no, tag, {_VISIBLE} AS visible FROM nodes",
)
def visible_elements(spark, d):
    return pg.nodes(derived.form_pages(spark, d)).select("page_id", "node_no", "tag", (pg.is_visible() & ~c("hidden")).alias("visible"))


@query(
    "element_roles",
    f"WITH {_FORM_SQL}, {nodes_ctes('form_pages')} SELECT page_id, {_ROLE} AS role, count(*) AS n FROM nodes WHERE tag NOT IN ({_SKIP}) GROUP BY 1, 2",
)
def element_roles(spark, d):
    kept = pg.nodes(derived.form_pages(spark, d)).where(~pg.is_skipped())
    return kept.groupBy("page_id", pg.role_of().alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("links", f"WITH {_ELEMENTS} SELECT page_id, uid, text FROM elements WHERE role = 'link'")
def links(spark, d):
    return pg.elements(derived.form_pages(spark, d)).where("role = 'link'").select("page_id", "uid", "text")


@query("generic_elements", f"WITH {_ELEMENTS} SELECT page_id, uid, kept_no, tag, has_text, text, class_name FROM elements WHERE role = 'element'")
def generic_elements(spark, d):
    rows = pg.elements(derived.form_pages(spark, d)).where("role = 'element'")
    return rows.select("page_id", "uid", "kept_no", "tag", "has_text", "text", "class_name")


@query("label_fallback", f"WITH {_ELEMENTS} SELECT page_id, uid, label FROM elements WHERE role IN ('input', 'textarea', 'select')")
def label_fallback(spark, d):
    """A control's own label, else its spoken label, else its title."""
    rows = pg.elements(derived.form_pages(spark, d)).where(c("role").isin("input", "textarea", "select"))
    return rows.select("page_id", "uid", "label")


@query("truncate_attrs", f"WITH {_ELEMENTS} SELECT page_id, uid, class_name, src, label FROM elements WHERE class_name IS NOT NULL OR src IS NOT NULL OR label IS NOT NULL")
def truncate_attrs(spark, d):
    """Attributes cut to what is shown: 60 or 40 characters of a class, 120 of a source, 80 of a label."""
    rows = pg.elements(derived.form_pages(spark, d)).select("page_id", "uid", "class_name", "src", "label")
    return rows.where("class_name IS NOT NULL OR src IS NOT NULL OR label IS NOT NULL")


# --- detections of pages ----------------------------------------------------------------------------

_SCANNED = (
    "scanned AS (SELECT page_id, uid, CASE WHEN input_type = 'password' THEN NULL WHEN coalesce(value, '') <> '' THEN value "
    "ELSE nullif(\"full\", '') END AS scanned FROM elements)"
)
_DETECTIONS = f"""{_ELEMENTS}, {_SCANNED}, {duck.hits_ctes('scanned', 'page_id, uid', 'scanned', 't_')},
controls AS (SELECT *, {verdict_sql('category')} AS category, {verdict_sql('confidence')} AS confidence, {verdict_sql('source')} AS source
  FROM elements WHERE role IN ('input', 'textarea', 'select')),
pictures AS (SELECT *, {image_sql('category')} AS category, {image_sql('confidence')} AS confidence FROM elements WHERE role = 'img'),
feeds AS (
  SELECT page_id, uid, 0 AS feed, hit_no, category, CAST(0.9 AS DOUBLE) AS confidence, 'text' AS source, match FROM t_hits
  UNION ALL SELECT page_id, uid, 1, 0, category, confidence, source, coalesce(nullif(label, ''), nullif(placeholder, '')) FROM controls WHERE category IS NOT NULL
  UNION ALL SELECT page_id, uid, 2, 0, category, confidence, 'image', alt FROM pictures WHERE category IS NOT NULL),
detections AS (SELECT page_id, uid, row_number() OVER (PARTITION BY page_id, uid ORDER BY feed, hit_no) AS det_no,
  category, confidence, source, match, 18 AS x, 24 + (uid - 1) * 52 - 2 AS y, 324 AS w, 38 AS h FROM feeds)"""
_BOX = "CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h"
_RECT = ["rect.x", "rect.y", "rect.w", "rect.h"]


@query(
    "analyze_elements",
    f"WITH {_DETECTIONS} SELECT page_id, uid, det_no, category, confidence, source, match, {_BOX} FROM detections",
)
def analyze_elements(spark, d):
    return detect.page_detections(derived.form_pages(spark, d)).select(
        "page_id", "uid", "det_no", "category", "confidence", "source", "match", *_RECT
    )


@query(
    "body_hit_owner",
    f"""WITH {_ELEMENTS}, bodies AS (SELECT page_id, {body_text_sql('html')} AS body FROM form_pages),
{duck.hits_ctes('bodies', 'page_id', 'body', 'b_')}
SELECT h.page_id, h.hit_no, h.category, h.match, min(e.uid) AS uid, CAST(0.86 AS DOUBLE) AS confidence, h.hit_no <= 61 AS in_cap
FROM b_hits h JOIN elements e ON e.page_id = h.page_id AND contains(e.text, h.match) GROUP BY h.page_id, h.hit_no, h.category, h.match""",
)
def body_hit_owner(spark, d):
    owned = detect.body_hit_owners(derived.form_pages(spark, d))
    return owned.select("page_id", "hit_no", "category", "match", "uid", "confidence", "in_cap")


# --- what leaves: summaries, payloads, log lines ----------------------------------------------------------

_LABEL = (
    "coalesce(CASE WHEN role IN ('input', 'textarea') THEN coalesce(nullif(label, ''), nullif(placeholder, '')) "
    "ELSE coalesce(nullif(text, ''), nullif(label, '')) END, '')"
)


def summaries_ctes(elements: str = "elements") -> str:
    return f"""labelled AS (SELECT *, {_LABEL} AS lbl, role IN ('input', 'textarea', 'select', 'button', 'img') AS control
  FROM {elements} WHERE role <> 'link'),
texts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY uid) AS n FROM labelled
  WHERE NOT control AND length(trim(lbl)) BETWEEN 2 AND 80) WHERE n <= 60),
summaries AS (SELECT page_id, role, uid AS id, CASE WHEN length(lbl) > 60 THEN left(lbl, 60) || '…' ELSE lbl END AS text,
  input_type, interactive, 24 + (uid - 1) * 52 AS y FROM (SELECT * FROM labelled WHERE control UNION ALL SELECT * EXCLUDE (n) FROM texts))"""


def summarized(pages: DataFrame) -> DataFrame:
    return detect.summaries(detect.page_rows(pages))


@query(
    "summarize_elements",
    f"WITH {_ELEMENTS}, {summaries_ctes()} SELECT page_id, role, id, text, input_type, interactive, CAST(y AS BIGINT) AS y FROM summaries",
)
def summarize_elements(spark, d):
    return summarized(derived.form_pages(spark, d)).select(
        "page_id", "role", "id", "text", c("inputType").alias("input_type"), "interactive", c("rect.y").alias("y")
    )


@query(
    "summary_cap",
    f"WITH {elements_ctes('pages')}, {summaries_ctes()} SELECT page_id, count(*) AS n_rows, count(*) FILTER (WHERE role = 'element') AS n_texts, "
    "CAST(sum(length(text)) AS BIGINT) AS n_chars FROM summaries GROUP BY 1",
)
def summary_cap(spark, d):
    return summarized(raw_pages(spark, d)).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(c("role") == "element", 1)).alias("n_texts"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query(
    "row_caps",
    f"""WITH {_DETECTIONS}, shown AS (SELECT page_id, uid, det_no, category, row_number() OVER (PARTITION BY page_id ORDER BY uid, det_no) AS n FROM detections)
SELECT page_id, n, uid, category FROM shown WHERE n <= 12""",
)
def row_caps(spark, d):
    """The 12 detections a panel would list for each page."""
    from veilspan.operators import boxes

    found = detect.page_detections(derived.form_pages(spark, d))
    first = boxes.head(found, ["page_id"], [c("uid"), c("det_no")], fv.DETECTIONS_SHOWN)
    return first.select("page_id", c("_rn").alias("n"), "uid", "category")


def page_payloads(spark, d) -> DataFrame:
    return payloads.build(payloads.audited_rows(derived.form_pages(spark, d)), ["page_id"], task="Fill the form")


_PAYLOAD_SQL = f"""{_DETECTIONS}, capped AS (SELECT * FROM elements WHERE in_cap), {summaries_ctes('capped')},
{duck.scrub_ctes('(SELECT page_id, id, text FROM summaries)', 'page_id, id', 'text', 's_')},
first_cat AS (SELECT page_id, uid, category FROM detections WHERE det_no = 1),
n_cat AS (SELECT page_id, count(*) FILTER (WHERE category = 'face') AS n_faces FROM detections GROUP BY 1),
cats AS (SELECT page_id, string_agg(category || '=' || n, ',' ORDER BY category) AS categories
  FROM (SELECT page_id, category, CAST(count(*) AS VARCHAR) AS n FROM detections GROUP BY 1, 2) GROUP BY 1),
bodies AS (SELECT page_id, {body_text_sql('html')} AS body FROM form_pages), {duck.hits_ctes('bodies', 'page_id', 'body', 'b_')},
{duck.regions_ctes('b_hits', 'page_id')},
altered AS (SELECT page_id, sum(r_end - r_start) AS n, sum(greatest(r_end - r_start - 2, 0)) AS masked FROM regions GROUP BY 1),
spanned AS (SELECT page_id, sum(length(match)) AS n FROM b_hits GROUP BY 1),
audits AS (SELECT b.page_id, coalesce(a.n, 0) / length(body) AS pixel_delta, coalesce(s.n, 0) / length(body) AS coverage,
  least(1, (strlen(body) + 2 * coalesce(masked, 0)) / strlen(body)) AS byte_delta
  FROM bodies b LEFT JOIN altered a ON a.page_id = b.page_id LEFT JOIN spanned s ON s.page_id = b.page_id)"""


@query(
    "payload_build",
    f"WITH {_PAYLOAD_SQL} SELECT s.page_id, s.id, s.role, x.scrubbed AS text, s.input_type, s.interactive, f.category AS pii_category, "
    f"'{payloads.SCHEMA_TAG}' AS schema, 'blur' AS scheme, coalesce(categories, '') AS categories, coalesce(n_faces, 0) AS face_count, "
    f"{duck.rounded('pixel_delta')} AS pixel_delta, {duck.rounded('byte_delta')} AS byte_delta, {duck.rounded('coverage')} AS coverage "
    "FROM summaries s JOIN s_scrubbed x ON x.page_id = s.page_id AND x.id = s.id LEFT JOIN first_cat f ON f.page_id = s.page_id AND f.uid = s.id "
    "LEFT JOIN n_cat n ON n.page_id = s.page_id LEFT JOIN cats ON cats.page_id = s.page_id JOIN audits a ON a.page_id = s.page_id",
)
def payload_build(spark, d):
    """One row per listed element, with what the payload says about its page."""
    told = (
        "'schema', _p.schema, 'scheme', _p.redaction.scheme, 'categories', "
        "array_join(transform(array_sort(map_entries(_p.redaction.categories)), _c -> concat(_c.key, '=', _c.value)), ','), "
        "'face_count', _p.redaction.faceCount, 'pixel_delta', round(_p.redaction.audit.pixelDelta, 9), "
        "'byte_delta', round(_p.redaction.audit.byteDelta, 9), 'coverage', round(_p.redaction.audit.redactionCoverage, 9)"
    )
    row = (
        "named_struct('id', _e.id, 'role', _e.role, 'text', _e.text, 'input_type', _e.inputType, 'interactive', _e.interactive, "
        f"'pii_category', _e.piiCategory, {told})"
    )
    # bound in a lambda, the payload is computed once and not once for each field read from it
    listed = let_sql("payload", "_p", f"transform(_p.elements, _e -> {row})")
    return page_payloads(spark, d).select("page_id", F.expr(f"inline({listed})"))


@query(
    "agent_log",
    f"WITH {_PAYLOAD_SQL}, totals AS (SELECT page_id, count(*) AS element_count FROM summaries GROUP BY 1) "
    "SELECT t.page_id, 'Fill the form' AS task, CAST(1 AS BIGINT) AS step, CAST(640 AS BIGINT) AS w, CAST(1100 AS BIGINT) AS h, 'blur' AS scheme, "
    "coalesce(categories, '') AS categories, coalesce(n_faces, 0) AS face_count, "
    f"{duck.rounded('pixel_delta', 4)} AS pixel_delta, {duck.rounded('byte_delta', 4)} AS byte_delta, CAST(0 AS BIGINT) AS image_kb, element_count, TRUE AS timed "
    "FROM totals t LEFT JOIN n_cat n ON n.page_id = t.page_id LEFT JOIN cats ON cats.page_id = t.page_id JOIN audits a ON a.page_id = t.page_id",
)
def agent_log(spark, d):
    return shown_log(payloads.log_rows(page_payloads(spark, d), ["page_id"]))


def shown_log(rows: DataFrame) -> DataFrame:
    """Log lines with the counts as text and the time as a test: it is now, to an hour."""
    counts = F.transform(F.array_sort(F.map_entries("categories")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    now = F.abs(F.unix_seconds("ts") - F.unix_seconds(F.current_timestamp())) < 3600
    return rows.withColumn("categories", F.array_join(counts, ",")).withColumn("timed", now).drop("ts")


# --- JSON bodies -------------------------------------------------------------------------------------------

_S, _L = T.StringType(), T.LongType()
BODY = payloads.struct(
    schema=_S, task=_S,
    user=payloads.struct(name=_S, email=_S, phone=_L, note=_S),
    elements=T.ArrayType(payloads.struct(id=_L, text=_S, password=_S)),
    redaction=payloads.struct(categories=T.MapType(_S, _L), audit=payloads.struct(email=_S)),
    notes=T.ArrayType(_S), comment=_S,
)
_TAG = f"CASE WHEN doc_id % 7 = 3 THEN 'other/2' ELSE '{payloads.SCHEMA_TAG}' END"


def bodies(spark, d) -> DataFrame:
    """One JSON body per planted document; every 11th is cut off and no longer JSON."""
    docs = derived.planted_documents(spark, d)
    body = F.struct(
        F.expr(_TAG).alias("schema"),
        F.concat(F.lit("Call "), c("match_1")).alias("task"),
        F.struct(
            F.lit("Priya").alias("name"), F.concat(F.lit("user"), c("doc_id"), F.lit("@example.com")).alias("email"),
            (F.lit(9876543210) + c("doc_id")).alias("phone"), c("text").alias("note"),
        ).alias("user"),
        F.array(
            F.struct(c("doc_id").alias("id"), c("match_1").alias("text"), F.lit("S3cret").alias("password")),
            F.struct((c("doc_id") + 1).alias("id"), F.lit("plain").alias("text"), F.lit(None).cast("string").alias("password")),
        ).alias("elements"),
        F.struct(
            F.create_map(F.lit("email"), F.lit(2).cast("bigint")).alias("categories"),
            F.struct(c("match_1").alias("email")).alias("audit"),
        ).alias("redaction"),
        F.array(F.lit("none"), c("match_2")).alias("notes"),
        c("match_1").alias("comment"),
    )
    text = F.to_json(body)
    broken = F.when(c("doc_id") % 11 == 5, F.left(text, F.length(text) - 3)).otherwise(text)
    return docs.select("doc_id", broken.alias("body"))


_BODY_SQL = f"""planted AS (SELECT {', '.join(derived.PLANTED)} FROM documents),
good AS (SELECT *, {_TAG} AS tag FROM planted WHERE doc_id % 11 <> 5)"""


@query(
    "payload_ingest",
    f"WITH {_BODY_SQL}, x AS (SELECT *, {_TAG} AS tag FROM planted) SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN 'invalid JSON' "
    f"WHEN tag <> '{payloads.SCHEMA_TAG}' THEN 'unrecognized payload schema' END AS rejected, "
    "CASE WHEN doc_id % 11 <> 5 THEN tag END AS schema, CASE WHEN doc_id % 11 <> 5 THEN length(text) END AS n_chars FROM x",
)
def payload_ingest(spark, d):
    taken = payloads.intake(bodies(spark, d), "body", BODY)
    return taken.select(
        "doc_id", "rejected", c("payload.schema").alias("schema"), F.length("payload.user.note").alias("n_chars")
    )


def _scrubbed_by(column: str, prefix: str) -> str:
    return duck.scrub_ctes(f"(SELECT doc_id, {column} AS v FROM good)", "doc_id", "v", prefix)


@query(
    "scrub_json",
    f"""WITH {_BODY_SQL}, {_scrubbed_by("'Call ' || match_1", 'a_')}, {_scrubbed_by('text', 'b_')}, {_scrubbed_by('match_1', 'c_')}, {_scrubbed_by('match_2', 'd_')}
SELECT g.doc_id, a.scrubbed AS task, 'Priya' AS name, '[REDACTED]' AS email, 9876543210 + g.doc_id AS phone, b.scrubbed AS note,
  c.scrubbed AS element_text, 'S3cret' AS element_password, c.scrubbed AS audit_email, d.scrubbed AS last_note, c.scrubbed AS comment
FROM good g JOIN a_scrubbed a USING (doc_id) JOIN b_scrubbed b USING (doc_id) JOIN c_scrubbed c USING (doc_id) JOIN d_scrubbed d USING (doc_id)
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM planted WHERE doc_id % 11 = 5""",
)
def scrub_json(spark, d):
    """Scrubbed bodies, parsed again; a body that was not JSON has no fields."""
    sent = scrub.scrub_body(bodies(spark, d), "body", BODY).select("doc_id", "sent")
    p = sent.select("doc_id", F.from_json("sent", BODY).alias("p"))
    return p.select(
        "doc_id", "p.task", "p.user.name", "p.user.email", "p.user.phone", "p.user.note",
        F.get("p.elements", F.lit(0))["text"].alias("element_text"),
        F.get("p.elements", F.lit(0))["password"].alias("element_password"),
        c("p.redaction.audit.email").alias("audit_email"), F.get("p.notes", F.lit(1)).alias("last_note"), "p.comment",
    )


_AUDITED = [
    ("user.email", "sensitive-key", None), ("user.email", "pii-pattern", "'user' || CAST(doc_id AS VARCHAR) || '@example.com'"),
    ("user.phone", "sensitive-key", None), ("user.note", "pii-pattern", "text"), ("task", "pii-pattern", "'Call ' || match_1"),
    ("elements.0.text", "pii-pattern", "match_1"), ("elements.0.password", "sensitive-key", None),
    ("redaction.audit.email", "pii-pattern", "match_1"), ("notes.1", "pii-pattern", "match_2"), ("comment", "pii-pattern", "match_1"),
]


def _any_pattern(t: str) -> str:
    return "(" + " OR ".join(f"len({duck.parts(n, t)}) > 1" for n in duck.SCRUB_ORDER) + ")"


_LEAKS_SQL = _BODY_SQL + ", leaks AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{path}' AS path, '{reason}' AS reason FROM good" + (f" WHERE {_any_pattern('(' + value + ')')}" if value else "")
    for path, reason, value in _AUDITED
) + ")"


def audited(spark, d) -> DataFrame:
    """Leaks of every body; a body that is not JSON was refused before and has none."""
    parsed = scrub.audit_body(payloads.intake(bodies(spark, d), "body", BODY), "body", BODY)
    return parsed.select("doc_id", "rejected", "leaks")


@query("leak_audit", f"WITH {_LEAKS_SQL} SELECT doc_id, path, reason FROM leaks")
def leak_audit(spark, d):
    found = audited(spark, d).select("doc_id", F.explode_outer("leaks").alias("l")).where(c("l").isNotNull())
    return found.select("doc_id", "l.path", "l.reason")


@query(
    "audit_verdict",
    f"WITH {_LEAKS_SQL}, n AS (SELECT doc_id, count(*) AS n_leaks FROM leaks GROUP BY 1) SELECT g.doc_id, coalesce(n_leaks, 0) AS n_leaks, "
    f"n_leaks IS NULL AS ok, CASE WHEN n_leaks IS NULL THEN '{fv.VERDICT_CLEAN}' ELSE '{fv.VERDICT_LEAK}' END AS verdict FROM good g LEFT JOIN n ON n.doc_id = g.doc_id",
)
def audit_verdict(spark, d):
    judged = audited(spark, d).where(~c("rejected").eqNullSafe("invalid JSON"))
    judged = judged.select("doc_id", scrub.audit_verdict(c("leaks")).alias("v"))
    return judged.select("doc_id", F.size("v.leaks").alias("n_leaks"), "v.ok", "v.verdict")


# Bodies of five shapes in one column: (shape, JSON text, where note, secret and other stand).
_QUOTED = "to_json(named_struct('v', {}))"


def _q(text: str) -> str:
    """A JSON string with the value of a SQL expression."""
    return f"regexp_replace({_QUOTED.format(text)}, '^.\"v\":|.$', '')"


_SHAPES = [
    (f"concat('{{\"note\":', {_q('text')}, ',\"password\":\"hunter2\",\"n\":', doc_id, '}}')", "$.note", "$.password", "$.n"),
    (f"concat('{{\"note\":', doc_id, ',\"password\":null,\"extra\":', {_q('match_1')}, '}}')", "$.note", "$.password", "$.extra"),
    (f"concat('{{\"note\":{{\"text\":', {_q('text')}, ',\"email\":', {_q('match_1')}, '}},\"AVOID\":', {_q('match_2')}, '}}')", "$.note.text", "$.note.email", "$.AVOID"),
    (f"concat('[{{\"password\":', {_q('match_1')}, ',\"note\":', {_q('text')}, '}},', {_q('match_2')}, ',', doc_id, ']')", "$[0].note", "$[0].password", "$[1]"),
    (f"concat('{{\"note\":[', {_q('text')}, ',{{\"pin\":\"1234\"}}],\"redaction\":{{\"email\":', {_q('match_1')}, '}},\"password\":[\"p\",{{\"x\":', {_q('match_2')}, '}}]}}')",
     "$.note[0]", "$.note[1].pin", "$.password[1].x"),
]


def mixed_bodies(spark, d) -> DataFrame:
    """One JSON body per planted document, in five shapes by document number."""
    cases = " ".join(f"WHEN {i} THEN {text}" for i, (text, *_) in enumerate(_SHAPES))
    return derived.planted_documents(spark, d).select("doc_id", F.expr(f"CASE doc_id % {len(_SHAPES)} {cases} END").alias("body"))


_MIXED_SQL = f"WITH planted AS (SELECT {', '.join(derived.PLANTED)} FROM documents)"


@query(
    "scrub_json_mixed",
    f"""{_MIXED_SQL}, good AS (SELECT * FROM planted), {_scrubbed_by('text', 'a_')}, {_scrubbed_by('match_1', 'b_')}, {_scrubbed_by('match_2', 'c_')}
SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN CAST(doc_id AS VARCHAR) ELSE a.scrubbed END AS note,
  CASE doc_id % 5 WHEN 1 THEN NULL ELSE '[REDACTED]' END AS secret,
  CASE doc_id % 5 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN b.scrubbed ELSE c.scrubbed END AS other
FROM planted JOIN a_scrubbed a USING (doc_id) JOIN b_scrubbed b USING (doc_id) JOIN c_scrubbed c USING (doc_id)""",
)
def scrub_json_mixed(spark, d):
    """Bodies of any shape next to each other, scrubbed without a declared shape."""
    sent = scrub.scrub_body(mixed_bodies(spark, d), "body").select("doc_id", "sent")

    def at(k: int) -> str:
        return "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN get_json_object(sent, '{shape[k]}')" for i, shape in enumerate(_SHAPES)) + " END"

    return sent.select("doc_id", *[F.expr(at(k)).alias(n) for k, n in ((1, "note"), (2, "secret"), (3, "other"))])


_MIXED_LEAKS = [  # (shape, path, reason, value that must hold a pattern)
    (0, "note", "pii-pattern", "text"), (0, "password", "sensitive-key", None), (1, "password", "sensitive-key", None),
    (1, "extra", "pii-pattern", "match_1"), (2, "note.text", "pii-pattern", "text"), (2, "note.email", "sensitive-key", None),
    (2, "note.email", "pii-pattern", "match_1"), (2, "AVOID", "pii-pattern", "match_2"), (3, "0.password", "sensitive-key", None),
    (3, "0.password", "pii-pattern", "match_1"), (3, "0.note", "pii-pattern", "text"), (3, "1", "pii-pattern", "match_2"),
    (4, "note.0", "pii-pattern", "text"), (4, "note.1.pin", "sensitive-key", None), (4, "redaction.email", "pii-pattern", "match_1"),
    (4, "password", "sensitive-key", None), (4, "password.1.x", "pii-pattern", "match_2"),
]


@query(
    "leak_audit_mixed",
    _MIXED_SQL + " " + " UNION ALL ".join(
        f"SELECT doc_id, '{path}' AS path, '{reason}' AS reason FROM planted WHERE doc_id % 5 = {shape}" + (f" AND {_any_pattern('(' + value + ')')}" if value else "")
        for shape, path, reason, value in _MIXED_LEAKS
    ),
)
def leak_audit_mixed(spark, d):
    found = scrub.audit_body(mixed_bodies(spark, d), "body").select("doc_id", F.explode_outer("leaks").alias("l")).where(c("l").isNotNull())
    return found.select("doc_id", "l.path", "l.reason")


# --- commands -------------------------------------------------------------------------------------------------

# The commands an answer may hold, as SQL values; chosen by order number.
_COMMANDS = [
    {"action": "'click'", "uid": "o_orderkey % 9"},
    {"action": "'TYPE'", "uid": "o_orderkey % 7", "text": "o_orderpriority"},
    {"action": "'type'", "id": "CAST(1 AS BIGINT)", "text": "''"},
    {"action": "'scroll'", "amount": "CAST(o_totalprice AS STRING)", "direction": "'up'"},
    {"action": "'scroll'", "amount": "'NaN'", "direction": "'sideways'"},
    {"action": "'wait'", "ms": "CAST(o_totalprice AS STRING)"},
    {"action": "'wait'", "ms": "'soon'"},
    {"action": "'open_url'", "url": "'HTTPS://example.com/' || CAST(o_orderkey AS STRING)"},
    {"action": "'open_url'", "url": "'ftp://example.com'"},
    {"action": "'explode'", "uid": "CAST(1 AS BIGINT)"},
    {"action": "'clear'", "id": "o_orderkey % 5"},
    {"action": "'done'", "text": "'x'"},
]
_COMMAND_TYPES = {"uid": "BIGINT", "id": "BIGINT"}
_COMMAND_FIELDS = ["action", "uid", "id", "text", "amount", "direction", "ms", "url"]
_PER_ANSWER = 10


def _command_field(name: str, index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {cmd[name]}" for i, cmd in enumerate(_COMMANDS) if name in cmd)
    return f"CAST(CASE CAST(({index}) % {len(_COMMANDS)} AS INT) {cases} END AS {_COMMAND_TYPES.get(name, 'STRING')})"


def answers(spark, d) -> DataFrame:
    """One answer of ten commands per order, in an order that depends on its number."""
    fields = ", ".join(f"'{f}', {_command_field(f, 'o_orderkey + i * 3')}" for f in _COMMAND_FIELDS)
    listed = f"transform(sequence(0, {_PER_ANSWER - 1}), i -> named_struct({fields}))"
    return spread(table(spark, d, "orders")).selectExpr("o_orderkey AS answer_id", f"to_json({listed}) AS body")


_COMMANDS_SQL = f"""raw AS (SELECT o_orderkey AS answer_id, i + 1 AS cmd_no,
  {', '.join(f"{_command_field(f, 'o_orderkey + i * 3')} AS {f}" for f in _COMMAND_FIELDS if f not in ("amount", "ms"))},
  CAST((o_orderkey + i * 3) % {len(_COMMANDS)} AS INT) AS kind, o_totalprice
  FROM orders, range(0, 8) r(i)),
clean AS (SELECT answer_id, cmd_no, lower(action) AS action,
  CASE WHEN lower(action) IN ('click', 'clear', 'type') THEN coalesce(uid, id) END AS uid,
  CASE WHEN lower(action) = 'type' THEN left(coalesce(text, ''), 200) END AS text,
  CASE kind WHEN 3 THEN greatest(-5000, least(5000, o_totalprice)) WHEN 4 THEN CAST(600 AS DOUBLE) END AS amount,
  CASE kind WHEN 3 THEN 'up' WHEN 4 THEN 'down' END AS direction,
  CASE kind WHEN 5 THEN greatest(0, least(20000, o_totalprice)) WHEN 6 THEN CAST(500 AS DOUBLE) END AS ms,
  CASE WHEN lower(action) = 'open_url' THEN left(url, 2000) END AS url FROM raw WHERE lower(action) <> 'explode'),
valid AS (SELECT * FROM clean WHERE (action NOT IN ('click', 'clear', 'type') OR uid IS NOT NULL)
  AND (action <> 'type' OR text <> '') AND (action <> 'open_url' OR regexp_matches(url, '^https?://', 'i')))"""


@query("validate_commands", f"WITH {_COMMANDS_SQL} SELECT * FROM valid")
def validate_commands(spark, d):
    return agent.commands(answers(spark, d), ["answer_id"], "body")


@query(
    "commands_known",
    f"WITH {_COMMANDS_SQL} SELECT answer_id, cmd_no, action, uid FROM valid v WHERE uid IS NULL OR EXISTS "
    "(SELECT 1 FROM lineitem WHERE l_orderkey = v.answer_id AND l_linenumber = v.uid)",
)
def commands_known(spark, d):
    elements = table(spark, d, "lineitem").select(c("l_orderkey").alias("answer_id"), c("l_linenumber").alias("uid"))
    known = agent.known_only(agent.commands(answers(spark, d), ["answer_id"], "body"), elements, ["answer_id"])
    return known.select("answer_id", "cmd_no", "action", "uid")


_WANTED = {"name": "name", "email": "email", "phone": "phone|mobile|contact", "dob": "dob|birth", "pincode": "pin ?code|postal"}
_LOOKUP_SQL = f"""WITH fields AS (SELECT {', '.join(derived.FIELDS)}, c_nationkey FROM customer),
f AS (SELECT CAST(c_nationkey AS BIGINT) AS page, field_id AS uid, role, trim(regexp_replace(coalesce(label, ''), '\\s+', ' ', 'g')) AS text,
  field_id % 3 <> 0 AS interactive, {verdict_sql('category')} AS pii_category FROM fields),
""" + ", ".join(
    f"""w_{cat} AS (SELECT page, '{cat}' AS category, uid, CASE WHEN tier <= 1 THEN 'category' ELSE 'label' END AS found_by FROM (
  SELECT page, uid, tier, row_number() OVER (PARTITION BY page ORDER BY tier, uid) AS n FROM (
    SELECT page, uid, CASE WHEN pii_category = '{cat}' AND interactive THEN 0 WHEN pii_category = '{cat}' THEN 1
      WHEN role IN ('input', 'textarea', 'select') AND {duck.matches('text', pattern)} AND interactive THEN 2
      WHEN role IN ('input', 'textarea', 'select') AND {duck.matches('text', pattern)} THEN 3 END AS tier FROM f) WHERE tier IS NOT NULL) WHERE n = 1)"""
    for cat, pattern in _WANTED.items()
) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM w_{cat}" for cat in _WANTED) + ")"


@query("field_lookup", _LOOKUP_SQL)
def field_lookup(spark, d):
    fields = table(spark, d, "customer").selectExpr(*derived.FIELDS, "c_nationkey AS page")
    described = fields.select(
        "page", c("field_id").alias("uid"), "role", c("label").alias("text"),
        (c("field_id") % 3 != 0).alias("interactive"), classify.field()["category"].alias("pii_category"),
    )
    return agent.find_fields(described, ["page"], _WANTED)
