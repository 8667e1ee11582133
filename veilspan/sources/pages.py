"""Raw HTML pages to nodes and elements.

There is no browser.  Every opening tag is a node, and its place in the page's tree
is an interval of tags: running counts of opening and closing tags of one name give
each tag its level, and in the order of (name, level, place) a closing tag stands right
behind the one it closes.  A tag that is never closed holds what follows up to the next
tag that does not run inside a line (one that does, also only up to the next one that is
never closed), which counts as its parent's own text too; so one forgotten closing tag
changes nothing elsewhere.  A node's text is all text in its interval, that of hidden parts left out, a
space in front of every tag that does not run inside a line.  Quoted attribute values
may hold any sign.  All of it is array and string functions on one row, so a page never
leaves its partition.

What differs from a live page: style comes from the inline ``style`` and ``hidden``
attributes of a tag and its ancestors (a child cannot become visible again), and boxes
are stacked by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions import text as tx
from veilspan.functions.spans import let_sql, raw, running, running_sum

RAW_TEXT_TAGS = ["script", "style", "noscript", "template", "title", "canvas", "svg"]
STACK_X, STACK_Y, STACK_W, STACK_H, STACK_GAP = 20, 24, 320, 34, 18

COMMENT = r"(?s)<!--.*?-->"
BODY_TAG = r"(?i)</?body\b[^>]*>"
OPTION = r"(?is)<option\b[^>]*>([^<]*)(?:</option\s*>)?"
BLOCK_END = r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/ul|/ol|/table|/section|/article|/main|/form|/nav|/footer|/header)\b[^>]*>"
# What stands inside a tag: quoted values may hold < and >.
INSIDE = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
ANY_TAG = rf"</?[A-Za-z]{INSIDE}>"
TOKEN = rf"</?[A-Za-z]{INSIDE}>?"
# Tags that run inside a line, and tags that hold nothing.
FORMATTING = "b|i|em|strong|u|s|small|mark|sub|sup|font|code|abbr|cite|q|kbd|samp|var|time|del|ins|big|tt|bdi|bdo|wbr"
IN_LINE = [*FORMATTING.split("|"), "a", "span", "label"]
VOID = "area base br col embed hr img input link meta param source track wbr".split()


def _text_through(names: str) -> str:
    return rf"(?:[^<]++|</?(?i:{names})(?=[\s/>]){INSIDE}>)*+"


QUOTED = r"""("[^"]*+"|'[^']*+')"""
HIDDEN_STYLE = r"(?i)(display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(\.0*)?\s*(;|$))"
HIDING_STYLE = r"(?i)(display\s*:\s*none|visibility\s*:\s*hidden)"
HIDDEN_ATTR = r"(?i)\shidden(\s|=|/|$)"


WRAPPED_LABEL = rf'(?is)<label\b([^>]*)>((?:[^<"]++|</?(?:{FORMATTING}|span)(?=[\s/>])[^<>"]*+>)*+)<(input|select|textarea)\b'
LABEL_FOR = rf'(?is)<label\b[^>]*\sfor="([^"]*)"[^>]*>({_text_through(FORMATTING + "|span")})'

# Elements whose content is not markup.
RAW_TEXT = r"(?is)(<(" + "|".join(RAW_TEXT_TAGS) + r")\b[^>]*>).*?(</\2\s*>)"
ATTRIBUTE = r"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _quoted(pattern: str) -> str:
    """A pattern that may hold both kinds of quote, as a SQL literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def body_markup_sql(html: str) -> str:
    clean = f"regexp_replace(regexp_replace({html}, {raw(COMMENT)}, ''), {raw(RAW_TEXT)}, '$1$3')"
    return let_sql(f"split({clean}, {raw(BODY_TAG)}, -1)", "_parts", "coalesce(get(_parts, 1), get(_parts, 0))")


def body_text(html: str) -> Column:
    """Visible text: block ends become line breaks, entities are decoded."""
    markup = f"regexp_replace({body_markup_sql(html)}, {raw(BLOCK_END)}, '\\n')"
    plain = tx.unescape_sql(f"regexp_replace({markup}, {_quoted(ANY_TAG)}, '')")
    lines = f"regexp_replace(regexp_replace({plain}, r'[ \t\r\f]+', ' '), r' ?\n[ \n]*', '\\n')"
    return F.expr(f"regexp_replace({lines}, r'^[ \n]+|[ \n]+$', '')")


def attribute_sql(attrs: str, name: str) -> str:
    """Value of one attribute; null when absent or empty."""
    found = f"regexp_extract({attrs}, {_quoted(ATTRIBUTE.replace('{name}', name))}, 1)"
    bare = f"regexp_replace(_raw, {_quoted(chr(94) + '[' + chr(34) + chr(39) + ']|[' + chr(34) + chr(39) + ']$')}, '')"
    value = let_sql(tx.unescape_sql(bare), "_value", "CASE WHEN _value <> '' THEN _value END")
    read = let_sql(found, "_raw", f"CASE WHEN _raw <> '' THEN {value} END")
    return f"CASE WHEN contains({attrs}, '=') THEN {read} END"


def attribute(attrs: str, name: str) -> Column:
    return F.expr(attribute_sql(attrs, name))


def _marked_up_sql(html: str) -> str:
    """Body markup with option texts and wrapping labels moved to their control."""
    with_options = f"regexp_replace({body_markup_sql(html)}, {raw(OPTION)}, '$1 ')"
    return f"regexp_replace({with_options}, {_quoted(WRAPPED_LABEL)}, '<label$1>$2<$3 data-wrapped-label=\"$2\"')"


def _hides_sql(attrs: str) -> str:
    """Whether a tag hides what is inside it: the name ``hidden``, or a style that is passed on."""
    names = f"regexp_replace({attrs}, {_quoted(QUOTED)}, '')"
    return (
        f"((contains(lower({attrs}), 'hidden') AND {names} RLIKE {raw(HIDDEN_ATTR)})"
        f" OR (contains(lower({attrs}), 'style') AND coalesce({attribute_sql(attrs, 'style')} RLIKE {raw(HIDING_STYLE)}, FALSE)))"
    )


def _pairs_sql(tags: str) -> str:
    """For every tag of ``tags``, in order: ``to``, the place of the tag that closes it, and ``of``, of the one it closes; -1 for none."""
    by_name = f"array_sort(transform(filter({tags}, _t -> _t.kind <> 0), _t -> named_struct('tag', _t.tag, 'pos', _t.pos, 'kind', _t.kind)))"
    levels = running_sum("transform(_named, _t -> _t.kind)")
    by_level = (
        f"array_sort(zip_with(_named, {levels}, (_t, _d) -> named_struct('tag', _t.tag, 'level', "
        "CASE WHEN _t.kind = 1 THEN _d ELSE _d + 1 END, 'pos', _t.pos, 'kind', _t.kind)))"
    )
    meets = "get(_lv, _i {side}).kind = {kind} AND get(_lv, _i {side}).level = _t.level AND get(_lv, _i {side}).tag = _t.tag"
    place = (
        "named_struct('pos', _t.pos, "
        f"'to', CASE WHEN _t.kind = 1 AND {meets.format(side='+ 1', kind=-1)} THEN get(_lv, _i + 1).pos ELSE -1 END, "
        f"'of', CASE WHEN _t.kind = -1 AND {meets.format(side='- 1', kind=1)} THEN get(_lv, _i - 1).pos ELSE -1 END)"
    )
    empty = f"transform(filter({tags}, _t -> _t.kind = 0), _t -> named_struct('pos', _t.pos, 'to', -1, 'of', -1))"
    return let_sql(by_name, "_named", let_sql(by_level, "_lv", f"array_sort(concat(transform(_lv, (_t, _i) -> {place}), {empty}))"))


def _tags_sql(markup: str) -> str:
    """All tags of a page, in document order."""
    name = "[A-Za-z][A-Za-z0-9-]*"
    kind = f"CASE WHEN _tag IN ({_names(VOID)}) THEN 0 WHEN startswith(_p, '</') THEN -1 ELSE 1 END"
    tag = (
        f"named_struct('pos', CAST(_i AS INT), 'tag', _tag, 'kind', {kind}, 'opens', NOT startswith(_p, '</'), "
        f"'attrs', regexp_extract(_p, {_quoted(f'^<{name}({INSIDE})')}, 1), 'block', NOT _tag IN ({_names(IN_LINE)}))"
    )
    named_tag = let_sql(f"lower(regexp_extract(_p, '^</?({name})', 1))", "_tag", tag)
    return f"transform(regexp_extract_all({markup}, {_quoted(TOKEN)}, 0), (_p, _i) -> {named_tag})"


# An array column used inside a lambda could be computed once a step; bound here, it is computed once a page.
def _bound(value: str, *columns: str) -> str:
    for column in columns:
        value = let_sql(column, column, value)
    return value


def _places_sql() -> dict[str, str]:
    """Of ``_tags`` and ``_pairs``, for every tag: open tags that hide, open tags, and where tags that are never closed end.

    Those end at the next block; inside a line also at the next one like them.
    """
    opened = "CASE WHEN _q.to >= 0{} THEN 1 WHEN _q.of >= 0{} THEN -1 ELSE 0 END"
    hiding = running_sum(f"transform(_pairs, _q -> {opened.format(' AND get(_hides, _q.pos)', ' AND get(_hides, _q.of)')})")
    cover = f"CASE WHEN exists(_hides, _h -> _h) THEN {hiding} ELSE array_repeat(0, size(_pairs)) END"
    hides = f"transform(_tags, _t -> _t.kind = 1 AND {_hides_sql('_t.attrs')})"
    loose = "_t.kind = 1 AND get(_pairs, _t.pos).to < 0"

    def ahead(ends: str) -> str:
        places = f"reverse(transform(_tags, _t -> CASE WHEN {ends} THEN _t.pos ELSE size(_tags) END))"
        return f"CASE WHEN exists(_tags, _t -> {loose}) THEN reverse({running(places, 'least({a}, {b})')}) ELSE CAST(array() AS array<int>) END"

    return {
        "_cover": _bound(let_sql(hides, "_hides", cover), "_tags", "_pairs"),
        "_depth": running_sum(f"transform(_pairs, _q -> {opened.format('', '')})"),
        "_next": _bound(ahead("_t.block"), "_tags", "_pairs"),
        "_near": _bound(ahead(f"_t.block OR ({loose})"), "_tags", "_pairs"),
    }


def _nodes_sql() -> str:
    """All opening tags, in order: their text, whether some of it is their own, and whether an ancestor or they hide it."""
    shown = "transform(_tags, _t -> CASE WHEN get(_cover, _t.pos) > 0 THEN '' ELSE get(_texts, _t.pos + 1) END)"
    spaced = "transform(_tags, _t -> concat(CASE WHEN _t.block THEN ' ' ELSE '' END, get(_shown, _t.pos)))"
    own = "transform(_tags, _t -> CASE WHEN get(_shown, _t.pos) RLIKE r'\\S' THEN get(_depth, _t.pos) END)"
    until = (
        "CASE WHEN _t.kind = 0 THEN _t.pos WHEN get(_pairs, _t.pos).to >= 0 THEN get(_pairs, _t.pos).to "
        "ELSE coalesce(get(CASE WHEN _t.block THEN _next ELSE _near END, _t.pos + 1), size(_tags)) END"
    )
    node = (
        "named_struct('tag', _t.tag, 'attrs', _t.attrs, "
        "'text', CASE WHEN _to > _t.pos THEN concat(get(_shown, _t.pos), array_join(slice(_spaced, _t.pos + 2, _to - _t.pos - 1), '')) ELSE '' END, "
        "'own', _to > _t.pos AND exists(slice(_own, _t.pos + 1, _to - _t.pos), _d -> _d <=> get(_depth, _t.pos)), "
        "'hidden', get(_cover, _t.pos) > 0)"
    )
    found = f"transform(filter(_tags, _t -> _t.opens), _t -> {let_sql(until, '_to', node)})"
    found = (
        f"transform({found}, (_n, _i) -> named_struct('node_no', CAST(_i + 1 AS INT), 'tag', _n.tag, 'attrs', _n.attrs, "
        "'text', _n.text, 'own', _n.own, 'hidden', _n.hidden))"
    )
    found = let_sql(shown, "_shown", let_sql(spaced, "_spaced", let_sql(own, "_own", found)))
    return _bound(found, "_texts", "_tags", "_pairs", "_cover", "_depth", "_next", "_near")


def nodes(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """One row per opening tag under the body.

    ``in_cap`` marks the first 2000 nodes, which is as far as a single-page
    walk would look; no node is dropped here.
    """
    # The outer generator with a filter behind it: for the inner one Spark infers size(_nodes) > 0, which would parse every page again.
    rows = with_nodes(pages, keys, html).select(*keys, F.expr("inline_outer(_nodes)")).where("node_no IS NOT NULL")
    return rows.withColumn("in_cap", F.col("node_no") <= fv.MAX_PAGE_NODES)


def _names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def skipped_sql(tag: str) -> str:
    return f"{tag} IN ({_names(fv.SKIPPED_TAGS)})"


def is_skipped(tag: str = "tag") -> Column:
    return F.expr(skipped_sql(tag))


def visible_sql(attrs: str) -> str:
    """By a tag's own attributes: the name ``hidden``, ``type="hidden"``, and the style."""
    style = attribute_sql(attrs, "style")
    names = f"regexp_replace({attrs}, {_quoted(QUOTED)}, '')"
    typed = f"coalesce(lower({attribute_sql(attrs, 'type')}) = 'hidden', FALSE)"
    hidden = (
        f"(contains(lower({attrs}), 'hidden') AND ({names} RLIKE {raw(HIDDEN_ATTR)} OR {typed}))"
        f" OR coalesce({style} RLIKE {raw(HIDDEN_STYLE)}, FALSE)"
    )
    return f"({attrs} = '' OR NOT ({hidden}))"


def is_visible(attrs: str = "attrs") -> Column:
    return F.expr(visible_sql(attrs))


def role_sql(tag: str, attrs: str) -> str:
    return (
        f"CASE WHEN {tag} IN ('input', 'textarea', 'select') THEN {tag} WHEN {tag} = 'button' THEN 'button' "
        f"WHEN {tag} = 'a' AND {attribute_sql(attrs, 'href')} IS NOT NULL THEN 'link' "
        f"WHEN {tag} = 'img' THEN 'img' ELSE 'element' END"
    )


def role_of(tag: str = "tag", attrs: str = "attrs") -> Column:
    """input, textarea, select, button, link, img or element."""
    return F.expr(role_sql(tag, attrs))


def _candidates_sql(nodes_sql: str) -> str:
    """Nodes that become elements, numbered per page; still one array per page."""
    visible = f"filter({nodes_sql}, _n -> NOT _n.hidden AND NOT {skipped_sql('_n.tag')} AND {visible_sql('_n.attrs')})"
    node = (
        "named_struct('node_no', _n.node_no, 'tag', _n.tag, 'attrs', _n.attrs, 'text', _n.text, 'own', _n.own, "
        f"'role', {role_sql('_n.tag', '_n.attrs')}, 'full', _full, 'short', left(_full, 120))"
    )
    described = f"transform({visible}, _n -> {let_sql(tx.short_text_sql(tx.unescape_sql('_n.text'), None), '_full', node)})"
    eligible = (
        f"filter({described}, _n -> _n.role IN ('input', 'textarea', 'select', 'button', 'img') "
        "OR (_n.role = 'link' AND _n.short IS NOT NULL) "
        f"OR (_n.role = 'element' AND (_n.tag IN ({_names(fv.CONTAINER_TAGS)}) OR (_n.own AND _n.short IS NOT NULL))))"
    )
    # Everything eligible is kept until the limit, so the position in this
    # array is the number of elements kept before.
    return (
        f"filter({eligible}, (_n, _i) -> _n.role <> 'element' OR (_n.own AND _n.short IS NOT NULL) "
        f"OR _i <= {fv.EMPTY_CONTAINERS_UNTIL})"
    )


_SHOWN = "CASE WHEN _n.role IN ('select', 'button', 'link') THEN left(_n.short, 60) WHEN _n.role = 'element' THEN _n.short END"


def with_nodes(pages: DataFrame, columns: tuple[str, ...], html: str = "html") -> DataFrame:
    """Some columns of pages, the markup and the array of nodes; in steps, since one expression for all would nest too deep."""
    rows = pages.select(*columns, F.expr(_marked_up_sql(html)).alias("_markup"))
    rows = rows.select("*", F.expr(f"split(_markup, {_quoted(TOKEN)}, -1)").alias("_texts"), F.expr(_tags_sql("_markup")).alias("_tags"))
    rows = rows.select("*", F.expr(_pairs_sql("_tags")).alias("_pairs"))
    rows = rows.select("*", *[F.expr(value).alias(name) for name, value in _places_sql().items()])
    return rows.select(*columns, "_markup", F.expr(_nodes_sql()).alias("_nodes"))


def shown_texts(nodes: str) -> Column:
    """``array<struct<uid, text>>`` of the elements that show text, in page order."""
    shown = f"transform({_candidates_sql(nodes)}, _n -> named_struct('uid', _n.node_no, 'text', {_SHOWN}))"
    return F.expr(f"filter({shown}, _n -> _n.text IS NOT NULL)")


def _stacked_sql(uid: str) -> str:
    """Stand-in for layout: elements in one column, one below the other."""
    return (
        f"named_struct('x', {STACK_X}, 'y', CAST({STACK_Y} + ({uid} - 1) * {STACK_H + STACK_GAP} AS INT), "
        f"'w', {STACK_W}, 'h', {STACK_H})"
    )


def _described_sql(markup: str, nodes: str) -> str:
    """Element structs; every attribute is read once, and only where its role uses it."""
    candidates = _candidates_sql(nodes)
    control = "_n.role IN ('input', 'textarea', 'select')"

    def attr(name: str) -> str:
        return attribute_sql("_n.attrs", name)

    def for_controls(value: str) -> str:
        return f"CASE WHEN {control} THEN {value} END"

    # First label written for this id; an unlabelled control has position 0.
    for_label = tx.unescape_sql("get(_labels.text, CAST(array_position(_labels.id, _id) AS INT) - 1)")
    no_tags = f"regexp_replace(coalesce({attr('data-wrapped-label')}, {for_label}), {_quoted(ANY_TAG)}, '')"
    own_label = let_sql(
        f"left(trim({no_tags}), 80)", "_l", "CASE WHEN _l <> '' THEN _l END"
    )
    fields = {
        "uid": "_n.node_no",
        "kept_no": "CAST(_i + 1 AS INT)",
        "in_cap": f"_n.node_no <= {fv.MAX_PAGE_NODES} AND _i < {fv.MAX_PAGE_ELEMENTS}",
        "tag": "_n.tag",
        "role": "_n.role",
        "input_type": f"CASE _n.role WHEN 'input' THEN coalesce(lower({attr('type')}), 'text') "
                      "WHEN 'textarea' THEN 'textarea' WHEN 'select' THEN 'select-one' END",
        "name": for_controls(attr("name")),
        "id": "_id",
        "autocomplete": for_controls(attr("autocomplete")),
        "label": for_controls(f"coalesce({own_label}, {attr('aria-label')}, {attr('title')})"),
        "placeholder": for_controls(attr("placeholder")),
        "aria_label": for_controls(attr("aria-label")),
        "class_name": f"left({attr('class')}, CASE WHEN _n.role = 'element' THEN 40 ELSE 60 END)",
        "value": f"CASE _n.role WHEN 'input' THEN {attr('value')} WHEN 'textarea' THEN "
                 + let_sql(tx.unescape_sql("_n.text"), "_t", "CASE WHEN _t <> '' THEN _t END") + " END",
        "text": _SHOWN,
        # what is scanned: a container without text of its own is read whole in its parts
        "full": "CASE WHEN _n.role = 'element' AND NOT _n.own THEN _n.short WHEN _n.role IN ('select', 'button', 'link', 'element') THEN _n.full END",
        "src": f"CASE WHEN _n.role = 'img' THEN left({attr('src')}, 120) END",
        "alt": f"CASE WHEN _n.role = 'img' THEN {attr('alt')} END",
        "interactive": f"{control} OR _n.role IN ('button', 'link')",
        "has_text": "_n.own AND _n.short IS NOT NULL",
        "rect": _stacked_sql("_n.node_no"),
    }
    struct = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    own_id = f"CASE WHEN {control} OR _n.role = 'img' THEN {attr('id')} END"
    label = _quoted(LABEL_FOR)
    written = f"named_struct('id', regexp_extract_all({markup}, {label}, 1), 'text', regexp_extract_all({markup}, {label}, 2))"
    # Bound outside the lambda, so that the labels of a page are collected once.
    return let_sql(written, "_labels", f"transform({candidates}, (_n, _i) -> {let_sql(own_id, '_id', struct)})")


def element_arrays(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """Each page with an array of its elements."""
    return with_nodes(pages, tuple(keys), html).select(*keys, F.expr(_described_sql("_markup", "_nodes")).alias("elements"))


def elements(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """One row per element of a page with its role, attributes, text and stacked box.

    ``uid`` is the node number and ``kept_no`` the element's place on its page.
    A container without text of its own is kept only while at most 200 elements are kept
    before it; ``in_cap`` marks what a single-page walk would return (2000
    nodes, 500 elements).
    """
    rows = element_arrays(pages, keys, html).select(*keys, F.expr("inline_outer(elements)"))
    return rows.where("uid IS NOT NULL")
