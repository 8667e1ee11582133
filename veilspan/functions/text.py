"""Small text functions: shortening, masking, fallbacks, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions.spans import let_sql

ELLIPSIS = "…"
BULLET = "•"
BLOCK = "█"


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def collapse(value: Column) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def short_text(value: Column, limit: int = 120) -> Column:
    """Collapsed text cut to ``limit`` characters; null when nothing is left."""
    return blank_to_null(F.left(collapse(value), F.lit(limit)))


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def clip(value: Column, limit: int) -> Column:
    """Cut to ``limit`` characters; empty becomes null."""
    return blank_to_null(F.left(value, F.lit(limit)))


def ellipsize(value: Column, limit: int) -> Column:
    text = F.coalesce(value, F.lit(""))
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(ELLIPSIS))
    ).otherwise(text)


def mask_all(value: Column, char: str = BULLET) -> Column:
    return F.repeat(F.lit(char), F.length(value))


def tokens(value: Column) -> Column:
    """Lower-case runs of letters and digits."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: w != "")


def scan_source_sql(of: str = "") -> str:
    """The text of an element that may be scanned; a password never is."""
    return (
        f"CASE WHEN {of}input_type = 'password' THEN NULL WHEN {of}value <> '' THEN {of}value "
        f"WHEN {of}text <> '' AND length({of}text) < {fv.ELEMENT_SCAN_CHARS} THEN {of}text END"
    )


def first_filled_sql(*values: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {v} <> '' THEN {v} END" for v in values) + ")"


def luma(color: Column) -> Column:
    """Perceived brightness 0..1 of an ``rgb()`` or ``rgba()`` string; null otherwise."""
    pattern = r"rgba?\((\d+),\s*(\d+),\s*(\d+)"
    channel = [F.regexp_extract(color, pattern, i).cast("double") for i in (1, 2, 3)]
    red, green, blue = fv.LUMA_WEIGHTS
    total = F.lit(red) * channel[0] + F.lit(green) * channel[1] + F.lit(blue) * channel[2]
    return F.when(color.rlike(pattern), total / 255)


def readable_on(color: Column) -> Column:
    """Text colour that can be read on a background colour."""
    return F.when(luma(color) > fv.LUMA_LIMIT, fv.DARK_TEXT).when(
        luma(color).isNotNull(), fv.LIGHT_TEXT
    ).otherwise(fv.DARK_TEXT)


def success_seen(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).rlike("(?i)" + fv.SUCCESS_WORDS)


ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
]


def unescape_sql(value: str) -> str:
    """Decode the common HTML entities (``&amp;`` last); text without ``&`` is passed on."""
    decoded = "_u"
    for entity, char in ENTITIES:
        decoded = f"replace({decoded}, '{entity}', " + ('"\'"' if char == "'" else f"'{char}'") + ")"
    return let_sql(value, "_u", f"CASE WHEN contains(_u, '&') THEN {decoded} ELSE _u END")


def short_text_sql(value: str, limit: int | None = 120) -> str:
    """Collapsed text, cut to ``limit`` characters if there is one; null when nothing is left."""
    collapsed = f"trim(regexp_replace({value}, r'\\s+', ' '))"
    collapsed = f"left({collapsed}, {limit})" if limit else collapsed
    return let_sql(collapsed, "_t", "CASE WHEN _t <> '' THEN _t END")
