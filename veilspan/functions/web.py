"""URLs, content types, base64 sizes and agent commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv


def b64_bytes(data_url: Column) -> Column:
    """Decoded size of a base64 data URL; 0 when it has no comma."""
    body = F.when(data_url.contains(","), F.get(F.split(data_url, ",", 3), F.lit(1))).otherwise("")
    padding = F.when(body.endswith("=="), 2).when(body.endswith("="), 1).otherwise(0)
    return F.floor(F.length(body) * F.lit(3) / F.lit(4)).cast("long") - padding


def clipped_url(url: Column) -> Column:
    return F.left(F.coalesce(url, F.lit("")), F.lit(fv.MAX_URL_CHARS))


def url_is_valid(url: Column) -> Column:
    return clipped_url(url).rlike("(?i)^https?://")


def url_path(url: Column) -> Column:
    """Percent-decoded path without query or fragment; ``/`` becomes the index page."""
    raw = F.regexp_extract(F.substring_index(F.substring_index(url, "#", 1), "?", 1), r"^[a-zA-Z]+://[^/]*(.*)$", 1)
    # url_decode also turns '+' into a space, which a path must not.
    path = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return F.when(path.isin("", "/"), "/index.html").otherwise(path)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for none or for a dot file."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def mime_type(ext: Column) -> Column:
    entries = [F.lit(x) for pair in fv.MIME_TYPES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), ext), F.lit(fv.DEFAULT_MIME))
