"""Scrub and audit outgoing bodies: plain text, JSON of a declared or any shape, header maps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions import fixed_values as fv
from veilspan.functions import json_walk
from veilspan.functions import regexes as rx
from veilspan.functions.spans import let_sql, raw, test_sql

REDACTED = "[REDACTED]"
LEAKS = "array<struct<path:string,reason:string>>"
NO_LEAKS = f"CAST(array() AS {LEAKS})"

# Order matters: each pattern runs on what the ones before it left.
BODY_PATTERNS = [
    ("aadhaar", rx.quick(rx.DIGIT, rx.BODY_AADHAAR)), ("pan", rx.quick(rx.CAPITAL, rx.PAN)),
    ("phone", rx.quick(rx.PHONE_HEAD, rx.PHONE)), ("email", rx.address()),
    ("card", rx.quick(rx.DIGIT, rx.CARD)), ("account", rx.quick(rx.DIGIT, rx.ACCOUNT)),
]
# Cheap test that must hold before a pattern can match.
_TEST = {"email": "at", "pan": "code"}
_KEY = rx.any_of(fv.SENSITIVE_KEYS)
_META = ", ".join(f"'{k}'" for k in fv.SCRUB_META_KEYS)
_AUDIT_META = ", ".join(f"'{k}'" for k in fv.AUDIT_META_KEYS)
_KEY_PY = re.compile("|".join(f"(?:{p})" for p in fv.SENSITIVE_KEYS), re.I | re.A)


def key_is_sensitive(key: Column) -> Column:
    return key.rlike(_KEY)


def name_is_sensitive(name: str) -> bool:
    """The same test for a field name that is known when the plan is built."""
    return _KEY_PY.search(name) is not None


def _replace_sql(text: str, pattern: str, guard: str) -> str:
    """Each match becomes ``[REDACTED:length]``."""
    p = raw(pattern)
    gaps = f"split({text}, {p}, -1)"
    kept = "zip_with(slice(_g, 1, size(_m)), _m, (_a, _b) -> concat(_a, '[REDACTED:', length(_b), ']'))"
    rebuilt = let_sql(gaps, "_g", f"concat(array_join({kept}, ''), element_at(_g, -1))")
    found = let_sql(f"regexp_extract_all({text}, {p}, 0)", "_m", f"CASE WHEN size(_m) > 0 THEN {rebuilt} ELSE {text} END")
    return f"CASE WHEN {guard} THEN {found} ELSE {text} END"


def scrub_sql(text: str, card_first: bool = False) -> str:
    """SQL that replaces PII patterns one after the other.

    The 4-4-4 pattern runs before the card pattern, so of a spaced card number
    the last group stays.  ``card_first`` closes that gap.
    """
    order = list(BODY_PATTERNS)
    if card_first:
        order.sort(key=lambda p: p[0] != "card")
    scrubbed = "_whole"
    for name, pattern in order:
        guard = test_sql("_s", _TEST.get(name, "run"))
        scrubbed = let_sql(scrubbed, "_s", _replace_sql("_s", pattern, guard))
    # most texts fail all tests, and are then what no pattern can change
    worth = " OR ".join(test_sql("_whole", test) for test in ("at", "run", "code"))
    return let_sql(text, "_whole", f"CASE WHEN {worth} THEN {scrubbed} ELSE _whole END")


def scrub_text(text: str, card_first: bool = False) -> Column:
    """:func:`scrub_sql` of a named column."""
    return F.expr(scrub_sql(text, card_first))


def scrub_value_sql(value: str, dtype: T.DataType, meta: bool = False, depth: int = 0) -> str:
    """Scrub a parsed JSON value.

    Strings under a sensitive key are replaced whole; other strings lose their
    PII patterns; numbers stay.  Keys inside a report subtree are not judged.
    """
    if isinstance(dtype, T.StructType):
        fields = []
        for f in dtype.fields:
            child = f"{value}.`{f.name}`"
            in_meta = meta or f.name in fv.SCRUB_META_KEYS
            if isinstance(f.dataType, T.StringType) and not in_meta and name_is_sensitive(f.name):
                out = f"CASE WHEN {child} IS NOT NULL THEN '{REDACTED}' END"
            else:
                out = scrub_value_sql(child, f.dataType, in_meta, depth)
            fields.append(f"'{f.name}', {out}")
        return f"CASE WHEN {value} IS NOT NULL THEN named_struct({', '.join(fields)}) END"
    if isinstance(dtype, T.ArrayType):
        item = f"_i{depth}"
        return f"transform({value}, {item} -> {scrub_value_sql(item, dtype.elementType, meta, depth + 1)})"
    if isinstance(dtype, T.MapType):
        k, v = f"_k{depth}", f"_v{depth}"
        plain = scrub_value_sql(v, dtype.valueType, meta, depth + 1)
        if not meta and isinstance(dtype.valueType, T.StringType):
            hide = f"{k} RLIKE {raw(_KEY)} AND NOT {k} IN ({_META}) AND {v} IS NOT NULL"
            plain = f"CASE WHEN {hide} THEN '{REDACTED}' ELSE {plain} END"
        elif not meta:
            inside = scrub_value_sql(v, dtype.valueType, True, depth + 1)
            plain = f"CASE WHEN {k} IN ({_META}) THEN {inside} ELSE {plain} END"
        return f"transform_values({value}, ({k}, {v}) -> {plain})"
    if isinstance(dtype, T.StringType):
        return scrub_sql(value)
    return value


def scrub_value(value: str, dtype: T.DataType) -> Column:
    return F.expr(scrub_value_sql(value, dtype))


def _fits_sql(body: str, parsed: str) -> str:
    """Whether the declared shape holds all of a body: the same JSON comes out as went in, nulls included."""
    return f"coalesce(to_json(try_parse_json({body})) = to_json(try_parse_json(to_json({parsed}))), FALSE)"


def scrub_body(df: DataFrame, body: str, schema: T.StructType | None = None, name: str = "sent") -> DataFrame:
    """Adds the scrubbed JSON body; a body that is not JSON is scrubbed as plain text.

    Bodies that ``schema`` holds completely are scrubbed by expressions; bodies of
    any other shape, and all bodies without a schema, by ``json_walk``.  A bare
    JSON number, string or literal passes through.
    """
    if schema is None:
        return df.withColumn(name, json_walk.scrub_any(F.col(body)))
    rows = df.withColumn("_p", F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    rows = rows.withColumn("_fits", F.expr(_fits_sql(f"`{body}`", "_p")))
    other = json_walk.scrub_any(F.expr(f"CASE WHEN NOT _fits THEN `{body}` END"))
    rows = rows.withColumn("_other", other)
    sent = f"CASE WHEN _fits THEN to_json({scrub_value_sql('_p', schema)}) ELSE _other END"
    return rows.withColumn(name, F.expr(sent)).drop("_p", "_fits", "_other")


def audit_body(df: DataFrame, body: str, schema: T.StructType | None = None, name: str = "leaks") -> DataFrame:
    """Adds the leaks of a JSON body of any shape; null for what is not JSON."""
    if schema is None:
        return df.withColumn(name, json_walk.leaks_any(F.col(body)))
    rows = df.withColumn("_p", F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    rows = rows.withColumn("_fits", F.expr(_fits_sql(f"`{body}`", "_p")))
    rows = rows.withColumn("_other", json_walk.leaks_any(F.expr(f"CASE WHEN NOT _fits THEN `{body}` END")))
    found = f"CASE WHEN _fits THEN {_concat(leaks_sql('_p', schema))} ELSE _other END"
    return rows.withColumn(name, F.expr(found)).drop("_p", "_fits", "_other")


def scrub_headers(headers: Column) -> Column:
    return F.transform_values(
        headers, lambda k, v: F.when(key_is_sensitive(k), F.lit(REDACTED)).otherwise(v)
    )


def has_pattern_sql(value: str) -> str:
    """Whether any body pattern occurs; patterns run only behind their cheap test."""
    by_test: dict[str, list[str]] = {}
    for name, pattern in BODY_PATTERNS:
        by_test.setdefault(_TEST.get(name, "run"), []).append(f"_t RLIKE {raw(pattern)}")
    parts = [f"({test_sql('_t', test)} AND ({' OR '.join(found)}))" for test, found in by_test.items()]
    return let_sql(value, "_t", " OR ".join(parts))


def leaks_sql(value: str, dtype: T.DataType, path: str = "", meta: bool = False, depth: int = 0) -> list[str]:
    """SQL arrays of ``struct<path, reason>``; their concatenation holds every leak.

    ``path`` is a SQL expression, empty at the top.
    """

    def hit(where: str, reason: str, test: str) -> str:
        return f"CASE WHEN {test} THEN array(named_struct('path', {where}, 'reason', '{reason}')) ELSE {NO_LEAKS} END"

    def below(key: str) -> str:
        return f"concat({path}, '.', {key})" if path else key

    if isinstance(dtype, T.StructType):
        found = []
        for f in dtype.fields:
            child, where = f"{value}.`{f.name}`", below(f"'{f.name}'")
            in_meta = meta or f.name in fv.AUDIT_META_KEYS
            if not in_meta and name_is_sensitive(f.name):
                found.append(hit(where, "sensitive-key", f"{child} IS NOT NULL"))
            found += leaks_sql(child, f.dataType, where, in_meta, depth)
        return found
    if isinstance(dtype, T.ArrayType):
        item, at = f"_i{depth}", f"_n{depth}"
        inner = _concat(leaks_sql(item, dtype.elementType, below(f"CAST({at} AS STRING)"), meta, depth + 1))
        return [f"coalesce(flatten(transform({value}, ({item}, {at}) -> {inner})), {NO_LEAKS})"]
    if isinstance(dtype, T.MapType):
        entry = f"_e{depth}"
        k, v, where = f"{entry}.key", f"{entry}.value", below(f"{entry}.key")
        inside = _concat(leaks_sql(v, dtype.valueType, where, True, depth + 1))
        if not meta:
            plain = _concat(leaks_sql(v, dtype.valueType, where, False, depth + 1))
            named = hit(where, "sensitive-key", f"{k} RLIKE {raw(_KEY)}")
            inside = f"CASE WHEN {k} IN ({_AUDIT_META}) THEN {inside} ELSE concat({named}, {plain}) END"
        return [f"coalesce(flatten(transform(map_entries({value}), {entry} -> {inside})), {NO_LEAKS})"]
    if isinstance(dtype, T.StringType):
        return [hit(path or "''", "pii-pattern", has_pattern_sql(value))]
    return []


def _concat(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if parts else NO_LEAKS


def leaks(value: str, dtype: T.DataType) -> Column:
    """All leaks in a parsed JSON value as ``array<struct<path, reason>>``."""
    return F.expr(_concat(leaks_sql(value, dtype)))


def audit_verdict(found: Column) -> Column:
    ok = F.size(found) == 0
    return F.struct(
        ok.alias("ok"), found.alias("leaks"),
        F.when(ok, fv.VERDICT_CLEAN).otherwise(fv.VERDICT_LEAK).alias("verdict"),
    )
