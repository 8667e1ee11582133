"""Classify form fields, images and identifiers by ordered rules.

A verdict is ``struct<category, confidence, source>`` or null.  The rules are a
``CASE`` chain, so Spark stops at the first rule that matches and nothing is
joined or exploded.  Callers may pass rules of their own in front of ours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions import regexes as rx
from veilspan.functions.spans import let_sql, raw

VERDICT = "struct<category:string,confidence:double,source:string>"
NO_VERDICT = f"CAST(NULL AS {VERDICT})"
Rule = tuple[str, float, str]

# Column names of an element table, as the field classifier reads them.
FIELD_COLUMNS = [
    "input_type", "autocomplete", "label", "placeholder", "aria_label", "name", "id", "class_name",
]


def _verdict(category: str, confidence: float, source: str) -> str:
    return f"named_struct('category', {category}, 'confidence', {confidence!r}D, 'source', '{source}')"


def joined_sql(separator: str, *values: str) -> str:
    """Non-empty values with a separator; empty when there are none."""
    filled = ", ".join(f"CASE WHEN {v} <> '' THEN {v} END" for v in values)
    return f"concat_ws('{separator}', {filled})"


def first_rule_sql(text: str, rules: Sequence[Rule], source: str, skip: dict[str, str] | None = None) -> str:
    """Verdict of the first rule whose pattern is found in a text that is not empty."""

    def found(pattern: str) -> str:
        return f"_hay RLIKE {raw(rx.java(pattern, ignore_case=True))}"

    cases = ["WHEN _hay = '' THEN NULL"]
    for category, confidence, pattern in rules:
        test = found(pattern)
        if skip and category in skip:
            test += f" AND NOT {found(skip[category])}"
        reported = fv.REPORTED_AS.get(category, category)
        cases.append(f"WHEN {test} THEN {_verdict(repr(reported), confidence, source)}")
    return let_sql(text, "_hay", f"CASE {' '.join(cases)} ELSE {NO_VERDICT} END")


def by_type_sql(input_type: str) -> str:
    conf = fv.SOURCE_CONFIDENCE
    told = conf["autocomplete"] * 0.98
    return (
        f"CASE {input_type} WHEN 'password' THEN {_verdict(repr('password'), conf['type'], 'type')} "
        f"WHEN 'email' THEN {_verdict(repr('email'), told, 'autocomplete')} "
        f"WHEN 'tel' THEN {_verdict(repr('phone'), told, 'autocomplete')} END"
    )


def by_autocomplete_sql(autocomplete: str) -> str:
    """A 26-entry constant map: cheaper than a join, and it stays in the projection."""
    entries = ", ".join(f"'{k}', '{v}'" for k, v in fv.AUTOCOMPLETE.items())
    verdict = _verdict("_known", fv.SOURCE_CONFIDENCE["autocomplete"], "autocomplete")
    return let_sql(
        f"try_element_at(map({entries}), lower({autocomplete}))", "_known",
        f"CASE WHEN _known IS NOT NULL THEN {verdict} END",
    )


def by_label_sql(label: str, placeholder: str, aria_label: str, extra: Sequence[Rule] = ()) -> str:
    return first_rule_sql(
        joined_sql(" | ", label, placeholder, aria_label), [*extra, *fv.LABEL_RULES], "label"
    )


def by_hint_sql(name: str, id_: str, class_name: str, extra: Sequence[Rule] = ()) -> str:
    return first_rule_sql(
        joined_sql(" ", name, id_, class_name), [*extra, *fv.HINT_RULES], "hint",
        skip={"account_number": fv.ACCOUNT_HINT_GUARD},
    )


def field_sql(of: str = "", extra_labels: Sequence[Rule] = (), extra_hints: Sequence[Rule] = ()) -> str:
    """Type, then autocomplete, then label text, then identifier hints.

    ``of`` is put in front of each column name (``"_n."`` inside a lambda).
    """
    c = {name: of + name for name in FIELD_COLUMNS}
    return (
        f"coalesce({by_type_sql(c['input_type'])}, {by_autocomplete_sql(c['autocomplete'])}, "
        f"{by_label_sql(c['label'], c['placeholder'], c['aria_label'], extra_labels)}, "
        f"{by_hint_sql(c['name'], c['id'], c['class_name'], extra_hints)})"
    )


def image_sql(of: str = "", extra: Sequence[Rule] = ()) -> str:
    hay = joined_sql(" ", *[of + name for name in ("src", "alt", "class_name", "id")])
    return first_rule_sql(hay, [*extra, *fv.IMAGE_RULES], "image")


# The same over the columns of a table.

def by_type() -> Column:
    return F.expr(by_type_sql("input_type"))


def by_autocomplete() -> Column:
    return F.expr(by_autocomplete_sql("autocomplete"))


def by_label(extra: Sequence[Rule] = ()) -> Column:
    return F.expr(by_label_sql("label", "placeholder", "aria_label", extra))


def by_hint(extra: Sequence[Rule] = ()) -> Column:
    return F.expr(by_hint_sql("name", "id", "class_name", extra))


def by_name(column: str, extra: Sequence[Rule] = ()) -> Column:
    """Identifier hints over one column that holds names."""
    return F.expr(by_hint_sql(column, "''", "''", extra))


def field(extra_labels: Sequence[Rule] = (), extra_hints: Sequence[Rule] = ()) -> Column:
    return F.expr(field_sql("", extra_labels, extra_hints))


def image(extra: Sequence[Rule] = ()) -> Column:
    return F.expr(image_sql("", extra))


def confidence_of(source: Column) -> Column:
    entries = [F.lit(x) for pair in fv.SOURCE_CONFIDENCE.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), source)


def always_sensitive(category: Column) -> Column:
    return category.isin(fv.ALWAYS_SENSITIVE)


def optionally_sensitive(category: Column) -> Column:
    return category.isin(fv.OPTIONALLY_SENSITIVE)


def rules_from(table: DataFrame, limit: int = 1000) -> list[Rule]:
    """User rules (rule_no, category, confidence, pattern) as a list.

    Rule lists are configuration.  A table above ``limit`` is refused, not cut.
    """
    rows = table.orderBy("rule_no").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a rule table may hold at most {limit} rules")
    return [(r["category"], float(r["confidence"]), r["pattern"]) for r in rows]
