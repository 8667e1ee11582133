"""PII spans in text as array columns: no shuffle, no Python, whole texts.

A span is ``struct<category, match, start>``; ``start`` counts code points
from 0.  Functions take the name of a text column (a lambda variable or a
struct field will do) and are written as Spark SQL, which is parsed once;
building the same tree call by call takes longer than scanning a small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import regexes as rx

SPAN_ARRAY = "array<struct<category:string,match:string,start:int>>"
NO_SPANS = f"CAST(array() AS {SPAN_ARRAY})"
#: Up to this many values a running combine needs no blocks.
_BLOCK = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let_sql(value: str, name: str, body: str) -> str:
    """The same in SQL text."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prefix(values: str, combine: str) -> str:
    """Inclusive running combine over one short array."""
    return (
        f"aggregate(slice({values}, 2, greatest(size({values}) - 1, 0)), slice({values}, 1, 1),"
        f" (_acc, _e) -> concat(_acc, array({combine.format(a='element_at(_acc, -1)', b='_e')})))"
    )


def running(values: str, combine: str) -> str:
    """Inclusive running combine of an array; ``combine`` is SQL over {a} and {b}.

    Done in blocks and then over block totals: with blocks of about the cube root,
    n values cost about n^(4/3) element copies instead of n squared.
    """
    in_blocks = let_sql(
        f"greatest({_BLOCK}, CAST(ceil(1.3 * cbrt(size(_v))) AS INT))", "_n",
        "transform(sequence(1, CAST(ceil(size(_v) / _n) AS INT)), _b -> "
        f"{let_sql('slice(_v, (_b - 1) * _n + 1, _n)', '_s', _prefix('_s', combine))})",
    )
    last_of_each = "transform(_bs, _b -> element_at(_b, -1))"
    shifted = (
        "flatten(transform(_bs, (_b, _i) -> CASE WHEN _i = 0 THEN _b "
        f"ELSE transform(_b, _e -> {combine.format(a='get(_t, _i - 1)', b='_e')}) END))"
    )
    joined = let_sql(let_sql(last_of_each, "_l", _prefix("_l", combine)), "_t", shifted)
    blocked = let_sql(in_blocks, "_bs", joined)
    return let_sql(
        values, "_v",
        f"CASE WHEN size(_v) <= 1 THEN _v WHEN size(_v) <= {_BLOCK} THEN {_prefix('_v', combine)} ELSE {blocked} END",
    )


def running_sum(values: str) -> str:
    return running(values, "{a} + {b}")


def running_max(values: str) -> str:
    return running(values, "greatest({a}, {b})")


def raw(pattern: str) -> str:
    """A regular expression as a SQL string literal."""
    if "'" not in pattern:
        return f"r'{pattern}'"
    if '"' in pattern:
        raise ValueError("a raw pattern may hold one kind of quote only")
    return f'r"{pattern}"'


PIECES = "array<struct<category:string,match:string,step:int>>"


def pieces_sql(text: str, category: str, pattern: str, guard: str) -> str:
    """All matches of one pattern, each with the length from the end of the one before to its own end.

    The pieces between matches and the matches alternate, so running sums of
    the steps are the ends; no marker characters enter the text.
    """
    p = raw(pattern)
    stepped = (
        f"CASE WHEN size(_m) > 0 THEN zip_with(slice(split({text}, {p}, -1), 1, size(_m)), _m, (_g, _x) -> "
        f"named_struct('category', '{category}', 'match', _x, 'step', length(_g) + length(_x))) ELSE CAST(array() AS {PIECES}) END"
    )
    found = let_sql(f"regexp_extract_all({text}, {p}, 0)", "_m", stepped)
    return f"CASE WHEN {guard} THEN CAST({found} AS {PIECES}) ELSE CAST(array() AS {PIECES}) END"


def located_sql(pieces: str) -> str:
    """Pieces to spans."""
    ends = running_sum("transform(_p, _q -> _q.step)")
    return let_sql(
        pieces, "_p",
        f"zip_with(_p, {ends}, (_q, _to) -> named_struct('category', _q.category, 'match', _q.match, "
        "'start', CAST(_to - length(_q.match) AS INT)))",
    )


def luhn_sql(value: str) -> str:
    """Luhn check of the digits in a string; 13 to 19 digits only."""
    return let_sql(
        f"regexp_replace({value}, '[^0-9]', '')", "_d",
        "length(_d) BETWEEN 13 AND 19 AND luhn_check(_d)",
    )


def luhn(value: str) -> Column:
    return F.expr(luhn_sql(value))


# category -> (pattern, cheap test that must hold first)
TEXT_PATTERNS = {
    "aadhaar": (rx.quick(rx.DIGIT, rx.AADHAAR), "run"),
    "pan": (rx.quick(rx.CAPITAL, rx.PAN), "code"),
    "phone": (rx.quick(rx.PHONE_HEAD, rx.PHONE), "run"),
    "email": (rx.address(), "at"),
    "credit_card": (rx.quick(rx.DIGIT, rx.CARD), "run"),
    "ifsc": (rx.quick(rx.CAPITAL, rx.IFSC), "code"),
    "dob": (rx.quick(rx.DIGIT, rx.DOB), "run"),
    "account_number": (rx.quick(rx.DIGIT, rx.ACCOUNT), "run"),
    "cvv": (rx.quick(rx.DIGIT, rx.CVV), "true"),
    "otp": (rx.quick(rx.DIGIT, rx.OTP), "true"),
}


def test_sql(text: str, name: str) -> str:
    return {
        "run": f"{text} RLIKE {raw(rx.NUMBER_RUN)}", "code": f"{text} RLIKE {raw(rx.CODE_HEAD)}",
        "at": f"contains({text}, '@')", "true": "true",
    }[name]


# Order in which a scan reports; account numbers come last, after the cover rule.
SPECIFIC = ["aadhaar", "pan", "phone", "email", "credit_card", "ifsc", "dob"]


def find(text: str, category: str) -> Column:
    """Spans of one category (account numbers before the cover rule)."""
    pattern, test = TEXT_PATTERNS[category]
    found = located_sql(pieces_sql(text, category, pattern, test_sql(text, test)))
    if category == "credit_card":
        found = f"filter({found}, _c -> {luhn_sql('_c.match')})"
    return F.expr(f"CAST({found} AS {SPAN_ARRAY})")


IN_RUNS = [name for name, (_, test) in TEXT_PATTERNS.items() if test == "run"]
IN_TEXT = ["pan", "email", "ifsc"]


def _with_cover_rule(text: str, keep: str) -> str:
    """``keep`` is SQL over ``_others`` and the account numbers no other span contains.

    The text is read once for its number runs; five of the eight patterns then
    see only those short pieces.  The flags ``_f`` are bound by the caller.
    """
    whole = [pieces_sql(text, "run", rx.NUMBER_RUN, "_f.run")] + [
        pieces_sql(text, name, TEXT_PATTERNS[name][0], f"_f.{TEXT_PATTERNS[name][1]}") for name in IN_TEXT
    ]
    top = f"transform(array({', '.join(whole)}), _one -> {located_sql('_one')})"
    numeric = ", ".join(pieces_sql("_run.match", name, TEXT_PATTERNS[name][0], "true") for name in IN_RUNS)
    moved = "named_struct('category', _x.category, 'match', _x.match, 'start', _x.start + _run.start)"
    in_runs = (
        f"transform(get(_top, 0), _run -> transform(array({numeric}), "
        f"_one -> transform({located_sql('_one')}, _x -> {moved})))"
    )

    def of(name: str) -> str:
        if name in IN_TEXT:
            return f"get(_top, {IN_TEXT.index(name) + 1})"
        spans = f"flatten(transform(_in, _r -> get(_r, {IN_RUNS.index(name)})))"
        return f"filter({spans}, _c -> {luhn_sql('_c.match')})" if name == "credit_card" else spans

    # Only a span with a long digit run can cover an account number.
    accounts = (
        f"filter({of('account_number')}, _a -> NOT exists(_long, _o -> _o.start <= _a.start"
        " AND _o.start + length(_o.match) >= _a.start + length(_a.match)))"
    )
    accounts = let_sql("filter(_others, _o -> length(_o.match) >= 9)", "_long", accounts)
    kept = let_sql(f"concat({', '.join(of(name) for name in SPECIFIC)})", "_others", keep.format(accounts=accounts))
    return f"CAST({let_sql(top, '_top', let_sql(in_runs, '_in', kept))} AS {SPAN_ARRAY})"


def _when_worth_it(text: str, full: str) -> str:
    """Three cheap tests, each run once; most texts fail them all."""
    flags = "named_struct(" + ", ".join(f"'{t}', {test_sql(text, t)}" for t in ("run", "code", "at")) + ")"
    return let_sql(flags, "_f", f"CASE WHEN _f.run OR _f.code OR _f.at THEN {full} ELSE {NO_SPANS} END")


def scan_sql(text: str) -> str:
    """Every span of a text: category order first, then position."""
    return _when_worth_it(text, _with_cover_rule(text, "concat(_others, {accounts})"))


def scan(text: str) -> Column:
    return F.expr(scan_sql(text))


def scan_accounts(text: str) -> Column:
    """Account numbers after the cover rule."""
    return F.expr(_when_worth_it(text, _with_cover_rule(text, "{accounts}")))


def span_end(span: Column) -> Column:
    return span["start"] + F.length(span["match"])


def unnest(df: DataFrame, spans: str, *keys: str, numbered: str | None = None) -> DataFrame:
    """One row per span.

    The outer generator with a filter behind it keeps Spark from inferring
    ``size(spans) > 0`` below, which would scan every text twice.
    """
    rows = df.select(*keys, F.posexplode_outer(spans)).where(F.col("col").isNotNull())
    number = [(F.col("pos") + 1).alias(numbered)] if numbered else []
    return rows.select(*keys, *number, "col.*")
