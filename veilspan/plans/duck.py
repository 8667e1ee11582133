"""DuckDB SQL for the checks.

DuckDB's regular expressions have no look-around, so the text is marked first:
every digit run is wrapped in Y and Z, a plus sign behind a digit becomes P,
and for scan-Aadhaar a separator between two runs is wrapped in J.  A pattern
on the marked text then says what look-around says on the plain one.
"""

from __future__ import annotations

from veilspan.functions import fixed_values as fv

Y, Z, J, P, M = "", "", "", "", ""
_SEP = f"(?:{Z}[\\s-]{Y})?"
_JSEP = f"(?:{J}[\\s-]{J})?"
_N = "[0-9]"

PATTERNS = {
    "aadhaar": ("j", f"{Y}{_N}{{4}}{_JSEP}{_N}{{4}}{_JSEP}{_N}{{4}}{Z}"),
    "body_aadhaar": ("m", f"{Y}{_N}{{4}}{_SEP}{_N}{{4}}{_SEP}{_N}{{4}}{Z}"),
    "pan": ("a", f"{Y}[A-Z]{{5}}{_N}{{4}}[A-Z]{Z}"),
    "phone": ("m", f"(?:\\+?{Y}91{_SEP}|{Y})[6-9]{_N}{{4}}{_SEP}{_N}{{5}}{Z}"),
    "email": ("t", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    "credit_card": ("m", f"{Y}(?:{_N}{{4}}{_SEP}){{3}}{_N}{{4}}{Z}"),
    "ifsc": ("a", f"{Y}[A-Z]{{4}}0[A-Z0-9]{{6}}{Z}"),
    "dob": ("m", f"{Y}{_N}{{1,2}}{Z}[/-]{Y}{_N}{{1,2}}{Z}[/-]{Y}{_N}{{4}}{Z}"),
    "account_number": ("m", f"{Y}{_N}{{9,18}}{Z}"),
    "cvv": ("m", f"{Y}{_N}{{3}}{Z}"),
    "otp": ("m", f"{Y}{_N}{{4,6}}{Z}"),
}
SCAN_ORDER = ["aadhaar", "pan", "phone", "email", "credit_card", "ifsc", "dob", "account_number"]
SCRUB_ORDER = ["body_aadhaar", "pan", "phone", "email", "credit_card", "account_number"]


def _base(kind: str, t: str) -> str:
    m = f"replace(regexp_replace({t}, '[0-9]+', '{Y}\\0{Z}', 'g'), '{Z}+', '{Z}{P}')"
    if kind == "m":
        return m
    if kind == "j":
        return f"regexp_replace({m}, '{Z}([\\s-]){Y}', '{J}\\1{J}', 'g')"
    if kind == "a":
        return f"regexp_replace({t}, '[A-Z0-9]+', '{Y}\\0{Z}', 'g')"
    return t


def parts(name: str, t: str) -> str:
    """Text cut at the matches; even places (from 1) are the matches."""
    kind, pattern = PATTERNS[name]
    cut = f"string_split(regexp_replace({_base(kind, t)}, '{pattern}', '{M}\\0{M}', 'g'), '{M}')"
    return (
        f"list_transform({cut}, lambda p: replace(regexp_replace(p, '[{Y}{Z}{J}]', '', 'g'), '{P}', '+'))"
    )


def spans(source: str, key: str, text: str, name: str) -> str:
    """(key, category, match, start) of one pattern."""
    return f"""
SELECT {key}, category, match, CAST(upto - length(match) AS BIGINT) AS start FROM (
  SELECT {key}, '{name}' AS category, p AS match, k,
         sum(length(p)) OVER (PARTITION BY {key} ORDER BY k) AS upto
  FROM (SELECT {key}, unnest(ps) AS p, generate_subscripts(ps, 1) AS k
        FROM (SELECT {key}, {parts(name, text)} AS ps FROM {source}) WHERE len(ps) > 1))
WHERE k % 2 = 0"""


def luhn_ok(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    total = (
        f"list_sum(list_transform(string_split(reverse({d}), ''), lambda c, i: "
        "CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) * 2 > 9 THEN CAST(c AS INT) * 2 - 9"
        " ELSE CAST(c AS INT) * 2 END))"
    )
    return f"(CASE WHEN length({d}) BETWEEN 13 AND 19 THEN {total} % 10 = 0 ELSE FALSE END)"


def hits_ctes(source: str, key: str, text: str, prefix: str = "") -> str:
    """CTEs that end in ``{prefix}hits(key, hit_no, category, match, start)``."""
    each = " UNION ALL ".join(
        f"SELECT *, {i} AS rank FROM ({spans(source, key, text, n)})" for i, n in enumerate(SCAN_ORDER)
    )
    keys = [k.strip() for k in key.split(",")]
    same = " AND ".join(f"o.{k} = s.{k}" for k in keys)
    return f"""{prefix}every AS MATERIALIZED ({each}),
{prefix}kept AS (
  SELECT * FROM {prefix}every s
  WHERE (category <> 'credit_card' OR {luhn_ok('match')})
    AND (category <> 'account_number' OR NOT EXISTS (
      SELECT 1 FROM {prefix}every o WHERE {same} AND o.category <> 'account_number'
        AND (o.category <> 'credit_card' OR {luhn_ok('o.match')})
        AND o.start <= s.start AND o.start + length(o.match) >= s.start + length(s.match)))),
{prefix}hits AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY rank, start) AS hit_no,
         category, match, start FROM {prefix}kept)"""


def scrub_ctes(source: str, key: str, text: str, prefix: str = "") -> str:
    """CTEs that end in ``{prefix}scrubbed(key, text, scrubbed)``."""
    ctes = [f"{prefix}c0 AS (SELECT {key}, {text} AS text, {text} AS t FROM {source})"]
    for i, name in enumerate(SCRUB_ORDER, 1):
        ctes.append(
            f"{prefix}c{i} AS (SELECT {key}, text, array_to_string(list_transform({parts(name, 't')}, lambda p, i: "
            f"CASE WHEN i % 2 = 0 THEN '[REDACTED:' || CAST(length(p) AS VARCHAR) || ']' ELSE p END), '') AS t "
            f"FROM {prefix}c{i - 1})"
        )
    ctes.append(f"{prefix}scrubbed AS (SELECT {key}, text, t AS scrubbed FROM {prefix}c{len(SCRUB_ORDER)})")
    return ",\n".join(ctes)


def regions_ctes(hits: str, key: str) -> str:
    """CTE ``regions(key, r_start, r_end)``: overlapping spans merged."""
    return f"""flagged AS (
  SELECT *, start + length(match) AS stop,
         max(start + length(match)) OVER (PARTITION BY {key} ORDER BY start, start + length(match), category
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM {hits}),
numbered AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END)
         OVER (PARTITION BY {key} ORDER BY start, stop, category ROWS UNBOUNDED PRECEDING) AS region FROM flagged),
regions AS (SELECT {key}, region, min(start) AS r_start, max(stop) AS r_end FROM numbered GROUP BY {key}, region)"""


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def matches(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '{pattern.replace(chr(39), chr(39) * 2)}', 'i')"


def number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def rule_case(hay: str, rules, what: str, guard: dict | None = None) -> str:
    """CASE over ordered rules; ``what`` is ``category`` or ``confidence``."""
    cases = []
    for category, confidence, pattern in rules:
        test = matches(hay, pattern)
        if guard and category in guard:
            test += f" AND NOT {matches(hay, guard[category])}"
        value = f"'{fv.REPORTED_AS.get(category, category)}'" if what == "category" else number(confidence)
        cases.append(f"WHEN {test} THEN {value}")
    return f"(CASE {' '.join(cases)} END)"


def sensitive_key(key: str) -> str:
    return matches(key, "|".join(f"(?:{p})" for p in fv.SENSITIVE_KEYS))


def rounded(value: str, digits: int = 9) -> str:
    return f"round(CAST({value} AS DOUBLE), {digits})"
