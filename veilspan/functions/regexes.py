"""Text patterns for Spark's Java regex engine.

Digit and identifier patterns use look-around so that a long number is never
matched in part.  ``\\b`` in Java follows Unicode letters; ours is spelled out
over ASCII word characters, so text in any language gives the same spans.
"""

ASCII_WORD = "A-Za-z0-9_"
BOUNDARY = (
    f"(?:(?<![{ASCII_WORD}])(?=[{ASCII_WORD}])|(?<=[{ASCII_WORD}])(?![{ASCII_WORD}]))"
)

# --- fixed values: what each category looks like in text -----------------------------
AADHAAR = r"(?<!\d)(?<![0-9][\s-])\d{4}[\s-]?\d{4}[\s-]?\d{4}(?![\s-]?\d)"
PAN = r"(?<![A-Z0-9])[A-Z]{5}\d{4}[A-Z](?![A-Z0-9])"
PHONE = r"(?<!\d)(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD = r"(?<!\d)(?:\d{4}[\s-]?){3}\d{4}(?!\d)"
IFSC = r"(?<![A-Z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Z0-9])"
ACCOUNT = r"(?<!\d)\d{9,18}(?!\d)"
DOB = r"(?<!\d)\d{1,2}[\/-]\d{1,2}[\/-]\d{4}(?!\d)"
CVV = r"(?<!\d)\d{3}(?!\d)"
OTP = r"(?<!\d)\d{4,6}(?!\d)"
# Outgoing bodies use a looser 4-4-4 pattern than text scans do.
BODY_AADHAAR = r"(?<!\d)\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)"
# --------------------------------------------------------------------------------------


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern in Java's dialect, optionally case-insensitive."""
    text = pattern.replace(r"\b", BOUNDARY)
    return f"(?i){text}" if ignore_case else text


def any_of(patterns: list[str], ignore_case: bool = True) -> str:
    """One alternation that matches when any of the patterns does."""
    return java("|".join(f"(?:{p})" for p in patterns), ignore_case)


def quick(first: str, pattern: str) -> str:
    """The same pattern behind a look-ahead for how a match begins.

    The engine then gives up at most positions before it tries look-behind;
    that halves the time of a scan and does not change what matches.
    """
    return f"(?={first})" + java(pattern)


# What the first character of a match can be.
DIGIT, PHONE_HEAD, CAPITAL = "[0-9]", "[+6-9]", "[A-Z]"


def address() -> str:
    """What EMAIL matches, in time proportional to the text.

    All starts inside one run of local characters meet the same at-sign, so only
    the first can matter: the first word character of the run, or, right behind
    an earlier match, the sign that ends a word there.  A run is then read once.
    The long look-behind is tried only where a sign stands in front.
    """
    local, signs, word = "[A-Za-z0-9._%+-]", "[.%+-]", f"[{ASCII_WORD}]"
    far = rf"(?:(?<=(?:\A|[^A-Za-z0-9._%+-]|\G){signs}{{1,64}})|(?<={signs}{{65}}))"
    before = rf"(?:(?<!{signs})|(?<={signs})(?:(?<=\G{signs})|(?<!{word}{signs}){far}))"
    first = rf"(?:(?={word})(?<!{word}){before}|\G(?<={word})(?={signs}))"
    head, tail = EMAIL.split("@")
    assert head == rf"\b{local}+"
    return java(rf"{first}{local}++@{tail}")


# Every numeric pattern matches inside one run of digits, separators and plus
# signs, and so does all it looks at on either side.  Such a run of eight or
# more characters is rare in prose (a year or a price is shorter).
NUMBER_RUN = r"[0-9+][0-9+/\s-]{7,}"
# Five capitals and a digit, or four and a zero: what PAN and IFSC codes need.
CODE_HEAD = "[A-Z]{4}(?:0|[A-Z][0-9])"
