"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues.  Each anchor wakes a small parser that expands left
and right from it over the characters its kind may hold, and keeps the span if it
is valid.  Text without anchors costs nothing but the pass.

Base kinds are email, ip, card and phone; they are what leftmost non-overlapping
matching of their grammar finds, failing matches dropped and not tried again.
The method adds two kinds: ``url`` (an address behind a scheme that carries a user
or a query) and ``account`` (a number behind a cue such as "account" or "iban").

Every parser reads a run of characters once and the next anchor of its kind
starts behind that run, so a text costs time in proportion to its length.

Defined results: a null text is empty; offsets count code points, ends exclusive;
doc_id may be null or repeated, rows are independent; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veilspan.llm.common import in_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")

#: Words behind which an account number may stand, and schemes.
CUES = ("account", "acct", "a/c", "iban", "konto", "compte", "cuenta")
SCHEMES = ("http://", "https://", "ftp://")

_DIGITS = "0123456789"
_LOCAL_LEFT = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9.]+")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"[0-9][\x20().0-9-]*")
_ADDRESS = re.compile(r"[^\s<>\"'`]+")
_NUMBER = re.compile(r"[^0-9A-Za-z]{0,8}(?:(?:no|number|nr|num)\b[^0-9A-Za-z]{0,4})?([A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?|[0-9](?:[ -]?[0-9]){5,17})(?![0-9A-Za-z])",
                     re.ASCII | re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def iban(number: str) -> bool:
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in _DIGITS:
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


class Finder:
    """Spans of one text at a time."""

    def __init__(self):
        self.anchors = automaton()

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """(start, end) by kind, in order."""
        out = {kind: [] for kind in KINDS}
        ends = dict.fromkeys(("at", "dotted", "chain", "url"), 0)
        cues = []
        for last, (anchor, width) in self.anchors.iter(text):
            start = last + 1 - width
            if anchor == "digit":
                if start >= ends["dotted"]:
                    ends["dotted"] = _dotted(text, start, out["ip"])
                if start >= ends["chain"]:
                    ends["chain"] = _chain(text, start, out["card"])
            elif anchor == "at":
                ends["at"] = _email(text, start, ends["at"], out["email"])
            elif anchor == "plus":
                _phone(text, start, out["phone"])
            elif anchor == "scheme":
                if start >= ends["url"]:
                    ends["url"] = _url(text, start, last + 1, out["url"])
            else:
                cues.append(last + 1)
        for end in cues:
            _account(text, end, out["account"])
        return out


def _email(text: str, at: int, floor: int, out: list) -> int:
    """The address around the at-sign; returns where the next local part may begin."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return max(floor, at)
    domain = _DOMAIN.match(text, at + 1)
    if not domain:
        return max(floor, at)
    out.append((start, domain.end()))
    return domain.end()


def _dotted(text: str, start: int, out: list) -> int:
    """Groups of four numbers inside a run of digits and dots."""
    end = _DOTTED.match(text, start).end()
    numbers, at = [], start
    for part in text[start:end].split("."):
        numbers = [*numbers, (at, part)] if part else []
        if len(numbers) == 4:
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for _, p in numbers):
                out.append((numbers[0][0], at + len(part)))
            numbers = []
        at += len(part) + 1
    return end


def _chain(text: str, start: int, out: list) -> int:
    """Digits with at most one space or hyphen between any two."""
    m = _CHAIN.match(text, start)
    digits = m.group().replace(" ", "").replace("-", "") if m.end() - start < 40 else ""
    if 13 <= len(digits) <= 19 and luhn(digits):
        out.append(m.span())
    return m.end()


def _phone(text: str, plus: int, out: list) -> None:
    m = _PHONE.match(text, plus + 1)
    if not m:
        return
    end = plus + 1 + len(m.group().rstrip(" ().-"))
    if end - plus >= 4 and 9 <= sum(c in _DIGITS for c in text[plus + 1:end]) <= 15:
        out.append((plus, end))


def _url(text: str, start: int, host: int, out: list) -> int:
    """An address that can name a person: a user before the host, or a query."""
    m = _ADDRESS.match(text, host)
    if not m:
        return host
    rest = m.group().rstrip(".,;:!?)]}")
    if rest and ("?" in rest or "@" in rest.split("/", 1)[0]):
        out.append((start, host + len(rest)))
    return m.end()


def _account(text: str, end: int, out: list) -> None:
    """A number right behind a cue: an IBAN that checks, or 6 to 18 digits."""
    m = _NUMBER.match(text, end)
    if not m or out and m.start(1) < out[-1][1]:
        return
    number = re.sub("[ -]", "", m.group(1)).upper()
    if number[0] in _DIGITS or iban(number):
        out.append(m.span(1))


def joined(spans: dict[str, list[tuple[int, int]]], kinds: Iterable[str]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in spans[kind])


def scrubbed(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind in KINDS for a, b in spans[kind]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def found(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, and all spans."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in in_slices(batches):
            columns = [[] for _ in range(len(BASE) + 2)]
            for text in batch.column(1).to_pylist():
                spans = finder.spans(text or "")
                digest = hashlib.sha256(joined(spans, BASE).encode()).hexdigest()
                for column, value in zip(columns, [*(len(spans[k]) for k in BASE), digest, joined(spans, KINDS)]):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64())] + [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])], schema=schema)

    ddl = "doc_id long, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def scrub(docs: DataFrame, column: str = "text") -> DataFrame:
    """The documents with every span of the column replaced; all columns and rows are kept, null stays null."""
    place = docs.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in in_slices(batches):
            texts = [None if t is None else scrubbed(t, finder.spans(t)) for t in batch.column(place).to_pylist()]
            columns = batch.columns
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
