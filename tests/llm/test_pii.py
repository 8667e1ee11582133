"""Anchor expansion against plain regular expressions."""

import hashlib
import random
import re
import time

from veilspan.llm import pii
from veilspan.llm.common import table
from veilspan.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(m):
    return re.sub("[^0-9]", "", m.group())


def brute(text):
    out = {"email": [m.span() for m in EMAIL.finditer(text)]}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


def base(finder, text):
    spans = finder.spans(text)
    return {k: spans[k] for k in pii.BASE}


def test_random_texts():
    rng, finder = random.Random(5), pii.Finder()
    for alphabet in ("a@.b", "12.", "4 1-", "+1 (2)-.", "a1@.+ -", "0123456789 -.+@ab"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
            assert base(finder, text) == brute(text), text


def test_cards():
    finder = pii.Finder()
    for text in ("4111 1111 1111 1111", "x4111-1111-1111-1111y 4111111111111112", "é 4111111111111111", "4111  1111 1111 1111"):
        assert base(finder, text) == brute(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_added_kinds():
    spans = pii.Finder().spans("see https://ann@host.org/x and https://host.org/y; IBAN: DE89 3704 0044 0532 0130 00. Account no 50100234567890, iban DE00 1234 5678 9012")
    assert [(a, b) for a, b in spans["url"]] == [(4, 26)]
    assert len(spans["account"]) == 2


def test_long_runs_are_linear():
    finder, start = pii.Finder(), time.time()
    for unit in ("a", "a.", "1", "1.", "1 ", "+1", "@", "a@", "a.a@b", "http://", "account "):
        finder.spans(unit * (400_000 // len(unit)))
    assert time.time() - start < 30


def test_query(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}
    rows = QUERIES["op10_pii"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(pii.joined(want, pii.BASE).encode()).hexdigest()
        assert r.spans.startswith(pii.joined(want, pii.BASE))


def test_scrub_keeps_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", 3), (1, None, 3), (None, "", 4)], "doc_id long, text string, n_email int")
    rows = sorted(pii.scrub(docs).collect(), key=str)
    assert {r.text for r in rows} == {"mail [EMAIL] now", None, ""}
    assert {(r.doc_id, r.n_email) for r in pii.found(docs).collect()} == {(1, 1), (1, 0), (None, 0)}
    assert pii.found(docs.limit(0)).count() == 0
