"""Phrase fingerprints against a plain parser and exact set likeness."""

import hashlib
import random

import pytest

from veilspan.llm import lz
from veilspan.llm.common import table
from veilspan.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain_phrases(text):
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen  # what is left is a phrase already


def test_parse_is_lz78():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("abé "[:rng.randrange(1, 5)]) for _ in range(rng.randrange(60)))
        seen = set()
        assert set(lz.parse(text, seen)[0]) == seen and seen == plain_phrases(text)
        cut, early = rng.randrange(len(text) + 1), set()
        _, left = lz.parse(text[:cut], early)
        lz.parse(left + text[cut:], early)
        assert early == seen


def test_likeness_is_near_exact():
    a, b = {f"x{i}" for i in range(3000)}, {f"x{i}" for i in range(1500, 4500)}
    assert abs(lz.likeness(lz.signature(list(a)), lz.signature(list(b))) - 1500 / 4500) < 0.13
    assert lz.likeness(lz.signature(list(a)), lz.signature(list(a))) == 1
    assert lz.likeness(lz.signature([]), lz.signature([])) == 1 and lz.likeness(lz.signature(list(a)), lz.signature([])) == 0


def expected(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        k = len(text) // 2
        edited = text[:len(text) - k] + after[:k]
        sigs = [lz.signature(list(plain_phrases(t))) for t in (text, edited, after)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), lz.written(sigs[0]), lz.written(sigs[1]),
                    lz.likeness(sigs[0], sigs[1]), lz.likeness(sigs[0], sigs[2])))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").collect()]
    assert rows(QUERIES["op9_lz_fingerprint"](spark, SF_DIR)) == expected(docs)


@pytest.mark.parametrize("docs", [
    [(1, "alone here")], [(1, None), (2, "")], [(5, "b b"), (5, "a a"), (None, "x y"), (9, None), (-3, "é" * 50)], []])
def test_odd_tables(spark, monkeypatch, docs):
    monkeypatch.setattr(lz, "DOCS_PER_RANGE", 2)
    assert rows(lz.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))) == expected(docs)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(lz, "DOCS_PER_RANGE", 3)
    rng = random.Random(4)
    docs = [(rng.randrange(-10**15, 10**15) if i % 3 else 10**17 + i, " ".join(rng.choice(["ab", "cd", "e"]) for _ in range(rng.randrange(9)))) for i in range(100)]
    df = spark.createDataFrame([(*d, "t") for d in docs], "doc_id long, text string, part string").repartition(7)
    assert rows(lz.fingerprints(df)) == expected(docs)
