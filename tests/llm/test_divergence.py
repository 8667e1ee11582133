"""The audit of sources against exact sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from veilspan.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least):
    groups, held, langs = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        words = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        groups[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
        langs.add(lang or "")
    out = []
    for lang in langs:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(mine.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in mine.items()}, shares(whole)
        for s in mine:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if mine[s][t] and p[s][t] > q[t])[:50]
            out += [(lang, s, part, item, -v, i) for part, rows in (("pair", pairs), ("term", more)) for i, (v, _, item) in enumerate(rows, 1)]
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    words = [f"{rng.choice('abÉéß')}{'xyzabc'[i % 6]}{'qrstuv'[i // 6 % 6]}" for i in range(120)]
    docs = []
    for i in range(n):
        source = rng.choice(["a", "b", "é", "", None, *[f"s{k}" for k in range(12)]])
        mine = words[sum(map(ord, source or "")) % 3::2] if rng.random() < .5 else words
        text = rng.choice(" 1-\x00").join(rng.choice([w, w.upper()]) for w in rng.choices(mine, k=rng.randrange(40)))
        docs.append((rng.choice([text, text, text, None, "", "123 .."]), rng.choice(["en", "en", "de", None, ""]), source))
    return docs + [("one two", "rare", "r1"), (None, "rare", "r2"), ("x", "alone", "q")] + [docs[0]] * 30


def found(spark, docs, least):
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "text string, lang string, source string, term string, n int, total int").repartition(6)
    return sorted(tuple(r) for r in divergence.audit(frame, least).collect())


@pytest.mark.parametrize("slice_,held,at_once", [(divergence.SLICE, divergence.HELD, divergence.AT_ONCE), (7, 20, 5)])
def test_against_brute_force(spark, monkeypatch, slice_, held, at_once):
    for name, value in (("SLICE", slice_), ("HELD", held), ("AT_ONCE", at_once)):
        monkeypatch.setattr(divergence, name, value)
    docs = made(2)
    want = brute(docs, 12)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "rare" and r[4] == 0 for r in want)
    assert found(spark, docs, 12) == want


def test_empty(spark):
    assert found(spark, [], 1) == []
    assert found(spark, [(None, None, None)], 1) == []


def test_very_long_text(spark):
    docs = [("ab " * 200_000 + "cd", "en", "s"), ("cd ef", "en", "t")]
    assert found(spark, docs, 1) == brute(docs, 1)
