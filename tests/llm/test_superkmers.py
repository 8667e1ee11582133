"""Removal of repeated passages against brute force."""

import random
import re

import numpy as np
import pytest

from veilspan.llm import superkmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def brute(docs):
    """(doc_id, n_words, n_removed, kept) of each (doc_id, text)."""
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words):
        for k in range(len(w) - 12):
            window = tuple(w[k:k + 13])
            first[window] = min(first.get(window, LAST), LAST if i is None else i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < (LAST if i is None else i) for j in range(13)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def made(seed, n=120):
    """Texts that share passages of many lengths, copies, repeats, short and empty texts, null and repeated ids."""
    rng = random.Random(seed)
    line = [f"l{i}" for i in range(30)]
    passages = [[f"p{k}w{rng.randrange(40)}" for _ in range(rng.randrange(10, 40))] for k in range(8)] + [line, ["same"] * 20]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += rng.choice([p, p[a:], [f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 15))]])
        docs.append((None if i % 17 == 0 else (i * 7) % n // (1 + i % 3), rng.choice([" ", "\t\n ", " "]).join(words)))
    docs += [(5000 + i, docs[3][1]) for i in range(40)] + [(4, docs[4][1])] * 30 + [(9, None), (10, ""), (11, " \n "), (-3, "Été " * 30), (12, "été " * 30), (LAST, docs[5][1])]
    return docs


def found(spark, docs, parts=7):
    frame = spark.createDataFrame([(a, b, 1, 2, 3, "x") for a, b in docs], "doc_id long, text string, _id int, _key int, key int, starts string").repartition(parts)
    return sorted((tuple(r) for r in superkmers.without_repeats(frame).collect()), key=repr)


@pytest.mark.parametrize("held", [superkmers.HELD, 50, 3])
def test_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(superkmers, "HELD", held)
    monkeypatch.setattr(superkmers, "SORTED", held)
    docs = made(held)
    want = brute(docs)
    assert sum(r[2] for r in want) > 1000
    assert found(spark, docs) == want


def test_parts_of_long_texts_and_frequent_strings(spark, monkeypatch):
    docs = made(1) + [(7000, " ".join(f"w{i % 977}" for i in range(60_000))), (7001, " ".join(f"w{(i + 5) % 977}" for i in range(2_000)))]
    want = brute(docs)
    assert found(spark, docs) == want
    monkeypatch.setattr(superkmers, "PIECE", 40)
    monkeypatch.setattr(superkmers, "FREQUENT", 3)
    monkeypatch.setattr(superkmers, "COUNTED", 5)
    monkeypatch.setattr(superkmers, "MOST", 1 << 8)
    monkeypatch.setattr(superkmers, "FEWEST", 1 << 6)
    assert found(spark, docs) == want


def test_one_hash_for_all_windows(spark, monkeypatch):
    """Windows of one hash are told apart by their words."""
    import numpy as np

    rows = superkmers.pa.RecordBatch.from_pydict({"bucket": [1, 1, 1], "packed": [b" ".join(b"a%d" % (i + k) for i in range(14)) for k in (0, 1, 5)],
                                                  "least": [9, 2, 1], "most": [9, 2, 1], "copies": [1, 1, 1]})
    monkeypatch.setattr(superkmers.Line, "hashes", lambda self, a, b: np.zeros(len(a), np.uint64))
    got = superkmers._firsts(rows).to_pylist()
    assert [(r["key"], r["firsts"]) for r in got] == [(superkmers.key_of(rows["packed"][0].as_py()), [9, 2])]


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 0, "")]


def test_strings_are_combined_in_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "HELD", 4)
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{passage} own{i} " + " ".join(f"v{i % 3}x{j}" for j in range(30))) for i in range(12)]
    docs = spark.createDataFrame(rows, "_id long, text string").coalesce(1)
    known = np.zeros(0, np.uint64)
    shared = superkmers.Bits(np.full(16, 2**64 - 1, np.uint64))
    found = {}
    for r in superkmers.strings_of(docs, known, shared).collect():
        old = found.setdefault(bytes(r["packed"]), [r["bucket"], r["least"], r["most"], 0])
        assert old[0] == r["bucket"] and r["least"] <= r["most"] and r["copies"] > 0
        old[1], old[2], old[3] = min(old[1], r["least"]), max(old[2], r["most"]), old[3] + r["copies"]
    expected = {}
    for i, text in rows:
        strings = superkmers.Strings([superkmers.words_of(text)], [(0, 0)], known)
        for string, bucket in zip(strings.words(np.arange(len(strings.rows))), strings.minimisers.view(np.int64).tolist()):
            old = expected.setdefault(string, [bucket, i, i, 0])
            old[1], old[2], old[3] = min(old[1], i), max(old[2], i), old[3] + 1
    assert found == expected
