"""SimHash components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from veilspan.llm import simhash
from veilspan.llm.common import table
from veilspan.llm.components import components
from veilspan.llm.queries import QUERIES


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    """Smallest id of each row's component, from (doc_id, fingerprint)."""
    fps = np.array(sorted({f for _, f in rows}), np.uint64)
    label = np.arange(len(fps))
    for i, f in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(fps ^ f) <= 3)
        group = np.isin(label, label[near])
        label[group] = label[near].min()
    at = {int(f): int(label[i]) for i, f in enumerate(fps)}
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[at[f]] = min(doc_id, least.get(at[f], doc_id))
    return sorted(((d, f"{f:016x}", least.get(at[f])) for d, f in rows), key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, f"/root/testdata/sf{sf}", "documents").collect()]
    got = sorted(map(tuple, QUERIES["op6_simhash"](spark, f"/root/testdata/sf{sf}").collect()), key=str)
    assert got == brute([(d, plain_fingerprint(t)) for d, t in docs])


def near_fingerprints(rng, centres=40, around=60):
    out = []
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(around):
            f = centre
            for _ in range(rng.randrange(7)):
                f ^= 1 << rng.randrange(64)
            out.append(f)
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_links_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(6)
    fps = near_fingerprints(rng) + [rng.getrandbits(64) for _ in range(500)] + [0xFFFF << 48 | rng.getrandbits(16) for _ in range(200)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64 if f >> 63 else 0) for f in fps]
    pairs = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5)).collect()
    arr = np.array(fps, np.uint64)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in pairs)
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    place = {s: i for i, s in enumerate(signed)}
    for r in pairs:
        root[max(top(place[r.a]), top(place[r.b]))] = min(top(place[r.a]), top(place[r.b]))
    for i, f in enumerate(arr):
        for j in np.flatnonzero(np.bitwise_count(arr ^ f) <= 3):
            assert top(i) == top(int(j))


def test_thresholds_add_up():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    parts = simhash.Partitions([list(range(i, 64, 4)) for i in range(4)], 3)
    counts = [np.bincount(parts.told(parts.value(fps, i)), minlength=1 << 16).astype(float) for i in range(4)]
    counts[2][:] = 1e6
    parts.estimate(counts)
    t = parts.thresholds(fps)
    assert ((t + 1).sum(axis=0) == 4).all() and (t[2] == -1).all()


@pytest.mark.parametrize("groups,most", [(4, 3), (4, 12), (3, 9), (3, 12)])
def test_thresholds_of_wide_radii_add_up(groups, most):
    parts = simhash.Partitions([list(range(i, 64, groups)) for i in range(groups)], most)
    parts.estimate([np.ones(1 << simhash.TOLD)] * groups)
    t = parts.thresholds(np.arange(50, dtype=np.uint64))
    assert ((t + 1).sum(axis=0) == most + 1).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_odd_tables(spark):
    words = "one two three four five six seven"
    docs = [(3, words, "a"), (9, words.upper(), "b"), (None, words, "c"), (None, None, "d"), (4, "", "e"), (3, words, "a"), (5, "unlike any", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert got == brute([(d, plain_fingerprint(t)) for d, t, _ in docs])
    kept = simhash.without_copies(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.fp) for r in kept.collect() if r.fp) == [(3, "a"), (4, "e")] and kept.count() == 3
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.without_copies(df.limit(0)).count() == 0
