"""The Merkle manifest against a version without Spark."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from veilspan.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, pos int, digest string, other string, block int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests):
    """Root, and for each digest its steps (left, right)."""
    steps, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, k in enumerate(at):
            run = k - k % 16
            steps[i].append(("".join(digests[run:k]), "".join(digests[k + 1:run + 16])))
        digests = [H(*digests[i:i + 16]) for i in range(0, len(digests), 16)]
        at = [k // 16 for k in at]
    return digests[0], steps


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    root, up = tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, up):
        for r, steps in zip(by[s], trees[s][1]):
            path = steps + above
            other = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                other = (*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))
            digest = leaf(other)
            for a, b in path:
                digest = H(a, digest, b)
            out.append((r[0], leaf(r), trees[s][0], root, H(*[a + b for a, b in path]), digest, digest == root))
    return sorted(out, key=repr)


def made(n, sources, seed=3):
    rng = random.Random(seed)
    rows = [(i - 40, rng.choice(sources), rng.choice(["en", "", None]), rng.choice([i, None]), rng.choice(["Some Text Ä", "low", "", None]) and f"T{i} É x") for i in range(n)]
    rows += [(None, sources[0], None, None, t) for t in ("a", "b", None)] + [(5, sources[-1], "en", 1, "Twice")] * 20 + [(5, sources[-1], "en", 1, "other")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], SCHEMA).repartition(5)


def got(spark, rows):
    return sorted((tuple(r) for r in merkle.checked(frame(spark, rows), merkle.lowered_text()).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 3])
@pytest.mark.parametrize("n,sources", [(700, ["a", "b", None, "", "é", "ab"]), (90, [f"s{i}" for i in range(40)]), (5, [None])])
def test_against_brute_force(spark, monkeypatch, levels, n, sources):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = made(n, sources)
    want = brute(rows)
    assert got(spark, rows) == want
    assert n < 50 or 0 < sum(r[6] for r in want) < len(want)


def test_one_row_and_none(spark):
    for rows in ([(1, None, None, None, None)], [(0, "s", "en", 3, "Abc")]):
        assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_proofs_fold_to_the_root(spark):
    rows = made(300, ["a", "b", None])
    for r in merkle.proofs(frame(spark, rows)).collect():
        assert merkle.folded(bytes(r.leaf), [bytes(p) for p in r.path]) == bytes(r.root)
        assert merkle.folded(bytes(32), [bytes(p) for p in r.path]) != bytes(r.root)
