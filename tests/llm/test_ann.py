"""One-bit codes against brute force."""

import math

import numpy as np
import pytest

from veilspan.llm import ann
from veilspan.llm.common import table
from veilspan.llm.queries import QUERIES


def brute(rows, every=100, k=10):
    out = []
    for q, v in {q: v for q, v in sorted(rows, key=lambda r: (len(r[1]), list(r[1])), reverse=True) if q % every == 0}.items():
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return out


def recall(got, want):
    near = {}
    for q, _, i, _ in want:
        near.setdefault(q, set()).add(i)
    return sum(i in near[q] for q, _, i, _ in got) / len(want)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
@pytest.mark.parametrize("block", [8192, 150])
def test_query(spark, monkeypatch, sf, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, f"/root/testdata/sf{sf}", "embeddings").collect()]
    got = sorted(map(tuple, QUERIES["op2_ann"](spark, f"/root/testdata/sf{sf}").collect()))
    want = sorted(brute(rows))
    assert len(got) == len(want) and recall(got, want) >= 0.99
    vectors = {i: np.array(v) for i, v in rows}
    assert all(math.isclose(d, float(np.linalg.norm(vectors[q] - vectors[i])), rel_tol=1e-12) for q, _, i, d in got)


def test_codes_prune_and_bound():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=(20, 64))
    codes = ann.Codes(x, ann.rotation(64))
    estimate, wrong = codes.distances(q, codes.signs())
    exact = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert (np.abs(estimate - exact) <= wrong).mean() > 0.99
    assert codes.packed.nbytes == 4000 * 8
    share = [len(ann.chosen(e, w, np.full(4000, True), x, v, 10)) / 4000 for e, w, v in zip(estimate, wrong, q)]
    assert max(share) < 0.6 and np.mean(share) < 0.4


def test_ties_and_odd_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 2.0, 0.0]
    rows = [(0, a), (1, a), (2, a), (3, b), (100, b), (100, b), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [1.0, float("nan"), 0.0]),
            (8, [float("inf"), 0.0, 0.0]), (None, a), (9, [1.0, 1.0]), (200, [1.0, 2.0]), (300, [5.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, ann.search(df, k=3).collect()))
    root5 = math.sqrt(5)
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, root5), (100, 1, 3, 0.0), (100, 2, 0, root5), (100, 3, 1, root5), (200, 1, 9, 1.0)]
    assert ann.search(df.limit(0)).count() == 0
