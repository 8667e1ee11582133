"""Connected components against a plain search."""

import random

import numpy as np
import pytest

from veilspan.llm import components as C

SCHEMA = "a long, b long"


def plain(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    root = {}
    for node in sorted(near):
        front = [] if node in root else [node]
        while front:
            at = front.pop()
            if at not in root:
                root[at] = node
                front.extend(near[at])
    return root


def found(df):
    rows = df.collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


def graph(seed, nodes, edges):
    rng = random.Random(seed)
    name = [rng.randrange(-2**63, 2**63) for _ in range(nodes)]
    return [(rng.choice(name), rng.choice(name)) for _ in range(edges)]


@pytest.mark.parametrize("parts,chunk", [(1, 1 << 18), (7, 3)])
def test_graphs(spark, monkeypatch, parts, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    names = random.Random(5).sample(range(10**6), 400)
    path = list(zip(names, names[1:]))
    hub = [(10**9, n) for n in range(300)] + [(-5, n) for n in range(250, 500)]
    for edges in (graph(1, 300, 200), graph(2, 200, 400), path, hub, hub * 3, [(1, 1), (None, 2), (3, None)], []):
        df = spark.createDataFrame(edges, SCHEMA).repartition(parts)
        assert found(C.components(df)) == plain(edges)


def test_added_edges(spark):
    old, new = graph(3, 300, 200), graph(4, 300, 60) + graph(3, 300, 240)
    known = C.components(spark.createDataFrame(old, SCHEMA))
    assert found(C.components(spark.createDataFrame(new, SCHEMA), known)) == plain(old + new)
    assert found(C.components(spark.createDataFrame([(None, 3), (4, 4)], SCHEMA), known)) == plain(old)


def test_stars():
    edges = graph(6, 500, 450)
    hi, lo = np.array([max(e) for e in edges]), np.array([min(e) for e in edges])
    nodes, roots = C.stars(hi, lo)
    assert dict(zip(nodes.tolist(), roots.tolist())) == {n: r for n, r in plain(edges).items() if n != r}


def test_later_rounds_write_few_files(spark, monkeypatch):
    """A checkpoint of a few edges is not cut into as many files as the shuffle has partitions."""
    made = []
    monkeypatch.setattr(C, "few", lambda df, n, f=C.few: made.append(f(df, n)) or made[-1])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = spark.range(300).selectExpr("(id * 7919) % 301 as a", "(id * 7919 + 7919) % 301 as b").repartition(20)
        known = C.components(edges)
        got = C.components(spark.createDataFrame([(0, 900)], "a long, b long"), known).collect()
        assert {r.root for r in got} == {0} and len(got) == 302
        assert len(made) > 1 and {df.rdd.getNumPartitions() for df in made} == {spark.sparkContext.defaultParallelism}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
