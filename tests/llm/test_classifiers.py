"""The two classifiers: exact marginals, flattened trees, held-out accuracy, odd tables."""

import itertools
import zlib

import numpy as np
import pytest

from veilspan.llm import quality, toxicity
from veilspan.llm.common import table
from veilspan.llm.learning import labelled_sample
from veilspan.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.1"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        e, start, a = rng.normal(size=n), rng.normal(), rng.normal(size=(2, 2))
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            weight[path] = np.exp(start * path[0] + sum(e[t] * path[t] for t in range(n)) + sum(a[path[t], path[t + 1]] for t in range(n - 1)))
        want = [np.log(sum(w for p, w in weight.items() if p[t]) / sum(w for p, w in weight.items() if not p[t])) for t in range(n)]
        padded = np.zeros((n + 3, 2))
        padded[:n, 1], padded[:, 0] = e, rng.normal(size=n + 3)
        got, _, _ = toxicity.marginals(padded, np.array([n + 3, n]), start, a)
        assert np.allclose(got[:n, 1], want)


def test_side_by_side_is_one_by_one():
    model = toxicity.Field(weights=np.random.default_rng(2).normal(size=toxicity.WEIGHTS), moves=np.array([[1.0, -1], [-1, 1]]))
    texts = ["", None, "one", "a b c d " * 40, "x y", "word " * 3000, "one two"]
    together = list(toxicity.Tagger(model).odds(texts))
    for text, odds in zip(texts, together):
        alone = next(toxicity.Tagger(model).odds([text]))
        assert np.allclose(odds, alone) and len(odds) == len((text or "").split())


def walked(forest, x):
    total = forest.base
    for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
        at = 0
        for _ in range(quality.DEPTH):
            at = 2 * at + (1 if x[feature[at]] <= cut[at] else 2)
        total += leaf[at - (2 ** quality.DEPTH - 1)]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    forest = quality.grow(x[:2000], y[:2000])
    scores = forest.scores(x[2000:])
    assert ((scores >= 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(scores[:50], [walked(forest, r) for r in x[2000:2050]])


def test_one_class_gives_a_constant():
    x = np.zeros((5, len(quality.STATISTICS)))
    assert (quality.grow(x, np.ones(5)).scores(x) > 0.99).all() and (quality.grow(x[:0], np.ones(0)).scores(x) == 0.5).all()
    assert toxicity.learn(["a"], np.array([1])).document_scores(np.zeros((2, 4))).tolist() == [1.0, 1.0]


@pytest.mark.parametrize("name,column,n,rest,threshold,least", [
    ("op1_toxicity", "toxic", 4, 2, 0.3, 0.9), ("op7_quality", "quality", 3, 1, 0.5, 0.98)])
def test_held_out_accuracy(spark, name, column, n, rest, threshold, least):
    rows = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(rows) == table(spark, SF_DIR, "documents").count()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % n == rest for i in rows["doc_id"]]).all()
    assert ((rows["score"] >= threshold) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()
    known = rows[rows["held_out"]].merge(table(spark, SF_DIR, "labels").toPandas(), on="doc_id")
    hit = known[known["predicted"] == 1][column].sum()
    precision, recall = hit / max(1, known["predicted"].sum()), hit / known[column].sum()
    assert precision >= least and recall >= least


def test_sample_leaves_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = labelled_sample(docs, labels, "toxic", 4, 2, 50).collect()
    assert len(got) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in got)


def test_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, t) for t in ("b", None, "c") * 20] + [(3, "z"), (3, "y")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 4, 2, 50)
    assert sorted(map(tuple, got.collect())) == sorted((i, t, 1) for i, t in ((1, ""), (3, "y")) if zlib.crc32(str(i).encode()) % 4 != 2)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot fool", "x"), (1, "you idiot fool", "x"), (2, None, "y"), (None, "", "z"), (3, "w " * 5000, None)],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (1, 0, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model).toPandas()
    assert len(got) == 5 and got["score"].between(0, 1).all() and not got["held_out"].isna().any()
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() <= 5
    assert toxicity.scored(docs.limit(0), model).count() == 0
    trees = quality.train(docs, labels)
    got = quality.scored(docs, trees).toPandas()
    assert len(got) == 5 and got["score"].between(0, 1).all() and quality.scored(docs.limit(0), trees).count() == 0
    assert toxicity.train(docs, labels.limit(0)).share == 0.0


def test_spans_are_the_insults():
    clean = [f"the quiet house number {i} stands near an old river and a wood" for i in range(200)]
    toxic = [f"the quiet house number {i} stands near an idiot and a trash wood" for i in range(60)]
    model = toxicity.learn(clean + toxic, np.array([0] * 200 + [1] * 60))
    text = "é an Idiot near the river and an old wood"
    odds = next(toxicity.Tagger(model).odds([text]))
    assert [text[a:b] for a, b in toxicity.spans(text, odds)] == ["Idiot"]
