"""Near copies of the pipeline against brute force over five-word shingles."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from veilspan.llm import common, shingles, simhash
from veilspan.llm.common import table


def plain_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def survivors(docs):
    """Smallest doc_id of each component; links are a Jaccard similarity of 0.8 or more."""
    sets = sorted({plain_set(t) for _, t in docs}, key=sorted)
    label, held = list(range(len(sets))), {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in held.get(x, ())}:
            if label[i] != label[j] and 10 * len(s & sets[j]) >= 8 * len(s | sets[j]):
                label = [min(label[i], label[j]) if v in (label[i], label[j]) else v for v in label]
        for x in s:
            held.setdefault(x, []).append(i)
    at, least = {s: label[i] for i, s in enumerate(sets)}, {}
    for doc_id, text in docs:
        root = at[plain_set(text)]
        least[root] = min(doc_id, least.get(root, doc_id))
    return sorted(least.values())


def kept(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect())


def test_edits_of_one_and_two_words(spark):
    rng = random.Random(5)
    docs = []
    for n in (60, 81, 88, 400):
        words = [f"w{rng.randrange(9999)}" for _ in range(n)]
        one, two, far = words.copy(), words.copy(), words.copy()
        one[n // 2] = "other"
        two[n // 3:n // 3 + 2] = ["some", "more"]
        for i in range(0, n, 9):
            far[i] = "else"
        docs += [(len(docs) + k, " ".join(w)) for k, w in enumerate((words, one, two, far, words[1:] + ["end"]))]
    assert kept(spark, docs) == survivors(docs) == [0, 3, 5, 8, 10, 13, 15, 18]


@pytest.mark.parametrize("block", [512, 3])
def test_groups_of_variants(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(8)
    docs, shared = [], [f"s{i}" for i in range(12)]
    for centre in range(12):
        words = shared + [f"c{centre}x{i}" for i in range(rng.randrange(20, 70))]
        for _ in range(25):
            new = words.copy()
            for _ in range(rng.randrange(4)):
                new[rng.randrange(len(new))] = f"v{rng.randrange(99999)}"
            docs.append((len(docs), " ".join(new)))
    docs += [(len(docs) + i, " ".join(shared + [f"t{i}"] * (i % 5))) for i in range(40)] + [(900, "a b"), (901, "A  b"), (902, ""), (903, None)]
    assert kept(spark, docs) == survivors(docs)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_documents(spark, sf):
    docs = table(spark, f"/root/testdata/sf{sf}", "documents").select("doc_id", "text")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == survivors([tuple(r) for r in docs.collect()])


def test_clashing_names_nulls_and_repeats(spark):
    """Own columns stay as they are; of rows without an id one is left if nothing else is in its group."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "a", 30, True, 7, 5), (2, text + " x", "b", 20, False, 8, 6), (None, text, "c", 10, True, 9, 7), (None, "alone here", "d", 1, True, 1, 1),
            (None, "alone here", "d", 1, True, 1, 1), (None, None, "e", 2, None, 2, 2), (4, "", "f", 3, None, 3, 3), (9, "v " * 300_000 + "end", "g", 4, None, 4, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string, _id int, _null boolean, _key int, _number int")
    got = corpus_pipeline.near_duplicates(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([rows[1], rows[3], rows[6], rows[7]], key=repr)
    assert corpus_pipeline.near_duplicates(spark, frame.limit(0), "").count() == 0


@pytest.mark.parametrize("shared, links", [(177, 0), (185, 39)])
def test_pairs_below_the_bound_are_no_rows(shared, links):
    """Members of a block are compared on their sets: a forest of the links comes out, and of near misses nothing."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 62, shared)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 200 - shared)])) for _ in range(40)]

    def block():
        return shingles.Block(np.array(list(map(len, sets))), list(map(shingles.mark, sets)), np.arange(40), np.zeros(40, np.int64), False)

    assert len(block().partners()) > 30
    assert sum(len(found) for _, found in block().pairs(sets)) == links


@pytest.mark.parametrize("shared, narrow, wide", [(171, 40, 0), (185, 40, 40)])
def test_wide_marks_allow_hardly_more_than_links(shared, narrow, wide):
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 62, shared)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 200 - shared)])) for _ in range(40)]

    def some(times):
        marks = [shingles.mark(s, times) for s in sets]
        return len(shingles.Block(np.array(list(map(len, sets))), marks, np.arange(40), np.zeros(40, np.int64), False).partners())

    assert (some(1), some(shingles.WIDER)) == (narrow, wide)


def test_sets_travel_only_to_blocks_of_several_components(spark):
    """A node meets its neighbours under many shingles; once they are in one component its set is not sent to any."""
    member = [(key, 0, 0, 9, node, node, 0) for key in range(30) for node in (1, 2)] + [(99, 0, 0, 9, node, node, 0) for node in (1, 2, 5)]
    left = spark.createDataFrame(member, "key long, i long, j long, size long, node long, root long, own long")
    roots = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    got = sorted((r.key, r.node, r.root) for r in shingles.still_open(left, roots).collect())
    assert got == [(99, 1, 1), (99, 2, 1), (99, 5, 5)]


def test_fingerprints_give_the_first_pairs(spark, monkeypatch):
    """All fingerprints that differ in few bits are connected by them, also equal ones; the rest of the links is found without them."""
    rng = random.Random(12)
    docs = []
    for centre in range(15):
        words = [f"c{centre}x{i}" for i in range(300)]
        for k in range(8):
            new = words.copy()
            for _ in range(k):
                new[rng.randrange(300)] = f"v{rng.randrange(99999)}"
            docs.append((len(docs), " ".join(new)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = shingles.with_entries(simhash.keyed(frame)).checkpoint()
    fp = {r.node: r.fp & (1 << 64) - 1 for r in rows.collect()}
    sets = [shingles.shingles(t) for _, t in docs]
    assert fp == {shingles.node(s): simhash.majority(s.view(np.uint64)) for s in sets}

    def reached(pairs):
        label = {n: n for n in fp}
        for a, b in pairs:
            label = {n: label[a] if v == label[b] else v for n, v in label.items()}
        return {frozenset(n for n in fp if label[n] == v) for v in label.values()}

    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= shingles.BITS]
    got = [tuple(r) for r in shingles.by_fingerprint(rows).collect()]
    assert len(near) > 15 and reached(got) == reached(near)
    called = []
    monkeypatch.setattr(shingles.simhash, "links", lambda nodes, most, f=simhash.links: called.append(most) or f(nodes, most))
    assert kept(spark, docs) == survivors(docs) and called == [shingles.BITS]


def test_batches_of_long_texts_are_bounded(spark):
    frame = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 2000) as text")
    corpus_pipeline.near_duplicates(spark, frame, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    got = [r.n for r in frame.mapInArrow(sizes, "n long").collect()]
    assert max(got) < 2 * common.BATCH_BYTES < sum(got)
