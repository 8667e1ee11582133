"""The pipeline against a version without Spark, and the mix against its definition."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_shingles import survivors
from veilspan.llm import mixing, pii, toxicity
from veilspan.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1)):
    """Deal out, cap, deal the rest again, until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def brute_taken(docs):
    """Words taken of each (doc_id, text, source)."""
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    sizes = Counter()
    for n, (_, _, s) in zip(size, docs):
        sizes[s] += n
    goal, out = brute_targets(sizes), [0] * len(docs)
    for s in sizes:
        rows = [i for i, d in enumerate(docs) if d[2] == s]
        rows.sort(key=lambda i: hashlib.md5(f"42:{'null' if docs[i][0] is None else docs[i][0]}:{hashlib.md5((docs[i][1] or '').encode()).hexdigest()}".encode()).hexdigest())
        left = int(goal[s] + 0.5)
        while left > 0:
            for i in rows:
                out[i] += min(size[i], left)
                left -= min(size[i], left)
    return size, out


def first_words(text, n):
    ends = [m.end() for m in WORD.finditer(text)]
    return text if n == len(ends) else text[:ends[n - 1]]


def expected(docs, model, coder):
    tagger = toxicity.Tagger(model)
    docs = [d for d in docs if model.document_scores(toxicity.numbers_of(tagger.odds([d.text])))[0] < toxicity.THRESHOLD]
    left = set(survivors([(d.doc_id, d.text) for d in docs]))
    docs = [d for d in docs if d.doc_id in left]
    docs = [(d.doc_id, pii.scrubbed(d.text, brute_spans(d.text) | {k: pii.Finder().spans(d.text)[k] for k in ("url", "account")}), d.source) for d in docs]
    rows = []
    for (doc_id, text, _), n, taken in zip(docs, *brute_taken(docs)):
        while taken > 0:
            part = first_words(text, min(n, taken))
            rows.append((doc_id, len(coder(part)), hashlib.sha256(part.encode()).hexdigest()))
            taken -= n
    return sorted(rows)


def test_pipeline(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    from veilspan.llm.bpe import read_ranks

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    docs = table(spark, SF_DIR, "documents")
    model = toxicity.train(docs, table(spark, SF_DIR, "labels"))
    want = expected(docs.collect(), model, plain.encode_ordinary)
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF_DIR, "documents").limit(60).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
    rows = [(None, None, "en", None, None), (7, "", None, "s", 0), (8, "one two three", "en", "s", 13), (8, "one two three", "en", "s", 13)]
    docs = spark.createDataFrame(rows, docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.count() >= 1 and stage(spark, docs.limit(0), SF_DIR).count() == 0, name


def test_targets_are_dealt_until_none_is_above(spark):
    cases = [{"a": 10, "b": 1000, "c": 50, None: 3, "d": 0, "e": 700}, {"a": 5}, {"a": 0, "b": 0}, {f"s{i}": i * i for i in range(40)}]
    for sizes in cases:
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "_source string, _size long")
        got = {r._source: r._target for r in mixing.targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_RANGE", 7)
    rows = [(i % 50, " ".join(["w"] * (i % 13)) if i % 11 else None, [None, "a", "b", "c"][i % 4], "x") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string").repartition(5)
    got = mixing.mix(df)
    docs = [(a, b, c) for a, b, c, _ in rows]
    size, taken = brute_taken(docs)
    by = defaultdict(int)
    for r in got.collect():
        by[r.source] += r.taken
        assert r.taken <= 2 * r.size
    want = defaultdict(int)
    for (_, _, s), t in zip(docs, taken):
        want[s] += t
    assert by == want
    assert sorted((r.doc_id, r.size, r.taken) for r in got.collect()) == sorted((r.doc_id, r.size, r.taken) for r in mixing.mix(df.repartition(2)).collect())
    written = mixing.written(got)
    counted = written.select("source", "text").collect()
    assert sum(len(WORD.findall(r.text or "")) for r in counted) == sum(by.values())
    assert mixing.mix(df.limit(0)).count() == 0


def test_own_columns_named_as_the_mix_names_its_own(spark):
    names = ["_source", "_key", "_size", "_sum", "_range", "_turn", "_budget", "Target", "c0"]
    df = spark.createDataFrame([(i, "w " * (i % 5), "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(20)],
                               "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix(df)
    kept = [n for n in names if n != "Target"]
    assert got.columns == ["doc_id", "text", "source", *kept, "size", "source_size", "target", "taken"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in kept)
    assert all(r[n] == f"{n}{r.doc_id}" for r in mixing.written(got).collect() for n in kept)
