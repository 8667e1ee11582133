"""The sentencepiece form of a rank file against tiktoken."""

import hashlib
import random
import struct

import pytest

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

from veilspan.llm import bpe  # noqa: E402
from veilspan.llm.common import table  # noqa: E402
from veilspan.llm.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.Coder(ranks, bpe.model_bytes(ranks), tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(coder, plain, texts):
    for text, ids in zip(texts, coder.encode(texts)):
        want = plain.encode_ordinary(text or "")
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text[:200]
        assert coder.decode(ids) == (text or "").encode()


def test_every_character(coder, plain):
    """White space, letters, digits and marks are cut as tiktoken cuts them."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)}b" for c in points[i:i + 256]) for i in range(0, 0x3400, 256)]
    rest = random.Random(1).sample(points[0x3400:], 8192)
    texts += ["".join(f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)}b" for c in rest[i:i + 256]) for i in range(0, 8192, 256)]
    check(coder, plain, texts)


def test_odd_texts(coder, plain):
    rng = random.Random(2)
    texts = ["", None, " ", "\n\n  x", "it's we'll  I'd", "<|endoftext|>", "a" * 20_000, " " * 5_000 + "b", "é" * 3_000,
             "\x00\x1c\x85 　x", "\U0001f600‍́ ok"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x4F00)]))
                      for _ in range(rng.randrange(200))) for _ in range(300)]
    check(coder, plain, texts)


def test_every_token(coder, ranks):
    words = [t.decode() for t in ranks if t.isascii()]
    coder.learn(set(words))
    assert all(struct.unpack("<I", coder.known[w])[0] == ranks[w.encode()] for w in words if w in coder.known)


def test_query(spark, plain):
    docs = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}
    rows = QUERIES["op3_byte_bpe"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = plain.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "x y", 5)], "doc_id long, text string, ids int")
    rows = bpe.encoded(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, with_ids=True).collect()
    assert sorted((r.n_tokens, len(r.ids)) for r in rows) == [(0, 0), (0, 0), (2, 8)]
    assert bpe.encoded(docs.limit(0), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).count() == 0
