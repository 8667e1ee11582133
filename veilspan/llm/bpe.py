"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

The rank file becomes a sentencepiece BPE model: every token's bytes are mapped to
printable characters (a piece), its score is its negative rank, normalisation is
the identity.  Merging the pair with the best score is then merging the pair with
the lowest rank.  A pre-token that is itself a token is that token.  Decoding maps
pieces back to bytes.

The model is about 1 MB whatever the corpus; it is broadcast.  Pre-tokens that
came up already are kept per task, up to a fixed number, then forgotten.

Defined results: a null text is empty; empty texts have no ids; doc_id may be
null or repeated, rows are independent of each other.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veilspan.llm.common import in_slices

#: Pre-tokens a task remembers, and characters of texts it cuts up at once.
REMEMBERED, CHARS_AT_ONCE = 250_000, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_characters() -> str:
    """256 characters, one for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in prints else chr(next(rest)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protocol-buffer field: bytes or a whole number."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: <unk> is id 0, the token of the i-th lowest rank is id i + 1."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(pieces))
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class Coder:
    """Encodes and decodes with the ranks; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        import sentencepiece

        self.ranks, self.chars = ranks, byte_characters()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(self.chars)}
        n = self.pieces.get_piece_size()
        self.bytes_of = dict(zip(sorted(ranks.values()), (
            bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(1, n))))
        self.rank_of = np.array([0, *sorted(ranks.values())], dtype="<u4")
        self.known: dict[str, bytes] = {}

    def learn(self, tokens: set[str]) -> None:
        """Ids of pre-tokens not met before, as little-endian 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        missing, mapped = [], []
        for token in tokens - self.known.keys():
            raw = token.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[token] = struct.pack("<I", rank)
            else:
                missing.append(token)
                mapped.append("".join([self.chars[b] for b in raw]))
        for token, ids in zip(missing, self.pieces.encode(mapped, out_type=int, num_threads=1)):
            self.known[token] = self.rank_of[ids].tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, packed."""
        at = 0
        while at < len(texts):
            some, chars = [], 0
            while at < len(texts) and (not some or chars < CHARS_AT_ONCE):
                some.append(self.cut(texts[at] or ""))
                chars += len(texts[at] or "")
                at += 1
            self.learn(set().union(*some))
            for tokens in some:
                yield b"".join(map(self.known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes; with_ids: the packed ids too."""
    spark = docs.sparkSession
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast((ranks, model_bytes(ranks)))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value, pattern)
        for batch in in_slices(batches):
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for ids in coder.encode(batch.column(1).to_pylist()):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
