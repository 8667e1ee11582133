"""Lempel-Ziv phrase fingerprints.

A text is parsed as LZ78 does: each phrase is the shortest piece from here on that
is no phrase yet.  The fingerprint holds the smallest hashes of the phrase set;
the share of common hashes among the smallest of both estimates how much of the
two phrase sets is common, and so how well one text compresses the other.

A document is also compared with the document behind it in ascending order, which
a second text is made of.  Documents are dealt into ranges of ids at percentiles
(about one per 1000 documents, 10 000 at most); the first document of each range
goes to the range before it as well.  A range is sorted and streamed; a task holds
two documents and their phrase sets.

Defined results: a null text is empty; two empty texts have likeness 1, an empty
and another 0; rows of one id follow their texts; a null id comes before all; a
document alone is its own next; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes of a fingerprint.
HASHES = 128
DOCS_PER_RANGE, MOST_RANGES = 1_000, 10_000
_FIRST = -(1 << 63)


def parse(text: str, seen: set[str]) -> tuple[list[str], str]:
    """Add the phrases of the text to ``seen``; returns the new ones and what is left behind the last, itself a phrase or empty."""
    add, new, phrase = seen.add, [], ""
    for c in text:
        phrase += c
        if phrase not in seen:
            add(phrase)
            new.append(phrase)
            phrase = ""
    return new, phrase


def signature(phrases: list[str], hashes: int = HASHES) -> np.ndarray:
    """The smallest distinct hashes of the phrases, ascending."""
    return smallest(np.fromiter(map(xxhash.xxh32_intdigest, phrases), np.uint32, len(phrases)), hashes)


def smallest(found: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    if len(found) > 8 * hashes:  # distinct phrases hardly share hashes; if too many do, all are sorted
        least = np.unique(np.partition(found, 2 * hashes)[:2 * hashes])
        if len(least) > hashes:
            return least[:hashes]
    return np.unique(found)[:hashes]


def likeness(a: np.ndarray, b: np.ndarray, hashes: int = HASHES) -> float:
    """Estimated share of common phrases among all phrases of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    first = np.r_[True, both[1:] != both[:-1]]
    least = both[first][:hashes]
    return float((both[~first] <= least[-1]).sum() / len(least))


def written(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


class Parsed:
    """A text, its fingerprint, and its phrases before the half that is replaced."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 2
        self.early: set[str] = set()
        found, self.left = parse(text[:self.cut], self.early)
        self.early_sig = signature(found)
        found, _ = parse(self.left + text[self.cut:], self.early.copy())
        self.sig = self._and(found)

    def _and(self, late: list[str]) -> np.ndarray:
        return smallest(np.concatenate([self.early_sig, signature(late)]))

    def row(self, following: Parsed) -> tuple:
        late = following.text[:len(self.text) - self.cut]
        edited = self.text[:self.cut] + late
        found, _ = parse(self.left + late, self.early)
        other = self._and(found)
        return (self.doc_id, len(self.text), hashlib.sha256(edited.encode()).hexdigest(), written(self.sig), written(other),
                likeness(self.sig, other), likeness(self.sig, following.sig))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(docs: DataFrame) -> list[int]:
    """The first id of each range."""
    n, least = docs.agg(F.count(F.lit(1)), F.min(F.coalesce("doc_id", F.lit(_FIRST)))).first()
    if not n:
        return []
    many = min(MOST_RANGES, -(-n // DOCS_PER_RANGE))
    if many == 1:
        return [least]
    found = docs.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 20 * many + 1000)).first()[0]
    bounds = np.array(sorted({least, *(found or [])}), np.int64)  # near the percentiles, not always ids

    def firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
            part, at = np.unique(np.searchsorted(bounds, ids, "right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(ids[at], pa.int64())], names=["part", "id"])

    ids = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("id"))
    return sorted(r.id for r in ids.mapInArrow(firsts, "part long, id long").groupBy("part").agg(F.min("id").alias("id")).collect())


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, its edited text's, and the likenesses."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    firsts = _ranges(docs)
    heads = np.array(firsts, np.int64)
    dealt = "doc_id long, text string, id long, part int, extra boolean"

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(_FIRST).to_numpy(zero_copy_only=False)
            part = np.maximum(np.searchsorted(heads, ids, "right") - 1, 0)
            yield _with(batch, ids, part, False)
            at = np.flatnonzero(heads[part] == ids)
            if len(at):
                yield _with(batch.take(pa.array(at)), ids[at], (part[at] - 1) % len(heads), True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_part, done = None, None, False
        for batch in batches:
            rows = []
            for doc_id, text, part, extra in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if part != last_part:
                    last, last_part, done = None, part, False
                if done:
                    continue
                here = Parsed(doc_id, text)
                if last:
                    rows.append(last.row(here))
                last, done = here, extra
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(SCHEMA), SCHEMA)], schema=SCHEMA)

    placed = docs.mapInArrow(deal, dealt).repartition("part")
    return placed.sortWithinPartitions("part", "extra", "id", "text").mapInArrow(run, DDL)


def _with(batch: pa.RecordBatch, ids, part, extra: bool) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array([extra] * n, pa.bool_())],
        names=["doc_id", "text", "id", "part", "extra"])
