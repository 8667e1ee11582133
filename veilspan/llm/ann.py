"""Nearest neighbours by randomly rotated one-bit codes.

Rows are dealt into blocks by a hash of their id.  In a block, vectors are taken
relative to the block's mean, rotated by a fixed random rotation and reduced to
one sign bit a dimension, packed, with two correction scalars each: the norm, and
the inner product of the unit vector with its code.  A query's inner product with
a code estimates its inner product with the vector; the estimate's error has a
known bound.  The best estimates are reranked on the original vectors; that gives
a distance to beat, and every vector that could beat it within its bound is
reranked too.

The bound holds with a probability set by ``BOUND``; every row is indexed and every
row's estimate is made, so nothing else can be missed.  Queries are streamed past
each block: a task holds one block and one batch of queries, however many there
are.  Work grows as queries times rows, in blocks.  Cells of nearest centroids
would save work only where vectors cluster; where they do not, a search of few
cells misses the recall asked for.

Defined results: vectors that are null, zero or hold null or non-finite parts take
no part, nor do rows without an id; vectors are compared only with those of their
length; candidates exclude rows of the query's id; rows of one id may repeat: as a
query it is asked once, with its shortest and then smallest vector, as candidates
they count each; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, on average; queries taken at once; deviations of the estimate's error that the bound allows; best estimates, times k.
BLOCK, QUERIES_AT_ONCE, BOUND, FIRST = 8192, 256, 3.0, 4
NEAREST, EVERY, SEED = 10, 100, 42


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of a block of vectors."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.turn, self.dim = turn, vectors.shape[1]
        self.centre = vectors.mean(axis=0)
        rest = (vectors - self.centre) @ turn
        self.norm = np.linalg.norm(rest, axis=1)
        unit = rest / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.packed = np.packbits(rest > 0, axis=1)
        self.fit = np.abs(unit).sum(axis=1) / np.sqrt(self.dim)  # inner product of the unit vector and its code

    def signs(self) -> np.ndarray:
        """Codes as unit vectors."""
        bits = np.unpackbits(self.packed, axis=1, count=self.dim).astype(np.float32)
        return (bits * 2 - 1) / np.float32(np.sqrt(self.dim))

    def distances(self, queries: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances, one row a query, and what they may be wrong by."""
        q = (queries - self.centre) @ self.turn
        length = np.linalg.norm(q, axis=1)
        fit = np.where(self.norm > 0, self.fit, 1.0)
        along = (q.astype(np.float32) @ signs.T) / fit.astype(np.float32)
        error = BOUND * np.sqrt(np.maximum(1 - fit ** 2, 0) / fit ** 2 / max(1, self.dim - 1))
        estimate = self.norm ** 2 + length[:, None] ** 2 - 2 * self.norm * along
        return estimate, 2 * self.norm * error * length[:, None] + 1e-5 * (self.norm ** 2 + length[:, None] ** 2)


def nearest(ids: np.ndarray, vectors: np.ndarray, codes: Codes, signs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
            k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, distances) of each query's k nearest rows of the block, by distance, then id."""
    estimate, wrong = codes.distances(queries, signs)
    for i, query in enumerate(queries):
        at = chosen(estimate[i], wrong[i], ids != query_ids[i], vectors, query, k)
        exact = np.sqrt(((vectors[at] - query) ** 2).sum(axis=1))
        if len(at) > k:
            close = exact <= np.partition(exact, k - 1)[k - 1]
            at, exact = at[close], exact[close]
        order = np.lexsort((ids[at], exact))[:k]
        yield at[order], exact[order]


def chosen(estimate: np.ndarray, wrong: np.ndarray, other: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows to rerank: those whose squared distance may be as small as the k-th of the best estimates' true ones."""
    if len(estimate) > FIRST * k + 1:
        first = np.argpartition(np.where(other, estimate, np.inf), FIRST * k)[:FIRST * k]
        limit = np.partition(((vectors[first[other[first]]] - query) ** 2).sum(axis=1), k - 1)[k - 1]
        other = other & (estimate - wrong <= limit)
    return np.flatnonzero(other)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def search(vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row whose id is divisible by ``every``."""
    rows = valid(vectors)
    blocks = max(1, -(-rows.count() // BLOCK))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("r")).select("vec_id", "r.*")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("query"), "vec_id", "v")
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    both = rows.select("dim", block.alias("block"), F.lit(0).alias("query"), "vec_id", "v").union(asked)
    both = both.repartition("dim", "block").sortWithinPartitions("dim", "block", "query", "vec_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_ids, held, block = None, [], [], None
        for batch in batches:
            dims, blocks, queries, ids = (batch.column(i).to_numpy() for i in range(4))
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0) | (np.diff(queries) != 0)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(ids)]):
                if a == b:
                    continue
                if (dims[a], blocks[a]) != at:
                    at, held_ids, held, block = (dims[a], blocks[a]), [], [], None
                v = batch.column(4).slice(a, b - a).flatten().to_numpy().reshape(-1, dims[a])
                if not queries[a]:
                    held_ids.append(ids[a:b])
                    held.append(v)
                    continue
                if block is None and held:
                    points = np.concatenate(held)
                    codes = Codes(points, rotation(int(dims[a])))
                    block = np.concatenate(held_ids), points, codes, codes.signs()
                if block is not None:
                    for c in range(0, b - a, QUERIES_AT_ONCE):
                        yield _found(block, ids[a + c:min(b, a + c + QUERIES_AT_ONCE)], v[c:c + QUERIES_AT_ONCE], k)

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", number).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(block, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    ids, points, codes, signs = block
    out = [(np.full(len(at), q), ids[at], exact) for q, (at, exact) in zip(query_ids, nearest(ids, points, codes, signs, query_ids, queries, k))]
    query, vec, score = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM numbered WHERE rank <= 10
"""
