"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import checkpoints_on, few

#: Edges that a task contracts at once.
CHUNK = 1 << 18


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of (a, b): root is the smallest node it reaches.

    ``known`` is an earlier result over other edges, which these are added to; without new edges
    it is given back.

    Each round lifts the lower end of every edge to that end's smallest neighbour, then points a
    node's further neighbours at its smallest one, until the edges are stars.  Before a shuffle
    a task turns its edges, a chunk at a time, into stars of their own, so that a node meets
    itself at most once a chunk.  Rounds take three shuffles and end in a checkpoint: a lost
    executor costs one round.  Null ends and loops link nothing; an empty table has no nodes.
    """
    checkpoints_on(edges.sparkSession)
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    n = None
    if known is not None:
        n = pairs.count()
        if not n:
            return known
        n += known.count()
        pairs = pairs.union(known.select(F.col("node").alias("hi"), F.col("root").alias("lo")))
    now = _contracted(pairs.withColumn("moved", F.lit(True)), n)
    while True:
        n, moved = now.agg(F.count(F.lit(1)), F.max("moved")).first()
        if not moved:
            break
        up = now.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("up"))
        lifted = now.join(up, "lo", "left").select(
            "hi", F.coalesce("up", "lo").alias("lo"), F.col("up").isNotNull().alias("moved"))
        at = Window.partitionBy("hi").orderBy("lo")
        met = lifted.select("*", F.first("lo").over(at).alias("least"), F.lag("lo").over(at).alias("last"))
        met = met.filter("last is null or last <> lo").withColumn("other", F.expr("lo <> least"))
        now = _contracted(met.select(
            F.when(F.col("other"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("least").alias("lo"),
            (F.col("other") | F.col("moved")).alias("moved")), n)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())


def stars(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest of each component, and that smallest one."""
    ids, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    one, two = at[:len(hi)], at[len(hi):]
    root = np.arange(len(ids))
    while True:
        a, b = root[one], root[two]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    leaves = np.flatnonzero(root != np.arange(len(ids)))
    return ids[leaves], ids[root[leaves]]


def _contracted(edges: DataFrame, n: int | None) -> DataFrame:
    """Each task's edges, n in all, as stars, a chunk at a time; ``moved`` if any edge of the chunk was."""
    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        hi, lo = stars(rows["hi"].to_numpy(), rows["lo"].to_numpy())
        moved = bool(rows["moved"].to_numpy().any())
        return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(np.full(len(hi), moved))], names=["hi", "lo", "moved"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield chunk(held)
                held, n = [], 0
        if n:
            yield chunk(held)

    edges = edges if n is None else few(edges, n)
    return edges.mapInArrow(run, "hi long, lo long, moved boolean").checkpoint()
