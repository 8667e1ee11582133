"""Merkle manifest of a table, by time-forward processing.

Every row is a leaf: the SHA-256 of its columns, each with its length in front.  The
leaves of a tree (here: of a source) ascend by id; runs of 16 nodes become a parent
until one node is left; the trees' last nodes, in order, are the leaves of one more tree.

Nodes are labelled by level and place.  A message carries a child's digest to its
parent's label; messages are read in label order, so a parent finds all its
children's at once.  Spark's external sort is the queue between blocks of 4096 nodes
(three levels), a heap the one inside a block.  One round lifts a table to one that is
4096 times smaller; few rounds reach the top.  The way back sends each block the
siblings above it, once, and hands them on to its nodes.  Only digests are shuffled,
texts stay where they are read.

Defined results: null columns are marked apart from empty ones; a null source is a
tree of its own, first in order; null ids come first in their tree; ties go by digest,
rows that are equal in all hashed columns are interchangeable; a null id is never
tampered with; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import checkpoints_on

#: Children of a node, levels of a block, columns of a leaf.
FAN, LEVELS = 16, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def combined(parts: Iterable[bytes]) -> bytes:
    """The digest of some digests, which are joined as lowercase hex."""
    return sha256(b"".join(parts).hex().encode()).digest()


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def sweep(digests: Sequence[bytes], levels: int) -> list[list[bytes]]:
    """All nodes above a block's, level by level: messages (level, place, child, digest) in label order."""
    out, queue = [list(digests)] + [[] for _ in range(levels)], []
    if levels:
        queue = [(1, i // FAN, i, d) for i, d in enumerate(digests)]
    while queue:
        label, children = queue[0][:2], []
        while queue and queue[0][:2] == label:
            children.append(heapq.heappop(queue)[3])
        level, place = label
        out[level].append(combined(children))
        if level < levels:
            heapq.heappush(queue, (level + 1, place // FAN, place, out[level][-1]))
    return out


def siblings(levels: list[list[bytes]], above: list[bytes]) -> Iterator[list[bytes]]:
    """The path of each node of the lowest level: left and right siblings, level by level, and at last those above the block.

    From the top down: a node's path is its own siblings and then its parent's path.
    """
    paths = [above]
    for nodes in reversed(levels[:-1]):
        down = []
        for i in range(len(nodes)):
            run = i - i % FAN
            down.append([b"".join(nodes[run:i]), b"".join(nodes[i + 1:run + FAN]), *paths[i // FAN]])
        paths = down
    return iter(paths)


def folded(digest: bytes, path: Sequence[bytes]) -> bytes:
    """The root that a leaf's digest and its path give."""
    for left, right in zip(path[::2], path[1::2]):
        digest = combined((left, digest, right))
    return digest


def digest_of(*columns: F.Column) -> F.Column:
    """SHA-256 over the columns: '-' if null, else the number of bytes, ':' and the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, changed: F.Column | None = None) -> DataFrame:
    """(doc_id, tree, digest, other): other is the digest of the row with the text ``changed``, null where that is null."""
    own = digest_of(*map(F.col, columns))
    other = digest_of(*[changed if c == "text" else F.col(c) for c in columns]) if changed is not None else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    if changed is not None:
        other = F.when(changed.isNotNull(), other)
    return docs.select("doc_id", tree.alias("tree"), own.alias("digest"), other.alias("other"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """All columns, the place of the row in its tree, and the tree's number of rows.

    A range sort over (tree, order); equal rows are told apart by a number, so that many copies don't meet in one range.
    """
    keys = ["tree", *order, "_copy"]
    rows = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.drop("_copy").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).checkpoint()
    parts = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    parts = parts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n"))
    return rows.join(parts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows in label order, those of one block side by side."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block; the first two columns are tree and block."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FAN ** LEVELS}"))


def lifted(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, digest) of the nodes three levels higher, or of the last one of a smaller tree."""
    levels = LEVELS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            n = rows[0][3]
            top = sweep([r[4] for r in rows], min(levels, height(n)))[-1][0]
            yield pa.RecordBatch.from_pylist([{"tree": rows[0][0], "pos": rows[0][1], "n": -(-n // FAN ** levels), "digest": top}],
                                             pa.schema({"tree": pa.string(), "pos": pa.int64(), "n": pa.int64(), "digest": pa.binary()}))

    rows = _blocks(_with_block(nodes).select("tree", "block", "pos", "n", "digest"))
    return rows.mapInArrow(run, "tree string, pos long, n long, digest binary").checkpoint()


def lowered(nodes: DataFrame, heads: DataFrame, finish: Callable, schema: str, extra: Sequence[str] = ()) -> DataFrame:
    """``finish`` of each block: its head (a dict), rows, and paths.

    nodes: (tree, pos, n, digest, extra ...); heads: one row a block, (tree, pos, path, ...), in which path goes up from the block.
    """
    levels, named = LEVELS, [c for c in heads.columns if c not in ("tree", "pos")]
    fields = ["tree", "block", "pos", "n", "digest", *extra]
    nodes = _with_block(nodes).select(*fields, F.lit(None).cast(heads.select(F.struct(*named)).schema[0].dataType).alias("head"))
    types = dict(nodes.dtypes)
    heads = heads.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"),
                         *[F.lit(None).cast(types[c]).alias(c) for c in fields[3:]], F.struct(*named).alias("head"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            head, rows = rows[0][-1], rows[1:]
            above = sweep([r[4] for r in rows], min(levels, height(rows[0][3])))
            yield finish(head, [dict(zip(fields, r)) for r in rows], siblings(above, head["path"]))

    return _blocks(nodes.unionByName(heads)).mapInArrow(run, schema)


def climbed(nodes: DataFrame) -> DataFrame:
    """(tree, pos, path, top) of nodes (tree, pos, n, digest): the siblings on the way up and the last digest of the tree."""
    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
        return nodes.select("tree", "pos", F.array().cast("array<binary>").alias("path"), F.col("digest").alias("top"))

    def finish(head: dict, rows: list[dict], paths: Iterator[list[bytes]]) -> pa.RecordBatch:
        out = [{"tree": r["tree"], "pos": r["pos"], "path": p, "top": head["top"]} for r, p in zip(rows, paths)]
        return pa.RecordBatch.from_pylist(out, pa.schema({"tree": pa.string(), "pos": pa.int64(), "path": pa.list_(pa.binary()), "top": pa.binary()}))

    return lowered(nodes, climbed(lifted(nodes)), finish, "tree string, pos long, path array<binary>, top binary").checkpoint()


def forest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves (tree, doc_id, digest, other, pos, n), and the heads of their blocks: path to the root, subroot, root."""
    checkpoints_on(rows.sparkSession)
    rows = numbered(rows.checkpoint(), "doc_id", "digest")
    heads = climbed(lifted(rows))
    subroots = heads.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest"))
    subroots = numbered(subroots, "of")
    root = climbed(subroots.select("tree", "pos", "n", "digest"))
    root = subroots.select("of", "pos").join(root.select("pos", F.col("path").alias("rest"), F.col("top").alias("root")), "pos")
    heads = heads.withColumnRenamed("tree", "of").withColumnRenamed("pos", "block").join(root.drop("pos"), "of")
    return rows, heads.select(F.col("of").alias("tree"), F.col("block").alias("pos"), F.concat("path", "rest").alias("path"),
                              F.col("top").alias("subroot"), "root")


def proofs(docs: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """doc_id, leaf, subroot, root and path of every row: the manifest; a path's entries are the siblings to the left and right, level by level."""
    rows, heads = forest(leaves(docs, columns))

    def finish(head: dict, rows: list[dict], paths: Iterator[list[bytes]]) -> pa.RecordBatch:
        out = [{"doc_id": r["doc_id"], "leaf": r["digest"], "subroot": head["subroot"], "root": head["root"], "path": p} for r, p in zip(rows, paths)]
        return pa.RecordBatch.from_pylist(out, pa.schema({"doc_id": pa.int64(), "leaf": pa.binary(), "subroot": pa.binary(), "root": pa.binary(), "path": pa.list_(pa.binary())}))

    return lowered(rows, heads, finish, "doc_id long, leaf binary, subroot binary, root binary, path array<binary>", ["doc_id"])


def checked(docs: DataFrame, changed: F.Column, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Digests in hex of every row, its proof's digest, and the root that the row with its text ``changed`` (null: as it is) folds to."""
    rows, heads = forest(leaves(docs, columns, changed))
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def finish(head: dict, rows: list[dict], paths: Iterator[list[bytes]]) -> pa.RecordBatch:
        subroot, root = head["subroot"].hex(), head["root"].hex()
        ids, texts, same = [], [[] for _ in names], []
        for r, path in zip(rows, paths):
            found = folded(r["other"] or r["digest"], path).hex()
            for out, text in zip(texts, (r["digest"].hex(), subroot, root, combined(path).hex(), found)):
                out.append(text)
            ids.append(r["doc_id"])
            same.append(found == root)
        arrays = [pa.array(ids, pa.int64()), *[pa.array(t, pa.string()) for t in texts], pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, "verified"])

    schema = "doc_id long, " + ", ".join(f"{n} string" for n in names) + ", verified boolean"
    return lowered(rows, heads, finish, schema, ["doc_id", "other"])


def lowered_text(doc_id: str = "doc_id", every: int = 5) -> F.Column:
    """The text with A-Z lower-cased where ``every`` divides the id's crc32, else null."""
    return F.when(F.crc32(F.col(doc_id).cast("string").cast("binary")) % every == 0, F.translate("text", _UPPER, _LOWER))


ORACLE = r"""
WITH RECURSIVE
crc_table AS (
  SELECT list(v ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) t(i))),
base AS (
  SELECT row_number() OVER () AS row_no, d.*,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
                     lambda c, b: xor(c // 256, crcs[CAST(xor(c % 256, b) AS BIGINT) + 1])) AS crc
  FROM documents d, crc_table),
parts AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front,
         CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM base),
hashed AS (
  SELECT row_no, doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(front || coalesce(strlen(other) || ':' || other, '-')) AS tampered
  FROM parts),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM hashed),
nodes AS (
  SELECT source, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1
  GROUP BY source, level, pos // 16, n),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS trees FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place AS pos, trees AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1
  GROUP BY level, pos // 16, n),
sides AS (
  SELECT false AS up, source, level, pos, n,
         coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
         coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM nodes WHERE n > 1),
top_sides AS (
  SELECT level, pos, n,
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM tops WHERE n > 1),
climb AS (
  SELECT row_no, source, 0 AS level, pos, n, tampered AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT c.row_no, c.source, c.level + 1, c.pos // 16, (c.n + 15) // 16, sha256(s.lefts || c.digest || s.rights), c.proof || s.lefts || s.rights
  FROM climb c JOIN sides s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.pos = s.pos WHERE c.n > 1),
climb_top AS (
  SELECT c.row_no, 0 AS level, s.place AS pos, s.trees AS n, c.digest, c.proof
  FROM climb c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source WHERE c.n = 1
  UNION ALL
  SELECT c.row_no, c.level + 1, c.pos // 16, (c.n + 15) // 16, sha256(s.lefts || c.digest || s.rights), c.proof || s.lefts || s.rights
  FROM climb_top c JOIN top_sides s ON c.level = s.level AND c.pos = s.pos WHERE c.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.digest AS folded_root, c.digest = t.digest AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
JOIN climb_top c ON c.row_no = l.row_no AND c.n = 1 CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
"""
