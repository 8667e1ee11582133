"""Near copies by five-word shingles: exact Jaccard similarity of 0.8 or more.

Texts of one shingle set are one node.  Its fingerprint is SimHash over the set, and the
generalised pigeonhole search of ``simhash`` gives the first pairs: fingerprints that differ in
few bits.  They are verified on the sets.  Fingerprints of links may differ in more bits, so an
exact search finds the rest.

Two sets of similarity 0.8 share a shingle
among the first |x| - ceil(0.8 |x|) + 1 of each, in any order that holds for all
sets.  So these entries alone are grouped by shingle, and no link is lost.  The order
takes rare shingles first, by counts over a sample of the rows; the sample decides
only how large the groups get, never what is linked.

A set's mark holds the parities of its hashes: marks of two sets differ in no more bits
than the sets in shingles, so marks too far apart exclude a pair.  Members of a group
meet in a grid of bounded blocks, with their marks, and a block gives no more pairs than
it has members: a spanning forest of what the marks allow.  Only members of groups that are
still in different components meet: those that the marks allow a partner, with marks of more
bits, which allow hardly any pair but links; pairs are verified on the whole sets, whose hashes
have 64 bits.
A node meets its neighbours under many shingles, so sets would travel many times over; here
a set travels once to each pair.  What is open after that is compared inside the blocks, on
the whole sets, and a block gives a forest of the links: sets just below the bound are many
pairs, but no rows.

Defined results: texts without words are one node, linked to no other; a text of fewer
than five words is one shingle; case counts only outside ASCII.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import simhash
from veilspan.llm.common import in_slices
from veilspan.llm.components import components
from veilspan.session import checkpoints_on, few

#: Words of a shingle and seed of its hash.
WORDS, SEED = 5, 42
#: Rows that are sampled for the order, and shingles whose count is kept.
SAMPLE, COUNTED = 5000, 1 << 17
#: Bits that fingerprints of the first pairs may differ in; more bits mean fewer late links and more probes, never other results.
BITS = 3
#: Rows a document by which the partitions of tables of entries and sets are counted.
ENTRIES = 40
#: Nodes of one side of a block, bits of the table of wanted texts, nodes a task remembers, and how many times the bits of a mark a wide one has.
BLOCK, WANTED, SEEN, WIDER = 512, 1 << 25, 100_000, 4
_PLACE = simhash.PLACE


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes; empty without words."""
    words = (text or "").encode().translate(simhash._LOWER).split()
    n = max(1, len(words) - WORDS + 1) if words else 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)][:n]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n).view(np.int64))


def node(hashes: np.ndarray) -> int:
    """The set's digest as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def first(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, enough of them to meet every set of similarity 0.8."""
    n = len(hashes) - (4 * len(hashes) + 4) // 5 + 1 if len(hashes) else 0
    often = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        often = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[:n]]


def mark(hashes: np.ndarray, times: int = 1) -> bytes:
    """Parity of the hashes of each rest; a power of two of rests, as many as hashes at least, or some times that."""
    wide = times << max(8, (len(hashes) - 1).bit_length())
    return np.packbits((np.bincount(hashes & wide - 1, minlength=wide) & 1).astype(np.uint8)).tobytes()


def similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of some sorted sets, none empty, have a similarity of 0.8 or more to another."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    held = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    return 9 * np.add.reduceat(held, np.cumsum(sizes) - sizes, dtype=np.int64) >= 4 * (sizes + len(one))


class Block:
    """Members of one group, by size: which pairs the marks allow."""

    def __init__(self, sizes: np.ndarray, marks: list[bytes], roots: np.ndarray, owns: np.ndarray, two: bool):
        self.roots, self.owns, self.two = roots, owns, two
        self.limit = (sizes, np.searchsorted(sizes, 5 * sizes // 4, "right"))
        wide = np.array([len(m) for m in marks])
        self.tables = {}
        for w in np.unique(wide).tolist():
            at = np.searchsorted(wide, w)
            own = np.frombuffer(b"".join(marks[at:np.searchsorted(wide, w, "right")]), np.uint64).reshape(-1, w // 8)
            far = marks[np.searchsorted(wide, 2 * w):np.searchsorted(wide, 2 * w, "right")]
            halves = np.frombuffer(b"".join(far), np.uint64).reshape(-1, 2, w // 8)
            self.tables[w] = at, np.concatenate([own, halves[:, 0] ^ halves[:, 1]])
        self.wide = wide

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of some later members, by size, that may be linked to member i."""
        sizes, ends = self.limit
        others = others[:np.searchsorted(others, ends[i])]
        others = others[self.roots[others] != self.roots[i]]
        if self.two:
            others = others[self.owns[others] != self.owns[i]]
        at, table = self.tables[int(self.wide[i])]
        apart = np.bitwise_count(table[others - at] ^ table[i - at]).sum(axis=1, dtype=np.int64)
        return others[9 * apart <= sizes[others] + sizes[i]]

    def partners(self) -> np.ndarray:
        """The members that the marks allow a pair with some other."""
        n = len(self.roots)
        some = np.zeros(n, bool)
        for i in range(n - 1):
            found = self.near(i, np.arange(i + 1, n))
            some[found] = True
            some[i] |= len(found) > 0
        return np.flatnonzero(some)

    def pairs(self, sets: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """A forest of the pairs that the marks allow; with sets, of those whose similarity is 0.8 or more."""
        n = len(self.roots)
        for i in range(n - 1):
            found = self.near(i, np.arange(i + 1, n))
            if sets is not None and len(found):
                found = found[similar(sets[i], [sets[k] for k in found.tolist()])]
            if not len(found):
                continue
            roots, first = np.unique(self.roots[found], return_index=True)
            yield i, found[first]
            self.roots[np.isin(self.roots, roots)] = self.roots[i]


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, sorted, and their counts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [shingles(t) for t in batch.column(0).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["key"])

    some = docs.select("text").sample(fraction=min(1.0, SAMPLE / max(1, docs.count())), seed=SEED)
    counted = some.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    rows = counted.orderBy(F.desc("n"), "key").limit(COUNTED).toArrow()
    known, counts = rows["key"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(known)
    return known[order], counts[order]


def with_entries(keyed: DataFrame) -> DataFrame:
    """Place, node, size of the set, its first shingles, mark and fingerprint; a task gives the last three of a node once, as long as it remembers it."""
    order = keyed.sparkSession.sparkContext.broadcast(common(keyed))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in in_slices(batches):
            nodes, sizes, entries, marks, fps = [], [], [], [], []
            for text in batch.column(3).to_pylist():
                hashes = shingles(text)
                nodes.append(node(hashes))
                sizes.append(len(hashes))
                known = nodes[-1] in seen
                entries.append(None if known else first(hashes, *order.value))
                marks.append(None if known else mark(hashes))
                fps.append(None if known else simhash.signed(simhash.majority(hashes.view(np.uint64))))
                seen.add(nodes[-1])
                if len(seen) > SEEN:
                    seen.clear()
            arrays = [*batch.columns[:3], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(entries, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*_PLACE, "node", "size", "entries", "mark", "fp"])

    place = ", ".join(f"`{n}` {t}" for n, t in zip(_PLACE, ("long", "boolean", "long")))
    return keyed.select(*_PLACE, "text").mapInArrow(run, f"{place}, node long, size int, entries array<long>, mark binary, fp long")


def meeting(rows: DataFrame) -> DataFrame:
    """(key, size, node): entries of shingles that several nodes hold.

    Repeats are left out, and entries whose neighbours in size are too far on both sides: all others are farther.
    """
    entries = rows.filter("entries is not null").select(F.explode("entries").alias("key"), "size", "node")
    entries = entries.repartition("key").sortWithinPartitions("key", "size", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, near = np.zeros((0, 3), np.int64), False  # the last entry, of which the next one is not known yet
        for batch in batches:
            lines = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
            lines = lines[np.r_[True, (lines[1:] != lines[:-1]).any(axis=1)]] if len(lines) else lines
            if not len(lines):
                continue
            same = (lines[1:, 0] == lines[:-1, 0]) & (4 * lines[1:, 1] <= 5 * lines[:-1, 1])
            before = np.r_[near, same]
            yield _batch(lines[:-1][before[:-1] | same])
            held, near = lines[-1:].copy(), bool(before[-1])
        yield _batch(held[:int(near)])

    return entries.mapInArrow(run, "key long, size long, node long")


def _batch(lines: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lines[:, k]) for k in range(3)], names=["key", "size", "node"])


def sets_of(keyed: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of some nodes; texts are chosen by a bit table of their hashes, so a few more are read."""
    wanted = rows.select("node", F.col(_PLACE[2]).alias("text")).join(nodes, "node").groupBy("node").agg(F.min("text").alias("text"))
    bit = F.pmod("text", F.lit(WANTED))
    words = wanted.groupBy((F.shiftright(bit, 3)).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(pmod(text, {WANTED}) & 7 as int))")).alias("bits")).toArrow()
    table = np.zeros(WANTED >> 3, np.uint8)
    table[words["at"].to_numpy()] = words["bits"].to_numpy()
    table = keyed.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            at = batch.column(0).to_numpy() % WANTED
            batch = batch.take(pa.array(np.flatnonzero(table.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)))
            found = {}
            for text in batch.column(1).to_pylist():
                hashes = shingles(text)
                found[node(hashes)] = hashes
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["node", "hashes"])

    sets = keyed.select(_PLACE[2], "text").mapInArrow(run, "node long, hashes array<long>")
    return sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def alike(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b), of n nodes, whose sets have a similarity of 0.8 or more."""
    one, two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    both = both.filter("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("a", "b")
    return few(both, 4 * n).checkpoint()


def blocks(met: DataFrame, marks: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, i, j, size, node, root, own, mark): the blocks of each shingle whose members are in different components."""
    known = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = known.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_ = open_.filter("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    known = known.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                        lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    known = known.join(marks, "node").select("key", "size", "node", "root", "own", "mark", F.explode(cells).alias("cell"))
    return known.select("key", "cell.i", "cell.j", "size", "node", "root", "own", "mark")


def _met(known: DataFrame) -> DataFrame:
    return known.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "size", "node")


def _each(batches: Iterable[pa.RecordBatch], told: Callable) -> Iterator[tuple[np.ndarray, list]]:
    """The lines of each block of two and more, and what the last column says of them."""
    lines, last = np.zeros((0, 7), np.int64), []
    for batch in batches:
        lines = np.concatenate([lines, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:7]], axis=1)])
        last += told(batch.column(7))
        starts = np.flatnonzero(np.r_[True, (lines[1:, :3] != lines[:-1, :3]).any(axis=1)]) if len(lines) else np.zeros(1, int)
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if end - start > 1:
                yield lines[start:end], last[start:end]
        lines, last = lines[starts[-1]:], last[starts[-1]:]
    if len(lines) > 1:
        yield lines, last


def _block(lines: np.ndarray, marks: list[bytes]) -> Block:
    return Block(lines[:, 3], marks, lines[:, 5].copy(), lines[:, 6], lines[0, 1] != lines[0, 2])


def forest(blocked: DataFrame) -> DataFrame:
    """A forest of the pairs (a, b) of one block and different components that the marks allow."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, marks in _each(batches, pa.Array.to_pylist):
            yield from _pairs(lines, _block(lines, marks).pairs())

    return _met(blocked).mapInArrow(run, "a long, b long").distinct()


def wide_marks(sets: DataFrame) -> DataFrame:
    """(node, mark) with ``WIDER`` times the bits: pairs they allow have a similarity hardly below the bound."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [mark(s.values.to_numpy(), WIDER) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["node", "mark"])

    return sets.select("node", "hashes").mapInArrow(run, "node long, mark binary")


_MEMBER = ["key", "i", "j", "size", "node", "root", "own"]


def with_partners(blocked: DataFrame) -> DataFrame:
    """The members of the blocks that the marks allow a partner, without the marks."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, marks in _each(batches, pa.Array.to_pylist):
            lines = lines[_block(lines, marks).partners()]
            if len(lines):
                yield pa.RecordBatch.from_arrays([pa.array(lines[:, k]) for k in range(7)], names=_MEMBER)

    return _met(blocked).mapInArrow(run, ", ".join(f"{n} long" for n in _MEMBER))


def still_open(left: DataFrame, roots: DataFrame) -> DataFrame:
    """The members with their roots of now, without blocks that hold one component."""
    known = left.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = known.groupBy("key", "i", "j").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return known.join(open_, ["key", "i", "j"], "left_semi").select(*_MEMBER)


def settled(met: DataFrame, marks: DataFrame, roots: DataFrame, keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The roots with all links between different components that share a shingle.

    Wide marks lead to nearly all of them; a set travels to each pair that they allow.  Only members that the wide marks
    allow a partner in another component after that bring their sets into the block, which compares them there:
    pairs just below the bound, as many as the square of a group, are never rows.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, sets in _each(batches, lambda column: [s.values.to_numpy() for s in column]):
            yield from _pairs(lines, _block(lines, list(map(mark, sets))).pairs(sets))

    n = rows.count()
    left = few(with_partners(blocks(met, marks, roots)), ENTRIES * n).checkpoint()
    sets = few(sets_of(keyed, rows, left.select("node").distinct()), ENTRIES * n).checkpoint()
    wide = wide_marks(sets).checkpoint()
    pairs = few(forest(left.join(wide, "node").select(*_MEMBER, "mark")), n).checkpoint()
    roots = components(alike(pairs, sets, n), roots)
    left = few(with_partners(still_open(left, roots).join(wide, "node").select(*_MEMBER, "mark")), ENTRIES * n).checkpoint()
    links = _met(left.join(sets, "node").select(*_MEMBER, "hashes")).mapInArrow(run, "a long, b long").distinct()
    return components(few(links, n).checkpoint(), roots)


def _pairs(lines: np.ndarray, pairs: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    found = [(lines[others, 4], np.full(len(others), lines[i, 4])) for i, others in pairs]
    if found:
        one, two = map(np.concatenate, zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints differ in at most ``BITS`` bits, enough of them to connect all those.

    A fingerprint is the majority over the set's hashes; the search is that of ``simhash.links``.
    """
    n = rows.count()
    nodes = few(rows.filter("fp is not null and size > 0").select("fp", "node").distinct(), n).checkpoint()
    least = few(nodes.groupBy("fp").agg(F.min("node").alias("least")), n).checkpoint()
    equal = nodes.join(least, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    far = simhash.links(least.select("fp"), BITS)
    for end in ("a", "b"):
        far = far.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_node")), end)
    far = far.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    return equal.union(far)


def linked(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have a link, a similarity of 0.8 or more; what fingerprints don't find, the exact search adds to their roots."""
    n = rows.count()
    met = few(meeting(rows), ENTRIES * n).checkpoint()
    marks = rows.filter("mark is not null").groupBy("node").agg(F.first("mark").alias("mark"))
    tried = few(by_fingerprint(rows), n).checkpoint()
    sets = sets_of(keyed, rows, tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct())
    return settled(met, marks, components(alike(tried, sets, n)), keyed, rows)


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each component: that of its smallest doc_id (rows without an id last), ties to the smallest node and text hash."""
    checkpoints_on(docs.sparkSession)
    keyed = simhash.keyed(docs)
    rows = with_entries(keyed).checkpoint()
    roots = linked(keyed, rows)
    found = rows.select("node").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return simhash.first_rows(keyed, rows.select(*_PLACE, F.col("node").alias("fp")), found.withColumnRenamed("node", "fp"), docs.columns)
