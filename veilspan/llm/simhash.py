"""SimHash near-duplicates through the generalised pigeonhole.

A document's fingerprint holds, bit by bit, the majority over the hashes of its
three-word shingles.  Documents of one fingerprint are one node; two nodes are
linked if their fingerprints differ in at most ``most`` bits; a component is what
links reach.

Search for links: the 64 bits are grouped into partitions, correlated bits into
the same one, by counts over all fingerprints.  If two fingerprints differ in at
most r bits and thresholds t_i (from -1 up) add up so that sum(t_i + 1) = r + 1,
then in some partition they differ in at most t_i bits.  So each fingerprint gets
its own thresholds: dynamic programming picks those with the fewest expected
candidates, by a histogram of each partition's values.  A crowded value is not
probed at all (-1) where rare values elsewhere can bear a higher threshold.
Probes meet index entries by value, candidates are verified on all bits.  No link
is lost, whatever the estimates.

Groups of one value are cut into a grid of bounded blocks; a block gives a
spanning forest of its links, not all pairs.

Defined results: a null or empty text has fingerprint 0 and is linked like any
other; a null doc_id counts only where no other id is reached; rows may repeat;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import in_slices
from veilspan.llm.components import components
from veilspan.session import checkpoints_on

#: Words of a shingle, seed of its hash, and bits that linked fingerprints may differ in.
WORDS, SEED, MOST_BITS = 3, 42, 3
#: Entries of one side of a block.
BLOCK = 4096
#: Bits of a value that the histogram of a partition tells apart.
TOLD = 16
#: A row's place: doc_id, whether it is null, the text's hash.  The names end in a character that no column of a table has.
PLACE = ["_id\u2063", "_null\u2063", "_key\u2063"]
_NUMBER = "_number\u2063"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit majority of the shingle hashes; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if n > 1 or len(words) == WORDS else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some unsigned hashes have; 0 without any."""
    n = len(hashes)
    parts = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    ones = sum(np.unpackbits(parts[i:i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, 65536))
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


def signed(fp: int) -> int:
    """The same 64 bits as a signed long."""
    return fp - (fp >> 63 << 64)


def with_fingerprint(docs: DataFrame, name: str = "fp", text: str = "text") -> DataFrame:
    """All columns and the fingerprint as a signed long."""
    place, schema = docs.columns.index(text), _ddl(docs) + f", `{name}` long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            fps = np.array([fingerprint(t) for t in batch.column(place).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


class Partitions:
    """Groups of bits, and how often each value of a group occurs."""

    def __init__(self, groups: list[list[int]], most: int):
        self.groups, self.most, self.costs = groups, most, None

    def value(self, fps: np.ndarray, i: int) -> np.ndarray:
        """The bits of group i, packed."""
        out = np.zeros(len(fps), np.uint64)
        for k, bit in enumerate(self.groups[i]):
            out |= (fps >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
        return out

    def told(self, values: np.ndarray) -> np.ndarray:
        return (values & np.uint64((1 << TOLD) - 1)).astype(np.int64)

    def estimate(self, counts: list[np.ndarray]) -> None:
        """costs[i][t + 1][value]: expected candidates and probes for threshold t."""
        self.costs = []
        at = np.arange(1 << TOLD)
        for bits, count in zip(self.groups, counts):
            rows, found, probes = [np.zeros(1 << TOLD)], np.zeros(1 << TOLD), 0
            share = 2.0 ** -max(0, len(bits) - TOLD)
            for t in range(min(self.most + 1, max(3, -(-(self.most + 1) // len(self.groups))))):
                for flips in combinations(range(len(bits)), t):
                    mask = sum(1 << f for f in flips if f < TOLD)
                    found += count[at ^ mask] * share
                    probes += 1
                rows.append(found + probes)
            self.costs.append(rows)

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each fingerprint, by dynamic programming; one row a partition."""
        n, units = len(fps), self.most + 1
        best = np.full((units + 1, n), np.inf)
        best[0] = 0
        picks = []
        for i, rows in enumerate(self.costs):
            value = self.told(self.value(fps, i))
            after, pick = np.full((units + 1, n), np.inf), np.zeros((units + 1, n), np.int8)
            for used, cost in enumerate(rows):
                price = cost[value]
                for total in range(used, units + 1):
                    sum_ = best[total - used] + price
                    better = sum_ < after[total]
                    after[total][better] = sum_[better]
                    pick[total][better] = used
            best = after
            picks.append(pick)
        out, left = np.zeros((len(self.groups), n), np.int8), np.full(n, units)
        for i in reversed(range(len(self.groups))):
            used = picks[i][left, np.arange(n)]
            out[i] = used - 1
            left = left - used
        return out

    def entries(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(partition, values, fingerprints, flags): 1 is an index entry, 2 a probe, 3 both."""
        for i, t in enumerate(self.thresholds(fps)):
            values = self.value(fps, i)
            yield i, values, fps, np.where(t >= 0, 3, 1).astype(np.int8)
            for far in range(1, t.max(initial=-1) + 1):
                some = t >= far
                for flips in combinations(range(len(self.groups[i])), far):
                    mask = np.uint64(sum(1 << f for f in flips))
                    yield i, values[some] ^ mask, fps[some], np.full(some.sum(), 2, np.int8)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in equal groups, each grown by the bit most correlated with the group so far."""
    share = together.diagonal() / max(1, n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = np.abs(together / max(1, n) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    free, groups = list(range(64)), []
    for i in range(parts):
        size = 64 // parts + (i < 64 % parts)
        group = [max(free, key=lambda b: (tied[b, free].max(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (tied[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(group)
    return groups


def partitions_of(nodes: DataFrame, most: int) -> Partitions:
    """Bit groups and histograms from all fingerprints; their size does not grow with the table."""
    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            bits = (fps[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.ravel())], names=["at", "n"])

    n = nodes.count()
    together = np.zeros(4096)
    for r in nodes.mapInArrow(pairs, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        together[r["at"]] = r["n"]
    found = Partitions(group_bits(together.reshape(64, 64), n, 4 if n < 1 << 24 else 3), most)

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(len(found.groups)):
                value, count = np.unique(found.told(found.value(fps, i)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value + (i << TOLD)), pa.array(count)], names=["at", "n"])

    counts = np.zeros(len(found.groups) << TOLD)
    rows = nodes.mapInArrow(values, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    found.estimate(np.split(counts, len(found.groups)))
    return found


def links(nodes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp), enough of them to connect all that differ in at most ``most`` bits."""
    parts = nodes.sparkSession.sparkContext.broadcast(partitions_of(nodes, most))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values, fps, flags in parts.value.entries(batch.column(0).to_numpy().view(np.uint64)):
                key = values | np.uint64(i) << np.uint64(40)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(flags)], names=["key", "fp", "flag"])

    entries = nodes.select("fp").mapInArrow(spread, "key long, fp long, flag byte")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("flag").alias("probed"))
    sizes = sizes.filter("n > 1 and probed > 1").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    entries = entries.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                        lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    entries = entries.select("key", "fp", F.explode(cells).alias("cell")).select("key", "cell.i", "cell.j", "fp")
    entries = entries.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            held = rows[starts[-1]:] if len(rows) else rows
            yield from _linked(rows[:starts[-1]] if len(rows) else rows, starts[:-1], most)
        if held is not None and len(held):
            yield from _linked(held, np.array([0]), most)

    return entries.mapInArrow(verify, "a long, b long").distinct()


def _linked(rows: np.ndarray, starts: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of each group of rows."""
    out = []
    fps = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
    ends = np.r_[starts[1:], len(rows)]
    small = ends - starts == 2
    a, b = fps[starts[small]], fps[starts[small] + 1]
    near = np.bitwise_count(a ^ b) <= most
    out.append(np.stack([a[near], b[near]], axis=1))
    for start, end in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
        out.extend(forest(np.unique(fps[start:end]), most))
    pairs = np.concatenate(out).view(np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def forest(fps: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Links that connect what all links connect: reached nodes are not compared again."""
    left = fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            node = front.pop()
            near = np.bitwise_count(left ^ node) <= most
            if near.any():
                yield np.stack([np.full(near.sum(), node), left[near]], axis=1)
                front.extend(left[near])
                left = left[~near]


def groups(rows: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(fp, root, component_id) of rows (doc_id, fp): the component's smallest fingerprint and smallest doc_id."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = components(links(nodes.select("fp"), most)).select(F.col("node").alias("fp"), "root")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return nodes.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    checkpoints_on(docs.sparkSession)
    rows = with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp").checkpoint()
    out = rows.join(groups(rows, most), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keyed(docs: DataFrame) -> DataFrame:
    """All columns and a row's place."""
    return docs.select("*", *[c.alias(n) for n, c in zip(PLACE, (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.xxhash64("text")))])


def first_rows(keyed: DataFrame, rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each root of found (fp, root); rows hold the place and fp of every row."""
    id_, null, key = map(F.col, PLACE)
    first = F.min(F.struct(null, id_, "fp", key)).alias("k")
    kept = rows.join(found.select("fp", "root"), "fp").groupBy("root").agg(first).select(*[F.col("k")[c].alias(c) for c in PLACE])
    same = keyed.join(kept, PLACE, "left_semi")
    number = F.row_number().over(Window.partitionBy(*PLACE).orderBy(key))
    return same.withColumn(_NUMBER, number).filter(F.col(_NUMBER) == 1).select(*[F.col(f"`{c}`") for c in columns])


def without_copies(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """One row of each component: that of its smallest doc_id (rows without an id last), ties to the smallest fingerprint and text hash."""
    checkpoints_on(docs.sparkSession)
    with_key = keyed(docs)
    rows = with_fingerprint(with_key.select(*PLACE, "text")).select(*PLACE, "fp").checkpoint()
    found = groups(rows.select(F.when(~F.col(PLACE[1]), F.col(PLACE[0])).alias("doc_id"), "fp"), most)
    return first_rows(with_key, rows, found, docs.columns)
