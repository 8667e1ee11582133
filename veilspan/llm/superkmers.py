"""Exact removal of repeated passages, by super-k-mers of words.

A window is 13 consecutive words of a document.  Its minimiser is the least hash among
its runs of 5 words, so equal windows have equal minimisers.  Consecutive windows of
one minimiser travel as one packed string to the minimiser's bucket, where the strings
are cut into windows again and sorted; a window's first document is the smallest id of
its run.  Hashes only bring windows together, equal words decide.

A string stays at home if no other document has its minimiser, for then its windows
are unique.  This is looked up in a table of bits of bounded size: if the table is too
small for a corpus, more strings travel, and no result changes.  Strings are combined
before the shuffle: a task sends each of its strings once, with smallest and largest
id, so that a passage of many documents is few rows.  Runs of words that a sample of
the texts holds often come last in the order of minimisers, which keeps buckets small;
the sample decides nothing else.  A bucket that is still overfull is handed on, and its
windows are grouped one by one.

Results go back by string: only strings with a repeated window have one, and only
documents that may hold such a string are joined, after a second table of bits.
Strings of very many documents are salted; at most 1000 strings can be that frequent.

Defined results: a null or empty text has no words; rows of one id are one document and
remove nothing from each other; a null id comes after all others, and the largest long
counts as null; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import in_slices
from veilspan.session import checkpoints_on

#: Words of a window, words of a minimiser.
WORDS, INNER = 13, 5
#: Words handled at once, strings a task combines, strings of buckets in its memory, bits of a table at least and at most.
PIECE, HELD, SORTED, FEWEST, MOST = 20_000, 20_000, 20_000, 1 << 20, 1 << 28
#: Rows sampled for the order, runs of words whose count is kept, salts of a frequent string, copies that make one frequent.
SAMPLE, COUNTED, SALTS, FREQUENT = 5000, 1 << 16, 64, 10_000
#: Hash of a byte, base of a string's polynomial, id of rows without one.
_BYTES = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64)
_BASE, _NO_ID = 0x9E3779B97F4A7C15, (1 << 63) - 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + n // 8, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps, out=steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Line:
    """Words joined by a space, and hashes of any run of them from prefix sums."""

    def __init__(self, joined: bytes):
        data = np.frombuffer(joined, np.uint8)
        self.joined = joined
        self.ends = np.append(np.flatnonzero(data == 32), len(data))
        self.starts = np.append(0, self.ends[:-1] + 1)
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[:-1], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        return found ^ found >> np.uint64(32)

    def inner(self) -> np.ndarray:
        """The hash of the run at each word, in 63 bits."""
        return self.hashes(self.starts[:-INNER + 1], self.ends[INNER - 1:]) >> np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def key_of(string: bytes) -> bytes:
    """The name of a string in joins, 128 bits."""
    return xxhash.xxh3_128_digest(string)


class Strings:
    """The strings of some texts: row of the batch, minimiser, first word, and where the words are."""

    def __init__(self, parts: list[list[bytes]], at: list[tuple[int, int]], known: np.ndarray):
        long = np.array([i for i, words in enumerate(parts) if len(words) >= WORDS], np.int64)
        self.rows = self.begin = self._starts = self._ends = long[:0]
        self.minimisers = np.zeros(0, np.uint64)
        if not len(long):
            return
        counts = np.array([len(parts[i]) for i in long])
        self._line = line = Line(b" ".join(b" ".join(parts[i]) for i in long))
        hashes = line.inner()
        if len(known):
            found = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hashes |= (known[found] == hashes).astype(np.uint64) << np.uint64(63)
        n = len(line.starts) - WORDS + 1
        least, place = hashes[:n].copy(), np.arange(n)
        for k in range(1, WORDS - INNER + 1):
            other = hashes[k:n + k]
            better = np.flatnonzero(other < least)
            least[better] = other[better]
            place[better] = better + k
        part = np.repeat(np.arange(len(long)), counts)
        inside = part[:n] == part[WORDS - 1:]
        first = np.flatnonzero(inside & np.r_[True, (place[1:] != place[:-1]) | (part[1:n] != part[:n - 1])])
        windows = np.flatnonzero(inside)
        last = windows[np.searchsorted(windows, np.r_[first[1:], n]) - 1]
        rows, starts = np.array([at[i] for i in long], np.int64).T
        self.rows, self.minimisers = rows[part[first]], least[first]
        self.begin = first - (np.cumsum(counts) - counts - starts)[part[first]]
        self._starts, self._ends = line.starts[first], line.ends[last + WORDS - 1]

    def words(self, some: np.ndarray) -> list[bytes]:
        return [self._line.joined[a:b] for a, b in zip(self._starts[some].tolist(), self._ends[some].tolist())]


def of_batches(batches: Iterable[pa.RecordBatch], known: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Strings]]:
    """The strings of some texts at a time; the last column is the text.

    ``known`` are the sorted hashes of frequent runs, which are minimisers only of windows that hold no other.
    A very long text is handled in parts that overlap by 12 words, so every window is in one part.
    """
    for batch in in_slices(batches, 200):
        parts, at, size = [], [], 0
        for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            words = words_of(text)
            for start in range(0, max(1, len(words) - WORDS + 1), PIECE):
                parts.append(words[start:start + PIECE + WORDS - 1])
                at.append((row, start))
                size += len(parts[-1])
                if size > PIECE:
                    yield batch, Strings(parts, at, known)
                    parts, at, size = [], [], 0
        yield batch, Strings(parts, at, known)


class Bits:
    """A table of bits for 64-bit hashes; it may hold more than was put in, never less."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % np.uint64(64 * len(self.words))
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, hashes: DataFrame) -> Bits:
        """Of the only column, longs; eight bits for each hash, up to ``MOST``."""
        size = min(MOST, max(FEWEST, 1 << (8 * hashes.count()).bit_length()))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(batch.column(0).to_numpy().view(np.uint64) % np.uint64(size))
                word = (at >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(word) else at
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(bits.view(np.int64))], names=["at", "bits"])

        rows = hashes.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(size >> 6, np.uint64)
        words[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return cls(words)


def frequent_runs(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the runs of words that most texts of a sample hold."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 200):
            lines = [Line(b" ".join(w)) for w in map(words_of, batch.column(0).to_pylist()) if len(w) >= INNER]
            if lines:
                keys, n = np.unique(np.concatenate([np.unique(line.inner()) for line in lines]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    some = docs.select("text").sample(fraction=min(1.0, SAMPLE / max(1, docs.count())), seed=WORDS)
    rows = some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 2")
    return np.sort(rows.orderBy(F.desc("n"), "key").limit(COUNTED).select("key").toArrow()["key"].to_numpy().view(np.uint64))


def shared_minimisers(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(bucket) of the minimisers that several rows of (_id, text) have."""
    order = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in of_batches(batches, order.value):
            sort = np.lexsort((found.rows, found.minimisers))
            least, rows = found.minimisers[sort], found.rows[sort]
            once = least[np.r_[True, (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])]] if len(least) else least
            buckets, n = np.unique(once, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.view(np.int64)), pa.array(n.astype(np.int32))], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n int")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 1").select("bucket")


def strings_of(docs: DataFrame, known: np.ndarray, shared: Bits) -> DataFrame:
    """(bucket, packed, least, most, copies) of (_id, text): each string of a task once, with its smallest and largest id."""
    both, limit = docs.sparkSession.sparkContext.broadcast((known, shared)), HELD

    def rows(held: dict[bytes, int], numbers: np.ndarray) -> pa.RecordBatch:
        numbers = numbers[:len(held)]
        arrays = [pa.array(numbers[:, 0]), pa.array(held, pa.binary(), size=len(held)), *[pa.array(numbers[:, k]) for k in (1, 2, 3)]]
        return pa.RecordBatch.from_arrays(arrays, names=["bucket", "packed", "least", "most", "copies"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # where a string's numbers are; Python lists of them would take several times the room
        held: dict[bytes, int] = {}
        numbers = np.zeros((limit, 4), np.int64)
        known, shared = both.value
        for batch, found in of_batches(batches, known):
            some = np.flatnonzero(shared.holds(found.minimisers))
            ids, buckets = batch.column(0).to_numpy()[found.rows[some]], found.minimisers[some].view(np.int64)
            at = np.fromiter((held.setdefault(string, len(held)) for string in found.words(some)), np.int64, len(some))
            if len(held) > len(numbers):
                numbers = np.concatenate([numbers, np.zeros((2 * len(held) - len(numbers), 4), np.int64)])
            new, first = np.unique(at, return_index=True)
            first = first[numbers[new, 3] == 0]
            numbers[at[first], 0] = buckets[first]
            numbers[at[first], 1] = numbers[at[first], 2] = ids[first]
            np.minimum.at(numbers[:, 1], at, ids)
            np.maximum.at(numbers[:, 2], at, ids)
            np.add.at(numbers[:, 3], at, 1)
            if len(held) > limit:
                yield rows(held, numbers)
                held = {}
                numbers[:, 3] = 0
        yield rows(held, numbers)

    return docs.select("_id", "text").mapInArrow(run, "bucket long, packed binary, least long, most long, copies long")


def sorted_buckets(strings: DataFrame) -> DataFrame:
    """(key, firsts, copies, packed, least, most): the smallest id of every window of the strings that hold a repeated one.

    Strings of overfull buckets come back as they are, with packed, least and most.
    """
    limit = SORTED

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = [], None
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            if over is not None and len(buckets):
                n = int(np.searchsorted(buckets != over, True))
                yield _handed_on([batch.slice(0, n)])
                batch, over = batch.slice(n), over if n == len(buckets) else None
            held.append(batch)
            if sum(map(len, held)) < limit:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[len(rows) - 1].as_py()))
            if cut:
                yield _firsts(rows.slice(0, cut))
                held = [rows.slice(cut)]
            else:
                yield _handed_on([rows])
                held, over = [], rows.column(0)[0].as_py()
        held = [b for b in held if len(b)]
        if held:
            yield _firsts(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    rows = strings.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "key binary, firsts array<long>, copies long, packed binary, least long, most long")


_FOUND = pa.schema({"key": pa.binary(), "firsts": pa.list_(pa.int64()), "copies": pa.int64(), "packed": pa.binary(), "least": pa.int64(), "most": pa.int64()})


def _handed_on(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = batches[0]
    empty = [pa.nulls(len(rows), _FOUND.field(k).type) for k in range(2)]
    return pa.RecordBatch.from_arrays([*empty, rows["copies"], rows["packed"], rows["least"], rows["most"]], schema=_FOUND)


def _firsts(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The results of whole buckets: windows are sorted by hash, those of one hash by their words."""
    found: dict[bytes, list[int]] = {}
    for string, least, most, copies in zip(*(rows[c].to_pylist() for c in ("packed", "least", "most", "copies"))):
        old = found.setdefault(string, [least, most, 0])
        old[0], old[1], old[2] = min(old[0], least), max(old[1], most), old[2] + copies
    strings = list(found)
    least, most, copies = np.array(list(found.values()), np.int64).T
    line = Line(b" ".join(strings))
    closing = np.cumsum([len(s) + 1 for s in strings]) - 1
    owner = np.searchsorted(closing, line.ends)
    n = max(0, len(line.starts) - WORDS + 1)
    window = np.flatnonzero(owner[:n] == owner[WORDS - 1:])
    begin, end, owner = line.starts[window], line.ends[window + WORDS - 1], owner[window]
    hashes, ids = line.hashes(begin, end), least[owner]
    order = np.argsort(hashes, kind="stable")
    cuts = np.append(np.flatnonzero(np.r_[True, hashes[order[1:]] != hashes[order[:-1]]]), len(order))
    for g in np.flatnonzero(np.diff(cuts) > 1).tolist():
        text = None
        for words, doc, at in sorted((line.joined[begin[i]:end[i]], int(ids[i]), i) for i in order[cuts[g]:cuts[g + 1]].tolist()):
            if words != text:
                text, first = words, doc
            ids[at] = first
    repeated = most > least
    repeated[owner[ids < least[owner]]] = True
    some = np.flatnonzero(repeated)
    ends = np.searchsorted(owner, some, "right")
    firsts = [ids[a:b] for a, b in zip(np.searchsorted(owner, some).tolist(), ends.tolist())]
    empty = [pa.nulls(len(some), _FOUND.field(k).type) for k in range(3, 6)]
    arrays = [pa.array([key_of(strings[i]) for i in some.tolist()], pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(copies[some]), *empty]
    return pa.RecordBatch.from_arrays(arrays, schema=_FOUND)


def by_window(strings: DataFrame) -> DataFrame:
    """(key, firsts, copies) of the strings of overfull buckets: every window is a row, and equal ones are grouped."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2000):
            at, keys, windows = [], [], []
            for row, string in enumerate(batch.column(0).to_pylist()):
                words, key = string.split(b" "), key_of(string)
                for i in range(len(words) - WORDS + 1):
                    at.append((row, i))
                    keys.append(key)
                    windows.append(b" ".join(words[i:i + WORDS]))
            rows, places = np.array(at, np.int64).reshape(-1, 2).T
            arrays = [pa.array(keys, pa.binary()), pa.array(places), pa.array(windows, pa.binary()), *[batch.column(k).take(pa.array(rows)) for k in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "i", "window", "least", "most", "copies"])

    strings = strings.groupBy("packed").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("copies").alias("copies"))
    windows = strings.mapInArrow(cut, "key binary, i long, window binary, least long, most long, copies long")
    first = windows.groupBy("window").agg(F.min("least").alias("first"))
    found = windows.join(first, "window").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "first"))).alias("w"),
                                                            *[F.first(c).alias(c) for c in ("least", "most", "copies")])
    found = found.filter("most > least or exists(w, x -> x.first < least)")
    return found.select("key", F.col("w.first").alias("firsts"), "copies")


def results(docs: DataFrame, known: np.ndarray, shared: Bits) -> DataFrame:
    """(key, firsts, copies) of the strings that hold a repeated window."""
    rows = sorted_buckets(strings_of(docs, known, shared)).checkpoint()
    done, over = rows.filter("key is not null").select("key", "firsts", "copies"), rows.filter("key is null")
    return done if over.isEmpty() else done.unionByName(by_window(over)).checkpoint()


def _front(keys: list[bytes]) -> np.ndarray:
    """The first half of each key."""
    return np.frombuffer(b"".join(keys), np.uint64)[::2]


def _fronts(found: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_front(batch.column(0).to_pylist()).view(np.int64))], names=["front"])

    return found.select("key").mapInArrow(run, "front long")


def holders(docs: DataFrame, known: np.ndarray, shared: Bits, wanted: Bits, frequent: list[bytes]) -> DataFrame:
    """(key, salt, _id, _key, start): where the wanted strings, and a few more, stand in (_id, _key, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((known, shared, wanted, set(frequent)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shared, wanted, frequent = sent.value
        for batch, found in of_batches(batches, known):
            some = np.flatnonzero(shared.holds(found.minimisers))
            keys = list(map(key_of, found.words(some)))
            held = np.flatnonzero(wanted.holds(_front(keys)))
            keys, some = [keys[i] for i in held.tolist()], some[held]
            rows, texts = found.rows[some], batch.column(1).to_numpy()
            salts = [t % SALTS if k in frequent else 0 for k, t in zip(keys, texts[rows].tolist())]
            arrays = [pa.array(keys, pa.binary()), pa.array(salts, pa.int32()), pa.array(batch.column(0).to_numpy()[rows]), pa.array(texts[rows]), pa.array(found.begin[some])]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "salt", "_id", "_key", "start"])

    return docs.select("_id", "_key", "text").mapInArrow(run, "key binary, salt int, _id long, _key long, start long")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(_id, _key, starts) of (_id, _key, text): first words of the windows that a smaller id holds too, in lists."""
    known = frequent_runs(docs)
    shared = Bits.of(shared_minimisers(docs, known).checkpoint())
    found = results(docs, known, shared)
    least = max(FREQUENT, (found.agg(F.sum("copies")).first()[0] or 0) // 1000)
    frequent = [bytes(r["key"]) for r in found.filter(F.col("copies") > least).select("key").collect()]
    salts = F.when(F.col("copies") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = found.select("key", F.explode(salts).alias("salt"), "firsts")
    rows = holders(docs, known, shared, Bits.of(_fronts(found)), frequent).join(salted, ["key", "salt"])
    starts = F.expr("transform(filter(sequence(0, size(firsts) - 1), i -> firsts[i] < _id), i -> start + i)")
    rows = rows.select("_id", "_key", starts.alias("starts")).filter("size(starts) > 0")
    return rows.groupBy("_id", "_key").agg(F.collect_set("starts").alias("starts"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words left over, joined by a space; one row for each row of docs."""
    checkpoints_on(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), F.xxhash64("text").alias("_key"), "text")
    rows = docs.join(repeated_windows(docs), ["_id", "_key"], "left").select("doc_id", "starts", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 200):
            counts, removed, kept = [], [], []
            for starts, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(text)
                counts.append(len(words))
                if starts:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = np.concatenate(starts)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + WORDS, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT row_no, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs),
windows AS (SELECT row_no, doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM places),
firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
repeats AS (SELECT x.row_no, x.i FROM windows x JOIN firsts f USING (w) WHERE f.least < coalesce(x.doc_id, 9223372036854775807)),
covered AS (SELECT row_no, list(DISTINCT i + k) AS places FROM repeats, range(13) r(k) GROUP BY row_no),
kept AS (
  SELECT d.doc_id, d.words, coalesce(c.places, []) AS places FROM docs d LEFT JOIN covered c USING (row_no))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(places, i)), ' ')) AS kept_sha256
FROM kept
"""
