"""How far the word use of sources lies apart, by Gustavson row accumulation.

Words are counted by (language, source).  A language keeps the terms that enough of
its documents hold; a group's share of a term is smoothed, so a term that it never uses
has the group's baseline.  The distance of two groups is the sum over all kept terms
of the difference of their shares.

The groups by terms are a sparse matrix.  Its product with itself, row by row: a
group's terms are looked up in the term-major index, and what each posting changes is
added to a dense accumulator of the group's peers.  Terms that only one or none of two
groups hold are put right by baselines: the distance of a group's shares to a peer's
baseline comes from sorted prefix sums, the rest is a product.  The index is dealt out
by slices of terms; a slice's accumulators are summed, and no pair of postings is ever
a row.

Defined results: null text, language and source are read as empty; a group without
terms counts as a group; a language that keeps no term has distances of 0 and no term
rows; repeated rows are documents of their own; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import in_slices
from veilspan.session import checkpoints_on

#: Documents that a kept term needs, smoothing, units of a share, terms reported for a group.
LEAST_DOCS, SMOOTH, UNITS, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Entries a task counts before it hands them on, postings of a slice, postings looked up at once.
HELD, SLICE, AT_ONCE = 300_000, 1_000_000, 1 << 21
#: Bytes of a text to its terms: A-Z is lower-cased, all ASCII but letters ends a term.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row without a term for each group."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = defaultdict(lambda: (Counter(), Counter())), {}
        for batch in in_slices(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                times, docs = found[lang or "", source or ""]
                words = terms(text)
                times.update(words)
                docs.update(set(words))
                held[lang or "", source or ""] = len(times)
            if sum(held.values()) > HELD:
                yield from map(_rows, found.items())
                found.clear()
                held.clear()
        yield from map(_rows, found.items())

    rows = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rows(entry: tuple) -> pa.RecordBatch:
    (lang, source), (times, docs) = entry
    words = list(times)
    n = len(words) + 1
    arrays = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([None, *words], pa.string()),
              pa.array([0, *times.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, words)], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])


def share(count: str, total: str, kept: str) -> F.Column:
    """The smoothed share in whole units."""
    return F.expr(f"1 + cast({UNITS} as decimal(20, 0)) * ({count} + {SMOOTH}) div ({total} + {SMOOTH} * {kept})")


def tables(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, g, groups, total, held, kept, base, postings) and kept entries (lang, source, term, n, lang_n).

    g numbers the groups of a language, held counts a group's terms, kept those of its language, base is the share of a term without occurrences.
    """
    checkpoints_on(docs.sparkSession)
    counts = counted(docs).checkpoint()
    term, lang = Window.partitionBy("lang", "term"), Window.partitionBy("lang")
    entries = counts.filter("term is not null").select("lang", "source", "term", "n", F.sum("docs").over(term).alias("_docs"), F.sum("n").over(term).alias("lang_n"))
    entries = entries.filter(F.col("_docs") >= least_docs).drop("_docs").checkpoint()
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    vocabulary = entries.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    groups = counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.na.fill(0, ["total", "held", "kept", "lang_total"])
    groups = groups.select("*", (F.row_number().over(lang.orderBy("source")) - 1).alias("g"), F.count(F.lit(1)).over(lang).alias("groups"),
                           F.sum("held").over(lang).alias("postings"), F.when(F.col("kept") > 0, share("0", "total", "kept")).otherwise(0).alias("base"))
    return groups.checkpoint(), entries


def accumulated(g: np.ndarray, starts: np.ndarray, p: np.ndarray, base: np.ndarray, held: np.ndarray, kept: int, whole: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each group, what a slice of the index adds to its distances; the sum for a pair comes from both its rows.

    Postings (g, p) are term-major, ``starts`` is each term's first; ``whole`` adds the terms that neither group holds, once.
    """
    ends = np.repeat(np.r_[starts[1:], len(g)], np.diff(np.r_[starts, len(g)])) if len(g) else np.zeros(0, np.int64)
    by_group = np.argsort(g, kind="stable")
    rows = np.searchsorted(g[by_group], np.arange(len(base) + 1))
    for own in range(len(base)):
        mine = by_group[rows[own]:rows[own + 1]]
        apart = np.abs(base - base[own])
        total = np.zeros(len(base), np.int64)
        # its shares against each peer's baseline
        shares = np.sort(p[mine])
        sums = np.r_[0, np.cumsum(shares)]
        below = np.searchsorted(shares, base)
        total += base * below - sums[below] + (sums[-1] - sums[below]) - base * (len(shares) - below)
        # postings of later peers: the real difference in place of two against baselines
        lens = ends[mine] - mine - 1
        cuts = np.searchsorted(np.cumsum(lens), np.arange(AT_ONCE, lens.sum() + AT_ONCE, AT_ONCE), "right")
        for part in np.split(np.arange(len(mine)), np.unique(cuts)):
            n = lens[part]
            at = np.repeat(mine[part] + 1 - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n) + np.arange(n.sum())
            peer, x, y = g[at], np.repeat(p[mine[part]], n), p[at]
            np.add.at(total, peer, np.abs(x - y) - np.abs(x - base[peer]) - np.abs(y - base[own]) + apart[peer])
        if whole:
            total[own + 1:] += (kept - held[own] - held[own + 1:]) * apart[own + 1:]
        yield own, total


def distances(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, lo, hi, value) of each two groups of a language, by number."""
    slices = F.ceil(F.col("postings") / (F.lit(SLICE) + 4 * F.col("groups"))).cast("int")
    groups = groups.withColumn("slices", F.greatest(F.lit(1), slices))
    heads = groups.select("lang", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"), F.lit(None).cast("string").alias("term"), "g", F.col("base").alias("p"), "held", "kept")
    cells = entries.join(groups.select("lang", "source", "g", "total", "kept", "slices"), ["lang", "source"])
    cells = cells.select("lang", F.expr("cast(pmod(xxhash64(term), slices) as int)").alias("slice"), "term", "g", share("n", "total", "kept").alias("p"), F.lit(0).cast("long").alias("held"), "kept")
    dealt = heads.unionByName(cells).repartition("lang", "slice").sortWithinPartitions("lang", "slice", F.col("term").asc_nulls_first(), "g")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            langs, parts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            cuts = [i for i in range(1, len(langs)) if parts[i] != parts[i - 1] or langs[i] != langs[i - 1]]
            for start, end in zip([0, *cuts], [*cuts, len(langs)]):
                piece = batch.slice(start, end - start)
                if held and (held[0].column(0)[0], held[0].column(1)[0]) != (piece.column(0)[0], piece.column(1)[0]):
                    yield from _summed(held)
                    held = []
                if len(piece):
                    held.append(piece)
        if held:
            yield from _summed(held)

    parts = dealt.mapInArrow(run, "lang string, lo int, hi int, value long")
    return parts.groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))


def _summed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The accumulators of one slice as rows; zeros are left out but in the first slice, which names every pair."""
    lines = pa.Table.from_batches(batches).combine_chunks()
    lang, whole = lines["lang"][0].as_py(), lines["slice"][0].as_py() == 0
    number = lines["term"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    g, p = lines["g"].to_numpy().astype(np.int64), lines["p"].to_numpy()
    n = int((number < 0).sum())
    number, held, kept = number[n:], lines["held"].to_numpy()[:n], int(lines["kept"][0].as_py())
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
    for own, total in accumulated(g[n:], starts, p[n:], p[:n], held, kept, whole):
        peers = np.arange(n)
        some = (peers != own) & ((total != 0) | (whole & (peers > own)))
        peers = peers[some]
        arrays = [pa.array([lang] * len(peers), pa.string()), pa.array(np.minimum(peers, own), pa.int32()), pa.array(np.maximum(peers, own), pa.int32()), pa.array(total[some])]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "lo", "hi", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every peer of a group by distance, and the terms it uses more than its language does."""
    groups, entries = tables(docs, least_docs)
    pairs = distances(groups, entries)
    pairs = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")))).alias("p"))
    pairs = pairs.select("lang", "value", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    one, two = groups.select("lang", F.col("g").alias("a"), "source"), groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"))
    pairs = pairs.join(one, ["lang", "a"]).join(two, ["lang", "b"])
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    more = entries.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    more = more.withColumn("value", share("n", "total", "kept") - share("lang_n", "lang_total", "kept")).filter("value > 0 and n > 0")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    more = more.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most_terms)
    return pairs.unionByName(more)


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (
  SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT row_no) >= 30),
langs AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.lang_n), 0) AS lang_total FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
groups AS (
  SELECT d.lang, d.source, any_value(l.v) AS v, any_value(l.lang_total) AS lang_total, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) d JOIN langs l USING (lang)
  LEFT JOIN (SELECT c.* FROM counts c JOIN kept k USING (lang, term)) c ON c.lang = d.lang AND c.source = d.source GROUP BY d.lang, d.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (g.lang_total + 5 * g.v) AS BIGINT) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, p - q, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS r
FROM shares WHERE n > 0 AND p > q QUALIFY r <= 50
"""
