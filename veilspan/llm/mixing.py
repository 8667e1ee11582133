"""Mix sources to target weights.

Every document gets a hash-random key.  The key space of each source is cut into
equal ranges, the ranges are sorted and summed on their own, and a small table of
(source, range) sums carries the running total from range to range.  A source's
budget is then cut at an exact word: whole epochs first, then the documents with
the smallest keys, the last of them in part.

Defined results: a null text has size 0; the null source is a source of its own,
last in order; rows with the same doc_id and text share one key and are cut one
after the other; an empty table gives an empty mix; other columns are kept, but
own columns named size, source_size, target or taken are replaced.
Order of magnitude: one row of the small table per 10 000 documents.  One task sorts
the sources to give them weights and levels: they are meant to be few, not hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import words_of

#: Documents of one key range, on average over all sources.
DOCS_PER_RANGE = 10_000


def targets(sums: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target words by source from (_source, _size) rows, one a source.

    ``share`` of all words is dealt out by the repeating weights; what exceeds
    ``most`` times a source's words is dealt again to the others.  The end of
    that process in closed form: a source is full if the level that fills it
    takes no more than the whole budget.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_level = Window.orderBy("_level", F.col("_source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    df = sums.withColumn("_weight", weight).withColumn("_cap", F.col("_size") * most)
    df = df.withColumn("_level", F.col("_cap") / F.col("_weight"))
    df = df.select("*", (F.sum("_size").over(every) * share).alias("_all"),
                   (F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap")
                    + F.col("_level") * F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))).alias("_needs"))
    df = df.withColumn("_full", F.col("_needs") <= F.col("_all"))
    left = F.max("_all").over(every) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(every)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least("_cap", F.col("_weight") * (left / open_weight)))
    return df.select("_source", F.col("_size").alias("_source_size"), target.alias("_target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The documents with size, source_size, target and taken: the words of each that the mix holds, repeats counted."""
    kept = _own(docs)
    ranges = max(1, -(-docs.count() // DOCS_PER_RANGE))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"),
                         F.md5(F.coalesce("text", F.lit("")))))
    # own columns travel under names that none of the columns below has
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col("source").alias("_source"), words_of(F.col("text")).alias("_size"), key.alias("_key"))
    part = F.floor(F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") / float(1 << 48) * ranges)
    rows = rows.withColumn("_range", part)
    sums = rows.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    starts = sums.select("_source", "_range", (before - F.col("_sum")).alias("_start"))
    goals = targets(sums.groupBy("_source").agg(F.sum("_sum").alias("_size")), weights, share, most)
    starts = _join(starts, goals, "_source").withColumn("_budget", F.floor(F.col("_target") + 0.5))
    running = Window.partitionBy("_source", "_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_size").over(running))
    rows = _join(rows, starts, "_source", "_range")
    epochs = F.when(F.col("_source_size") > 0, F.floor(F.col("_budget") / F.col("_source_size"))).otherwise(0)
    rest = F.col("_budget") - epochs * F.col("_source_size")
    here = F.greatest(F.lit(0), F.least(F.col("_size"), rest - (F.col("_start") + F.col("_sum") - F.col("_size"))))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                       F.col("_target").alias("target"), (epochs * F.col("_size") + here).cast("long").alias("taken"))


def _own(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() not in ("size", "source_size", "target", "taken")]


def _join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join in which null keys meet; small tables are broadcast only if Spark finds them small."""
    other = right.select(*[F.col(c).alias(f"{c}_r") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys]
    return left.join(other, on).drop(*[f"{k}_r" for k in keys])


def written(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each time a document is taken, the last one cut after its last taken word."""
    kept = _own(mixed)
    turn = "_turn" + "_" * max(map(len, mixed.columns))
    words = F.least(F.col("size"), F.col("taken") - F.col(turn) * F.col("size"))
    pieces = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.when(words == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), ""))
    turns = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).cast("int") - 1)
    rows = mixed.filter(F.col("taken") > 0).select("*", F.explode(turns).alias(turn))
    return rows.select(*[cut.alias(c) if c == "text" else F.col(f"`{c}`") for c in kept])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS level, sum(source_size) OVER () * 1.5::DOUBLE AS whole FROM weighed),
filled AS (
  SELECT *, sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap
            + level * sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= whole AS fits
  FROM levels),
goals AS (
  SELECT source, source_size,
         CASE WHEN fits THEN cap ELSE least(cap, weight * ((whole - coalesce(sum(CASE WHEN fits THEN cap END) OVER (), 0.0))
              / sum(CASE WHEN NOT fits THEN weight END) OVER ())) END AS target
  FROM filled),
ordered AS (
  SELECT s.*, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
            + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)) AS BIGINT) AS taken
FROM ordered
"""
