"""Score detections against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv


def multiset_match(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True and false positives and misses per distinct key.

    The k-th copy of an expected hit matches the k-th copy found, so the
    copies only need to be counted: both sides are combined before the shuffle
    and nothing is numbered inside a group.
    """
    e = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_expected"))
    f = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_found"))
    n_e, n_f = F.coalesce("n_expected", F.lit(0)), F.coalesce("n_found", F.lit(0))
    return e.join(f, list(keys), "full_outer").select(
        *keys,
        n_e.alias("n_expected"), n_f.alias("n_found"),
        F.least(n_e, n_f).alias("tp"),
        F.greatest(n_f - n_e, F.lit(0)).cast("long").alias("fp"),
        F.greatest(n_e - n_f, F.lit(0)).cast("long").alias("fn"),
    )


def totals(matched: DataFrame, by: str) -> DataFrame:
    """Counts per category, and over all (``by`` is ``(all)``)."""
    return (
        matched.rollup(by)
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.grouping(by).alias("_all"))
        .select(F.when(F.col("_all") == 1, "(all)").otherwise(F.col(by)).alias(by), "tp", "fp", "fn")
    )


def precision(tp: Column, fp: Column) -> Column:
    return tp / (tp + fp + F.lit(fv.EPSILON))


def recall(tp: Column, fn: Column) -> Column:
    return tp / (tp + fn + F.lit(fv.EPSILON))


def f1(p: Column, r: Column) -> Column:
    return F.lit(2.0) * p * r / (p + r + F.lit(fv.EPSILON))


def with_scores(counts: DataFrame) -> DataFrame:
    scored = counts.withColumn("precision", precision(F.col("tp"), F.col("fp"))).withColumn(
        "recall", recall(F.col("tp"), F.col("fn"))
    )
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def exactness(matched: DataFrame, doc: str) -> DataFrame:
    """A text is exact when as many hits are found as expected and every one is known."""
    return matched.groupBy(doc).agg(
        F.sum("n_expected").alias("expected"), F.sum("n_found").alias("found"),
        (
            (F.sum("n_expected") == F.sum("n_found"))
            & F.min((F.col("n_found") == 0) | (F.col("n_expected") > 0))
        ).alias("ok"),
    )


def field_verdict(expected: Column, got: Column) -> Column:
    """TP, FN, FP or TN of one classified field."""
    return (
        F.when(expected.isNotNull() & (got == expected), "TP")
        .when(expected.isNotNull(), "FN")
        .when(got.isNotNull(), "FP")
        .otherwise("TN")
    )


def under_target(value: Column, target: float) -> Column:
    """1 at zero, 0 at the target and beyond."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - value / F.lit(float(target))))


def composite(scores: dict[str, Column]) -> Column:
    """Weighted sum of metric scores; a missing metric counts as 0."""
    total = F.lit(0.0)
    for name, weight in fv.METRIC_WEIGHTS.items():
        total = total + F.coalesce(scores.get(name, F.lit(None)), F.lit(0.0)) * F.lit(weight)
    return total
