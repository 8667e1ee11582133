"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.plans import box_queries, field_queries, page_queries, session_queries, text_queries

MODULES = [text_queries, field_queries, page_queries, box_queries, session_queries]
_WIDE = {T.IntegerType: "long", T.ShortType: "long", T.ByteType: "long", T.FloatType: "double"}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long and fractions as double, like the SQL side."""
    wide = [(f.name, _WIDE.get(type(f.dataType))) for f in df.schema.fields]
    if not any(t for _, t in wide):
        return df
    return df.select(*[F.col(n).cast(t).alias(n) if t else F.col(n) for n, t in wide])


def _plain(fn: Callable) -> Callable:
    def run(spark, sf_dir):
        return plain(fn(spark, sf_dir))
    return run


def queries() -> dict[str, Callable]:
    return {name: _plain(fn) for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
