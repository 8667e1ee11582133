"""Agent commands and the lookups around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions import text as tx
from veilspan.functions import web

COMMANDS = "array<struct<action:string,uid:bigint,id:bigint,text:string,amount:string,direction:string,ms:string,url:string>>"


def _number(value: Column) -> Column:
    """A finite double, or null."""
    n = value.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def commands(df: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """First 8 commands of each body whose action is known, with their numbers clamped.

    ``cmd_no`` is the place in the body.  Whether a ``uid`` exists is checked
    by :func:`known_only`.
    """
    c = F.col
    parsed = F.slice(F.coalesce(F.from_json(body, COMMANDS), F.array().cast(COMMANDS)), 1, fv.MAX_COMMANDS)
    rows = (
        df.select(*keys, F.posexplode(parsed))
        .select(*keys, (c("pos") + 1).alias("cmd_no"), "col.*")
        .withColumn("action", F.lower("action"))
        .where(c("action").isin(fv.ACTIONS))
    )
    aimed = c("action").isin("click", "clear", "type")
    amount = _number(c("amount"))
    ms = _number(c("ms"))
    typed = F.left(F.coalesce("text", F.lit("")), F.lit(fv.MAX_TYPED_CHARS))
    out = rows.select(
        *keys, "cmd_no", "action",
        F.when(aimed, F.coalesce("uid", "id")).alias("uid"),
        F.when(c("action") == "type", typed).alias("text"),
        F.when(
            c("action") == "scroll",
            F.when(amount.isNull(), float(fv.DEFAULT_SCROLL)).otherwise(
                F.greatest(F.lit(-float(fv.MAX_SCROLL)), F.least(F.lit(float(fv.MAX_SCROLL)), amount))
            ),
        ).alias("amount"),
        F.when(
            c("action") == "scroll", F.when(c("direction") == "up", "up").otherwise("down")
        ).alias("direction"),
        F.when(
            c("action") == "wait",
            F.greatest(
                F.lit(0.0),
                F.least(F.lit(float(fv.MAX_WAIT_MS)), F.coalesce(F.nullif(ms, F.lit(0.0)), F.lit(float(fv.DEFAULT_WAIT_MS)))),
            ),
        ).alias("ms"),
        F.when(c("action") == "open_url", web.clipped_url(c("url"))).alias("url"),
    )
    return out.where(
        (~aimed | c("uid").isNotNull())
        & ((c("action") != "type") | (c("text") != ""))
        & ((c("action") != "open_url") | c("url").rlike("(?i)^https?://"))
    )


def known_only(cmds: DataFrame, elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops commands aimed at an element the page does not have."""
    aimed = F.col("uid").isNotNull()
    known = elements.select(*keys, F.col("uid").cast("bigint").alias("uid")).distinct()
    return cmds.where(~aimed).unionByName(cmds.where(aimed).join(known, [*keys, "uid"], "left_semi"))


def find_fields(elements: DataFrame, keys: Sequence[str], wanted: dict[str, str]) -> DataFrame:
    """The field of each wanted category per page; ``wanted`` maps category to a label pattern.

    By category, else by label; interactive ones first, then page order.  All
    lookups are conditional minima of one aggregate, with no join and no sort.
    """
    c = F.col
    control = c("role").isin("input", "textarea", "select")
    label = tx.collapse(F.coalesce("text", F.lit("")))

    def best(category: str, pattern: str) -> Column:
        tagged = c("pii_category") == category
        named = control & label.rlike("(?i)" + pattern)
        tier = (
            F.when(tagged & c("interactive"), 0).when(tagged, 1)
            .when(named & c("interactive"), 2).when(named, 3)
        )
        return F.min(F.when(tier.isNotNull(), F.struct(tier.alias("tier"), c("uid").alias("uid")))).alias(category)

    found = elements.groupBy(*keys).agg(*[best(k, p) for k, p in wanted.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("category"), c(k).alias("best")) for k in wanted])
    return found.select(*keys, F.inline(rows)).where(c("best").isNotNull()).select(
        *keys, "category", c("best.uid").alias("uid"),
        F.when(c("best.tier") <= 1, "category").otherwise("label").alias("found_by"),
    )
