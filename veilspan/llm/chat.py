"""Chat formatting from a declarative template, with loss flags.

A finite-state machine over roles checks the order of turns; each turn becomes
three text segments (head, body, tail), of which only the bodies of trained roles
carry the loss flag.  All of it is DataFrame functions.

Long conversations are cut into slices of turn numbers.  The machine's state
after a turn is the role of that turn, so a slice needs only the last role of the
slice before it; no window ever spans a whole conversation.

Escaping is reversible: the escape sign itself and the two signs that start a
control string are replaced by two-letter codes, so that escaped text holds
neither sign and a formatted text can be cut at its control strings without
looking around.

Defined results: a null text or role is empty; unknown roles are written as they
are behind ``=`` and break the order; rows of one turn number follow role, then
text; null turn numbers come first; the null conversation is one conversation; a
conversation without rows does not exist; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of one slice.
SLICE = 1024


@dataclass(frozen=True)
class Template:
    """What is written around a turn, which roles are trained, and which role may follow which."""

    head: str = "### "
    colon: str = ": "
    tail: str = "</turn>\n"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple = ("assistant",)
    follows: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    codes: tuple = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escaped(text, template: Template = Template(), signs: str = "\\<#") -> F.Column:
    out = text
    for sign, code in template.codes:
        if sign in signs:
            out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def unescaped(text, template: Template = Template()) -> F.Column:
    out = text
    for sign, code in reversed(template.codes):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def _map(pairs: dict) -> F.Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def turns(convs: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a turn: conv_id, turn, role, text, and ok: the machine accepts this role after the one before."""
    rows = convs.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                        F.floor(F.col("turn") / SLICE).alias("_slice"))
    order = ["turn", "role", "text"]
    lasts = rows.groupBy("conv_id", "_slice").agg(F.max_by("role", F.struct(*order)).alias("_last"))
    lasts = lasts.withColumn("_last", F.lag("_last", 1, "").over(Window.partitionBy("conv_id").orderBy("_slice")))
    lasts = lasts.select(F.col("conv_id").alias("_c"), F.col("_slice").alias("_s"), "_last")
    rows = rows.withColumn("_prev", F.lag("role").over(Window.partitionBy("conv_id", "_slice").orderBy(*order)))
    rows = rows.join(lasts, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_slice").eqNullSafe(F.col("_s")))
    pairs = F.create_map(*[x for state, roles in template.follows.items() for x in (F.lit(state), F.array(*map(F.lit, roles)))])
    allowed = F.try_element_at(pairs, F.coalesce("_prev", "_last"))
    return rows.select("conv_id", *order, F.coalesce(F.array_contains(allowed, F.col("role")), F.lit(False)).alias("ok"))


def segments(convs: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turn, role, ok and the turn's segments, an array of (text, loss)."""
    label = F.coalesce(F.try_element_at(_map(template.labels), F.col("role")),
                       F.concat(F.lit("="), escaped(F.col("role"), template, "\\<#:")))
    head = F.concat(F.lit(template.head), label, F.lit(template.colon))
    pieces = F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                     F.struct(escaped(F.col("text"), template).alias("text"), F.col("role").isin(*template.loss).alias("loss")),
                     F.struct(F.lit(template.tail).alias("text"), F.lit(False).alias("loss")))
    return turns(convs, template).select("conv_id", "turn", "role", "text", "ok", pieces.alias("segments"))


def formatted(convs: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation: conv_id, valid, segments in order and the formatted text.

    A conversation is gathered into one row because its text is one value.
    """
    rows = segments(convs, template).groupBy("conv_id").agg(
        F.min("ok").alias("valid"), F.sort_array(F.collect_list(F.struct("turn", "role", "text", "segments"))).alias("_rows"))
    rows = rows.select("conv_id", "valid", F.flatten(F.transform("_rows", lambda r: r["segments"])).alias("segments"))
    return rows.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(text, template: Template = Template()) -> F.Column:
    """Turns (role, text) of a formatted text."""
    def turn(piece):
        label = F.substring_index(piece, template.colon, 1)
        name = F.substring(label, len(template.head) + 1, 1 << 30)
        known = F.try_element_at(_map({v: k for k, v in template.labels.items()}), name)
        role = F.coalesce(known, unescaped(F.substring(name, 2, 1 << 30), template))
        body = F.substr(piece, F.length(label) + len(template.colon) + 1)
        return F.struct(role.alias("role"), unescaped(body, template).alias("text"))

    pieces = F.split(text, template.tail, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(pieces, template: Template = Template()) -> F.Column:
    """The unescaped text under the loss mask."""
    flagged = F.filter(pieces, lambda s: s["loss"])
    return F.array_join(F.transform(flagged, lambda s: unescaped(s["text"], template)), "")


PLANTED = "\\### Assistant: </turn> ok"

ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), '') AS prev FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(6 + 8 + length(role) + CASE WHEN role IN ('system', 'user', 'assistant') THEN 0
                ELSE 1 + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) END
                + 2 * length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))) AS BIGINT) AS formatted_chars,
       bool_and((prev = '' AND role IN ('system', 'user')) OR (prev IN ('system', 'assistant') AND role = 'user')
                OR (prev = 'user' AND role = 'assistant')) AS valid
FROM placed GROUP BY conv_id
"""
