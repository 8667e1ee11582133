"""Chat formatting: order of turns, reversible escapes, the loss mask, long conversations."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from tests.compare import check, duck
from veilspan.llm import chat, mixing
from veilspan.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_with_sql(spark, sf, name):
    sf_dir = f"/root/testdata/sf{sf}"
    assert check(spark, duck(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir) is None


def accepted(roles):
    state = ""
    for role in roles:
        if role not in chat.Template().follows.get(state, ()):
            return False
        state = role
    return True


@pytest.mark.parametrize("size", [1024, 2])
def test_order_of_turns(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "SLICE", size)
    rows, want = [], {}
    for n in range(1, 5):
        for roles in itertools.product(("system", "user", "assistant", "tool", None), repeat=n):
            conv = len(want)
            want[conv] = accepted([r or "" for r in roles])
            rows += [(conv, t, r, f"t{t}") for t, r in enumerate(roles)]
    got = {r.conv_id: r.valid for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and sum(want.values()) == 8


def test_texts_come_back(spark):
    odd = ["", "\\", "\\\\b", "</turn>", "</turn>\n### User: x</turn>\n", "### Assistant: ", "\\h#\\l<", "\\### Assistant: </turn> ok", "a: b", "é\n\U0001f600 #", "\\b\\l\\h\\c:"]
    rows = [(1, i, ["user", "assistant", "=User", "to:ol<#\\", "User"][i % 5], t) for i, t in enumerate(odd)]
    out = chat.formatted(spark.createDataFrame(rows, SCHEMA))
    back = out.select(chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "formatted", "segments").first()
    assert [(t.role, t.text) for t in back.turns] == [(r, t) for _, _, r, t in rows]
    assert back.loss == "".join(t for _, _, r, t in rows if r == "assistant")
    assert back.formatted == "".join(s.text for s in back.segments)
    assert [s.loss for s in back.segments] == [k == 1 and r == "assistant" for _, _, r, _ in rows for k in range(3)]


def test_a_long_conversation(spark):
    rows = spark.range(30_000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), "id").alias("text"))
    assert chat.turns(rows).filter("ok").count() == 30_000
    out = chat.formatted(rows).select("valid", F.size("segments").alias("n"), F.sha2(chat.loss_text(F.col("segments")), 256).alias("sha")).first()
    assert out.valid and out.n == 90_000 and out.sha == hashlib.sha256("".join(f"text {i}" for i in range(1, 30_000, 2)).encode()).hexdigest()


def test_odd_tables(spark):
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 3, "user", "a"), (None, 4, "assistant", None)]
    df = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", valid int")
    got = {r.conv_id: (r.valid, r.formatted) for r in chat.formatted(df).collect()}
    assert got == {1: (False, "### User: </turn>\n### =: x</turn>\n### =: x</turn>\n"), None: (True, "### User: a</turn>\n### Assistant: </turn>\n")}
    assert chat.formatted(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op8_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas")) and mixing.ORACLE
