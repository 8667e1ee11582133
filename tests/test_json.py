"""Scrubbing and auditing of JSON bodies, known and unknown shape."""

import json
import tracemalloc

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions import fixed_values as fv
from veilspan.functions import json_walk, scrub
from veilspan.sources import payloads


def sent(spark, bodies, schema=None):
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    return [r["sent"] for r in scrub.scrub_body(df, "body", schema).collect()]


def test_unknown_shape(spark):
    body = {
        "email": "a@b.co", "author": "x", "count": 3, "phone": 9876543210,
        "list": ["call 9876543210", "plain"], "deep": {"pin": "1", "x": [{"password": "p", "t": "ABCDE1234F"}]},
    }
    out = json.loads(sent(spark, [json.dumps(body)])[0])
    assert out == {
        "email": "[REDACTED]", "author": "[REDACTED]", "count": 3, "phone": 9876543210,
        "list": ["call [REDACTED:10]", "plain"],
        "deep": {"pin": "[REDACTED]", "x": [{"password": "[REDACTED]", "t": "[REDACTED:10]"}]},
    }


def test_report_subtree_keeps_its_keys(spark):
    body = {"redaction": {"categories": {"email": "kept"}, "audit": {"phone": "9876543210"}}, "elements": [{"password": "kept"}]}
    out = json.loads(sent(spark, [json.dumps(body)])[0])
    assert out["redaction"] == {"categories": {"email": "kept"}, "audit": {"phone": "[REDACTED:10]"}}
    assert out["elements"] == [{"password": "kept"}]


def test_bodies_that_are_not_objects(spark):
    schema = T.StructType([T.StructField("a", T.StringType())])
    out = sent(spark, ["call 9876543210", '"9876543210"', '["9876543210"]', "7"], schema)
    assert out == ["call [REDACTED:10]", '"9876543210"', '["[REDACTED:10]"]', "7"]


def test_map_keys_are_judged(spark):
    schema = T.StructType([T.StructField("h", T.MapType(T.StringType(), T.StringType()))])
    out = json.loads(sent(spark, ['{"h": {"Cookie": "c", "accept": "a@b.co", "task": "9876543210"}}'], schema)[0])
    assert out["h"] == {"Cookie": "[REDACTED]", "accept": "[REDACTED:6]", "task": "[REDACTED:10]"}


def audited(spark, bodies, schema=None):
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    rows = scrub.audit_body(df, "body", schema).select(scrub.audit_verdict(F.col("leaks")).alias("v")).collect()
    return [r["v"] and ({(h["path"], h["reason"]) for h in r["v"]["leaks"] or ()}, r["v"]["ok"], r["v"]["verdict"]) for r in rows]


def test_leaks(spark):
    body = {
        "user": {"email": "a@b.co", "phone": 1}, "redaction": {"email": "x", "note": "9876543210"},
        "elements": [{"text": "ABCDE1234F"}, {"password": "p"}], "ok": "fine",
    }
    want = {
        ("user.email", "sensitive-key"), ("user.email", "pii-pattern"), ("user.phone", "sensitive-key"),
        ("redaction.note", "pii-pattern"), ("elements.0.text", "pii-pattern"), ("elements.1.password", "sensitive-key"),
    }
    _S, _L = T.StringType(), T.LongType()
    schema = payloads.struct(
        user=payloads.struct(email=_S, phone=_L), redaction=payloads.struct(email=_S, note=_S),
        elements=T.ArrayType(payloads.struct(text=_S, password=_S)), ok=_S)
    for shape in (None, schema, payloads.struct(ok=_S)):
        assert audited(spark, [json.dumps(body)], shape) == [(want, False, fv.VERDICT_LEAK)]


def test_bodies_of_many_shapes_side_by_side(spark):
    """One body's shape must not change what happens to another."""
    cases = [
        ('{"note": "call 9876543210"}', {"note": "call [REDACTED:10]"}, {("note", "pii-pattern")}),
        ('{"note": {"k": "priya@example.com"}}', {"note": {"k": "[REDACTED:17]"}}, {("note.k", "pii-pattern")}),
        ('{"note": 5}', {"note": 5}, set()),
        ("[1]", [1], set()),
        ('{"password": "hunter2", "t": "call 9876543210"}', {"password": "[REDACTED]", "t": "call [REDACTED:10]"}, {("password", "sensitive-key"), ("t", "pii-pattern")}),
        ('[{"password": "hunter2"}]', [{"password": "[REDACTED]"}], {("0.password", "sensitive-key")}),
        ('{"AVOID": "x"}', {"AVOID": "x"}, set()),
        ('{"password": null}', {"password": None}, {("password", "sensitive-key")}),
        ('{"user": {"phone": "not a number", "name": "P", "extra": [true, null, 1.5]}}',
         {"user": {"phone": "[REDACTED]", "name": "P", "extra": [True, None, 1.5]}}, {("user.phone", "sensitive-key")}),
        ('{"password": "a", "password": "b"}', {"password": "[REDACTED]"}, {("password", "sensitive-key")}),
        ('{"password": ["p", {"x": "9876543210"}]}', {"password": ["p", {"x": "[REDACTED:10]"}]}, {("password", "sensitive-key"), ("password.1.x", "pii-pattern")}),
        ('{"é \\u0022": "a\\n\\"9876543210"}', {'é "': 'a\n"[REDACTED:10]'}, {('é "', "pii-pattern")}),
    ]
    schema = payloads.struct(note=T.StringType(), user=payloads.struct(phone=T.LongType(), name=T.StringType()))
    for shape in (None, schema):
        assert [json.loads(s) for s in sent(spark, [b for b, _, _ in cases], shape)] == [w for _, w, _ in cases]
        assert [v[0] for v in audited(spark, [b for b, _, _ in cases], shape)] == [w for _, _, w in cases]


def test_what_is_not_json(spark):
    deep = "[" * 200_000 + "]" * 200_000
    assert sent(spark, ["{9876543210", "NaN", None, deep]) == ["{[REDACTED:10]", "NaN", None, '"[REDACTED]"']
    assert [v[0] for v in audited(spark, [deep])] == [{("", "too deep")}]


def test_walker_finds_what_expressions_find(spark):
    import random

    from veilspan.functions import json_walk

    rng = random.Random(13)
    pieces = ["a@b.com", "+x@d.com", " ", ".", "9876543210", "+91 98765 43210", "4111 1111 1111 1111", "1234-5678-9012", "ABCDE1234F", "123456789", "x", "é", "\n", "-", "@", "00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", scrub.scrub_text("t").alias("s"), F.expr(scrub.has_pattern_sql("t")).alias("h")).collect()
    for r in rows:
        assert json_walk.scrub_string(r.t) == r.s and json_walk.has_pattern(r.t) == r.h, r.t


def test_map_leaks(spark):
    schema = T.StructType([T.StructField("h", T.MapType(T.StringType(), T.StringType()))])
    df = spark.createDataFrame([('{"h": {"Cookie": "c", "x": "a@b.co", "audit": "9876543210"}}',)], "body string")
    rows = df.withColumn("p", F.from_json("body", schema)).select(scrub.leaks("p", schema).alias("l")).first()["l"]
    assert {(h["path"], h["reason"]) for h in rows} == {
        ("h.Cookie", "sensitive-key"), ("h.x", "pii-pattern"), ("h.audit", "pii-pattern"),
    }


def test_intake(spark):
    tag = payloads.SCHEMA_TAG
    bodies = [json.dumps({"schema": tag}), json.dumps({"schema": "x"}), "{", json.dumps({"schema": tag, "task": "t" * 100}), "{}"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    out = [r["rejected"] for r in payloads.intake(df, "body", payloads.PAYLOAD, limit=60).collect()]
    assert out == [None, "unrecognized payload schema", "invalid JSON", "too large", "unrecognized payload schema"]


def test_sinks(spark, tmp_path):
    from veilspan.operators import detect

    html = '<body><label>Email <input type="email" value="a@b.co"></label><p>call 9876543210</p></body>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    built = payloads.build(detect.page_rows(pages), ["page_id"], task="write a@b.co")
    payloads.write_payloads(built, str(tmp_path / "out"), before_send=lambda df: df.where("page_id = 1"))
    text = spark.read.text(str(tmp_path / "out")).first()[0]
    assert "a@b.co" not in text and "9876543210" not in text
    body = json.loads(text)
    assert body["redaction"]["categories"] == {"email": 2, "phone": 1}
    assert [e["piiCategory"] for e in body["elements"] if "piiCategory" in e] == ["email", "phone"]
    payloads.append_log(built, ["page_id"], str(tmp_path / "log"))
    payloads.append_log(built, ["page_id"], str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and "payload" not in log.columns
    assert log.first()["task"] == "write [REDACTED:6]"


def test_bodies_that_utf8_or_json_cannot_hold(spark):
    """Half surrogate pairs stay escaped, in paths they are replaced; numbers beyond a double become null."""
    bodies = [r'{"k":"\ud800 x"}', r'{"\ud800":"call 9876543210"}', '{"a":1e400,"b":-1e999,"c":1.5}', r'{"k":"\ud83d\ude00 a@b.co"}', '{"ok":"9876543210"}']
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string").repartition(2)
    sent = {r.i: r.sent for r in scrub.scrub_body(rows, "body").collect()}
    assert sent == {0: r'{"k":"\ud800 x"}', 1: r'{"\ud800":"call [REDACTED:10]"}', 2: '{"a":null,"b":null,"c":1.5}', 3: '{"k":"\U0001f600 [REDACTED:6]"}', 4: '{"ok":"[REDACTED:10]"}'}
    found = {r.i: [tuple(x) for x in r.leaks] for r in scrub.audit_body(rows, "body").collect()}
    assert found == {0: [], 1: [("\ufffd", "pii-pattern")], 2: [], 3: [("k", "pii-pattern")], 4: [("ok", "pii-pattern")]}


def test_few_bodies_are_python_values_at_once():
    """A batch of large bodies stays in Arrow but for one slice."""
    import pyarrow as pa

    n, size = 10 * json_walk.SLICE + 7, 20_000
    batch = pa.array([f'{{"n":{i},"t":"é{"x" * size}"}}' if i % 9 else None for i in range(n)])
    tracemalloc.start()
    out = json_walk.in_slices(batch, json_walk.scrub_one, pa.string())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == batch.to_pylist()
    assert most < 8 * json_walk.SLICE * size < n * size
    assert json_walk.in_slices(batch[:0], json_walk.leaks_of, json_walk.LEAKS).to_pylist() == []
