"""Golden texts, traps and properties of scan, scrub and redaction."""

import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.functions import regexes as rx
from veilspan.functions import scrub, spans
from veilspan.operators import detect, evaluate, redact

GOLDEN = [
    ("Aadhaar: 1234 5678 9012", [("aadhaar", "1234 5678 9012")]),
    ("My Aadhaar is 2345-6789-0123, keep it safe", [("aadhaar", "2345-6789-0123")]),
    ("PAN number ABCDE1234F", [("pan", "ABCDE1234F")]),
    ("Call +91 98765 43210 or 9876543210", [("phone", "+91 98765 43210"), ("phone", "9876543210")]),
    ("Email me at priya.sharma@example.com", [("email", "priya.sharma@example.com")]),
    ("Card 4111 1111 1111 1111 exp 12/28 cvv 123", [("credit_card", "4111 1111 1111 1111")]),
    ("Card 1234 5678 9012 3456 (invalid luhn)", []),
    ("IFSC HDFC0001234, account 50100234567890", [("ifsc", "HDFC0001234"), ("account_number", "50100234567890")]),
    ("Account 50100234567890 is long but must NOT be aadhaar", [("account_number", "50100234567890")]),
    ("DOB 15/08/1995", [("dob", "15/08/1995")]),
    ("No sensitive data here, just prose about the weather.", []),
    ("PIN 560001 near MG Road Bengaluru", []),
    ("12345", []),
]
TRAPS = [
    ("éabc@x.com", [("email", "abc@x.com")]),
    ("+919876543210", [("aadhaar", "919876543210"), ("phone", "+919876543210")]),
    ("4111111111111112", [("account_number", "4111111111111112")]),
    ("4111111111111111", [("credit_card", "4111111111111111")]),
    ("1234567890@x.com", [("email", "1234567890@x.com")]),
    ("", []),
]


def scan_all(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in detect.hits(df, "id").orderBy("id", "hit_no").collect():
        out[r["id"]].append((r["category"], r["match"], r["start"]))
    return out


def test_golden_texts(spark):
    cases = GOLDEN + TRAPS
    found = scan_all(spark, [t for t, _ in cases])
    for i, (text, expected) in enumerate(cases):
        assert [(cat, m) for cat, m, _ in found[i]] == expected, text
        for _, match, start in found[i]:
            assert text[start:start + len(match)] == match


def test_null_text_has_no_spans(spark):
    df = spark.createDataFrame([(1, None)], "id long, text string")
    assert detect.hits(df, "id").count() == 0


def test_golden_scores_are_perfect(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "id long, text string")
    expected = spark.createDataFrame(
        [(i, cat, m) for i, (_, es) in enumerate(GOLDEN) for cat, m in es], "id long, category string, match string"
    )
    matched = evaluate.multiset_match(expected, detect.hits(df, "id"), ["id", "category", "match"])
    row = evaluate.with_scores(evaluate.totals(matched, "category")).where("category = '(all)'").first()
    assert (row["tp"], row["fp"], row["fn"]) == (11, 0, 0)
    assert row["f1"] == pytest.approx(1.0)


def test_offsets_with_many_matches(spark):
    """More matches than one block of running sums."""
    text = "".join(f"é a{i}@b.co, " for i in range(1500))
    got = scan_all(spark, [text])[0]
    assert [(m, s) for _, m, s in got] == [(m.group(), m.start()) for m in re.finditer(r"a\d+@b\.co", text)]


PIECES = st.lists(
    st.sampled_from([
        "1234", "5678", " ", "-", "+91", "98765", "43210", "a@b.co", "ABCDE1234F", "HDFC0001234", "/", "15", "1995",
        "é", "4111", "1111", "x", "_", ".", "50100234567890", "\n", "4111111111111111",
    ]),
    max_size=14,
).map("".join)


def plain_matches(pattern, text):
    return [(m.group(), m.start()) for m in re.finditer(pattern, text, re.ASCII)]


def digits_pass(value):
    ds = [int(x) for x in value if x.isdigit()][::-1]
    return 13 <= len(ds) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(ds)) % 10 == 0


def plain_scan(text):
    """The scan by hand, with Python's engine and an ASCII word boundary."""
    found = []
    for name, pattern in [
        ("aadhaar", rx.AADHAAR), ("pan", rx.PAN), ("phone", rx.PHONE), ("email", rx.EMAIL), ("credit_card", rx.CARD),
        ("ifsc", rx.IFSC), ("dob", rx.DOB),
    ]:
        found += [(name, m, s) for m, s in plain_matches(pattern, text) if name != "credit_card" or digits_pass(m)]
    others = [(s, s + len(m)) for _, m, s in found]
    return found + [
        ("account_number", m, s) for m, s in plain_matches(rx.ACCOUNT, text)
        if not any(a <= s and b >= s + len(m) for a, b in others)
    ]


def plain_scrub(text):
    for pattern in (rx.BODY_AADHAAR, rx.PAN, rx.PHONE, rx.EMAIL, rx.CARD, rx.ACCOUNT):
        text = re.sub(pattern, lambda m: f"[REDACTED:{len(m.group())}]", text, flags=re.ASCII)
    return text


@settings(max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(PIECES, min_size=400, max_size=400))
def test_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    done = (
        df.withColumn("scrubbed", scrub.scrub_text("text"))
        .withColumn("spans", spans.scan("text")).withColumn("regions", redact.regions("spans"))
        .withColumn("solid", redact.apply("text", "regions", "solid"))
        .withColumn("blur", redact.apply("text", "regions", "blur"))
    )
    for r in done.collect():
        text = r["text"]
        assert [(s["category"], s["match"], s["start"]) for s in r["spans"]] == plain_scan(text)
        assert r["scrubbed"] == plain_scrub(text)
        covered = {i for s in r["spans"] for i in range(s["start"], s["start"] + len(s["match"]))}
        ends = -1
        for a in r["regions"]:
            assert a["start"] >= ends and a["end"] > a["start"]
            ends = a["end"]
        assert covered == {i for a in r["regions"] for i in range(a["start"], a["end"])}
        assert r["solid"] == "".join("█" if i in covered else ch for i, ch in enumerate(text))
        assert len(r["blur"]) == len(text)
        assert all(r["blur"][i] == text[i] for i in range(len(text)) if i not in covered)


def test_scrub_order_and_card_first(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",)], "text string")
    row = df.select(scrub.scrub_text("text").alias("a"), scrub.scrub_text("text", card_first=True).alias("b")).first()
    assert row["a"] == "[REDACTED:14] 1111"
    assert row["b"] == "[REDACTED:19]"


def test_luhn(spark):
    values = [("4111 1111 1111 1111", True), ("4111111111111112", False), ("0" * 12, False), ("0" * 13, True), ("0" * 20, False)]
    df = spark.createDataFrame(values, "v string, ok boolean")
    assert all(r["got"] == r["ok"] for r in df.withColumn("got", spans.luhn("v")).collect())


def test_strategy(spark):
    df = spark.createDataFrame([("password",), ("otp",), ("face",), ("email",)], "category string")
    blur = [r[0] for r in df.select(redact.strategy(F.col("category"), "blur", "blur")).collect()]
    solid = [r[0] for r in df.select(redact.strategy(F.col("category"), "solid", "blur")).collect()]
    assert blur == ["solid", "solid", "blur", "blur"]
    assert solid == ["solid", "solid", "blur", "solid"]
