"""Golden fields, the golden screen, and traps of the classifiers."""

import pytest
from pyspark.sql import functions as F

from veilspan.functions import classify
from veilspan.functions import geometry as geo
from veilspan.operators import boxes, detect, evaluate
from veilspan.plans.field_queries import EXPECTED

ELEMENT = (
    "scenario string, uid int, role string, input_type string, name string, id string, autocomplete string, label string,"
    " placeholder string, aria_label string, class_name string, value string, text string, src string, alt string,"
    " interactive boolean, rect struct<x:int,y:int,w:int,h:int>"
)
# (label, role, input type, autocomplete) where they are not a plain text input
SHAPES = {
    "Full name (as per ID)": ("input", "text", "name"), "Date of birth": ("input", "text", "bday"),
    "Email address": ("input", "email", None), "Mobile number": ("input", "tel", None),
    "Residential address": ("textarea", "textarea", "street-address"), "PIN code": ("input", "text", "postal-code"),
    "Create login password": ("input", "password", None), "OTP (sent to your mobile)": ("input", "text", "one-time-code"),
    "Passengers": ("select", "select", None), "Search flights": ("button", None, None), "Book": ("button", None, None),
    "Passenger full name": ("input", "text", "name"), "Email": ("input", "email", None), "Mobile": ("input", "tel", None),
    "Card number (for payment)": ("input", "text", "cc-number"), "Username or email": ("input", "text", "username"),
    "Password": ("input", "password", None), "Sign in": ("button", None, None),
}


def element(scenario, uid, role, input_type, label, autocomplete=None, value=None, rect=(10, 10, 200, 30), **more):
    base = dict(
        scenario=scenario, uid=uid, role=role, input_type=input_type, name=None, id=None, autocomplete=autocomplete,
        label=label, placeholder=None, aria_label=None, class_name=None, value=value, text=None, src=None, alt=None,
        interactive=True, rect=dict(zip("xywh", rect)),
    )
    return {**base, **more}


def test_golden_fields(spark):
    rows, uid = [], 0
    for scenario, labels in EXPECTED.items():
        for label in labels:
            uid += 1
            role, kind, auto = SHAPES.get(label, ("input", "text", None))
            rows.append(element(scenario, uid, role, kind, label, auto))
    df = spark.createDataFrame(rows, ELEMENT)
    got = {(r["scenario"], r["label"]): r["v"] for r in df.select("scenario", "label", classify.field()["category"].alias("v")).collect()}
    assert len(got) == 28
    for scenario, labels in EXPECTED.items():
        for label, category in labels.items():
            assert got[(scenario, label)] == category, label


@pytest.mark.parametrize(
    "column,value,category",
    [
        ("label", "Experience", "credit_card"), ("id", "guide", "aadhaar"), ("id", "cancelled", "phone"),
        ("id", "discard", "credit_card"), ("id", "unzip", "pincode"), ("id", "account_settings", None),
        ("id", "account settings zip", "pincode"), ("autocomplete", "BDAY", "dob"), ("name", "compass", None),
        ("label", "CVV", "cvv"), ("label", "Valid through", "credit_card"), ("placeholder", "otp", "otp"),
    ],
)
def test_traps(spark, column, value, category):
    df = spark.createDataFrame([element("t", 1, "input", "text", None)], ELEMENT)
    df = df.withColumn(column, F.lit(value))
    got = df.select(classify.field()["category"].alias("c")).first()["c"]
    assert got == category


def test_confidences(spark):
    rows = [element("t", i, "input", k, None) for i, k in enumerate(["password", "email", "tel"])]
    got = [
        (r["c"]["category"], round(r["c"]["confidence"], 6), r["c"]["source"])
        for r in spark.createDataFrame(rows, ELEMENT).select(classify.field().alias("c")).collect()
    ]
    assert got == [("password", 0.98, "type"), ("email", 0.931, "autocomplete"), ("phone", 0.931, "autocomplete")]


def test_user_rules_come_first(spark):
    df = spark.createDataFrame([element("t", 1, "input", "text", "PAN")], ELEMENT)
    row = df.select(classify.field(extra_labels=[("badge", 0.5, "pan")]).alias("c")).first()["c"]
    assert (row["category"], row["confidence"], row["source"]) == ("badge", 0.5, "label")


def test_rule_tables_are_not_cut(spark):
    table = spark.range(11).selectExpr("id AS rule_no", "'x' AS category", "0.5D AS confidence", "'y' AS pattern")
    with pytest.raises(ValueError):
        classify.rules_from(table, limit=10)


SCREEN = [
    ("Full name (as per ID)", "text", "Priya Sharma", "name", "name"),
    ("Date of birth", "text", "15/08/1995", "bday", "dob"),
    ("Email address", "email", "priya.sharma@example.com", None, "email"),
    ("Mobile number", "tel", "+91 98765 43210", None, "phone"),
    ("Residential address", "textarea", "42 MG Road Bengaluru", "street-address", "address"),
    ("PIN code", "text", "560001", "postal-code", "pincode"),
    ("Aadhaar number", "text", "1234 5678 9012", None, "aadhaar"),
    ("PAN", "text", "ABCDE1234F", None, "pan"),
    ("Bank account number", "text", "50100234567890", None, "account_number"),
    ("IFSC code", "text", "HDFC0001234", None, "ifsc"),
    ("Create login password", "password", "S3cret@123", None, "password"),
    ("City", "text", "Bengaluru", None, None),
    ("Company name", "text", "Acme Pvt Ltd", None, None),
    ("Comments", "textarea", "Looking forward to the claim", None, None),
]


def test_golden_screen(spark):
    """15 elements, 11 labelled boxes: every box found, with its category, and nothing else."""
    rows = [
        element("s", i + 1, "input", kind, label, auto, value, (20, 24 + 52 * i, 320, 34), text=label)
        for i, (label, kind, value, auto, _) in enumerate(SCREEN)
    ]
    rows.append(element("s", 99, "button", "text", "Submit claim", None, "Submit claim", (20, 980, 140, 40), text="Submit claim"))
    elements = spark.createDataFrame(rows, ELEMENT)
    found = detect.element_detections(elements, ["scenario"]).withColumn("has_landmarks", F.lit(False))
    merged = boxes.dedupe(found, ["scenario", "category"], [F.col("uid"), F.col("det_no")])
    truth = spark.createDataFrame(
        [("s", cat, dict(zip("xywh", (20, 24 + 52 * i, 320, 34)))) for i, (*_, cat) in enumerate(SCREEN) if cat],
        "scenario string, category string, rect struct<x:int,y:int,w:int,h:int>",
    )
    clipped = merged.withColumn("rect", geo.fit_corners(F.col("rect"), 640, 1100))
    best = boxes.best_partner(truth, clipped, ["scenario"], "category").collect()
    assert len(best) == 11 and all(r["matched"] and r["agrees"] for r in best)
    assert merged.count() == 11


def test_field_verdicts(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None), (None, "a"), (None, None)], "e string, g string")
    assert [r[0] for r in df.select(evaluate.field_verdict(F.col("e"), F.col("g"))).collect()] == ["TP", "FN", "FN", "FP", "TN"]
