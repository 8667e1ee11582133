"""Input tables derived from the given ones.

The corpus has little of some categories and its pages have no forms, so values
are planted by row number.  Each expression is plain SQL that Spark and DuckDB
read alike; the same text builds both sides of a check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspan.sources.tables import spread, table, text_table


def pick(index: str, values: list[str | None]) -> str:
    """The ``index``-th of some strings, as a CASE expression."""
    cases = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values)
    )
    return f"(CASE CAST(({index}) % {len(values)} AS INT) {cases} END)"


def _four(key: str) -> str:
    return f"lpad(CAST({key} % 10000 AS STRING), 4, '0')"


# --- documents with one planted sentence -------------------------------------------------

_D4 = _four("doc_id")
_DAY = "lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')"
_YEAR = "CAST(1950 + doc_id % 60 AS STRING)"

# (sentence before, category, match, between, second category, second match, after)
PLANTS = [
    ("'Aadhaar: '", "aadhaar", f"'2345 ' || {_D4} || ' 9012'", "''", None, "''", "''"),
    ("'My Aadhaar is '", "aadhaar", f"'2345-' || {_D4} || '-0123'", "''", None, "''", "', keep it safe'"),
    ("'PAN number '", "pan", f"'ABCDE' || {_D4} || 'F'", "''", None, "''", "'.'"),
    ("'Call '", "phone", f"'+91 98765 4' || {_D4}", "' or '", "phone", f"'987654' || {_D4}", "''"),
    ("'Email me at '", "email", f"'user' || {_D4} || '@example.com'", "''", None, "''", "', please'"),
    ("'Card '", "credit_card", f"'4111 1111 ' || {_D4} || ' 1111'", "''", None, "''", "' exp 12/28 cvv 123'"),
    ("'IFSC '", "ifsc", f"'HDFC000' || {_D4}", "', account '", "account_number", f"'5010023456' || {_D4}", "''"),
    ("'DOB '", "dob", f"{_DAY} || '/08/' || {_YEAR}", "''", None, "''", "' at noon'"),
    ("'reach '", "phone", f"'+91987654' || {_D4}", "''", None, "''", "''"),
    ("'write é'", "email", f"'abc' || {_D4} || '@x.com'", "''", None, "''", "' today'"),
    ("'ref '", "account_number", f"'411111111111' || {_D4}", "''", None, "''", "''"),
    ("'born '", "dob", f"{_DAY} || '-11-' || {_YEAR}", "' id '", "pan", f"'QWERT' || {_D4} || 'Z'", "''"),
    ("'code '", None, f"{_D4}", "''", None, "''", "' expires soon'"),
]


def _by_plant(parts: list[str | None], wrap: bool = False) -> str:
    def literal(p):
        return "NULL" if p is None else ("'" + p + "'" if wrap else p)
    cases = " ".join(f"WHEN {i} THEN {literal(p)}" for i, p in enumerate(parts))
    return f"(CASE CAST(doc_id % {len(PLANTS)} AS INT) {cases} END)"


LEAD = _by_plant([p[0] for p in PLANTS])
CATEGORY_1 = _by_plant([p[1] for p in PLANTS], wrap=True)
MATCH_1 = _by_plant([p[2] for p in PLANTS])
BETWEEN = _by_plant([p[3] for p in PLANTS])
CATEGORY_2 = _by_plant([p[4] for p in PLANTS], wrap=True)
MATCH_2 = _by_plant([p[5] for p in PLANTS])
AFTER = _by_plant([p[6] for p in PLANTS])

PLANTED = [
    "doc_id",
    f"text || ' ' || {LEAD} || {MATCH_1} || {BETWEEN} || {MATCH_2} || {AFTER} AS text",
    f"CAST({CATEGORY_1} AS STRING) AS category_1",
    f"{MATCH_1} AS match_1",
    f"CAST(length(text || ' ' || {LEAD}) AS INT) AS start_1",
    f"CAST({CATEGORY_2} AS STRING) AS category_2",
    f"{MATCH_2} AS match_2",
]


def planted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one sentence that holds known values."""
    return text_table(spark, sf_dir, "documents", "doc_id", "text").selectExpr(*PLANTED)


def planted_labels(docs: DataFrame) -> DataFrame:
    """What was planted: (doc_id, category, match)."""
    return docs.selectExpr(
        "doc_id",
        "inline(array(named_struct('category', category_1, 'match', match_1),"
        " named_struct('category', category_2, 'match', match_2)))",
    ).where("category IS NOT NULL")


# --- form fields from customers --------------------------------------------------------------

# The labels that form fixtures carry, with a few traps added.
FIELD_LABELS = [
    "Full name (as per ID)", "Date of birth", "Email address", "Mobile number", "Residential address",
    "PIN code", "Aadhaar number", "PAN", "Bank account number", "IFSC code", "Create login password",
    "OTP (sent to your mobile)", "City", "Company name", "Comments", "From", "To", "Travel date",
    "Passengers", "Search flights", "Book", "Passenger full name", "Card number (for payment)",
    "Username or email", "Sign in", "Experience", "Valid through", "CVV", None, "", "é Aadhaar é",
]
FIELD_TYPES = ["text", "text", "text", "email", "tel", "password", "textarea", None, "text", "select", "text"]
FIELD_AUTOCOMPLETE = [
    None, "", "off", "name", "bday", "street-address", "postal-code", "one-time-code", "cc-number", "cc-csc",
    "USERNAME", "current-password", None,
]
FIELD_IDENTIFIERS = [
    None, "guide", "cancelled", "discard", "unzip", "account_settings", "acct_no", "user_id", "phone_no", "",
    "cardno", "company-pan", "pass", "compass", "mailid", "birth_date", "ifs_code", "home addr", "city",
    "otp_code", "account admin zip",
]
FIELD_PLACEHOLDERS = [None, "", "Enter 6 digit code", "e-mail", "Your answer", "secret", "street"]

FIELDS = [
    "c_custkey AS field_id",
    pick("c_custkey", ["banking", "flight", "login"]) + " AS scenario",
    pick("c_custkey", FIELD_LABELS) + " AS label",
    pick("c_custkey * 13 + c_nationkey * 3", FIELD_TYPES) + " AS input_type",
    pick("c_custkey * 7 + c_nationkey", FIELD_AUTOCOMPLETE) + " AS autocomplete",
    pick("c_custkey * 3 + c_nationkey", FIELD_IDENTIFIERS) + " AS name",
    pick("c_custkey * 5", FIELD_IDENTIFIERS) + " AS id",
    pick("c_custkey + c_nationkey * 11", FIELD_IDENTIFIERS) + " AS class_name",
    pick("c_custkey * 2 + c_nationkey", FIELD_PLACEHOLDERS) + " AS placeholder",
    pick("c_nationkey", [None, "phone", "", "Customer name", None]) + " AS aria_label",
    pick("c_custkey", ["input", "input", "select", "textarea", "button"]) + " AS role",
    "c_name AS value",
]


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form field per customer; labels, types and identifiers vary independently."""
    return spread(table(spark, sf_dir, "customer")).selectExpr(*FIELDS)


# --- images from parts ---------------------------------------------------------------------

IMAGES = [
    "p_partkey AS image_id",
    "'/img/' || replace(p_name, ' ', '_') || " + pick("p_partkey", [".jpg", "_photo.jpg", "_kyc.png", "_scan.svg", "_id-card.png"]) + " AS src",
    pick("p_partkey * 3 + p_size", [None, "", "Profile picture", "Aadhaar front", "company logo", "pan", "panorama", "selfie"]) + " AS alt",
    pick("p_size", ["avatar", None, "hero wide", "thumb", "document-view"]) + " AS class_name",
    pick("p_partkey + p_size", [None, "", "main", "voter", "bill"]) + " AS id",
]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*IMAGES)


# --- pages with a form -------------------------------------------------------------------------

_P = "CAST(page_id AS STRING)"
_P4 = _four("page_id")

# A form with the labels of the fixtures, one control a line.
FORM = " || ".join([
    "'<form id=\"f' || " + _P + " || '\">'",
    "'<label>Full name (as per ID) <input type=\"text\" name=\"full_name\" autocomplete=\"name\" value=\"Priya ' || " + _P + " || '\"></label>'",
    "'<label for=\"ph' || " + _P + " || '\">Mobile &amp; home</label><input type=\"tel\" id=\"ph' || " + _P + " || '\" class=\"wide field\" value=\"+91 98765 4' || " + _P4 + " || '\">'",
    "'<input type=''email'' placeholder=''Email address'' value=''user' || " + _P4 + " || '@example.com''>'",
    "'<input type=\"password\" name=\"pwd\" value=\"2345 6789 ' || " + _P4 + " || '\">'",
    "'<textarea name=\"addr\" autocomplete=\"street-address\">42 MG Road ' || " + _P4 + " || '</textarea>'",
    "'<select name=\"plan\" aria-label=\"Plan\"><option>Gold</option><option selected>Silver</option></select>'",
    "'<input title=\"Aadhaar number\" value=\"2345 ' || " + _P4 + " || ' 9012\">'",
    "'<input type=\"text\" name=\"account_no\" style=\"display: none\" value=\"5010023456' || " + _P4 + " || '\">'",
    "'<input type=\"text\" name=\"' || " + pick("page_id", ["account_settings", "acct_no", "city", "discard", "otp_code"]) + " || '\" value=\"5010023456' || " + _P4 + " || '\">'",
    "'<img src=\"/img/profile_' || " + _P + " || '.jpg\" alt=\"Profile photo\" class=\"avatar\"><img src=\"/scan/passport.png\"><img src=\"/logo.png\" alt=\"\">'",
    "'<button class=\"btn primary\">Submit claim</button><a href=\"\">x</a><a name=\"top\">no target</a><a href=\"/empty\"></a>'",
    "'<div style=\"visibility:hidden\">hidden 9876543210</div><span hidden>secret</span><div></div><span></span>'",
    "'<table><tr><td>Account 5010023456' || " + _P4 + " || '</td><td></td></tr></table><span>DOB 15/08/1995</span>'",
    "'<input placeholder=\"a > b\" title=\"x <b> y\" value=\"98765 4' || " + _P4 + " || '\"><input type=\"hidden\" value=\"98765 4' || " + _P4 + " || '\">'",
    "'<p class=\"nav hidden md:block\" title=\"a hidden thing\">Call 98765 4' || " + _P4 + " || '</p><p id=x hidden=\"\">98765 4' || " + _P4 + " || '</p>'",
    "'<label>' || repeat('Very long label ', 8) || '<input name=\"l\" title=\"not used\" class=\"' || repeat('wide ', 20) || '\"></label>'",
    "'<input aria-label=\"' || repeat('Spoken label ', 9) || '\" title=\"not used\"><textarea title=\"Only a title\"></textarea>'",
    "'<img src=\"/' || repeat('deep/', 40) || 'x.png\" alt=\"\" class=\"' || repeat('pic ', 30) || '\"><div class=\"' || repeat('box ', 20) || '\">x</div>'",
    "'<p>Call <b>me</b> on <i>98765</i> 4' || " + _P4 + " || ' or <a href=\"/c\"><i></i>mail <b>user' || " + _P4 + " || '</b>@example.com</a> today</p><button><span>Send</span> it</button>'",
    "'<label><b>Aadhaar</b> number <input name=\"w\"></label><label for=\"q' || " + _P + " || '\"><span>PAN</span> code</label><input id=\"q' || " + _P + " || '\">'",
    "'<p>' || repeat('far behind ', 20) || '98765 4' || " + _P4 + " || '</p>'",
    "'<p>Card 4111 1111 ' || " + _P4 + " || ' 1111</p><p>' || " + pick("page_id", ["Claim submitted", "Thank you", "Please wait", "Order 12"]) + " || '</p></form>'",
])

FORM_PAGES = ["page_id", "url", f"replace(html, '</body>', {FORM} || '</body>') AS html"]


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a form in front of its end."""
    return text_table(spark, sf_dir, "pages").selectExpr(*FORM_PAGES)


# --- boxes from order lines -----------------------------------------------------------------------

# Ten consecutive orders make an image of about forty boxes.
_BOX_KEYS = [
    "l_orderkey - l_orderkey % 10 AS img", "l_linenumber AS box_no",
    "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice",
]
_RECT = {
    "x": "CAST(l_partkey % 400 AS INT)", "y": "CAST(l_suppkey % 300 AS INT)",
    "w": "20 + CAST(l_quantity AS INT)", "h": "20 + CAST(l_quantity AS INT) % 17",
}
# A second box near the first, as a model would predict it.
_NEAR = {
    "x": f"{_RECT['x']} + CAST(l_suppkey % 9 AS INT) - 4", "y": f"{_RECT['y']} + CAST(l_partkey % 7 AS INT) - 3",
    "w": f"{_RECT['w']} + CAST(l_partkey % 5 AS INT)", "h": f"{_RECT['h']} + CAST(l_suppkey % 5 AS INT)",
}
_KINDS = ["email", "phone", "name", "face"]
_SOURCE = pick("l_suppkey", ["text", "label", "face-model", "hint"]) + " AS source"
_NEAR_KIND = pick("l_partkey + l_linenumber + (CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END)", _KINDS)

BOXES = [
    *_BOX_KEYS, *[f"{v} AS {k}" for k, v in _RECT.items()], "1 - l_discount AS score",
    pick("l_partkey + l_linenumber", _KINDS) + " AS category", _SOURCE,
]
PREDICTED = [
    *_BOX_KEYS, *[f"{v} AS {k}" for k, v in _NEAR.items()], "1 - l_tax AS score",
    _NEAR_KIND + " AS category", _SOURCE,
]
# Box and prediction of one order line side by side.
PAIRS = [*BOXES, *[f"{v} AS p{k}" for k, v in _NEAR.items()]]
BOX_ORDER = ["box_no", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]


def _rect(prefix: str, name: str) -> str:
    parts = ", ".join(f"'{k}', {prefix}{k}" for k in "xywh")
    return f"named_struct({parts}) AS {name}"


def boxes(spark: SparkSession, sf_dir: str, exprs: list[str] = BOXES) -> DataFrame:
    """One box per order line."""
    flat = table(spark, sf_dir, "lineitem").selectExpr(*exprs)
    rest = [c for c in flat.columns if c not in ("x", "y", "w", "h")]
    return flat.selectExpr(*rest, _rect("", "rect"))


def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir, PREDICTED)


def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``a``, the box of an order line, and ``b``, the prediction near it."""
    flat = table(spark, sf_dir, "lineitem").selectExpr(*PAIRS)
    return flat.selectExpr(*BOX_ORDER, "img", "score", "category", "source", _rect("", "a"), _rect("p", "b"))


# --- agent events ------------------------------------------------------------------------------------

STATE_EVENTS = "(CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'ready' WHEN 'click' THEN 'pause' WHEN 'purchase' THEN 'stop' ELSE 'fail' END)"
STEPS = ["event_id", "ts", "user_id AS session", f"{STATE_EVENTS} AS event", "value AS ms", "event_type", "props"]


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent steps: the user is the session, the value its latency."""
    return table(spark, sf_dir, "events").selectExpr(*STEPS)
