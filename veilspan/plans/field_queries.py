"""Queries over form fields, images, identifiers and column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions import classify, scrub, web
from veilspan.functions import fixed_values as fv
from veilspan.functions import text as tx
from veilspan.operators import evaluate
from veilspan.plans import derived, duck
from veilspan.sources.tables import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

c = F.col
FIELDS_SQL = f"fields AS (SELECT {', '.join(derived.FIELDS)} FROM customer)"
IMAGES_SQL = f"images AS (SELECT {', '.join(derived.IMAGES)} FROM part)"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# --- SQL of the classifier ---------------------------------------------------------------

def _joined(separator: str, *columns: str) -> str:
    return f"nullif(concat_ws('{separator}', " + ", ".join(f"nullif({x}, '')" for x in columns) + "), '')"


_HAY = _joined(" | ", "label", "placeholder", "aria_label")
_IDENT = _joined(" ", "name", "id", "class_name")
_GUARD = {"account_number": fv.ACCOUNT_HINT_GUARD}
_AUTO = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.AUTOCOMPLETE.items())
_EMAIL_TEL = 0.95 * 0.98

TYPE_CATEGORY = "CASE input_type WHEN 'password' THEN 'password' WHEN 'email' THEN 'email' WHEN 'tel' THEN 'phone' END"
TYPE_CONFIDENCE = (
    f"CASE input_type WHEN 'password' THEN {duck.number(0.98)} WHEN 'email' THEN {duck.number(_EMAIL_TEL)} "
    f"WHEN 'tel' THEN {duck.number(_EMAIL_TEL)} END"
)
TYPE_SOURCE = "CASE input_type WHEN 'password' THEN 'type' WHEN 'email' THEN 'autocomplete' WHEN 'tel' THEN 'autocomplete' END"
AUTO_CATEGORY = f"CASE lower(autocomplete) {_AUTO} END"


def verdict_sql(what: str) -> str:
    """Category, confidence or source of the whole field classifier."""
    label = duck.rule_case(_HAY, fv.LABEL_RULES, "category" if what == "source" else what)
    hint = duck.rule_case(_IDENT, fv.HINT_RULES, "category" if what == "source" else what, _GUARD)
    if what == "category":
        return f"coalesce({TYPE_CATEGORY}, {AUTO_CATEGORY}, {label}, {hint})"
    if what == "confidence":
        auto = f"CASE WHEN ({AUTO_CATEGORY}) IS NOT NULL THEN {duck.number(0.95)} END"
        return f"coalesce({TYPE_CONFIDENCE}, {auto}, {label}, {hint})"
    return (
        f"coalesce({TYPE_SOURCE}, CASE WHEN ({AUTO_CATEGORY}) IS NOT NULL THEN 'autocomplete' END, "
        f"CASE WHEN {label} IS NOT NULL THEN 'label' END, CASE WHEN {hint} IS NOT NULL THEN 'hint' END)"
    )


def image_sql(what: str) -> str:
    hay = _joined(" ", "src", "alt", "class_name", "id")
    return duck.rule_case(hay, fv.IMAGE_RULES, what)


def _spread_verdict(df: DataFrame, key: str, verdict) -> DataFrame:
    return df.select(key, verdict.alias("v")).select(key, "v.category", "v.confidence", "v.source")


_FULL = f"SELECT field_id, {verdict_sql('category')} AS category, {verdict_sql('confidence')} AS confidence, {verdict_sql('source')} AS source FROM fields"


@query("classify_fields", f"WITH {FIELDS_SQL} {_FULL}")
def classify_fields(spark, d):
    return _spread_verdict(derived.fields(spark, d), "field_id", classify.field())


@query(
    "classify_by_type",
    f"WITH {FIELDS_SQL} SELECT field_id, {TYPE_CATEGORY} AS category, {TYPE_CONFIDENCE} AS confidence, {TYPE_SOURCE} AS source FROM fields",
)
def classify_by_type(spark, d):
    return _spread_verdict(derived.fields(spark, d), "field_id", classify.by_type())


@query(
    "classify_by_autocomplete",
    f"WITH {FIELDS_SQL}, a AS (SELECT field_id, {AUTO_CATEGORY} AS category FROM fields) SELECT field_id, category, "
    "CASE WHEN category IS NOT NULL THEN CAST(0.95 AS DOUBLE) END AS confidence, "
    "CASE WHEN category IS NOT NULL THEN 'autocomplete' END AS source FROM a",
)
def classify_by_autocomplete(spark, d):
    return _spread_verdict(derived.fields(spark, d), "field_id", classify.by_autocomplete())


_L = duck.rule_case(_HAY, fv.LABEL_RULES, "category")
_H = duck.rule_case(_IDENT, fv.HINT_RULES, "category", _GUARD)


@query(
    "classify_by_label",
    f"WITH {FIELDS_SQL} SELECT field_id, {_L} AS category, {duck.rule_case(_HAY, fv.LABEL_RULES, 'confidence')} AS confidence, "
    f"CASE WHEN {_L} IS NOT NULL THEN 'label' END AS source FROM fields",
)
def classify_by_label(spark, d):
    return _spread_verdict(
        derived.fields(spark, d), "field_id", classify.by_label()
    )


@query(
    "classify_by_hint",
    f"WITH {FIELDS_SQL} SELECT field_id, {_H} AS category, {duck.rule_case(_IDENT, fv.HINT_RULES, 'confidence', _GUARD)} AS confidence, "
    f"CASE WHEN {_H} IS NOT NULL THEN 'hint' END AS source FROM fields",
)
def classify_by_hint(spark, d):
    return _spread_verdict(
        derived.fields(spark, d), "field_id", classify.by_hint()
    )


@query(
    "classify_images",
    f"WITH {IMAGES_SQL} SELECT image_id, {image_sql('category')} AS category, {image_sql('confidence')} AS confidence, "
    f"CASE WHEN {image_sql('category')} IS NOT NULL THEN 'image' END AS source FROM images",
)
def classify_images(spark, d):
    return _spread_verdict(derived.images(spark, d), "image_id", classify.image())


_USER_RULES = [("travel", 0.5, "(travel|from|passenger)"), ("company", 0.4, "company")]


@query(
    "classify_with_user_rules",
    f"WITH {FIELDS_SQL} SELECT field_id, {duck.rule_case(_HAY, [*_USER_RULES, *fv.LABEL_RULES], 'category')} AS category, "
    f"{duck.rule_case(_HAY, [*_USER_RULES, *fv.LABEL_RULES], 'confidence')} AS confidence FROM fields",
)
def classify_with_user_rules(spark, d):
    rules = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(_USER_RULES)], "rule_no int, category string, confidence double, pattern string"
    )
    verdict = classify.by_label(classify.rules_from(rules))
    return _spread_verdict(derived.fields(spark, d), "field_id", verdict).drop("source")


# --- column names of the tables, with the number of values each exposes ------------------------

COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def column_values(spark, d) -> DataFrame:
    """(table_name, column_name, n_values): one aggregate per table, turned into rows."""
    out = None
    for name in COLUMNS:
        df = table(spark, d, name)
        counted = df.agg(*[F.count(x).alias(x) for x in df.columns])
        rows = counted.select(
            F.lit(name).alias("table_name"),
            F.explode(F.create_map(*[y for x in df.columns for y in (F.lit(x), c(x))])).alias("column_name", "n_values"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_VALUES_SQL = "col_values AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{x}' AS column_name, count({x}) AS n_values FROM {t}"
    for t, cols in COLUMNS.items() for x in cols
) + ")"
_NAME_RULES = duck.rule_case("column_name", fv.HINT_RULES, "category", _GUARD)


@query(
    "classify_columns",
    f"WITH {_VALUES_SQL} SELECT table_name, column_name, n_values, {_NAME_RULES} AS category, "
    f"{duck.rule_case('column_name', fv.HINT_RULES, 'confidence', _GUARD)} AS confidence FROM col_values",
)
def classify_columns(spark, d):
    return column_values(spark, d).withColumn("v", classify.by_name("column_name")).select(
        "table_name", "column_name", "n_values", "v.category", "v.confidence"
    )


@query(
    "sensitive_columns",
    f"WITH {_VALUES_SQL} SELECT table_name, column_name, n_values, {duck.sensitive_key('column_name')} AS sensitive FROM col_values",
)
def sensitive_columns(spark, d):
    return column_values(spark, d).withColumn("sensitive", scrub.key_is_sensitive(c("column_name")))


_KEYS = [*fv.SCRUB_META_KEYS, "author", "passwd", "cvc", "csv", "pan", "panel", "bankName", "Licence-No", "e-mail", "userPin", "pinned"]


@query(
    "sensitive_keys",
    f"WITH {FIELDS_SQL} SELECT field_id, coalesce(name, '') AS key, {duck.sensitive_key(chr(39) * 2 + ' || coalesce(name, ' + chr(39) * 2 + ')')} AS sensitive, "
    f"{duck.sensitive_key('coalesce(label, ' + chr(39) * 2 + ')')} AS label_sensitive FROM fields",
)
def sensitive_keys(spark, d):
    key = F.coalesce("name", F.lit(""))
    return derived.fields(spark, d).select(
        "field_id", key.alias("key"), scrub.key_is_sensitive(key).alias("sensitive"),
        scrub.key_is_sensitive(F.coalesce("label", F.lit(""))).alias("label_sensitive"),
    )


@query(
    "meta_keys",
    f"WITH k AS (SELECT o_orderkey, {derived.pick('o_orderkey', _KEYS)} AS key FROM orders) SELECT key, count(*) AS n, "
    f"bool_or(key IN ({duck.quoted(fv.SCRUB_META_KEYS)})) AS scrub_meta, bool_or(key IN ({duck.quoted(fv.AUDIT_META_KEYS)})) AS audit_meta, "
    f"bool_or({duck.sensitive_key('key')} AND key NOT IN ({duck.quoted(fv.SCRUB_META_KEYS)})) AS hidden FROM k GROUP BY 1",
)
def meta_keys(spark, d):
    keys = table(spark, d, "orders").selectExpr(f"{derived.pick('o_orderkey', _KEYS)} AS key")
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    meta = c("key").isin(fv.SCRUB_META_KEYS)
    return counted.select(
        "key", "n", meta.alias("scrub_meta"), c("key").isin(fv.AUDIT_META_KEYS).alias("audit_meta"),
        (scrub.key_is_sensitive(c("key")) & ~meta).alias("hidden"),
    )


_HEADER_NAMES = ["Authorization", "Content-Type", "X-Session-Id", "Accept", "X-Trace"]


@query(
    "scrub_headers",
    f"""WITH {FIELDS_SQL}, h AS (
SELECT field_id, 'Authorization' AS header, 'Bearer ' || value AS v FROM fields
UNION ALL SELECT field_id, 'Content-Type', 'application/json' FROM fields
UNION ALL SELECT field_id, 'X-' || coalesce(name, 'none'), value FROM fields
UNION ALL SELECT field_id, 'Accept', scenario FROM fields)
SELECT field_id, header, CASE WHEN {duck.sensitive_key('header')} THEN '[REDACTED]' ELSE v END AS sent FROM h""",
)
def scrub_headers(spark, d):
    headers = F.create_map(
        F.lit("Authorization"), F.concat(F.lit("Bearer "), c("value")),
        F.lit("Content-Type"), F.lit("application/json"),
        F.concat(F.lit("X-"), F.coalesce("name", F.lit("none"))), c("value"),
        F.lit("Accept"), c("scenario"),
    )
    sent = derived.fields(spark, d).select("field_id", scrub.scrub_headers(headers).alias("h"))
    return sent.select("field_id", F.explode("h").alias("header", "sent"))


# --- fallbacks, truncation, options -------------------------------------------------------------

@query(
    "scan_source",
    f"WITH {FIELDS_SQL} SELECT field_id, CASE WHEN input_type = 'password' THEN NULL WHEN coalesce(value, '') <> '' AND field_id % 4 <> 0 THEN value "
    "WHEN length(label) < 300 THEN nullif(label, '') END AS scanned FROM fields",
)
def scan_source(spark, d):
    value = F.when(c("field_id") % 4 != 0, c("value"))
    rows = derived.fields(spark, d).withColumn("value", value).withColumn("text", c("label"))
    return rows.select("field_id", F.expr(tx.scan_source_sql()).alias("scanned"))


@query(
    "tokens",
    "SELECT p_partkey, unnest(list_filter(string_split(trim(regexp_replace(lower(p_name || ' / ' || p_type || '-' || p_brand), '[^a-z0-9]+', ' ', 'g')), ' '), "
    "lambda w: w <> '')) AS token FROM part",
)
def tokens(spark, d):
    words = tx.tokens(F.concat(c("p_name"), F.lit(" / "), c("p_type"), F.lit("-"), c("p_brand")))
    return table(spark, d, "part").select("p_partkey", F.explode(words).alias("token"))


_COLOR = (
    "CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'transparent' WHEN 1 THEN '' WHEN 2 THEN "
    "'rgba(' || CAST(p_partkey % 256 AS STRING) || ', ' || CAST(p_size * 5 AS STRING) || ',  ' || CAST(p_partkey % 97 AS STRING) || ', 0.5)' "
    "ELSE 'rgb(' || CAST(p_partkey * 7 % 256 AS STRING) || ',' || CAST(p_size * 5 AS STRING) || ',' || CAST(p_partkey % 256 AS STRING) || ')' END"
)
_RGB = r"rgba?\((\d+),\s*(\d+),\s*(\d+)"


@query(
    "color_luma",
    f"WITH k AS (SELECT p_partkey, {_COLOR} AS color FROM part), l AS (SELECT p_partkey, color, CASE WHEN regexp_matches(color, '{_RGB}') THEN "
    f"(CAST(0.299 AS DOUBLE) * CAST(regexp_extract(color, '{_RGB}', 1) AS DOUBLE) + CAST(0.587 AS DOUBLE) * CAST(regexp_extract(color, '{_RGB}', 2) AS DOUBLE) "
    f"+ CAST(0.114 AS DOUBLE) * CAST(regexp_extract(color, '{_RGB}', 3) AS DOUBLE)) / 255 END AS luma FROM k) "
    f"SELECT p_partkey, {duck.rounded('luma')} AS luma, CASE WHEN luma > 0.6 THEN '#1e293b' WHEN luma IS NOT NULL THEN '#ffffff' ELSE '#1e293b' END AS text_color FROM l",
)
def color_luma(spark, d):
    colors = table(spark, d, "part").selectExpr("p_partkey", f"{_COLOR} AS color")
    return colors.select("p_partkey", F.round(tx.luma(c("color")), 9).alias("luma"), tx.readable_on(c("color")).alias("text_color"))


_OPTIONS = {"strategy": "blur", "face_strategy": "blur", "color": "#000000"}


@query(
    "options_merge",
    f"WITH {FIELDS_SQL} SELECT field_id, coalesce(CASE WHEN field_id % 3 = 0 THEN 'solid' END, 'blur') AS strategy, "
    "coalesce(CASE WHEN field_id % 4 = 1 THEN 'solid' END, 'blur') AS face_strategy, "
    "coalesce(CASE WHEN field_id % 3 = 0 THEN '#' || right('000000' || CAST(field_id AS STRING), 6) END, '#000000') AS color FROM fields",
)
def options_merge(spark, d):
    """Defaults overridden by what a run sets; an option that is not set keeps its default."""
    fields = derived.fields(spark, d)
    given = F.struct(
        F.when(c("field_id") % 3 == 0, "solid").alias("strategy"),
        F.when(c("field_id") % 4 == 1, "solid").alias("face_strategy"),
        F.when(c("field_id") % 3 == 0, F.concat(F.lit("#"), F.lpad(c("field_id").cast("string"), 6, "0"))).alias("color"),
    )
    return fields.select("field_id", given.alias("o")).select(
        "field_id", *[F.coalesce(c(f"o.{k}"), F.lit(v)).alias(k) for k, v in _OPTIONS.items()]
    )


# --- URLs --------------------------------------------------------------------------------------------

_PATH = "regexp_extract(regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', ''), '^[a-zA-Z]+://[^/]*(.*)$', 1)"
_DECODED = f"(CASE WHEN url_decode({_PATH}) IN ('', '/') THEN '/index.html' ELSE url_decode({_PATH}) END)"
_EXT = f"lower(regexp_extract(regexp_extract({_DECODED}, '([^/]*)$', 1), '^.+([.][^.]*)$', 1))"


@query(
    "url_valid",
    "SELECT page_id, left(CASE WHEN page_id % 7 = 0 THEN replace(url, 'http', 'ftp') WHEN page_id % 7 = 1 THEN upper(url) ELSE url END, 2000) AS clipped, "
    "regexp_matches(CASE WHEN page_id % 7 = 0 THEN replace(url, 'http', 'ftp') WHEN page_id % 7 = 1 THEN upper(url) ELSE url END, '^https?://', 'i') AS valid FROM pages",
)
def url_valid(spark, d):
    url = F.when(c("page_id") % 7 == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).when(
        c("page_id") % 7 == 1, F.upper("url")
    ).otherwise(c("url"))
    return table(spark, d, "pages").select(
        "page_id", web.clipped_url(url).alias("clipped"), web.url_is_valid(url).alias("valid")
    )


@query("url_parts", f"SELECT page_id, {_DECODED} AS path, {_EXT} AS ext FROM pages")
def url_parts(spark, d):
    rows = table(spark, d, "pages").select("page_id", web.url_path(c("url")).alias("path"))
    return rows.withColumn("ext", web.extension(c("path")))


_MIME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.MIME_TYPES.items())
_ASSET = "CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', '') || {ext} END"
_EXTS = ["", ".JSON", ".js", ".tar.gz", ".png", "/.hidden", ".svg", "/a%20b.css"]


@query(
    "mime_lookup",
    f"WITH p AS (SELECT page_id, {_ASSET.format(ext=derived.pick('page_id', _EXTS))} AS url FROM pages) "
    f"SELECT page_id, {_EXT} AS ext, CASE {_EXT} {_MIME} ELSE '{fv.DEFAULT_MIME}' END AS mime FROM p",
)
def mime_lookup(spark, d):
    bare = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    url = F.when(c("page_id") % 3 == 0, c("url")).otherwise(F.concat(bare, F.expr(derived.pick("page_id", _EXTS))))
    rows = table(spark, d, "pages").select("page_id", web.extension(web.url_path(url)).alias("ext"))
    return rows.withColumn("mime", web.mime_type(c("ext")))


# --- expected categories of fields -----------------------------------------------------------------------

# What each label of the three forms should be classified as.
EXPECTED = {
    "banking": {
        "Full name (as per ID)": "name", "Date of birth": "dob", "Email address": "email", "Mobile number": "phone",
        "Residential address": "address", "PIN code": "pincode", "Aadhaar number": "aadhaar", "PAN": "pan",
        "Bank account number": "account_number", "IFSC code": "ifsc", "Create login password": "password",
        "OTP (sent to your mobile)": "otp", "City": None, "Company name": None, "Comments": None,
    },
    "flight": {
        "From": None, "To": None, "Travel date": None, "Passengers": None, "Search flights": None, "Book": None,
        "Passenger full name": "name", "Email": "email", "Mobile": "phone", "Card number (for payment)": "credit_card",
    },
    "login": {"Username or email": "username", "Password": "password", "Sign in": None},
}
_EXPECTED_ROWS = [(s, label, cat) for s, labels in EXPECTED.items() for label, cat in labels.items()]
_EXPECTED_SQL = "expected(scenario, label, expected) AS (VALUES " + ", ".join(
    f"('{s}', '{label}', {'NULL' if cat is None else repr(cat)})" for s, label, cat in _EXPECTED_ROWS
) + ")"


def judged_fields(spark, d) -> DataFrame:
    """Fields that have an expected category; the 28-row label table is broadcast."""
    expected = spark.createDataFrame(_EXPECTED_ROWS, "scenario string, label string, expected string")
    fields = derived.fields(spark, d).withColumn("got", classify.field()["category"])
    joined = fields.join(F.broadcast(expected), ["scenario", "label"])
    return joined.withColumn("verdict", evaluate.field_verdict(c("expected"), c("got")))


_JUDGED_SQL = f"""{FIELDS_SQL}, {_EXPECTED_SQL}, judged AS (SELECT f.field_id, f.scenario, f.label, e.expected, v.category AS got,
CASE WHEN e.expected IS NOT NULL AND v.category = e.expected THEN 'TP' WHEN e.expected IS NOT NULL THEN 'FN'
     WHEN v.category IS NOT NULL THEN 'FP' ELSE 'TN' END AS verdict
FROM fields f JOIN expected e ON e.scenario = f.scenario AND e.label = f.label JOIN ({_FULL}) v ON v.field_id = f.field_id)"""


@query("eval_field_match", f"WITH {_JUDGED_SQL} SELECT * FROM judged")
def eval_field_match(spark, d):
    return judged_fields(spark, d).select("field_id", "scenario", "label", "expected", "got", "verdict")


@query("field_verdicts", f"WITH {_JUDGED_SQL} SELECT scenario, verdict, count(*) AS n FROM judged GROUP BY 1, 2")
def field_verdicts(spark, d):
    return judged_fields(spark, d).groupBy("scenario", "verdict").agg(F.count(F.lit(1)).alias("n"))


_FIELD_COUNTS = """n AS (SELECT CAST(count(*) FILTER (WHERE verdict = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE verdict = 'FP') AS BIGINT) AS fp,
CAST(count(*) FILTER (WHERE verdict = 'FN') AS BIGINT) AS fn FROM judged),
pr AS (SELECT *, tp / (tp + fp + CAST(1e-9 AS DOUBLE)) AS p, tp / (tp + fn + CAST(1e-9 AS DOUBLE)) AS r FROM n)"""


def field_scores(spark, d) -> DataFrame:
    verdicts = judged_fields(spark, d)
    counts = verdicts.agg(*[F.count(F.when(c("verdict") == v.upper(), 1)).alias(v) for v in ("tp", "fp", "fn")])
    return evaluate.with_scores(counts)


@query(
    "field_prf",
    f"WITH {_JUDGED_SQL}, {_FIELD_COUNTS} SELECT tp, fp, fn, {duck.rounded('p')} AS precision, {duck.rounded('r')} AS recall, "
    f"{duck.rounded('2 * p * r / (p + r + CAST(1e-9 AS DOUBLE))')} AS f1 FROM pr",
)
def field_prf(spark, d):
    return field_scores(spark, d).select("tp", "fp", "fn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])
