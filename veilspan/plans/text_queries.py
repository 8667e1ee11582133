"""Queries over texts: scan, scrub, redact, audit, score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions import classify, scrub, spans, web
from veilspan.functions import fixed_values as fv
from veilspan.functions import text as tx
from veilspan.operators import detect, evaluate, redact
from veilspan.plans import derived, duck
from veilspan.sources.tables import table, text_table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

c = F.col
PLANTED_SQL = f"planted AS (SELECT {', '.join(derived.PLANTED)} FROM documents)"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def documents(spark, d, *columns) -> DataFrame:
    return text_table(spark, d, "documents", *(columns or ("doc_id", "text")))


# --- one pattern at a time ---------------------------------------------------------------

def _pattern_query(name: str, category: str, planted: bool) -> None:
    source = "planted" if planted else "documents"

    def run(spark, d):
        docs = derived.planted_documents(spark, d) if planted else documents(spark, d)
        found = docs.select("doc_id", spans.find("text", category).alias("s"))
        return spans.unnest(found, "s", "doc_id").select("doc_id", "match", "start")

    QUERIES[name] = run
    keep = f"WHERE {duck.luhn_ok('match')}" if category == "credit_card" else ""
    ORACLES[name] = (
        f"WITH {PLANTED_SQL} SELECT doc_id, match, start FROM ({duck.spans(source, 'doc_id', 'text', category)}) {keep}"
    )


_pattern_query("scan_email", "email", False)
_pattern_query("scan_aadhaar", "aadhaar", True)
_pattern_query("scan_pan", "pan", True)
_pattern_query("scan_phone", "phone", True)
_pattern_query("scan_card", "credit_card", False)
_pattern_query("scan_ifsc", "ifsc", True)
_pattern_query("scan_dob", "dob", True)

_HITS = duck.hits_ctes("documents", "doc_id", "text")
_PLANTED_HITS = PLANTED_SQL + ",\n" + duck.hits_ctes("planted", "doc_id", "text")


@query("scan_account", f"WITH {_HITS} SELECT doc_id, match, start FROM hits WHERE category = 'account_number'")
def scan_account(spark, d):
    found = documents(spark, d).select("doc_id", spans.scan_accounts("text").alias("s"))
    return spans.unnest(found, "s", "doc_id").select("doc_id", "match", "start")


_HIT_COLUMNS = "doc_id, hit_no, category, match, start"


@query("scan_text", f"WITH {_HITS} SELECT {_HIT_COLUMNS} FROM hits")
def scan_text(spark, d):
    return detect.hits(documents(spark, d), "doc_id")


@query("scan_planted", f"WITH {_PLANTED_HITS} SELECT {_HIT_COLUMNS} FROM hits")
def scan_planted(spark, d):
    return detect.hits(derived.planted_documents(spark, d), "doc_id")


@query(
    "scan_turns",
    f"WITH {duck.hits_ctes('conversations', 'conv_id, turn', 'text')} "
    "SELECT t.conv_id, t.role, count(DISTINCT t.turn) AS n_turns, count(h.match) AS n_hits FROM conversations t "
    "LEFT JOIN hits h ON h.conv_id = t.conv_id AND h.turn = t.turn GROUP BY 1, 2",
)
def scan_turns(spark, d):
    """Hits per conversation and role, conversations without one included."""
    turns = text_table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    counted = turns.select("conv_id", "role", "turn", F.size(spans.scan("text")).alias("n"))
    return counted.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("n").alias("n_hits"))


@query(
    "scan_benchmark",
    f"WITH {duck.hits_ctes('benchmark', 'item_id', 'text')} "
    "SELECT b.item_id, count(h.match) AS n_hits FROM benchmark b LEFT JOIN hits h ON h.item_id = b.item_id GROUP BY 1",
)
def scan_benchmark(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(spans.scan("text")).alias("n_hits"))


_OPTIONAL = " UNION ALL ".join(
    f"SELECT doc_id, category, match, start FROM ({duck.spans('documents', 'doc_id', 'text', n)})" for n in ("cvv", "otp")
)


@query("scan_optional", _OPTIONAL)
def scan_optional(spark, d):
    both = F.concat(spans.find("text", "cvv"), spans.find("text", "otp"))
    return spans.unnest(documents(spark, d).select("doc_id", both.alias("s")), "s", "doc_id")


_DIGITS = "regexp_extract_all(text, '[0-9][0-9 -]*[0-9]')"


@query(
    "luhn",
    f"SELECT doc_id, candidate, {duck.luhn_ok('candidate')} AS ok FROM "
    f"(SELECT doc_id, unnest({_DIGITS}) AS candidate FROM documents)",
)
def luhn(spark, d):
    runs = F.regexp_extract_all(c("text"), F.lit("[0-9][0-9 -]*[0-9]"), F.lit(0))
    rows = documents(spark, d).select("doc_id", F.explode(runs).alias("candidate"))
    return rows.select("doc_id", "candidate", F.coalesce(spans.luhn("candidate"), F.lit(False)).alias("ok"))


@query(
    "sensitive_flag",
    f"WITH {_PLANTED_HITS} SELECT doc_id, hit_no, category, category IN ({duck.quoted(fv.ALWAYS_SENSITIVE)}) AS always, "
    f"category IN ({duck.quoted(fv.OPTIONALLY_SENSITIVE)}) AS optional FROM hits",
)
def sensitive_flag(spark, d):
    return detect.hits(derived.planted_documents(spark, d), "doc_id").select(
        "doc_id", "hit_no", "category", classify.always_sensitive(c("category")).alias("always"),
        classify.optionally_sensitive(c("category")).alias("optional"),
    )


_CONF = " ".join(f"WHEN '{k}' THEN {duck.number(v)}" for k, v in fv.SOURCE_CONFIDENCE.items())


@query(
    "confidence",
    f"WITH {_PLANTED_HITS} SELECT doc_id, hit_no, source, CASE source {_CONF} END AS confidence FROM "
    "(SELECT doc_id, hit_no, CASE hit_no % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'value' ELSE 'label' END AS source FROM hits)",
)
def confidence(spark, d):
    source = F.when(c("hit_no") % 3 == 0, "text").when(c("hit_no") % 3 == 1, "value").otherwise("label")
    rows = detect.hits(derived.planted_documents(spark, d), "doc_id").select("doc_id", "hit_no", source.alias("source"))
    return rows.withColumn("confidence", classify.confidence_of(c("source")))


# --- counts --------------------------------------------------------------------------------

@query("category_counts", f"WITH {_PLANTED_HITS} SELECT doc_id, category, count(*) AS n FROM hits GROUP BY 1, 2")
def category_counts(spark, d):
    counted = detect.category_counts(derived.planted_documents(spark, d), "doc_id")
    return detect.counted_rows(counted, "doc_id")


@query("counts_by_category",
       f"WITH {_HITS} SELECT category, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY 1")
def counts_by_category(spark, d):
    # A document gives one row per category, so documents are counted by plain rows.
    rows = detect.counted_rows(detect.category_counts(documents(spark, d), "doc_id"), "doc_id")
    return rows.groupBy("category").agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_docs"))


@query(
    "pii_types",
    f"WITH {_PLANTED_HITS} SELECT p.doc_id, count(DISTINCT category) FILTER (WHERE category <> 'face') AS n_types "
    "FROM planted p LEFT JOIN hits h ON h.doc_id = p.doc_id GROUP BY 1",
)
def pii_types(spark, d):
    counted = detect.category_counts(derived.planted_documents(spark, d), "doc_id")
    return counted.select("doc_id", F.size(F.array_remove(F.map_keys("counts"), "face")).alias("n_types"))


@query(
    "label_exposure",
    f"WITH {_HITS} SELECT CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic, count(*) AS n_docs, count(h.doc_id) AS n_exposed, "
    "CAST(coalesce(sum(h.n), 0) AS BIGINT) AS n_hits FROM labels l "
    "LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1) h ON h.doc_id = l.doc_id GROUP BY 1, 2",
)
def label_exposure(spark, d):
    exposed = detect.hits(documents(spark, d), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        table(spark, d, "labels").join(exposed, "doc_id", "left").groupBy("quality", "toxic")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count("n").alias("n_exposed"),
             F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"))
    )


# --- small text functions ---------------------------------------------------------------------

@query(
    "short_text",
    "SELECT doc_id, nullif(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 120), '') AS short FROM documents",
)
def short_text(spark, d):
    return documents(spark, d).select("doc_id", tx.short_text(c("text"), 120).alias("short"))


@query(
    "truncate_ellipsis",
    "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS label FROM documents",
)
def truncate_ellipsis(spark, d):
    return documents(spark, d).select("doc_id", tx.ellipsize(c("text"), 60).alias("label"))


@query("mask_repeat", "SELECT doc_id, repeat('•', CAST(length(text) AS BIGINT)) AS masked FROM documents")
def mask_repeat(spark, d):
    return documents(spark, d).select("doc_id", tx.mask_all(c("text")).alias("masked"))


@query("body_gate", "SELECT doc_id, length(text) AS n_chars, length(text) <= 20000 AS in_gate FROM documents")
def body_gate(spark, d):
    return documents(spark, d).select(
        "doc_id", F.length("text").alias("n_chars"), (F.length("text") <= fv.BODY_SCAN_CHARS).alias("in_gate")
    )


@query("size_gate", "SELECT doc_id, strlen(text) AS n_bytes, strlen(text) <= 26214400 AS accepted FROM documents")
def size_gate(spark, d):
    return documents(spark, d).select(
        "doc_id", F.octet_length("text").alias("n_bytes"), (F.octet_length("text") <= fv.MAX_BODY_BYTES).alias("accepted")
    )


@query(
    "b64_bytes",
    "SELECT doc_id, strlen(text) AS n_bytes, CAST(0 AS BIGINT) AS bare_bytes FROM documents",
)
def b64_bytes(spark, d):
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(c("text").cast("binary")))
    # base64() breaks no lines in Spark 4; strip them anyway so old data reads the same.
    rows = documents(spark, d).select("doc_id", F.regexp_replace(url, r"\s", "").alias("u"))
    return rows.select(
        "doc_id", web.b64_bytes(c("u")).alias("n_bytes"),
        web.b64_bytes(F.substring_index("u", ",", -1)).alias("bare_bytes"),
    )


@query(
    "success_state",
    "SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 5 = 0 THEN ' Claim Submitted' ELSE '' END, "
    f"'{fv.SUCCESS_WORDS}', 'i') AS success FROM documents",
)
def success_state(spark, d):
    said = F.concat(c("text"), F.when(c("doc_id") % 5 == 0, " Claim Submitted").otherwise(""))
    return documents(spark, d).select("doc_id", tx.success_seen(said).alias("success"))


# --- scrub -------------------------------------------------------------------------------------

_SCRUB = duck.scrub_ctes("documents", "doc_id", "text")


@query("scrub_text", f"WITH {_SCRUB} SELECT doc_id, scrubbed FROM scrubbed")
def scrub_text(spark, d):
    return documents(spark, d).select("doc_id", scrub.scrub_text("text").alias("scrubbed"))


@query(
    "scrub_planted",
    f"WITH {PLANTED_SQL}, {duck.scrub_ctes('planted', 'doc_id', 'text')} SELECT doc_id, scrubbed FROM scrubbed",
)
def scrub_planted(spark, d):
    return derived.planted_documents(spark, d).select("doc_id", scrub.scrub_text("text").alias("scrubbed"))


@query(
    "scrub_stats",
    f"WITH {_SCRUB} SELECT count(*) AS n_bodies, CAST(sum(CASE WHEN scrubbed <> text THEN 1 ELSE 0 END) AS BIGINT) AS n_scrubbed, "
    "CAST(sum(length(text)) AS BIGINT) AS chars_in, CAST(sum(length(scrubbed)) AS BIGINT) AS chars_out FROM scrubbed",
)
def scrub_stats(spark, d):
    done = documents(spark, d).withColumn("scrubbed", scrub.scrub_text("text"))
    return stats_of(done)


def stats_of(done: DataFrame) -> DataFrame:
    return done.agg(
        F.count(F.lit(1)).alias("n_bodies"),
        F.coalesce(F.sum((c("scrubbed") != c("text")).cast("long")), F.lit(0)).alias("n_scrubbed"),
        F.sum(F.length("text")).alias("chars_in"), F.sum(F.length("scrubbed")).alias("chars_out"),
    )


# --- redact and audit ------------------------------------------------------------------------------

_REGIONS = _PLANTED_HITS + ",\n" + duck.regions_ctes("hits", "doc_id")


def _redacted_sql(mask: str) -> str:
    return f"""WITH {_REGIONS},
pieces AS (
  SELECT r.doc_id, r.region, substr(p.text, CAST(coalesce(lag(r_end) OVER w, 0) + 1 AS BIGINT),
         CAST(r_start - coalesce(lag(r_end) OVER w, 0) AS BIGINT)) || {mask} AS piece, r_end
  FROM regions r JOIN planted p ON p.doc_id = r.doc_id WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.region)),
joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY region) AS head, max(r_end) AS last_end, count(*) AS n FROM pieces GROUP BY 1)
SELECT p.doc_id, coalesce(j.n, 0) AS n_regions,
       CASE WHEN j.doc_id IS NULL THEN p.text ELSE head || substr(p.text, CAST(last_end + 1 AS BIGINT)) END AS redacted
FROM planted p LEFT JOIN joined j ON j.doc_id = p.doc_id"""


_BLUR = ("repeat('•', CAST(greatest(r_end - r_start - 2, 0) AS BIGINT)) || "
         "substr(p.text, CAST(r_start + greatest(r_end - r_start - 2, 0) + 1 AS BIGINT), CAST(least(r_end - r_start, 2) AS BIGINT))")
_SOLID = "repeat('█', CAST(r_end - r_start AS BIGINT))"


@query("redact_spans", _redacted_sql(_BLUR))
def redact_spans(spark, d):
    done = redact.redacted(derived.planted_documents(spark, d), "doc_id", style="blur")
    return done.select("doc_id", F.size("regions").alias("n_regions"), "redacted")


@query("redact_solid", _redacted_sql(_SOLID))
def redact_solid(spark, d):
    done = redact.redacted(derived.planted_documents(spark, d), "doc_id", style="solid")
    return done.select("doc_id", F.size("regions").alias("n_regions"), "redacted")


@query(
    "redaction_audit",
    f"""WITH {_REGIONS},
r AS (SELECT doc_id, sum(r_end - r_start) AS altered, count(*) AS n FROM regions GROUP BY 1),
h AS (SELECT doc_id, sum(length(match)) AS covered FROM hits GROUP BY 1),
x AS (SELECT p.doc_id, length(p.text) AS n_chars, strlen(p.text) AS n_bytes, CAST(coalesce(altered, 0) AS BIGINT) AS altered_chars,
  CAST(coalesce(covered, 0) AS BIGINT) AS span_chars, coalesce(n, 0) AS n_regions
  FROM planted p LEFT JOIN r ON r.doc_id = p.doc_id LEFT JOIN h ON h.doc_id = p.doc_id)
SELECT doc_id, n_chars, altered_chars, span_chars, n_regions, {duck.rounded('least(1, (n_bytes + 2 * altered_chars) / n_bytes)')} AS size_ratio, {duck.rounded('altered_chars / n_chars')} AS char_delta,
  {duck.rounded('span_chars / n_chars')} AS coverage FROM x""",
)
def redaction_audit(spark, d):
    done = redact.redacted(derived.planted_documents(spark, d), "doc_id", style="solid")
    return redact.audit(done, "doc_id").select(
        "doc_id", "n_chars", "altered_chars", "span_chars", "n_regions", F.round("size_ratio", 9).alias("size_ratio"),
        F.round("char_delta", 9).alias("char_delta"), F.round("coverage", 9).alias("coverage"),
    )


@query(
    "redaction_leakage",
    f"""WITH {_REGIONS},
truth AS (SELECT doc_id, length(text) AS n_chars, start_1 AS a, start_1 + length(match_1) AS b,
  greatest(0, start_1 - 3) AS ga, least(length(text), start_1 + length(match_1) + 3) AS gb FROM planted),
o AS (SELECT t.doc_id, sum(CASE WHEN r_end IS NULL THEN 0 ELSE greatest(0, least(r_end, b) - greatest(r_start, a)) END) AS inside,
  sum(coalesce(r_end - r_start, 0)) AS masked,
  sum(CASE WHEN r_end IS NULL THEN 0 ELSE greatest(0, least(r_end, gb) - greatest(r_start, ga)) END) AS near
  FROM truth t LEFT JOIN regions r ON r.doc_id = t.doc_id GROUP BY 1),
x AS (SELECT CASE WHEN b > a THEN inside / (b - a) END AS inside, n_chars - (gb - ga) AS oc, masked - near AS om
  FROM truth JOIN o USING (doc_id))
SELECT count(inside) AS n_spans, {duck.rounded('avg(inside)')} AS inside_share, CAST(sum(om) AS BIGINT) AS outside_masked,
  CAST(sum(oc) AS BIGINT) AS outside_chars, {duck.rounded('sum(om) / sum(oc)')} AS outside_share FROM x""",
)
def redaction_leakage(spark, d):
    docs = derived.planted_documents(spark, d)
    # scan() may not run twice per text, so the truth span travels with the row.
    done = docs.select(
        "text", spans.scan("text").alias("spans"), c("start_1").alias("a"),
        (c("start_1") + F.length("match_1")).alias("b"),
    ).withColumn("regions", redact.regions("spans"))
    out = redact.leakage(done, "a", "b")
    return out.withColumn("inside_share", F.round("inside_share", 9)).withColumn("outside_share", F.round("outside_share", 9))


# --- score against planted labels --------------------------------------------------------------------

_LABELS_SQL = """expected AS (SELECT doc_id, category_1 AS category, match_1 AS match FROM planted WHERE category_1 IS NOT NULL
  UNION ALL SELECT doc_id, category_2, match_2 FROM planted WHERE category_2 IS NOT NULL)"""
_MATCH_SQL = f"""{_PLANTED_HITS}, {_LABELS_SQL},
e AS (SELECT doc_id, category, match, row_number() OVER (PARTITION BY doc_id, category, match ORDER BY 1) AS k FROM expected),
f AS (SELECT doc_id, category, match, row_number() OVER (PARTITION BY doc_id, category, match ORDER BY 1) AS k FROM hits),
m AS (SELECT coalesce(e.doc_id, f.doc_id) AS doc_id, coalesce(e.category, f.category) AS category, coalesce(e.match, f.match) AS match,
  CASE WHEN e.k IS NOT NULL AND f.k IS NOT NULL THEN 1 ELSE 0 END AS tp,
  CASE WHEN e.k IS NULL THEN 1 ELSE 0 END AS fp, CASE WHEN f.k IS NULL THEN 1 ELSE 0 END AS fn
  FROM e FULL OUTER JOIN f ON e.doc_id = f.doc_id AND e.category = f.category AND e.match = f.match AND e.k = f.k)"""


def matched(spark, d) -> DataFrame:
    docs = derived.planted_documents(spark, d)
    found = detect.hits(docs, "doc_id").select("doc_id", "category", "match")
    return evaluate.multiset_match(derived.planted_labels(docs), found, ["doc_id", "category", "match"])


@query(
    "eval_text_match",
    f"WITH {_MATCH_SQL} SELECT doc_id, category, match, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, "
    "CAST(sum(fn) AS BIGINT) AS fn FROM m GROUP BY 1, 2, 3",
)
def eval_text_match(spark, d):
    return matched(spark, d).select("doc_id", "category", "match", "tp", "fp", "fn")


_COUNTS_SQL = f"""{_MATCH_SQL}, counts AS (SELECT CASE WHEN grouping(category) = 1 THEN '(all)' ELSE category END AS category,
  CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM m GROUP BY ROLLUP (category))"""


@query("eval_counts", f"WITH {_COUNTS_SQL} SELECT * FROM counts")
def eval_counts(spark, d):
    return evaluate.totals(matched(spark, d), "category")


@query(
    "eval_prf",
    f"WITH {_COUNTS_SQL}, pr AS (SELECT *, tp / (tp + fp + CAST(1e-9 AS DOUBLE)) AS p, tp / (tp + fn + CAST(1e-9 AS DOUBLE)) AS r FROM counts) "
    f"SELECT category, tp, fp, fn, {duck.rounded('p')} AS precision, {duck.rounded('r')} AS recall, "
    f"{duck.rounded('2 * p * r / (p + r + CAST(1e-9 AS DOUBLE))')} AS f1 FROM pr",
)
def eval_prf(spark, d):
    scored = evaluate.with_scores(evaluate.totals(matched(spark, d), "category"))
    return scored.select("category", "tp", "fp", "fn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query(
    "eval_exact",
    f"WITH {_MATCH_SQL} SELECT doc_id, CAST(sum(tp + fn) AS BIGINT) AS expected, CAST(sum(tp + fp) AS BIGINT) AS found, "
    "sum(tp + fn) = sum(tp + fp) AND bool_and(known) AS ok FROM (SELECT *, "
    "fp = 0 OR EXISTS (SELECT 1 FROM e x WHERE x.doc_id = m.doc_id AND x.category = m.category AND x.match = m.match) AS known FROM m) GROUP BY 1",
)
def eval_exact(spark, d):
    return evaluate.exactness(matched(spark, d), "doc_id")
