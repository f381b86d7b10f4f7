"""Every query of the library on the supplied tables, with its SQL.

The supplied tables stand in for the domain's: orders and their shipments are
monthly filings, customers and suppliers two registers of registrations, events the
answers of a registry or the hits of a screen, conversations documents with turns.
Rule and grade tables are inputs of the scoring operators; those here are examples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelight.functions import address, names, text
from duelight.operators import classify, extract, filings, match, registry, report, review, score, screening
from duelight.sources import io

AS_OF = "2001-09-01"
RULES = [
    ("com_gst_filing_compliance", 0, 'value == "timely"', "On time", 10.0), ("com_gst_filing_compliance", 1, 'value == "minor_delays"', "Up to 3 late", 6.0),
    ("com_gst_filing_compliance", 2, 'value == "five_delays"', "Up to 5 late", 3.0), ("com_gst_filing_compliance", 3, 'value == "significant_delays"', "Over 5 late", 0.0),
    ("com_gst_delay_days", 0, "value <= 10", "Up to 10 days", 5.0), ("com_gst_delay_days", 1, "value IN (10, 60]", "Up to 60 days", 3.0), ("com_gst_delay_days", 2, "value > 60", "Over 60 days", 1.0),
    ("ident_balance", 0, "value < 0", "Overdrawn", 0.0), ("ident_balance", 1, "value IN [0, 5000)", "Funded", 4.0), ("ident_balance", 2, "value >= 5000", "Well funded", 8.0),
]
PARAMS = [("compliance", "com_gst_filing_compliance", 0, 10.0, False), ("compliance", "com_gst_delay_days", 1, 5.0, True), ("proof_of_identity", "ident_balance", 0, 8.0, False)]
GRADES = [("A", 18.0), ("B", 12.0), ("C", 6.0), ("D", 0.0)]

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt out by its key, for work that costs far more than reading: a file of one row group is read by one task."""
    return table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col(key))


def _delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of recent orders against the 20th of the month after the order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("vendor_id"), F.trunc(F.to_date("o_orderdate"), "month").alias("period"))
    o = o.where(text.in_window(F.col("period"), F.to_date(F.lit(AS_OF))))
    rows = o.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey")
    late = F.greatest(F.lit(0), F.date_diff(F.to_date("l_shipdate"), text.due_date(F.col("period"), F.lit("GSTR3B"))))
    return rows.select("vendor_id", late.alias("delay_days"))


_DELAY_SQL = """
    SELECT o_custkey AS vendor_id, greatest(0, date_diff('day', CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + INTERVAL 19 DAY AS DATE), CAST(l_shipdate AS DATE))) AS delay_days
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE date_trunc('month', o_orderdate) >= DATE '2001-09-01' - INTERVAL 372 DAY
"""
_SUMMARY_SQL = f"SELECT vendor_id, count(*) AS periods, count(*) FILTER (delay_days > 0) AS late, max(delay_days) AS max_delay FROM ({_DELAY_SQL}) GROUP BY vendor_id"
_BUCKET_SQL = "CASE WHEN late = 0 THEN 'timely' WHEN late <= 3 THEN 'minor_delays' WHEN late <= 5 THEN 'five_delays' ELSE 'significant_delays' END"


@query(f"SELECT vendor_id, CAST(periods AS BIGINT) AS periods, CAST(late AS BIGINT) AS late, CAST(max_delay AS BIGINT) AS max_delay, {_BUCKET_SQL} AS bucket FROM ({_SUMMARY_SQL})")
def filing_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03..05: periods, late ones, longest delay and bucket per customer."""
    rows = filings.filing_summary(_delays(spark, sf_dir))
    return rows.select("vendor_id", "periods", "late", F.col("max_delay").cast("long").alias("max_delay"), filings.filing_bucket(F.col("late")).alias("bucket"))


def _param_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "parameter_id string, ordinal int, expr string, condition string, assigned_score double")
    params = spark.createDataFrame(PARAMS, "category_id string, parameter_id string, param_ord int, max_score double, conditional boolean")
    vendors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id"), "c_acctbal")
    found = filings.filing_summary(_delays(spark, sf_dir))
    wide = vendors.join(found, "vendor_id", "left")
    each = F.array(
        F.struct(F.lit("com_gst_filing_compliance").alias("parameter_id"), filings.filing_bucket(F.col("late")).alias("value")),
        F.struct(F.lit("com_gst_delay_days").alias("parameter_id"), F.col("max_delay").cast("string").alias("value")),
        F.struct(F.lit("ident_balance").alias("parameter_id"), F.col("c_acctbal").cast("string").alias("value")),
    )
    resolved = wide.select("vendor_id", F.explode(each).alias("r")).select("vendor_id", "r.*", F.lit("").alias("note")).withColumn("unresolved", F.col("value").isNull())
    return score.score_params(resolved, params, rules, vendors)


_SCORE_SQL = f"""
    WITH s AS ({_SUMMARY_SQL}), w AS (
        SELECT c_custkey AS vendor_id, c_acctbal, late, max_delay,
               CASE WHEN late IS NULL THEN NULL ELSE {_BUCKET_SQL} END AS bucket
        FROM customer LEFT JOIN s ON c_custkey = vendor_id
    ), p AS (
        SELECT vendor_id, 'compliance' AS category_id, 'com_gst_filing_compliance' AS parameter_id,
               CASE bucket WHEN 'timely' THEN 10.0 WHEN 'minor_delays' THEN 6.0 WHEN 'five_delays' THEN 3.0 ELSE 0.0 END AS assigned_score, 10.0 AS max_score FROM w
        UNION ALL
        SELECT vendor_id, 'compliance', 'com_gst_delay_days',
               CASE WHEN max_delay IS NULL THEN 0.0 WHEN max_delay <= 10 THEN 5.0 WHEN max_delay <= 60 THEN 3.0 ELSE 1.0 END, CASE WHEN max_delay IS NULL THEN 0.0 ELSE 5.0 END FROM w
        UNION ALL
        SELECT vendor_id, 'proof_of_identity', 'ident_balance', CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal < 5000 THEN 4.0 ELSE 8.0 END, 8.0 FROM w
    )
"""


@query(f"{_SCORE_SQL} SELECT vendor_id, category_id, CAST(sum(assigned_score) AS DOUBLE) AS earned, CAST(sum(max_score) AS DOUBLE) AS max_score FROM p GROUP BY ALL")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06, JN-09, AGG-09: points per customer and category by the rule table."""
    return score.category_scores(_param_scores(spark, sf_dir))


@query(f"""{_SCORE_SQL}, v AS (SELECT vendor_id, CAST(sum(assigned_score) AS DOUBLE) AS total, CAST(sum(max_score) AS DOUBLE) AS max_total FROM p GROUP BY vendor_id)
    SELECT *, total AS report_total, CASE WHEN total >= 18 THEN 'A' WHEN total >= 12 THEN 'B' WHEN total >= 6 THEN 'C' WHEN total >= 0 THEN 'D' END AS grade FROM v""")
def flagship_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, JN-10: totals and grade of every customer, from filings to scores."""
    grades = spark.createDataFrame(GRADES, "grade string, min_score double")
    return score.grade_band(score.vendor_scores(score.category_scores(_param_scores(spark, sf_dir))), grades)


def _registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = lambda b: F.when(b < 0, "Cancelled suo motu").when(b < 1000, "Inactive").otherwise("Active")
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("vendor_id"), F.col("c_custkey").cast("string").alias("gstin"), status(F.col("c_acctbal") + 900).alias("status"), F.col("c_mktsegment").alias("state"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("vendor_id"), F.col("s_suppkey").cast("string").alias("gstin"), F.when(F.col("s_acctbal") > 0, status(F.col("s_acctbal"))).alias("status"), F.lit("supplier").alias("state"))
    return match.merge_registrations(a, b)


def _status_sql(b: str) -> str:
    return f"CASE WHEN {b} < 0 THEN 'Cancelled suo motu' WHEN {b} < 1000 THEN 'Inactive' ELSE 'Active' END"


_REGISTER_SQL = f"""
    WITH a AS (SELECT c_nationkey AS vendor_id, CAST(c_custkey AS VARCHAR) AS gstin, {_status_sql("c_acctbal + 900")} AS status, c_mktsegment AS state FROM customer),
    b AS (SELECT s_nationkey AS vendor_id, CAST(s_suppkey AS VARCHAR) AS gstin, CASE WHEN s_acctbal > 0 THEN {_status_sql("s_acctbal")} END AS status, 'supplier' AS state FROM supplier),
    m AS (SELECT vendor_id, gstin, coalesce(b.status, a.status) AS status, coalesce(a.state, b.state) AS state, CASE WHEN b.status IS NOT NULL THEN 'details' ELSE 'by_pan' END AS status_source
          FROM a FULL JOIN b USING (vendor_id, gstin))
"""


@query(f"{_REGISTER_SQL} SELECT * FROM m")
def merged_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-02: two registers per nation, the second one's status winning."""
    return _registers(spark, sf_dir)


@query(f"""{_REGISTER_SQL}, o AS (SELECT m.vendor_id, CASE WHEN gstin = subject THEN NULL WHEN status = 'Active' THEN 'active' WHEN status LIKE 'Cancel%' THEN 'cancelled' WHEN status = 'Inactive' THEN 'ambiguous' ELSE 'unknown' END AS kind
        FROM m JOIN (SELECT s_nationkey AS vendor_id, CAST(min(s_suppkey) AS VARCHAR) AS subject FROM supplier GROUP BY s_nationkey) USING (vendor_id))
    SELECT vendor_id, count(*) AS n, CASE WHEN count(kind) = 0 THEN 'no_additional' WHEN bool_or(kind = 'cancelled') THEN 'cancelled_present' WHEN bool_and(kind = 'active') FILTER (kind IS NOT NULL) THEN 'active_multi_state' END AS value
    FROM o GROUP BY vendor_id""")
def registration_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06: what the other registrations of a nation's first supplier say."""
    subject = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("vendor_id")).agg(F.min("s_suppkey").cast("string").alias("subject_gstin"))
    rows = _registers(spark, sf_dir).join(subject.select("vendor_id"), "vendor_id")
    return registry.registration_verdict(rows, subject)


@query("""SELECT o_custkey AS vendor_id, CASE WHEN arg_max(o_orderpriority, (strftime(o_orderdate, '%Y'), CAST(quarter(o_orderdate) AS VARCHAR), o_orderkey)) < '3' THEN 'monthly' ELSE 'quarterly' END AS frequency FROM orders GROUP BY o_custkey""")
def latest_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01: the frequency of each customer's latest quarter."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("vendor_id"), F.date_format("o_orderdate", "yyyy").alias("financial_year"), F.quarter("o_orderdate").cast("string").alias("quarter"),
        F.when(F.col("o_orderpriority") < "3", "Monthly").otherwise("Quarterly (QRMP)").alias("frequency"), F.col("o_orderkey").alias("pos"),
    )
    return filings.latest_frequency(rows)


_FRESH_SQL = """
    WITH g AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS fetched_at, arg_max(props, ts) FILTER (event_type <> 'error') AS data, arg_max(event_type, ts) = 'error' AS last_failed FROM events GROUP BY user_id)
    SELECT user_id AS key, CASE WHEN fetched_at IS NULL THEN 'missing' WHEN fetched_at >= TIMESTAMP '2024-02-05' - INTERVAL 7 DAY THEN 'fresh' WHEN last_failed THEN 'stale_served' ELSE 'expired' END AS status, data, fetched_at FROM g
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    tries = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("fetched_at"), failed.alias("failed"), failed.alias("retriable"), F.col("props").alias("data"))
    return registry.fresh_snapshots(tries, F.lit("2024-02-05").cast("timestamp_ntz"), 7)


@query(f"SELECT key, status, CASE WHEN status IN ('fresh', 'stale_served') THEN data END AS data, fetched_at FROM ({_FRESH_SQL})")
def fresh_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: per user the answer served, errors as failed refetches."""
    return _snapshots(spark, sf_dir)


@query(f"SELECT status, count(*) AS n FROM ({_FRESH_SQL}) GROUP BY status")
def freshness_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: how many answers were fresh, stale or missing."""
    return registry.freshness_stats(_snapshots(spark, sf_dir))


@query("""WITH l AS (SELECT conv_id AS vendor_id, role, arg_max(text, turn) AS value FROM conversations WHERE text IS NOT NULL GROUP BY ALL)
    SELECT vendor_id, 'text' AS field, arg_min(value, CASE role WHEN 'assistant' THEN 0 ELSE 1 END) AS value FROM l WHERE role IN ('assistant', 'user') AND value <> '' GROUP BY vendor_id""")
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-02: the last turn per role, then roles by priority."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("vendor_id"), F.col("role").alias("doc_type"), F.lit("text").alias("field"), F.col("text").alias("value"), F.col("turn").alias("seq"))
    return registry.merge_by_priority(registry.merge_within_type(rows), {"text": ("assistant", "user")})


URL_RULES = (("paged", (r"[?&]page=\d",)), ("french", ("/fr/",)), ("english", ("/en/",)), ("other_site", (r"https?://",)))
TEXT_RULES = (("licence", ((r"licensed? under", "licen[cs]e"),)), ("contact", (("@", r"\.com"),)), ("shouting", (("!!",),)), ("table", ((r" \| ",),)))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '[?&]page=\d') THEN 'paged' WHEN contains(lower(url), '/fr/') THEN 'french' WHEN contains(lower(url), '/en/') THEN 'english' WHEN regexp_matches(lower(url), 'https?://') THEN 'other_site' END AS doc_type FROM pages""")
def classified_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01: pages by ordered patterns of their address."""
    return table(spark, sf_dir, "pages").select("page_id", classify.by_name(F.col("url"), URL_RULES).alias("doc_type"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(t, 'licensed? under') AND regexp_matches(t, 'licen[cs]e') THEN 'licence' WHEN contains(t, '@') AND contains(t, '.com') THEN 'contact' WHEN contains(t, '!!') THEN 'shouting' WHEN contains(t, ' | ') THEN 'table' END AS doc_type FROM d""")
def classified_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02: documents by groups of patterns that must occur together."""
    return table(spark, sf_dir, "documents").select("doc_id", classify.by_content(F.col("text"), TEXT_RULES).alias("doc_type"))


@query(r"""SELECT doc_id, 'mobile' AS kind, unnest(regexp_extract_all(text, '\b[6-9]\d{9}\b')) AS ident FROM documents
    UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+')) FROM documents""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-13: e-mail addresses and mobile numbers in documents."""
    return extract.find_identifiers(table(spark, sf_dir, "documents"), "doc_id", "text", ("mobile", "email"))


@query(r"""WITH r AS (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS items FROM pages)
    SELECT page_id, CAST(n - 1 AS INT) AS row_no, trim(regexp_replace(regexp_replace(items[n], '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS item FROM r, unnest(range(1, len(items) + 1)) AS u(n)""")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08: list items of web pages in order, tags stripped."""
    rows = io.html_table_rows(table(spark, sf_dir, "pages"), "page_id", "html", tag="li", cell="")
    return rows.select("page_id", "row_no", F.col("cells")[0].alias("item"))


@query(r"""WITH p AS (SELECT p_partkey, lower(trim(p_name)) AS flat, list_filter(regexp_extract_all(lower(p_name), '\b[a-z0-9]{3,}\b'), lambda w: w NOT IN ('national', 'the', 'and', 'state', 'global', 'public', 'private', 'group')) AS toks FROM part),
    n AS (SELECT DISTINCT flat AS name, list_distinct(toks) AS toks FROM p)
    SELECT p_partkey AS entity_id, n.name AS list_id FROM p JOIN n ON p.flat = n.name
        OR (len(p.toks) >= 2 AND (len(list_filter(p.toks, lambda w: list_contains(n.toks, w))) >= 2))
        OR (len(p.toks) = 1 AND list_contains(n.toks, p.toks[1]) AND len(n.toks) <= 3)""")
def screened_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03: parts against the list of distinct names by an inverted index."""
    parts = table(spark, sf_dir, "part")
    listed = parts.select(text.normalize(F.col("p_name")).alias("list_id")).distinct().withColumn("name", F.col("list_id"))
    return match.screen_names(parts.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")), listed)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("vendor_id"), F.col("event_type").alias("slot"), F.lit("events").alias("list_name"), F.lit("watch").alias("category"), F.lit("open").alias("status"),
        F.concat(F.floor("value").cast("string"), F.lit("%")).alias("score"), F.col("event_id").alias("seq"), F.col("props").alias("source"),
    )


@query("""WITH h AS (SELECT user_id AS vendor_id, event_type AS slot, concat(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '%') AS score, floor(value) AS num, event_id AS seq, props FROM events)
    SELECT vendor_id, slot, 'events' AS list_name, 'watch' AS category, 'open' AS status, count(*) AS n_rows, arg_max(score, (num, -seq)) AS score, arg_min(props, seq) AS first_source, CAST(count(DISTINCT props) - 1 AS BIGINT) AS more_sources
    FROM h GROUP BY vendor_id, slot""")
def hit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07: hits per user and kind, the strongest score and first source."""
    return screening.summarize_hits(_hits(spark, sf_dir))


@query("""WITH s AS (SELECT user_id AS vendor_id, event_type AS source, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' AND value > 150 THEN 'high' ELSE 'none' END AS severity FROM events)
    SELECT vendor_id, CASE WHEN coalesce(bool_or(severity = 'high'), false) THEN 'listed' WHEN count(severity) > 0 THEN 'not_listed' END AS verdict, coalesce(string_agg(DISTINCT CASE WHEN severity IS NULL THEN source END, ','), '') AS unscreened FROM s GROUP BY vendor_id""")
def sweep_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: what a sweep over all kinds of events finds per user."""
    severity = F.when(F.col("event_type") == "error", F.lit(None)).when((F.col("event_type") == "purchase") & (F.col("value") > 150), "high").otherwise("none")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("vendor_id"), F.col("event_type").alias("source"), severity.alias("severity"))
    return screening.sweep_verdict(rows).withColumn("unscreened", F.array_join("unscreened", ","))


@query("""SELECT c_custkey AS vendor_id, t AS doc_type FROM customer, (VALUES ('F'), ('O'), ('P')) AS r(t) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = t)""")
def missing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01: order states that a customer lacks."""
    vendors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id"))
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vendor_id"), F.col("o_orderstatus").alias("doc_type"))
    return registry.missing_documents(vendors, have, ("F", "O", "P"))


@query("SELECT conv_id AS vendor_id, string_agg(concat_ws(' | ', role, text), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-07: the lines of a conversation as one text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("vendor_id"), F.lit("turns").alias("section"), F.col("turn").alias("ordinal"), F.col("role").alias("c1"), F.col("text").alias("c2"), F.lit(None).cast("string").alias("c3"))
    return report.text_report(rows)


@query("""SELECT conv_id AS vendor_id, turn AS pass, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(CASE WHEN role = 'assistant' THEN length(text) END, 0)) AS BIGINT) AS output_tokens, CAST(sum(length(text)) AS BIGINT) AS total_tokens, CAST(0 AS BIGINT) AS reasoning_tokens
    FROM conversations GROUP BY ROLLUP (conv_id, turn) HAVING conv_id IS NOT NULL""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: counters per conversation and turn, and per conversation."""
    n = F.length("text").cast("long")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("vendor_id"), F.col("turn").alias("pass"), n.alias("input_tokens"), F.when(F.col("role") == "assistant", n).alias("output_tokens"), n.alias("total_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"))
    return review.usage_rollup(rows)


@query("""WITH f AS (SELECT user_id AS vendor_id, CAST(day(ts) AS BIGINT) AS pass, event_type AS parameter_id, CASE WHEN value > 50 THEN 'verified' ELSE 'likely' END AS confidence, CASE event_id % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'escalate' ELSE 'confirm_ok' END AS action, event_id % 5 AS t FROM events),
    c AS (SELECT vendor_id, pass, CASE t WHEN 0 THEN 'ReviewReport' WHEN 1 THEN 'look' ELSE 'ask' END AS tool FROM f WHERE parameter_id = 'view'),
    u AS (SELECT DISTINCT vendor_id, pass FROM c WHERE tool <> 'ReviewReport'),
    p AS (SELECT f.vendor_id, count(*) AS findings, count(*) FILTER (confidence = 'verified' AND u.vendor_id IS NULL) AS unsupported, list(DISTINCT parameter_id) AS flagged,
            count(*) FILTER (action = 'correct' AND confidence = 'verified') AS corrections, count(*) FILTER (action = 'escalate' OR action = 'correct' AND confidence <> 'verified') AS escalations
        FROM f LEFT JOIN u ON f.vendor_id = u.vendor_id AND f.pass = u.pass GROUP BY f.vendor_id),
    k AS (SELECT vendor_id, 'a' AS kind, action AS name, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT vendor_id, 'c', confidence, count(*) FROM f GROUP BY ALL UNION ALL SELECT vendor_id, 't', tool, count(*) FROM c WHERE tool <> 'ReviewReport' GROUP BY ALL),
    m AS (SELECT vendor_id, coalesce(string_agg(name || ':' || n, ',' ORDER BY name) FILTER (kind = 'a'), '') AS by_action, coalesce(string_agg(name || ':' || n, ',' ORDER BY name) FILTER (kind = 'c'), '') AS by_confidence, coalesce(string_agg(name || ':' || n, ',' ORDER BY name) FILTER (kind = 't'), '') AS tools FROM k GROUP BY vendor_id),
    n AS (SELECT vendor_id, count(*) AS calls FROM c GROUP BY vendor_id)
    SELECT vendor_id, findings, unsupported, array_to_string(list_sort(list_intersect(['error', 'purchase', 'refund'], flagged)), ',') AS hit, array_to_string(list_sort(list_filter(['error', 'purchase', 'refund'], lambda x: NOT list_contains(flagged, x))), ',') AS missed,
        coalesce(calls, 0) AS calls, corrections, escalations, tools, by_action, by_confidence FROM p JOIN m USING (vendor_id) LEFT JOIN n USING (vendor_id)""")
def trace_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16: findings of a user's days, unsupported ones, recall of three expected kinds, and counts of calls, tools, actions, confidence, corrections and escalations."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    action = F.when(k % 3 == 0, "correct").when(k % 3 == 1, "escalate").otherwise("confirm_ok")
    tool = F.when(k % 5 == 0, review.REPORT_CALL).when(k % 5 == 1, "look").otherwise("ask")
    found = e.select(F.col("user_id").alias("vendor_id"), F.dayofmonth("ts").cast("long").alias("pass"), F.col("event_type").alias("parameter_id"), F.when(F.col("value") > 50, "verified").otherwise("likely").alias("confidence"), action.alias("action"), tool.alias("tool"))
    want = found.select("vendor_id").distinct().select("vendor_id", F.explode(F.array(F.lit("error"), F.lit("purchase"), F.lit("refund"))).alias("parameter_id"))
    asked = found.withColumns({"proposed_value": F.lit("1"), "proposed_note": F.lit("")})
    kinds = found.select("parameter_id").distinct().select("parameter_id", F.lit(True).alias("numeric"), F.array().cast("array<string>").alias("buckets"))
    routed = review.route_corrections(asked, asked.where("false").select("vendor_id", "parameter_id", F.col("proposed_value").alias("value")), kinds)
    rows = review.evaluate_traces(found, found.where("parameter_id = 'view'"), want, routed)
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias(c)
    return rows.select("vendor_id", "findings", "unsupported", F.array_join("hit", ",").alias("hit"), F.array_join("missed", ",").alias("missed"), "calls", "corrections", "escalations", shown("tools"), shown("by_action"), shown("by_confidence"))


@query("""SELECT event_id AS call_no, CASE WHEN event_id > min(event_id) OVER w THEN min(event_id) OVER w END AS repeats FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE), event_type, props)""")
def repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06: later identical events of a user's day point to the first."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("vendor_id"), F.to_date("ts").alias("pass"), F.col("event_type").alias("tool"), F.col("props").alias("args"), F.col("event_id").alias("call_no"))
    return review.dedupe_calls(rows).select("call_no", "repeats")


@query("""SELECT conv_id AS vendor_id, turn AS pass, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations""")
def pass_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07: the roles that spoke before each turn."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("vendor_id"), F.col("turn").alias("pass"), F.col("role").alias("summary"))
    return review.pass_history(rows).select("vendor_id", "pass", F.array_join("history", ",").alias("history"))


@query("""WITH k AS (SELECT o_custkey AS vendor_id, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderdate, o_orderkey) AS a FROM orders GROUP BY o_custkey)
    SELECT vendor_id, array_to_string(a[1:6], '; ') || CASE WHEN len(a) > 6 THEN ' (+' || (len(a) - 6) || ' more)' ELSE '' END AS summary FROM k""")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-02: the first six orders of each customer and how many more."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vendor_id"), F.col("o_orderkey").alias("item"), F.struct("o_orderdate", "o_orderkey").alias("place"))
    return report.first_k_summary(rows, ["vendor_id"], "item", "place", 6)


@query("""SELECT o_custkey AS vendor_id, CASE WHEN count(*) = 0 THEN 'none' WHEN count(DISTINCT o_orderstatus) > 1 THEN 'conflict' WHEN count(*) = 1 THEN 'single' ELSE 'agree' END AS state, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS account_number FROM orders GROUP BY o_custkey""")
def account_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-20: do all of a customer's orders carry one state?"""
    return registry.account_agreement(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vendor_id"), F.col("o_orderstatus").alias("account_number")))


@query("""SELECT o_orderkey, CAST(round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-09-01') / 365.25, 2) AS DOUBLE) AS years,
    '~' || (m // 12) || ' years ' || (m % 12) || ' months' AS phrase
    FROM (SELECT *, 12 * (2001 - year(o_orderdate)) + 9 - month(o_orderdate) - CASE WHEN 1 < day(o_orderdate) THEN 1 ELSE 0 END AS m FROM orders)""")
def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-01, DAT-05, DAT-07: age of every order from a date in text."""
    told, as_of = F.date_format("o_orderdate", "dd/MM/yyyy"), F.to_date(F.lit(AS_OF))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.years_since(told, as_of).alias("years"), text.vintage_phrase(told, as_of).alias("phrase"))


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS found FROM events""")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01, JSN-03: a dotted path into a VARIANT, and a key at any depth, past the key in a text and before a later one."""
    deep = F.concat(F.lit(r'{"a": "\"k\": 5", "m": [{"k": null}, {"x": '), "props", F.lit('}], "n": {"k": -1}}'))
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"), F.parse_json(F.when(F.col("event_type") == "error", F.col("props")).otherwise(deep)).alias("w"))
    rows = text.find_key(rows, "w", "k", "found")
    return rows.select("event_id", text.dig(F.col("v"), "k", "bigint").alias("k"), F.col("found").cast("string").alias("found"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15: text of web pages."""
    return table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("text"))


@query("SELECT doc_id, length(text) > 6000 AS truncated, length(text) AS total_chars, sha256(substring(text, 1, 6000)) AS preview_sha256 FROM documents")
def capped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-15: documents as results with a size and a preview (the limit is the feature)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", review.cap_result(F.col("text")).alias("r"))
    return rows.select("doc_id", "r.truncated", F.col("r.total_chars").cast("long").alias("total_chars"), F.sha2(F.col("r.preview").cast("binary"), 256).alias("preview_sha256"))


_OVERRIDE_SQL = """
    WITH f AS (SELECT doc_id AS vendor_id, CAST(quality AS VARCHAR) AS fresh, CASE WHEN toxic = 1 THEN '0' END AS carried FROM labels),
    o AS (SELECT doc_id AS vendor_id, CASE WHEN n_chars < 300 THEN '0' WHEN n_chars > 9000 THEN '1' END AS analyst, '1' AS issued FROM documents)
    SELECT vendor_id, 'quality' AS parameter_id, coalesce(analyst, carried, fresh) AS value, CASE WHEN analyst IS NOT NULL THEN 'analyst' WHEN carried IS NOT NULL THEN 'review' ELSE 'fresh' END AS kind, coalesce(carried, fresh) AS before,
           CASE WHEN issued IS NULL THEN FALSE ELSE fresh IS DISTINCT FROM issued END AS stale FROM f LEFT JOIN o USING (vendor_id)
"""


@query(_OVERRIDE_SQL)
def override_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-17: analyst over review over fresh label, with staleness."""
    labels = table(spark, sf_dir, "labels")
    name = F.lit("quality").alias("parameter_id")
    fresh = labels.select(F.col("doc_id").alias("vendor_id"), name, F.col("quality").cast("string").alias("value"))
    carried = labels.where("toxic = 1").select(F.col("doc_id").alias("vendor_id"), name, F.lit("0").alias("value"))
    analyst = F.when(F.col("n_chars") < 300, "0").when(F.col("n_chars") > 9000, "1")
    overrides = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vendor_id"), name, analyst.alias("analyst_value"), F.lit("1").alias("issued_original"))
    return review.apply_overrides(fresh, carried, overrides)


@query()
def premises_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06..08, JN-13, JN-14, RES-11: customers' addresses against those of their nation's first supplier, both put together from keys."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("Plot No. "), F.pmod("c_custkey", F.lit(40)).cast("string"), F.lit("-"), F.pmod(F.col("c_custkey") + 1, F.lit(40)).cast("string"), F.lit(", "), F.col("c_mktsegment"), F.lit(" Nagar, Town"), F.col("c_nationkey").cast("string"), F.lit(" 6000"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("mine"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("k"))
    s = s.select("c_nationkey", F.concat(F.lit("Plot "), F.col("k").cast("string"), F.lit(", Machinery Nagar, 6000"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("theirs"))
    none = F.lit(None).cast("string")
    judge = lambda keys: keys.withColumns({"verdict": address.bill_verdict(F.col("mine"), F.col("theirs"), none, none), "note": address.registration_note(F.col("mine"), F.col("theirs"))})
    return text.once_each(c.join(s, "c_nationkey", "left"), ["mine", "theirs"], judge).select("c_custkey", "verdict", "note")


@query()
def agreeing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04, STR-05, UDF-01: names of parts of one brand, type and size, each with the brand's first."""
    p = table(spark, sf_dir, "part")
    first = p.groupBy("p_brand", "p_type", "p_size").agg(F.min_by("p_name", "p_partkey").alias("first_name"))
    rows = p.join(first, ["p_brand", "p_type", "p_size"]).select("p_partkey", "p_name", "first_name")
    pair = (F.col("p_name"), F.col("first_name"))
    judge = lambda pairs: names.decide(names.decide(pairs, "same_name", names.match_question(*pair)), "agree", names.agree_question(*pair))
    return text.once_each(rows, ["p_name", "first_name"], judge).select("p_partkey", "same_name", "agree")
