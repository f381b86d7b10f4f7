"""More queries on the supplied tables: documents, resolvers, screening, review and reports.

As in `catalog`, the supplied tables stand in for the domain's: each customer, order or
event gives one vendor, document or hit, whose texts and flags are put together from
its columns, so that work grows with the tables and SQL can say what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelight.functions import text
from duelight.operators import cases, classify, consistency, extract, match, ocr, registry, report, resolve, review, score, screening
from duelight.plans.catalog import AS_OF, PARAMS, RULES, _param_scores, _SCORE_SQL, query, spread, table

# ---- extraction


def _certificates(spark: SparkSession, sf_dir: str, nic: Column | None = None) -> DataFrame:
    """A document of one of ten types per customer, by its key; `nic` is the industry code of those that name one (else of any division, by the key)."""
    k = F.col("c_custkey")
    n = F.lpad(k.cast("string"), 9, "0")
    four, five = F.lpad(F.pmod(k, F.lit(10000)).cast("string"), 4, "0"), F.lpad(F.pmod(k, F.lit(100000)).cast("string"), 5, "0")
    name, pan = F.concat(F.lit("Alpha Mills "), F.col("c_mktsegment")), F.concat(F.lit("ABCFP"), four, F.lit("K"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    gst = say("Registration Number 27", pan, "1Z5\n1. Legal Name\n", name, "\n2. Trade Name, if any\nM/S ", name, "\n3. Constitution of Business\nPartnership\n4. Address of Principal Place of\nBusiness\nPlot ", n, ",\n  Rose Nagar\n5. Date of Liability\n01/07/2017\n8. Type of Registration\nRegular\n")
    msme = say("UDYAM-MH-01-00", five, "\nNAME OF ENTERPRISE\nM/S ", name, "\nMAJOR ACTIVITY\nMANUFACTURING\nOFFICIAL ADDRESS OF ENTERPRISE\nFlat/Door/Block No.\n", n, "\nCity\nRoseville\nBlock\n-\nPin 600001\nMobile 9876500000\nNational Industry Code\n22 - Plastics\n", five if nic is None else nic, " - Manufacture of semi\nfinished plastics,\n\nMicro 2021 Small 2022\n")
    cheque = say("Sample Bank RTGS IFSC: SBINO", five, "1\nA/c. No. 77", n, "\nVALID FOR THREE MONTHS ONLY\nFOR ", F.upper(name), " PVT LTD\nCANCELLED\n")
    bill = say("Consumer Name : ", name, "\nAddress : ", n, " Rose Road\n Roseville\nPin Code : 600001\nCategory : Industrial\nSanctioned Load : 12.5 KW\n")
    portal = say("Bank Account Details\nBank Name : Sample Bank\nAccount Number : 88", n, "\nIFSC : SBIN0", five, "1\nAccount Status : Active\nType of Account : CC\nPARSED_STATUS: VERIFIED\n")
    card = say("INCOME TAX DEPARTMENT   GOVT. OF INDIA\n", name, "\n01/01/1990\nPermanent Account Number\n", pan, "\n")
    form = say("KYC\nGSTIN 27", pan, "1Z5\nBank Account Details: Sample Bank, 99", n, "\nIFSC: SBIN0", five, "1\nmail a", n, "@example.com 98765", five, "\n")
    licence = say("Registration Number : LN", n, "\nDescription of Licensed Premises\nShed ", n, ",\nRose Nagar 600 001\nDigitally signed by Joint Director\n")
    consent = say("Consent Order No. CO", n, "\nS.F. No. ", n, " Rose Village\nAlpha District and more\n")
    month = F.element_at(F.array(*[F.lit(m.upper()) for m in text.MONTHS]), (F.pmod(k, F.lit(12)) + 1).cast("int"))
    company = say("I hereby certify that ", name, " is incorporated on this TWENTY NINTH day of ", month, " TWO THOUSAND SIXTEEN under the Act\nCIN U", five, "MH2016PTC", F.lpad(F.pmod(k, F.lit(1000000)).cast("string"), 6, "0"), "\nThe Permanent Account Number (PAN) is ", pan, "\n")
    texts = {"gst_certificate": gst, "msme_certificate": msme, "cancelled_cheque": cheque, "electricity_bill": bill, "gst_portal": portal, "pan_entity": card, "kyc_form": form, "factory_license": licence, "pcb_certificate": consent, "certificate_of_incorporation": company}
    kind = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod(k, F.lit(len(texts))) + 1).cast("int"))
    body = F.coalesce(*[F.when(F.col("doc_type") == t, c) for t, c in texts.items()])
    return spread(spark, sf_dir, "customer", "c_custkey").withColumn("doc_type", kind).select(k.alias("vendor_id"), k.alias("doc_id"), "doc_type", F.lit(1).alias("seq"), body.alias("text"))


def _fields_sql(kind: int, **fields: str) -> str:
    return " UNION ALL ".join(f"SELECT k AS doc_id, '{f}' AS field, {v} AS value FROM c WHERE k % 10 = {kind}" for f, v in fields.items())


_EXTRACTED_SQL = f"""
    WITH c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS n, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS five, 'ABCFP' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'K' AS pan, 'Alpha Mills ' || c_mktsegment AS name FROM customer)
    {_fields_sql(0, gstin="'27' || pan || '1Z5'", legal_name="name", trade_name="name", constitution="'Partnership'", address="'Plot ' || n || ', Rose Nagar'", date_of_registration="'01/07/2017'", taxpayer_type="'Regular'", state="'Maharashtra'", pan="pan")}
    UNION ALL {_fields_sql(1, udyam_number="'UDYAM-MH-01-00' || five", enterprise_name="name", enterprise_type="'Small'", major_activity="'Manufacturing'", address="'Flat/Door/Block No.: ' || n || ' City: Roseville'", pincode="'600001'", mobile="'9876500000'", nic_5_code="five", nic_5_description="'Manufacture of semi finished plastics'")}
    UNION ALL {_fields_sql(2, ifsc="'SBIN0' || five || '1'", bank_name="'State Bank of India'", account_number="'77' || n", account_holder="upper(name)", cancellation_mark_present="'true'")}
    UNION ALL {_fields_sql(3, consumer_name="name", address="n || ' Rose Road, Roseville'", pincode="'600001'", category="'Industrial'", sanctioned_load="'12.5 KW'")}
    UNION ALL {_fields_sql(4, ifsc="'SBIN0' || five || '1'", account_number="'88' || n", bank_name="'Sample Bank'", account_status="'Active'", type_of_account="'CC'", bank_verified="'true'")}
    UNION ALL {_fields_sql(5, pan="pan", name="name")}
    UNION ALL {_fields_sql(6, gstin="'27' || pan || '1Z5'", ifsc="'SBIN0' || five || '1'", account_number="'99' || n", bank_name="'Sample Bank'", mobile="'98765' || five", email="'a' || n || '@example.com'")}
    UNION ALL {_fields_sql(7, registration_number="'LN' || n", premises_address="'Shed ' || n || ', Rose Nagar 600 001'")}
    UNION ALL {_fields_sql(8, consent_order_no="'CO' || n", premises_address="'S.F. No. ' || n || ' Rose Village Alpha District'")}
    UNION ALL {_fields_sql(9, name="name", cin="'U' || five || 'MH2016PTC' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0')", pan="pan", date_of_incorporation="'29/' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '/2016'")}
"""


@query(_EXTRACTED_SQL)
def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-01..12, DAT-06, STR-09..12: fields of documents of ten types."""
    return extract.extract_fields(_certificates(spark, sf_dir)).select("doc_id", "field", "value")


@query("""WITH d AS (SELECT c_custkey // 7 AS vendor_id, c_custkey AS seq, c_custkey % 10 AS kind, 'U' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') || 'MH2016PTC' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') AS cin FROM customer)
    SELECT vendor_id, arg_min(cin, seq) AS cin FROM d WHERE kind = 9 GROUP BY vendor_id""")
def company_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-16: the company number of groups of documents."""
    docs = _certificates(spark, sf_dir).select(F.floor(F.col("doc_id") / 7).alias("vendor_id"), "doc_type", F.col("doc_id").alias("seq"), "text")
    return extract.company_number(docs)


# ---- resolvers
@query("""WITH c AS (SELECT c_custkey AS k, c_acctbal AS b FROM customer),
    s AS (SELECT *, CASE WHEN b < 0 THEN 'cancelled' WHEN b < 2000 THEN 'suspended' WHEN b < 4500 THEN NULL ELSE 'active' END AS gstin,
        CASE k % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'not_match' WHEN 2 THEN 'minor_discrepancy' ELSE 'not_match' END AS bill FROM c),
    o AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'owned' WHEN bill = 'not_match' THEN 'address_mismatch' WHEN k % 3 = 0 THEN 'rented' WHEN k % 7 = 0 THEN 'address_mismatch' ELSE 'owned' END AS own FROM s),
    p AS (
        SELECT k, 'com_gstin_active' AS parameter_id, gstin AS value FROM o
        UNION ALL SELECT k, 'com_gst_vintage', CASE WHEN k % 7 > 0 THEN NULL WHEN k % 3 = 0 THEN '6.42' END FROM o
        UNION ALL SELECT k, 'com_hsn_match', CASE k % 5 WHEN 0 THEN 'not_available' WHEN 1 THEN 'match' WHEN 2 THEN NULL WHEN 3 THEN 'not_match' ELSE NULL END FROM o
        UNION ALL SELECT k, 'com_bank_verification', CASE WHEN k % 4 = 0 THEN CASE WHEN k % 2 = 0 AND k % 5 >= 2 THEN 'penny_success_gst_match' END WHEN k % 4 = 1 THEN 'penny_unsuccessful' WHEN k % 3 = 0 THEN 'penny_success_gst_unavailable' WHEN k % 3 = 1 THEN 'penny_success_gst_match' ELSE 'penny_success_gst_mismatch' END FROM o
        UNION ALL SELECT k, 'com_pf_filing_status', CASE WHEN k % 3 > 0 THEN NULL WHEN k % 6 = 0 THEN 'compliant' WHEN k % 9 = 0 THEN 'non_compliant' END FROM o
        UNION ALL SELECT k, 'addr_ownership_type', own FROM o
        UNION ALL SELECT k, 'addr_electricity_bill', bill FROM o
        UNION ALL SELECT k, 'addr_rental_validation', CASE WHEN own = 'owned' THEN 'owned' WHEN own = 'rented' AND bill = 'match' THEN 'rented_matching' WHEN own = 'rented' AND bill = 'minor_discrepancy' THEN 'minor_discrepancy' ELSE 'not_match' END FROM o
        UNION ALL SELECT k, 'addr_msme', CASE WHEN k % 5 = 0 THEN 'valid_active' WHEN k % 2 = 0 THEN 'not_valid' WHEN k % 3 = 0 THEN 'valid_active' ELSE 'not_valid' END FROM o
        UNION ALL SELECT k, 'addr_landlord_declaration', CASE WHEN k % 6 = 0 THEN 'present' WHEN own = 'owned' THEN 'not_applicable' ELSE 'absent' END FROM o
        UNION ALL SELECT k, 'ident_pan_active', CASE k % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'not_found' WHEN 2 THEN 'inactive' ELSE CASE WHEN gstin = 'active' THEN 'active' END END FROM o
        UNION ALL SELECT k, 'ident_seller_type', CASE WHEN k % 3 = 0 THEN 'manufacturer' WHEN k % 5 = 0 THEN 'processor' WHEN k % 2 = 0 THEN 'trader' END FROM o
        UNION ALL SELECT k, 'ident_constitution', CASE k % 4 WHEN 0 THEN 'llp' WHEN 1 THEN 'pvt_public_listed' WHEN 2 THEN 'partnership_proprietorship' END FROM o
        UNION ALL SELECT k, 'ident_pan_name_match', CASE k % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'not_match' END FROM o)
    SELECT k AS vendor_id, parameter_id, value, value IS NULL AS unresolved FROM p""")
def resolved_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RES-01, 02, 06, 07, 09..13, 15..19, AGG-20, JN-07, JN-11: values of parameters of every customer."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    of = lambda n, *values: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    divides = lambda n: F.pmod(k, F.lit(n)) == 0
    none = F.lit(None).cast("string")
    entity = spread(spark, sf_dir, "customer", "c_custkey").select(
        k.alias("vendor_id"), F.when(b < 0, "Cancelled suo motu").when(b < 2000, "Suspended").when(b < 4000, "Inactive").when(b >= 4500, "Active").alias("gstin_status"),
        F.when(divides(7) & divides(3), "01/04/1995").alias("oldest_registration"),
        of(5, F.lit(None).cast("array<string>"), F.array(F.lit("3901")), F.array(F.lit("7204"), F.lit("0101")), F.array(F.lit("7010")), F.array(F.lit("0101"))).alias("hsn_codes"),
        of(2, "plastic goods", "plastic toys").alias("nic_5_description"),
        (~divides(4)).alias("bank_called"), F.when(F.pmod(k, F.lit(4)) == 1, "").otherwise("H").alias("bank_holder"), F.lit("1").alias("account_number"), of(3, none, "1", "2").alias("portal_account"),
        divides(2).alias("portal_verified"), F.pmod(k, F.lit(5)).alias("agreeing_accounts"),
        divides(3).alias("has_pf"), F.when(divides(6), "compliant").when(divides(9), "late").alias("pf_flag"), divides(11).alias("has_sale_deed"), divides(3).alias("has_rental"), F.lit(True).alias("has_bill"),
        F.lit("Plot No. 12, Rose Nagar, 600001").alias("address"), of(4, "Plot 12, Rose Nagar", "Plot 13, Rose Nagar", "Rose Nagar", none).alias("bill_address"), F.lit("Asha Traders").alias("legal_name"),
        F.when(divides(7), "Other Mills").otherwise("M/s. Asha Traders").alias("bill_consumer_name"), (F.pmod(k, F.lit(2)) == 0).alias("msme_called"), F.when(divides(5), "U1").alias("msme_number"), F.when(divides(3), "U2").alias("udyam_number"),
        divides(6).alias("has_landlord"), of(4, "VALID", "Invalid", "merged", none).alias("pan_status"), F.when(divides(3), "Factory / Manufacturing").alias("gst_nature"), F.when(divides(5), "38110").alias("nic_5_code"),
        F.when(divides(2), "Wholesale trade").alias("form_activity"), of(4, "Limited Liability Partnership", "Private Limited Company", "Proprietorship", "Trust").alias("constitution"), of(3, "ASHA TRADERS PVT LTD", "Zed Works", none).alias("pan_entity_name"),
    )
    wanted = ("com_gstin_active", "com_gst_vintage", "com_hsn_match", "com_bank_verification", "com_pf_filing_status", "addr_ownership_type", "addr_electricity_bill", "addr_rental_validation", "addr_msme", "addr_landlord_declaration", "ident_pan_active", "ident_seller_type", "ident_constitution", "ident_pan_name_match")
    return resolve.resolve_all(entity, F.to_date(F.lit(AS_OF))).where(F.col("parameter_id").isin(*wanted)).select("vendor_id", "parameter_id", "value", "unresolved")


@query("""WITH v AS (SELECT DISTINCT user_id AS vendor_id FROM events),
    h AS (SELECT user_id AS vendor_id, CASE event_type WHEN 'purchase' THEN 'legal_sanctions' WHEN 'error' THEN 'legal_pep' ELSE 'other' END AS slot, event_type = 'error' AS owner, event_id AS seq, props AS text FROM events WHERE value > 150),
    g AS (SELECT vendor_id, slot, string_agg(text, '; ' ORDER BY owner, seq) AS told FROM h GROUP BY ALL),
    p(parameter_id, bad, good) AS (VALUES ('legal_sanctions', 'listed', 'not_listed'), ('legal_pep', 'pep_identified', 'no_pep'), ('legal_rbi_wilful_defaulter', 'listed', 'not_listed'), ('legal_ecourts', 'active_criminal', 'no_criminal'), ('legal_drt_sarfaesi', 'active_drt', 'no_drt')),
    r AS (SELECT v.vendor_id, p.parameter_id, CASE WHEN told IS NOT NULL THEN bad WHEN v.vendor_id % 3 = 0 THEN good WHEN v.vendor_id % 2 = 0 THEN 'free' END AS value,
          CASE WHEN told IS NOT NULL THEN told WHEN v.vendor_id % 3 = 0 THEN 'a comprehensive sweep found no match' WHEN v.vendor_id % 2 = 0 THEN 'free lists' ELSE '' END AS note
          FROM v CROSS JOIN p LEFT JOIN g ON g.vendor_id = v.vendor_id AND g.slot = p.parameter_id),
    q AS (SELECT r.*, CASE WHEN parameter_id = 'legal_sanctions' THEN told END AS other FROM r LEFT JOIN g ON g.vendor_id = r.vendor_id AND g.slot = 'other')
    SELECT vendor_id, parameter_id, CASE WHEN other IS NOT NULL AND value IS DISTINCT FROM 'listed' THEN 'adverse_watchlist' ELSE value END AS value,
        CASE WHEN other IS NULL THEN note WHEN value = 'listed' THEN note || ' | ALSO: ' || other
             ELSE 'WATCHLIST HIT (confirm or dismiss): ' || other || CASE WHEN value IS NULL OR note = '' THEN '' ELSE ' | sanctions lists: ' || note END END AS note,
        other IS NULL AND value IS NULL AS unresolved FROM q""")
def aml_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, RES-20..23, SET-04: legal parameters of every user from events as hits of the firm and of its owner."""
    e = table(spark, sf_dir, "events")
    vendors = e.select(F.col("user_id").alias("vendor_id")).distinct()
    hit = e.where("value > 150").select(F.col("user_id").alias("vendor_id"), F.col("event_type"), F.col("event_id").alias("seq"), F.col("props").alias("text"))
    slot = F.when(F.col("event_type") == "purchase", "legal_sanctions").when(F.col("event_type") == "error", "legal_pep").otherwise("other")
    both = cases.union_hits(hit.where("event_type <> 'error'"), hit.where("event_type = 'error'"))
    hits = both.select("vendor_id", slot.alias("slot"), (F.col("screened") == "owner").alias("owner"), "seq", "text")
    sweeps = vendors.select("vendor_id", (F.pmod("vendor_id", F.lit(3)) == 0).alias("comprehensive"))
    free = vendors.where("vendor_id % 2 = 0").select("vendor_id", F.explode(F.array(*[F.lit(p) for p in screening.VERDICTS])).alias("parameter_id"), F.lit("free").alias("value"), F.lit("free lists").alias("note"))
    return screening.resolve_legal(vendors, hits, sweeps, free, hits.where("false").select("vendor_id", "owner", "seq", "text"))


# ---- registry
@query("""SELECT k AS vendor_id, endpoint, key FROM (SELECT c_custkey AS k FROM customer) c, LATERAL (
        SELECT 'bank' AS endpoint, CAST(k AS VARCHAR) || '|I' AS key WHERE k % 2 = 0 UNION ALL SELECT 'detail', 'G' || k WHERE k % 3 > 0
        UNION ALL SELECT e, CASE k % 4 WHEN 0 THEN 'ABCFP1234K' WHEN 1 THEN 'ABCPP1234K' ELSE 'ABCCP1234K' END FROM (VALUES ('by_pan'), ('msme'), ('screening')) t(e) WHERE k % 4 < 3
        UNION ALL SELECT e, 'U' || k FROM (VALUES ('company_page'), ('company_entity')) t(e) WHERE k % 5 = 0
        UNION ALL SELECT 'firm', CASE k % 4 WHEN 0 THEN 'ABCFP1234K' ELSE 'ABCPP1234K' END WHERE k % 5 > 0 AND k % 4 < 2
        UNION ALL SELECT 'owner_screening', 'O' || k WHERE k % 6 = 0)""")
def lookup_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08, STR-12: the registry calls that every customer's identifiers allow."""
    k = F.col("c_custkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    entity = table(spark, sf_dir, "customer").select(
        k.alias("vendor_id"), F.when(mod(2) == 0, k.cast("string")).alias("account_number"), F.lit("I").alias("ifsc"), F.when(mod(3) > 0, F.concat(F.lit("G"), k.cast("string"))).alias("gstin"),
        F.when(mod(4) == 0, "ABCFP1234K").when(mod(4) == 1, "ABCPP1234K").when(mod(4) == 2, "ABCCP1234K").alias("pan"),
        F.when(mod(5) == 0, F.concat(F.lit("U"), k.cast("string"))).alias("cin"), F.when(mod(6) == 0, F.concat(F.lit("O"), k.cast("string"))).alias("pan_owner_pan"),
    )
    return registry.lookup_plan(entity)


@query("""SELECT vendor_id, o_orderkey AS doc_id FROM (SELECT o_custkey AS vendor_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'F') WHERE nth = 1""")
def anchor_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08: each customer's first order of a state."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vendor_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("doc_type"))
    return registry.anchor_doc(docs, "F").select("vendor_id", "doc_id")


@query("""SELECT vendor_id, o_orderkey, CAST(place AS INT) AS place, greatest(n - 3, 0) AS more FROM (SELECT o_custkey AS vendor_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE place <= 3""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-03: the three dearest orders of each customer and how many more there are."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vendor_id"), "o_orderkey", "o_totalprice")
    return registry.top_rows(rows, ["vendor_id"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("vendor_id", "o_orderkey", "place", "more")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unreadable' WHEN o_orderstatus = 'F' THEN 'read' WHEN o_orderstatus = 'O' THEN 'partial' ELSE 'poor' END AS quality, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'account_number' ELSE 'ifsc,account_number' END AS missing FROM orders""")
def read_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: what a document's reading lacks."""
    found = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("ifsc"), F.lit("account_number"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("ifsc")))
    reads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("cancelled_cheque").alias("doc_type"), (F.pmod("o_orderkey", F.lit(7)) != 0).alias("confident"), found.alias("found"))
    return registry.assess_reads(reads).select("doc_id", "quality", F.array_join("missing", ",").alias("missing"))


@query("""WITH f AS (SELECT o_custkey AS v, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders GROUP BY o_custkey), u AS (SELECT o_custkey AS v, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
    SELECT c_custkey AS vendor_id, coalesce(states, '') AS states, coalesce(urgent, '') AS urgent FROM customer LEFT JOIN f ON f.v = c_custkey LEFT JOIN u ON u.v = c_custkey""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: lists of each customer's states and urgent orders in one row."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vendor_id"), "o_orderstatus", "o_orderkey", "o_orderpriority")
    rows = registry.run_summary(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id")),
        states=o.select("vendor_id", F.col("o_orderstatus").alias("item")).distinct(), urgent=o.where("o_orderpriority = '1-URGENT'").select("vendor_id", F.col("o_orderkey").cast("string").alias("item")),
    )
    return rows.select("vendor_id", F.array_join("states", ",").alias("states"), F.array_join("urgent", ",").alias("urgent"))


@query("""WITH l AS (SELECT user_id AS vendor_id, event_type, arg_max(props, event_id) AS data FROM events GROUP BY ALL)
    SELECT u.vendor_id, (SELECT data FROM l WHERE l.vendor_id = u.vendor_id AND event_type = 'view') AS view, (SELECT data FROM l WHERE l.vendor_id = u.vendor_id AND event_type = 'purchase') AS purchase FROM (SELECT DISTINCT user_id AS vendor_id FROM events) u""")
def attached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01: the latest answer of two endpoints beside each user."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy(F.col("user_id").alias("vendor_id"), F.col("event_type").alias("endpoint")).agg(F.max_by("props", "event_id").alias("data"))
    return registry.attach_registry(e.select(F.col("user_id").alias("vendor_id")).distinct(), last, ["view", "purchase"])


@query("""SELECT user_id AS vendor_id, event_type AS endpoint, 'k: ' || json_extract_string(props, '$.k') AS error FROM events WHERE event_type = 'refund' UNION ALL SELECT user_id, event_type, 'status 503' FROM events WHERE event_type = 'error'""")
def call_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-09: failed calls, and errors inside good answers."""
    data = F.parse_json(F.when(F.col("event_type") == "refund", F.concat(F.lit('{"errors": '), "props", F.lit("}"))).otherwise("{}"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("vendor_id"), F.col("event_type").alias("endpoint"), (F.col("event_type") == "error").alias("failed"), F.lit(503).alias("http_status"), data.alias("data"))
    return registry.registry_errors(rows)


# ---- screening
@query("""WITH t AS (SELECT user_id, event_type, count(*) FILTER (value > 100) AS n FROM events GROUP BY ALL)
    SELECT e.user_id AS vendor_id, e.event_type AS category, CAST(event_id AS VARCHAR) AS id, CASE e.event_type WHEN 'error' THEN 'legal_pep' WHEN 'purchase' THEN 'legal_ecourts' WHEN 'refund' THEN 'legal_rbi_wilful_defaulter' ELSE 'other' END AS slot
    FROM events e JOIN t ON t.user_id = e.user_id AND t.event_type = e.event_type WHERE n > 0""")
def listed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-11, PRJ-12: rows of categories with a positive counter, and the parameter each belongs to."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("vendor_id"), "event_type", "value", F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("row"))
    per = e.groupBy("vendor_id", "event_type").agg(F.collect_list("row").alias("rows"), F.count_if(F.col("value") > 100).cast("int").alias("n"))
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("event_type", c)))
    responses = per.groupBy("vendor_id").agg(entries("rows").alias("categories"), entries("n").alias("hits_found"))
    kind = F.when(F.col("category") == "error", "PEPCheck").when(F.col("category") == "refund", "CIBIL suits").otherwise("Lists")
    listed = F.when(F.col("category") == "purchase", "High Court orders").otherwise("x")
    return screening.hit_rows(responses).select("vendor_id", "category", F.col("row")["id"].alias("id"), screening.classify_hit(kind, listed).alias("slot"))


@query("""SELECT user_id AS vendor_id, event_type AS list_name, count(*) AS n_rows, string_agg(DISTINCT CASE WHEN value > 100 THEN 'another id' ELSE 'another name' END, ',' ORDER BY CASE WHEN value > 100 THEN 'another id' ELSE 'another name' END) AS reasons FROM events WHERE value > 50 GROUP BY ALL""")
def dismissed_namesakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06, AGG-08: hits of someone else by their id or name, and their reasons per list."""
    ids = F.when(F.col("value") > 100, F.array(F.lit("AAAAA1111B"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("vendor_id"), F.col("event_type").alias("list_name"), ids.alias("own_ids"), F.lit("ABCFP1234K").alias("vendor_pan"), F.lit("Asha Traders").alias("entity_name"),
        F.when(F.col("value") > 50, "Quill Forge").otherwise("Asha Traders").alias("matched_name"),
    )
    out = screening.summarize_dismissed(match.dismiss_namesakes(rows).where("reason is not null"))
    return out.select("vendor_id", "list_name", "n_rows", F.array_join("reasons", ",").alias("reasons"))


@query(r"""WITH o AS (SELECT s_suppkey AS vendor_id, upper(trim(p_name)) AS name FROM supplier JOIN part ON p_partkey = s_suppkey),
    s AS (SELECT p_partkey AS case_id, 'X' || upper(trim(p_name)) || 'Z' AS party FROM part WHERE p_partkey % 2 = 0)
    SELECT vendor_id, count(DISTINCT case_id) AS rejected FROM o JOIN s ON contains(party, name) WHERE length(name) >= 4
    AND NOT list_has_any(regexp_extract_all(lower(name), '\b[a-z0-9]{3,}\b'), regexp_extract_all(lower(party), '\b[a-z0-9]{3,}\b')) GROUP BY vendor_id""")
def rejected_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-04: cases whose party holds a supplier's name only inside longer words."""
    part = table(spark, sf_dir, "part")
    names = table(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("vendor_id"), F.col("p_name").alias("name"))
    docket = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("case_id"), F.concat(F.lit("x"), F.trim("p_name"), F.lit("z")).alias("applicant"), F.lit(None).cast("string").alias("respondent"))
    return cases.screen_cases(names, docket)[1]


@query("""SELECT c_custkey AS vendor_id, count(s_suppkey) AS hits, CASE WHEN count(s_suppkey) > 0 THEN 'pep_identified' ELSE 'no_pep' END AS value, 'second source not read' AS gap FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey GROUP BY c_custkey""")
def screened_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05: customers as persons against suppliers as office-holders, without the second list."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id"), F.concat(F.lit("Shri Ab"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("name"))
    listed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Ab"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("name"))
    return cases.screen_persons(own, listed, None)


@query("""SELECT o_custkey AS vendor_id, 'Firm ' || o_custkey || ';' || string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS names, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS persons FROM orders GROUP BY o_custkey""")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02, SET-07: a firm's names and people without repeats, the first source's people where it names any."""
    people = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("vendor_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    firm = F.concat(F.lit("Firm "), F.col("vendor_id").cast("string"))
    some = cases.partners(F.filter("p", lambda x: x == "none"), F.concat("p", F.transform("p", lambda x: F.lower(x))))
    rows = people.select("vendor_id", F.array(firm, F.upper(firm)).alias("own"), some.alias("people"))
    return cases.screening_names(rows).select("vendor_id", F.array_join("names", ";").alias("names"), F.array_join("persons", ";").alias("persons"))


# ---- pages, documents
@query("""WITH t AS (SELECT l_orderkey AS doc_id, [0, 180, 90, 270][l_linenumber % 4 + 1] AS angle, l_linenumber % 4 AS place, (l_partkey % 4 + 1) / 4.0 AS conf, CAST(l_quantity AS INT) AS n FROM lineitem),
    s AS (SELECT doc_id, angle, place, sum(n) AS chars, sum(n) >= 120 AND sum(n * conf) / sum(n) >= 0.6 AS sure FROM t WHERE conf >= 0.4 GROUP BY ALL),
    w AS (SELECT *, min(place) FILTER (sure) OVER (PARTITION BY doc_id) AS stop FROM s)
    SELECT doc_id, arg_max(angle, (chars, -place)) AS angle FROM w WHERE stop IS NULL OR place <= stop GROUP BY doc_id""")
def best_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, WIN-04: the angle that reads best, of passes up to the first confident one."""
    angle = F.element_at(F.array(*[F.lit(a) for a in ocr.ANGLES]), (F.pmod("l_linenumber", F.lit(4)) + 1).cast("int"))
    tokens = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), angle.alias("angle"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"), ((F.pmod("l_partkey", F.lit(4)) + 1) / 4.0).alias("conf"),
    )
    return ocr.best_rotation(ocr.pass_stats(tokens)).select("doc_id", "angle")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN iou_w <= 0 OR iou_h <= 0 THEN 0.0 ELSE iou_w * iou_h / (q * q + 625 - iou_w * iou_h) END AS iou
    FROM (SELECT *, l_quantity AS q, least(x + l_quantity, 25) - greatest(x, 0) AS iou_w, least(l_quantity, 25) AS iou_h FROM (SELECT *, CAST(l_partkey % 40 AS DOUBLE) AS x FROM lineitem))""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-01: overlap of boxes with a fixed one."""
    x, q = F.pmod("l_partkey", F.lit(40)).cast("double"), F.col("l_quantity")
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    mine, fixed = box(x, F.lit(0.0), x + q, q), box(F.lit(0.0), F.lit(0.0), F.lit(25.0), F.lit(25.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.iou(mine, fixed).alias("iou"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'native' WHEN length(trim(text)) >= 21 THEN 'ocr' END IS NOT NULL AS has_text,
    CASE WHEN doc_id % 5 = 0 THEN 'unavailable' WHEN doc_id % 3 = 0 THEN 'native' WHEN length(trim(coalesce(text, ''))) >= 21 THEN 'ocr' ELSE 'unavailable' END AS method,
    (length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) < 30) OR (length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) < 300 AND doc_id % 2 = 0) AS scan FROM documents""".replace("\\\\", "\\"))
def text_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, PRJ-18: which tier gives a document's text, and is its page a scan?"""
    d = table(spark, sf_dir, "documents")
    native, read = F.when(F.expr("doc_id % 3 = 0 and doc_id % 5 <> 0"), "text layer"), F.when(F.expr("doc_id % 5 <> 0"), F.col("text"))
    chosen = classify.choose_text([("native", native), ("ocr", read)])
    cover = F.when(F.expr("doc_id % 2 = 0"), 0.9).otherwise(0.1)
    return d.select("doc_id", chosen.alias("c"), classify.page_is_scan(F.col("text"), cover).alias("scan")).select("doc_id", F.col("c.text").isNotNull().alias("has_text"), "c.method", "scan")


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 3 THEN 'pan_owner' ELSE 'pan_entity' END AS doc_type FROM customer""")
def routed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05, STR-09: the entity's own card, a garbled or unreadable one, and another person's."""
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    cards = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("pan_entity").alias("doc_type"), F.lit("ABCFP1234K").alias("entity_pan"), pick("ABCFP1234K", "ABCFP1284K", None, "QWEPR9876Z").alias("card_pan"), pick("ABCFP1234K", "no ABCFP12B4K", "unreadable", "card QWEPR9876Z").alias("text"))
    return classify.route_id_cards(cards).select("doc_id", "doc_type")


@query("""SELECT o_custkey AS vendor_id, CAST(o_orderkey AS VARCHAR) AS file_name, CASE WHEN o_orderkey % 5 = 1 THEN 'kyc_form' ELSE o_orderstatus END AS doc_type FROM orders WHERE o_orderkey % 5 > 0""")
def retyped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-04: documents that an analyst moved to another type or dropped."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vendor_id"), F.col("o_orderkey").cast("string").alias("file_name"), F.col("o_orderstatus").alias("doc_type"))
    moves = docs.where("file_name % 5 < 2").select("vendor_id", "file_name", F.expr("if(file_name % 5 = 0, 'Ignore', ' KYC_form ')").alias("doc_type"))
    return classify.apply_doc_overrides(docs, moves)[0]


@query("""SELECT c_custkey AS vendor_id, 'a=' || CASE WHEN c_custkey % 3 = 0 THEN '2' ELSE '1' END || CASE WHEN c_custkey % 3 = 2 THEN '' ELSE ',b=3' END AS read FROM customer""")
def chosen_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-17: the second reading where it recovers more, the first one's values winning."""
    k = F.col("c_custkey")
    first = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit("2"))).when(k % 3 == 1, F.create_map(F.lit("a"), F.lit("1"))).otherwise(F.create_map(F.lit("a"), F.lit("1")))
    second = F.when(k % 3 == 2, F.create_map(F.lit("a"), F.lit("9"))).otherwise(F.create_map(F.lit("a"), F.lit("9"), F.lit("b"), F.lit("3")))
    got = classify.choose_read(first, second, F.array(F.lit("a"), F.lit("b")))
    entries = F.array_sort(F.transform(F.map_entries(got), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, sf_dir, "customer").select(k.alias("vendor_id"), F.array_join(entries, ",").alias("read"))


@query("""SELECT vendor_id, CASE WHEN vendor_id % 3 > 0 THEN 'U' || vendor_id END AS cin, vendor_id % 3 = 0 AS warned FROM (SELECT c_custkey AS vendor_id FROM customer)""")
def kept_company_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-16: company numbers only where the constitution has one."""
    k = F.col("c_custkey")
    form = F.when(k % 3 == 0, "Partnership").when(k % 3 == 1, "Private Limited Company")
    entity = table(spark, sf_dir, "customer").select(k.alias("vendor_id"), form.alias("constitution"), F.concat(F.lit("U"), k.cast("string")).alias("cin"))
    return extract.keep_company_number(entity).select("vendor_id", "cin", F.col("warning").isNotNull().alias("warned"))


# ---- text
@query("""SELECT o_orderkey AS k, '27ABCFP1234K1Z5'[3:12] AS pan, CASE o_orderkey % 2 WHEN 0 THEN 'firm' ELSE 'company' END AS category, CASE WHEN o_orderkey % 3 = 0 THEN 'Maharashtra' WHEN o_orderkey % 3 = 1 THEN 'Gujarat' END AS state,
    'SBIN0' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS ifsc, CASE o_orderkey % 4 WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'processor' WHEN 2 THEN 'trader' END AS nic, CASE o_orderkey % 4 WHEN 0 THEN 'llp' WHEN 1 THEN 'pvt_public_listed' WHEN 2 THEN 'partnership_proprietorship' END AS constitution FROM orders""")
def id_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10..12: what identifiers and codes say."""
    k = F.col("o_orderkey")
    of = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    code = F.concat(F.lit("bank: sbino"), F.lpad(F.pmod(k, F.lit(1000000)).cast("string"), 6, "0"))
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), text.pan_from_gstin(F.lit("27ABCFP1234K1Z5")).alias("pan"), text.pan_category(of(2, "ABCFP1234K", "ABCCP1234K")).alias("category"), text.state_from_gstin(of(3, "27A", "24A", "99A")).alias("state"),
        text.fix_ifsc(code).alias("ifsc"), text.seller_type_nic(of(4, "22209", "38110", "46620", "01110")).alias("nic"), text.constitution(of(4, "An LLP", "Public Limited", "HUF", "Society")).alias("constitution"),
    )


@query("""SELECT s_suppkey AS k, '&lt;a&amp;' || s_suppkey || '&gt;' AS escaped, 'a-b-' || s_suppkey AS slug, 'File ' || s_suppkey AS head, 'no page' AS detail, CAST(s_suppkey AS VARCHAR) AS number, 'x|y' AS items, s_suppkey || '=First goods|77=' AS pairs,
    'WARNING: see line ' || s_suppkey || '.' AS headline, 'Rose Bank' AS bank, CAST(s_suppkey AS VARCHAR) AS code, s_suppkey || ', Roseville' AS address, 'a trader' AS name FROM supplier""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02, STR-13..18, JSN-04: escaped, shortened, split and cleaned texts."""
    k = F.col("s_suppkey").cast("string")
    flag, pairs = text.split_flag(F.concat(F.lit("File "), k, F.lit(": no page"))), text.parse_pairs(F.concat(k, F.lit(" - First goods; ; 77 ")))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), text.escape_html(F.concat(F.lit("<a&"), k, F.lit(">"))).alias("escaped"), text.slug(F.concat(F.lit(" A & B: "), k)).alias("slug"), flag["head"].alias("head"), flag["detail"].alias("detail"),
        text.fmt_value(F.concat(k, F.lit(".0"))).alias("number"), F.array_join(text.parse_override(F.lit(" x;; y ")), "|").alias("items"), F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["code"], p["description"])), "|").alias("pairs"),
        text.headline(F.concat(F.lit("No. 5 is fine. WARNING: see line "), k, F.lit(". Rest."))).alias("headline"), text.clean_bank(F.lit("ROSE  BANK LTD.")).alias("bank"), text.split_code(F.concat(k, F.lit(" - Goods")))["code"].alias("code"),
        text.display_address(F.concat(F.lit("Building No./Flat No.: "), k, F.lit(", Block: -, City: Roseville"))).alias("address"), text.strip_honorifics(F.lit("Late Shri. A Trader")).alias("name"),
    )


@query("""SELECT o_orderkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, strftime(o_orderdate, '%d/%m/%Y') AS dmy, strftime(CASE WHEN year(o_orderdate) < 2000 THEN o_orderdate - INTERVAL (year(o_orderdate) - 1995) YEAR ELSE o_orderdate END, '05/%m/') || CASE WHEN year(o_orderdate) < 2000 THEN '1995' ELSE '2023' END AS spelt FROM orders""")
def filing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-02, DAT-06: periods from month names and fiscal years, dates spelt in words."""
    d = F.col("o_orderdate")
    first = F.year(d) - F.when(F.month(d) >= 4, 0).otherwise(1)
    year = F.concat_ws("-", first.cast("string"), (first + 1).cast("string"))
    words = F.concat(F.lit("this FIFTH day of "), F.upper(F.date_format(d, "MMMM")), F.when(F.year(d) < 2000, " ONE THOUSAND NINE HUNDRED NINETY FIVE").otherwise(" TWO THOUSAND TWENTY THREE"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.period_start(F.date_format(d, "MMMM"), year).alias("period"), text.to_dmy(F.date_format(d, "yyyy-MM-dd")).alias("dmy"), text.spelt_date(words).alias("spelt"))


@query("""SELECT user_id AS vendor_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_type <> 'purchase', event_id) AS codes FROM events WHERE event_type IN ('purchase', 'refund') GROUP BY user_id""")
def goods_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-01: codes of goods, then of services."""
    part = lambda kind: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.col("event_id"))))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vendor_id")).agg(part("purchase").alias("g"), part("refund").alias("s"))
    codes = lambda c: F.concat(F.transform(c, lambda i: F.struct(i.cast("string").alias("code"), F.lit("").alias("description"))), F.array(F.struct(F.lit(" ").alias("code"), F.lit("none").alias("description"))))
    listed = rows.select("vendor_id", text.hsn_rows(codes("g"), codes("s")).alias("r")).where(F.size("r") > 0)
    return listed.select("vendor_id", F.array_join(F.transform("r", lambda r: r["code"]), ",").alias("codes"))


# ---- review
_FINDING_SQL = """
    WITH f AS (SELECT user_id AS vendor_id, CAST(day(ts) AS BIGINT) AS pass, event_id AS ord, CASE event_type WHEN 'view' THEN 'a' WHEN 'purchase' THEN 'n' ELSE 'q' END AS parameter_id, CASE WHEN value < 40 THEN NULL WHEN value < 80 THEN 'y' WHEN value < 120 THEN '7' ELSE 'zz' END AS proposed, value > 20 AS verified FROM events),
    r AS (SELECT *, CASE WHEN NOT verified THEN 'not a verified correction' WHEN parameter_id = 'q' THEN 'unknown parameter' WHEN proposed IS NULL AND vendor_id % 2 = 0 THEN 'no value to note on' WHEN parameter_id = 'n' AND proposed IN ('y', 'zz') THEN 'not a number' WHEN parameter_id = 'a' AND proposed IN ('7', 'zz') THEN 'not an allowed value' END AS reason FROM f)
"""


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, v = table(spark, sf_dir, "events"), F.col("value")
    code = F.when(F.col("event_type") == "view", " ab-01 ").when(F.col("event_type") == "purchase", "AB-02").otherwise("q")
    rows = e.select(
        F.col("user_id").alias("vendor_id"), F.dayofmonth("ts").cast("long").alias("pass"), F.col("event_id").alias("ord"), code.alias("parameter_id"), F.when(v < 40, " ").when(v < 80, "y").when(v < 120, "7").otherwise("zz").alias("proposed_value"),
        F.col("props").alias("proposed_note"), F.when(v > 20, "verified").otherwise("likely").alias("confidence"), F.lit("correct").alias("action"),
    )
    codes = spark.createDataFrame([("AB-01", "a"), ("AB-02", "n")], "code string, parameter_id string")
    resolved = e.select(F.col("user_id").alias("vendor_id")).distinct().select("vendor_id", F.explode(F.array(F.lit("a"), F.lit("n"))).alias("parameter_id"), F.when(F.col("vendor_id") % 2 > 0, "x").alias("value"), F.lit("").alias("note"))
    specs = spark.createDataFrame([("a", False, ["x", "y"]), ("n", True, [])], "parameter_id string, numeric boolean, buckets array<string>")
    return review.route_corrections(review.normalise_codes(rows, codes), resolved, specs), resolved


@query(_FINDING_SQL + "SELECT ord, parameter_id, reason, CASE WHEN reason IS NOT NULL THEN 'escalate' WHEN proposed IS NULL THEN 'note_only' ELSE 'apply' END AS route FROM r")
def routed_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15, JN-16: which of the reviewers' findings may be applied."""
    return _findings(spark, sf_dir)[0].select("ord", "parameter_id", "reason", "route")


@query(_FINDING_SQL + """, l AS (SELECT vendor_id, parameter_id, arg_max(coalesce(proposed, ''), (pass, ord)) AS v FROM r WHERE reason IS NULL GROUP BY ALL),
    s AS (SELECT DISTINCT vendor_id, p AS parameter_id, CASE WHEN vendor_id % 2 > 0 THEN 'x' END AS value FROM f, (VALUES ('a'), ('n')) t(p))
    SELECT vendor_id, parameter_id, coalesce(nullif(v, ''), value) AS value FROM s LEFT JOIN l USING (vendor_id, parameter_id)""")
def corrected_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16: parameters after the latest correction that applies."""
    routed, resolved = _findings(spark, sf_dir)
    return review.apply_corrections(resolved, routed).select("vendor_id", "parameter_id", "value")


@query("""SELECT o_orderkey AS vendor_id, CASE o_orderkey % 3 WHEN 0 THEN 'com_gst_delay_days' WHEN 1 THEN 'com_gst_filing_compliance' ELSE 'gone' END AS parameter_id, CASE o_orderkey % 3 WHEN 0 THEN 'not a number' WHEN 1 THEN 'not an allowed value' ELSE 'unknown parameter' END AS problem FROM orders WHERE o_orderkey % 3 = 2 OR o_orderstatus = 'O'""")
def override_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OVR-01, OVR-04: overrides that the scoring model cannot take."""
    rules = spark.createDataFrame(RULES, "parameter_id string, ordinal int, expr string, condition string, assigned_score double")
    k = F.pmod("o_orderkey", F.lit(3))
    value = F.when(F.col("o_orderstatus") == "O", "late").when(F.col("o_orderstatus") == "P", " Unresolved").otherwise(F.when(k == 0, "12").otherwise(" Timely"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vendor_id"), F.when(k == 0, "com_gst_delay_days").when(k == 1, "com_gst_filing_compliance").otherwise("gone").alias("parameter_id"), value.alias("analyst_value"))
    return review.validate_overrides(rows, score.param_specs(rules))


@query("""SELECT conv_id AS vendor_id, turn AS pass, CASE WHEN role = 'user' AND turn < 4 THEN 'llm_review' ELSE 'finalize' END AS route, role = 'assistant' AS approved FROM conversations""")
def review_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REV-02: is there another pass after this one?"""
    verdict = F.when(F.col("role") == "user", "needs_another_pass").when(F.col("role") == "assistant", "approved").otherwise("other")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("vendor_id"), F.col("turn").alias("pass"), verdict.alias("verdict"))
    return review.route_passes(rows).select("vendor_id", "pass", "route", "approved")


@query("""SELECT conv_id AS vendor_id, turn AS pass, CAST(i AS INT) AS ord, CASE i WHEN 0 THEN 'human' ELSE 'ai' END AS kind, CASE i WHEN 0 THEN text ELSE coalesce(text || chr(10), '') || role END AS text, CASE i WHEN 0 THEN '' ELSE 'look' END AS calls FROM conversations, (VALUES (0), (1)) t(i)""")
def trace_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REV-03: messages of traces, plain or in parts."""
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    call = F.array(F.struct(F.lit("look").alias("name")))
    one = F.struct(F.lit("human").alias("type"), F.col("text").alias("content"), F.array().cast("array<struct<type:string,text:string>>").alias("parts"), F.slice(call, 1, 0).alias("tool_calls"))
    two = F.struct(F.lit("ai").alias("type"), F.lit(None).cast("string").alias("content"), F.array(part("text", F.col("text")), part("image", F.lit("x")), part("text", F.col("role"))).alias("parts"), call.alias("tool_calls"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("vendor_id"), F.col("turn").alias("pass"), F.array(one, two).alias("messages"))
    return review.flatten_messages(rows).select("vendor_id", "pass", "ord", "kind", "text", F.array_join("tool_calls", ",").alias("calls"))


@query("""SELECT user_id AS vendor_id, string_agg(p || ' = ' || v, chr(10) ORDER BY p) AS text FROM (SELECT user_id, event_type AS p, coalesce(CAST(count(*) FILTER (value > 150) AS VARCHAR), '') AS v FROM events GROUP BY ALL) GROUP BY user_id""")
def state_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REV-04: a line per parameter as one text."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vendor_id"), F.col("event_type").alias("parameter_id")).agg(F.count_if(F.col("value") > 150).cast("string").alias("value"))
    return review.state_text(rows)


@query("""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 2 WHEN 0 THEN 'rented' ELSE 'owned' END AS o, CASE c_custkey % 3 WHEN 0 THEN 'match' ELSE 'not_match' END AS b FROM customer)
    SELECT k AS vendor_id, 'addr_ownership_type' AS parameter_id, o AS value FROM c UNION ALL SELECT k, 'addr_electricity_bill', b FROM c
    UNION ALL SELECT k, 'addr_rental_validation', CASE WHEN k % 5 = 0 THEN 'owned' WHEN o = 'owned' THEN 'owned' WHEN b = 'match' THEN 'rented_matching' ELSE 'not_match' END FROM c
    UNION ALL SELECT k, 'addr_landlord_declaration', CASE WHEN o = 'owned' THEN 'not_applicable' ELSE 'absent' END FROM c""")
def rederived_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OVR-02, RES-12, RES-15: address rows after their sources changed, but for those overridden themselves."""
    k = F.col("c_custkey")
    row = lambda p, v: F.struct(F.lit(p).alias("parameter_id"), v.alias("value"))
    each = F.array(row("addr_ownership_type", F.when(k % 2 == 0, "rented").otherwise("owned")), row("addr_electricity_bill", F.when(k % 3 == 0, "match").otherwise("not_match")), row("addr_rental_validation", F.lit("owned")), row("addr_landlord_declaration", F.lit("not_applicable")))
    state = table(spark, sf_dir, "customer").select(k.alias("vendor_id"), F.explode(each).alias("r")).select("vendor_id", "r.*")
    return review.rederive_address(state, state.where("parameter_id = 'addr_rental_validation' and vendor_id % 5 = 0"))


@query(f"""{_SCORE_SQL}, o AS (SELECT vendor_id, parameter_id, CASE WHEN parameter_id = 'ident_balance' AND vendor_id % 4 = 0 THEN 8.0 ELSE assigned_score END AS a, max_score FROM p)
    SELECT vendor_id, CAST(sum(a) AS DOUBLE) AS total, CAST(sum(max_score) AS DOUBLE) AS max_total, CAST(sum(a) AS DOUBLE) AS report_total FROM o GROUP BY vendor_id""")
def previewed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OVR-03: scores as they would be if every fourth customer's balance were set by an analyst."""
    rules = spark.createDataFrame(RULES, "parameter_id string, ordinal int, expr string, condition string, assigned_score double")
    params = spark.createDataFrame(PARAMS, "category_id string, parameter_id string, param_ord int, max_score double, conditional boolean")
    fresh = _param_scores(spark, sf_dir).select("vendor_id", "parameter_id", "value")
    vendors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id"))
    overrides = vendors.where("vendor_id % 4 = 0").select("vendor_id", F.lit("ident_balance").alias("parameter_id"), F.lit("9999").alias("analyst_value"), F.lit(None).cast("string").alias("issued_original"))
    return review.preview_scores(fresh, fresh.where("false"), overrides, params, rules, vendors)


# ---- reports
@query(f"""{_SCORE_SQL} SELECT vendor_id, parameter_id, CASE parameter_id WHEN 'com_gst_filing_compliance' THEN 'COM-01' WHEN 'com_gst_delay_days' THEN 'COM-02' ELSE 'POI-01' END AS code, CAST(assigned_score AS DOUBLE) AS assigned_score, CAST(max_score AS DOUBLE) AS max_score FROM p""")
def scoring_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-01, WIN-02: points per parameter under its display code."""
    params = spark.createDataFrame(PARAMS, "category_id string, parameter_id string, param_ord int, max_score double, conditional boolean")
    rows = report.scoring_rows(_param_scores(spark, sf_dir), score.display_codes(params))
    return rows.select("vendor_id", "parameter_id", "code", "assigned_score", "max_score")


@query("""SELECT c_custkey AS vendor_id, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'GST active' END, CASE WHEN c_custkey % 3 = 0 THEN 'PAN matched' END], lambda x: x IS NOT NULL), ',') AS chips FROM customer""")
def earned_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-03: chips of values that earn them."""
    k = F.col("c_custkey")
    row = lambda p, v: F.struct(F.lit(p).alias("parameter_id"), v.alias("value"))
    each = F.array(row("com_gstin_active", F.when(k % 2 == 0, "active")), row("ident_pan_name_match", F.when(k % 3 == 0, "match").otherwise("not_match")))
    rows = table(spark, sf_dir, "customer").select(k.alias("vendor_id"), F.explode(each).alias("r")).select("vendor_id", "r.*")
    return report.chips(rows).select("vendor_id", F.array_join("chips", ",").alias("chips"))


@query("""SELECT c_custkey AS vendor_id, CAST(i AS INT) AS ordinal, l AS label, v AS value FROM customer, LATERAL (VALUES (0, 'Name', c_name), (1, 'Segment', CASE WHEN c_nationkey > 5 THEN c_mktsegment END), (2, 'Nation', CAST(c_nationkey AS VARCHAR))) t(i, l, v) WHERE v IS NOT NULL""")
def entity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-04: labelled fields that have a value."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id"), "c_name", F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).otherwise("").alias("seg"), "c_nationkey")
    return report.entity_rows(rows, {"c_name": "Name", "seg": "Segment", "c_nationkey": "Nation", "gone": "Gone"})


@query("""SELECT c_custkey AS vendor_id, c_name || '; in ' || c_mktsegment || '.' AS text FROM customer""")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-05: what is known of each customer in one line."""
    return report.profile(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id"), F.col("c_name").alias("legal_name"), F.col("c_mktsegment").alias("state"), F.lit("").alias("constitution")))


@query("""SELECT c_custkey AS vendor_id, array_to_string(list_filter([CASE WHEN c_custkey % 3 > 0 THEN 'File returns on time' END, CASE WHEN c_acctbal < 600 THEN 'Strengthen proof of address' END, CASE WHEN c_custkey % 2 = 0 THEN 'Align PAN and registered name' END], lambda x: x IS NOT NULL), ',') AS tags FROM customer""")
def improvement_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-06: what each customer could mend."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("vendor_id"), F.pmod(k, F.lit(3)).alias("late"), F.lit(0).alias("max_delay"), (F.col("c_acctbal") / 100).alias("address_score"), F.when(k % 2 == 0, "not_match").alias("pan_name"))
    return report.improvement_tags(rows).select("vendor_id", F.array_join("tags", ",").alias("tags"))


@query("""SELECT o_custkey AS vendor_id, 'open' AS section, 'order ' || o_orderkey AS head, 'late' AS detail FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 'paid', NULL, 'done' FROM orders WHERE o_orderstatus = 'F'""")
def flag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05, STR-17: lines of several sections, "where: what" split."""
    o = table(spark, sf_dir, "orders")
    item = lambda state, c: o.where(F.col("o_orderstatus") == state).select(F.col("o_custkey").alias("vendor_id"), c.alias("item"))
    return report.flags_table({"open": item("O", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(": late"))), "paid": item("F", F.lit("done"))})


@query("""SELECT o_custkey AS vendor_id, o_orderkey || '.pdf' AS file_name, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS doc_type, CASE WHEN o_orderstatus = 'P' THEN 'unrecognized' WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'warning' ELSE 'ok' END AS status FROM orders""")
def verified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-18, SRT-01: the state of every file."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vendor_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("s"))
    docs = o.select("vendor_id", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), F.when(F.col("s") != "P", F.col("s")).alias("doc_type"))
    reads = o.select("vendor_id", "doc_id", F.when(F.col("doc_id") % 5 == 0, "partial").otherwise("read").alias("quality"))
    return consistency.verification_rows(docs, reads, o.where("doc_id % 3 = 0").select("vendor_id", "doc_id"))
