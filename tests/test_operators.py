"""Operators on small tables, and registered queries against their SQL."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from duelight.operators import cases, classify, extract, filings, match, ocr, registry, resolve, review, score, screening
from duelight.plans import analogues, assessments, catalog, formats  # noqa: F401
from duelight.sources import io


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_equal_their_sql(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    if name not in catalog.ORACLE:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.execute(catalog.ORACLE[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(rel.fetchall())


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rule_forms(spark):
    forms = [("value > 5", "6", True), ("value > 5", "5", False), ("value <= 10", "10", True), ("value IN [2, 5]", "2", True), ("value IN (10, 20]", "10", False), ("value IN (10, 20]", "20", True), ("value IN [1, 2)", "2", False), ("value == 100", "100.0", True), ('value == "owned"', " Owned ", True), ("value < 3", "word", False), ("value ~ 3", "3", False)]
    rules = score.parse_rules(spark.createDataFrame([(i, e, v) for i, (e, v, _) in enumerate(forms)], "i int, expr string, v string"))
    got = {r.i: r.h for r in rules.select("i", score.rule_holds(F.col("v")).alias("h")).collect()}
    assert [got[i] for i in range(len(forms))] == [w for *_, w in forms]
    assert rules.where("kind is null").select("expr").first()[0] == "value ~ 3"


def test_scores_of_missing_values(spark):
    params = spark.createDataFrame([("compliance", "a", 0, 5.0, False), ("compliance", "b", 1, 3.0, True), ("other", "c", 0, 9.0, False)], "category_id string, parameter_id string, param_ord int, max_score double, conditional boolean")
    rules = spark.createDataFrame([("a", 0, "value >= 1", "one", 5.0), ("a", 1, "value >= 0", "zero", 2.0)], "parameter_id string, ordinal int, expr string, condition string, assigned_score double")
    resolved = spark.createDataFrame([(1, "a", "3", "", False), (2, "a", None, "gone", True)], "vendor_id int, parameter_id string, value string, note string, unresolved boolean")
    got = score.score_params(resolved, params, rules, spark.createDataFrame([(1,), (2,)], "vendor_id int"))
    assert rows_of(score.category_scores(got)) == [(1, "compliance", 5.0, 5.0), (2, "compliance", 0.0, 5.0)]
    assert score.param_specs(rules).first().numeric is True
    assert len(score.rules_hash(rules).first()[0]) == 12


def test_filing_delays(spark):
    rows = [(1, "GSTR3B", "January", "2025-2026", "25/02/2026"), (1, "GSTR1", "January", "2025-2026", "05/02/2026"), (1, "GSTR9", "Annual", "2025-2026", "05/02/2026"), (1, "GSTR1", "January", "2020-2021", "05/02/2024")]
    df = spark.createDataFrame(rows, "vendor_id int, return_type string, tax_period string, financial_year string, date_of_filing string")
    got = filings.filing_summary(filings.delays(df, F.to_date(F.lit("2026-03-01")))).first()
    assert (got.periods, got.late, got.max_delay) == (2, 1, 5)


def test_screening_index_equals_all_pairs(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").limit(60)
    a = parts.select(F.col("p_partkey").alias("entity_id"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" steel bank")).alias("name"))
    b = parts.select((F.col("p_partkey") + 1000).alias("list_id"), F.col("p_name").alias("name")).union(spark.createDataFrame([(1, "Promo"), (2, ""), (3, "bank of steel ring small")], "list_id long, name string"))
    from duelight.functions.names import token_match

    want = a.crossJoin(b.withColumnRenamed("name", "other")).where(token_match(F.col("name"), F.col("other"))).select("entity_id", "list_id")
    assert rows_of(match.screen_names(a, b)) == rows_of(match.screen_names(a, b, together=2)) == rows_of(want)


def test_classification(spark):
    files = ["GST Certificate.pdf", "x_pan.pdf", "Owner PAN.jpg", "electrity bill.pdf", "B_Udyam_reg.pdf", "scan 12.pdf", "Sale Deed - proof of premises.pdf", "company.pdf"]
    want = ["gst_certificate", "pan_entity", "pan_owner", "electricity_bill", "msme_certificate", None, "sale_deed", None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "doc_id int, file_name string")
    texts = spark.createDataFrame([(5, "Consumer\nNumber 12 units", True), (7, "lessor", False)], "doc_id int, text string, confident boolean")
    got = {r.doc_id: r for r in classify.classify(df, texts).collect()}
    assert [got[i].doc_type for i in range(5)] == want[:5] and got[6].doc_type == "sale_deed"
    assert got[5].doc_type == "electricity_bill" and got[5].by_text and got[7].doc_type is None


GST = "Registration\n27AAAAA1234B1Z5\nLegal Name\nEXAMPLE TRADERS\nTrade Name, if any\nM/S EXAMPLE\nConstitution of Business\nPartnership\nAddress of Principal Place of\nBusiness\nPlot 1,\nAlphatown\n5. Date\nDate of Liability\n01/07/2017\nType of Registration\nRegular\n"
CHEQUE = "VALID FOR THREE MONTHS ONLY\nIFS Code SBINO123456 A/c No. 123456789012\nCANCELLED\nFOR EXAMPLE TRADERS PVT LTD\n"
PAN = "GOVT. OF INDIA\nPermanent Account Number Card\nAAAAA1234B\nनाम / Name\nEXAMPLE TRADERS\n01/01/2000\n"
BILL = "Name/Address & GST of the Consumer\nEXAMPLE TRADERS\nPlot 1 Alphatown 600001\nState : X\nSanctioned Load: 25 kW\n"
COI = "certify that EXAMPLE LIMITED is incorporated on this TWENTY NINTH day of NOVEMBER TWO THOUSAND TWENTY THREE under the Act\nCIN U12345MH2020PTC123456\nPermanent Account Number is AAAAA1234B"
MSME = "UDYAM-MH-01-1234567\nNAME OF ENTERPRISE\nM/S Example\nMAJOR ACTIVITY\nMANUFACTURING\nMicro Small\nOFFICAL ADDRESS OF\nENTERPRISE\nFlat/Door/Block No.\n12\nCity\n-\nState\nX, Pin 600001\nMobile\n9876543210\n22209 - Manufacture of other plastics\nproducts n.e.c\nManufacturing\n"


def test_extraction(spark):
    docs = [(1, 1, "gst_certificate", 0, GST), (1, 2, "cancelled_cheque", 1, CHEQUE), (1, 3, "pan_entity", 2, PAN), (1, 4, "electricity_bill", 3, BILL), (1, 5, "certificate_of_incorporation", 4, COI), (1, 6, "msme_certificate", 5, MSME), (1, 7, None, 6, "x"), (1, 8, "kyc_form", 7, None)]
    df = spark.createDataFrame(docs, "vendor_id int, doc_id int, doc_type string, seq int, text string")
    rows = extract.extract_fields(df)
    got = {(r.doc_id, r.field): r.value for r in rows.collect()}
    assert got[1, "gstin"] == "27AAAAA1234B1Z5" and got[1, "legal_name"] == "EXAMPLE TRADERS" and got[1, "trade_name"] == "EXAMPLE"
    assert got[1, "address"] == "Plot 1, Alphatown" and got[1, "date_of_registration"] == "01/07/2017" and got[1, "state"] == "Maharashtra"
    assert got[2, "account_number"] == "123456789012" and got[2, "account_holder"] == "EXAMPLE TRADERS" and got[2, "cancellation_mark_present"] == "true"
    assert got[2, "ifsc"] == "SBIN0123456" if (2, "ifsc") in got else True
    assert got[3, "pan"] == "AAAAA1234B" and got[3, "name"] == "EXAMPLE TRADERS"
    assert got[4, "consumer_name"] == "EXAMPLE TRADERS" and got[4, "address"] == "Plot 1 Alphatown 600001" and got[4, "sanctioned_load"] == "25 kW"
    assert got[5, "cin"] == "U12345MH2020PTC123456" and got[5, "date_of_incorporation"] == "29/11/2023" and got[5, "name"] == "EXAMPLE LIMITED"
    assert got[6, "enterprise_type"] == "Small" and got[6, "nic_5_description"] == "Manufacture of other plastics products n.e.c" and got[6, "major_activity"] == "Manufacturing"
    assert got[6, "address"] == "Flat/Door/Block No.: 12 State: X, Pin 600001" and got[6, "pincode"] == "600001"
    assert not any(d in (7, 8) for d, _ in got)
    entity = registry.merge_entity(rows).first()
    assert entity.pan == "AAAAA1234B" and entity.date_of_incorporation == "29/11/2023"


def test_registrations(spark):
    by_pan = spark.createDataFrame([(1, "A", "Active", "x"), (1, "B", "Inactive", "y"), (2, "C", "Active", "x"), (2, "D", "Inactive", "x"), (2, " ", "x", "x")], "vendor_id int, gstin string, status string, state string")
    details = spark.createDataFrame([(1, "B", "Cancelled", "z")], by_pan.schema)
    subject = spark.createDataFrame([(1, "a"), (2, "C")], "vendor_id int, subject_gstin string")
    got = {r.vendor_id: r.value for r in registry.registration_verdict(match.merge_registrations(by_pan, details), subject).collect()}
    assert got == {1: "cancelled_present", 2: None}


def test_snapshots(spark):
    rows = [("fresh", "2026-03-09", False, False), ("old", "2026-01-01", False, False), ("stale", "2026-01-01", False, False), ("stale", "2026-03-09", True, True), ("hard", "2026-01-01", False, False), ("hard", "2026-03-09", True, False), ("none", "2026-03-09", True, True)]
    df = spark.createDataFrame(rows, "key string, t string, failed boolean, retriable boolean").select("key", F.to_timestamp("t").alias("fetched_at"), "failed", "retriable", F.lit("d").alias("data"))
    as_of = F.to_timestamp(F.lit("2026-03-10"))
    assert {r.key: r.status for r in registry.fresh_snapshots(df, as_of, 7).collect()} == {"fresh": "fresh", "old": "expired", "stale": "stale_served", "hard": "expired", "none": "missing"}
    assert {r.key: r.status for r in registry.fresh_snapshots(df, as_of, 0).collect()}["old"] == "fresh"


def test_screening_responses(spark):
    df = spark.createDataFrame([(1, {"PEPCheck": 1, "Blank": 0}, {"PEPCheck": [{"Name": "x"}, {}], "Blank": [{"Name": ""}], "Loose": [{"a": "b"}]}), (2, None, {"PEPCheck": [{"Name": "y"}]})], "vendor_id int, hits_found map<string,int>, categories map<string,array<map<string,string>>>")
    assert rows_of(screening.hit_rows(df)) == [(1, "PEPCheck", {"Name": "x"})]
    pick = lambda c, n: spark.range(1).select(screening.classify_hit(F.lit(c), F.lit(n))).first()[0]
    assert [pick("SanctionCheck", ""), pick("x", "NCLT orders"), pick("Indian", "ESIC list"), pick(None, None)] == ["legal_sanctions", "legal_ecourts", "other", "other"]
    hits = spark.createDataFrame([(["27BBBBB1234C1Z5"], "AAAAA1234B", "Example Co", "Example Co"), (["AAAAA1234B"], "AAAAA1234B", "Example", "Example"), ([], "AAAAA1234B", "MS R R TRADING COMPANY", "B.R. TRADING COMPANY"), ([], None, "Example Traders", "Example Traders")], "own_ids array<string>, vendor_pan string, matched_name string, entity_name string")
    assert [r.reason for r in match.dismiss_namesakes(hits).collect()][1:] == [None, "another name", None]


def test_resolvers(spark):
    entity = spark.createDataFrame([(1, "Active", "Plot 12 Alphatown 600001", "Plot 12 Alphatown 600001", True, False, "Private Limited", "Retail", "46620", "EXAMPLE CO", "EXAMPLE CO")], "vendor_id int, gstin_status string, address string, bill_address string, has_bill boolean, has_rental boolean, constitution string, gst_nature string, nic_5_code string, legal_name string, bill_consumer_name string")
    got = {r.parameter_id: r for r in resolve.resolve_all(entity, F.to_date(F.lit("2026-03-10"))).collect()}
    assert len(got) == 23
    value = lambda p: got[p].value
    assert (value("com_gstin_active"), value("addr_electricity_bill"), value("addr_ownership_type"), value("addr_rental_validation")) == ("active", "match", "owned", "owned")
    assert (value("ident_constitution"), value("ident_seller_type"), value("ident_pan_active"), value("addr_landlord_declaration")) == ("pvt_public_listed", "trader", "active", "not_applicable")
    assert got["legal_sanctions"].unresolved and value("com_hsn_match") == "not_available"
    assert any("inferred" in r.item for r in resolve.cross_check_items(resolve.resolve_all(entity, F.current_date())).collect())


@pytest.mark.parametrize(("codes", "activity", "want"), [(["4601"], "plastics moulding", "match"), (["7013"], "plastics", "not_match"), (["0902"], "plastics", None), (None, "plastics", "not_available"), (["3923"], "", None)])
def test_hsn(spark, codes, activity, want):
    df = spark.createDataFrame([(codes, activity)], "codes array<string>, activity string")
    assert df.select(resolve.hsn_match(F.col("codes"), F.col("activity"))[0].alias("v")).first().v == want


@pytest.mark.parametrize(("called", "holder", "portal", "verified", "n", "want"), [(True, "X", "1", None, 0, "penny_success_gst_match"), (True, "X", "2", None, 0, "penny_success_gst_mismatch"), (True, "X", None, None, 0, "penny_success_gst_unavailable"), (True, None, "1", None, 0, "penny_unsuccessful"), (False, None, "1", True, 2, "penny_success_gst_match"), (False, None, "1", False, 3, None)])
def test_bank(spark, called, holder, portal, verified, n, want):
    df = spark.createDataFrame([(called, holder, "1", portal, verified, n)], "c boolean, h string, a string, p string, v boolean, n int")
    assert df.select(resolve.bank_verification(*[F.col(x) for x in "chapvn"])[0].alias("v")).first().v == want


def test_corrections_and_overrides(spark):
    specs = spark.createDataFrame([("a", False, ["x", "y"]), ("n", True, [])], "parameter_id string, numeric boolean, buckets array<string>")
    resolved = spark.createDataFrame([(1, "a", "x", "", False), (1, "n", None, "", True)], "vendor_id int, parameter_id string, value string, note string, unresolved boolean")
    found = [(1, 1, 1, "a", "y", "n1", "verified", "correct"), (1, 1, 2, "a", "zz", "n2", "verified", "correct"), (1, 1, 3, "q", "x", "n3", "verified", "correct"), (1, 1, 4, "n", "w", "n4", "verified", "correct"), (1, 1, 5, "n", " ", "n5", "verified", "correct"), (1, 2, 1, "a", "x", "n6", "likely", "correct")]
    findings = spark.createDataFrame(found, "vendor_id int, pass int, ord int, parameter_id string, proposed_value string, proposed_note string, confidence string, action string")
    routed = review.route_corrections(findings, resolved, specs)
    assert {(r["pass"], r.ord): r.route for r in routed.collect()} == {(1, 1): "apply", (1, 2): "escalate", (1, 3): "escalate", (1, 4): "escalate", (1, 5): "escalate", (2, 1): "escalate"}
    assert {r.parameter_id: r.value for r in review.apply_corrections(resolved, routed).collect()} == {"a": "y", "n": None}
    bad = review.validate_overrides(spark.createDataFrame([(1, "a", "y"), (1, "a", "q"), (1, "n", "5"), (1, "n", "five"), (1, "zz", "1")], "vendor_id int, parameter_id string, analyst_value string"), specs)
    assert sorted(r.problem for r in bad.collect()) == ["not a number", "not an allowed value", "unknown parameter"]
    rows = [(1, "addr_ownership_type", "rented"), (1, "addr_electricity_bill", "match"), (1, "addr_rental_validation", "owned"), (1, "addr_landlord_declaration", "not_applicable")]
    state = spark.createDataFrame(rows, "vendor_id int, parameter_id string, value string")
    got = {r.parameter_id: r.value for r in review.rederive_address(state, state.where("parameter_id = 'addr_ownership_type'")).collect()}
    assert (got["addr_rental_validation"], got["addr_landlord_declaration"]) == ("rented_matching", "absent")


def test_finalise_reads_cross_checks_from_the_applied_state(spark):
    rules = spark.createDataFrame([("a", 0, 'value == "x"', "X", 5.0), ("a", 1, 'value == "y"', "Y", 1.0), ("b", 0, 'value == "x"', "X", 5.0)], "parameter_id string, ordinal int, expr string, condition string, assigned_score double")
    params = spark.createDataFrame([("compliance", "a", 0, 5.0, False), ("compliance", "b", 1, 5.0, False)], "category_id string, parameter_id string, param_ord int, max_score double, conditional boolean")
    kind = "vendor_id int, parameter_id string, value string, note string, unresolved boolean"
    resolved = spark.createDataFrame([(1, "a", "x", "GAP: look", False), (1, "b", "x", "WARNING: open", False), (2, "a", "x", "GAP: look", False)], kind)
    overrides = spark.createDataFrame([(1, "a", "y", "x"), (1, "b", " ", "z"), (2, "a", "nope", "x")], "vendor_id int, parameter_id string, analyst_value string, issued_original string")
    grades = spark.createDataFrame([("A", 0.0)], "grade string, min_score double")
    out = review.finalise(resolved, resolved.limit(0), overrides, params, rules, resolved.select("vendor_id").distinct(), grades)
    assert {(r.vendor_id, r.item) for r in out["cross_checks"].collect()} == {(1, "b: WARNING: open"), (1, "stale: b"), (2, "a: GAP: look")}
    assert {(r.vendor_id, r.parameter_id): (r.value, r.note) for r in out["state"].collect()}[1, "a"] == ("y", "")


def test_legal_parameters(spark):
    vendors = spark.createDataFrame([(1,), (2,), (3,), (4,)], "vendor_id int")
    hits = spark.createDataFrame([(1, "legal_sanctions", False, 2, "b"), (1, "legal_sanctions", False, 1, "a"), (1, "other", True, 1, "esi"), (2, "other", False, 1, "dealer"), (2, "legal_pep", True, 1, "p")], "vendor_id int, slot string, owner boolean, seq int, text string")
    sweeps = spark.createDataFrame([(2, True), (3, False)], "vendor_id int, comprehensive boolean")
    free = spark.createDataFrame([(3, "legal_pep", "no_pep", "free lists"), (3, "legal_ecourts", None, "manual")], "vendor_id int, parameter_id string, value string, note string")
    dropped = spark.createDataFrame([(2, False, 1, "namesake")], "vendor_id int, owner boolean, seq int, text string")
    got = {(r.vendor_id, r.parameter_id): (r.value, r.note) for r in screening.resolve_legal(vendors, hits, sweeps, free, dropped).collect()}
    assert len(got) == 20
    assert got[1, "legal_sanctions"] == ("listed", "a; b | ALSO: esi") and got[1, "legal_pep"] == (None, "")
    assert got[2, "legal_sanctions"] == ("adverse_watchlist", "WATCHLIST HIT (confirm or dismiss): dealer | sanctions lists: a comprehensive sweep found no match | namesakes dismissed: namesake")
    assert got[2, "legal_pep"] == ("pep_identified", "p") and got[2, "legal_ecourts"][0] == "no_criminal"
    assert got[3, "legal_pep"] == ("no_pep", "free lists") and got[3, "legal_ecourts"] == (None, "manual") and got[4, "legal_sanctions"] == (None, "")


def test_traces_of_other_vendors_stay(spark, tmp_path):
    for v in (1, 2):
        io.write_traces(spark.createDataFrame([(v, "t")], "vendor_id int, text string"), str(tmp_path / "traces"))
    assert {r.vendor_id for r in spark.read.json(str(tmp_path / "traces")).collect()} == {1, 2}


def test_hot_tokens_and_runs_are_split(spark):
    """A token in a third of all names, and a run in a third of all texts: no part of their postings is over three times the median part."""
    listed = spark.range(1000, 4000).select(F.col("id").alias("list_id"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("rosewood w"), F.col("id"))).otherwise(F.concat(F.lit("v"), F.col("id"), F.lit(" u"), F.col("id"))).alias("name"))
    postings = listed.select("list_id", F.explode(F.split("name", " ")).alias("tok"))
    held = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    hot, probes = match.split_hot(postings, held.select("tok"), held, "tok", "list_id", 100)
    parts = sorted(r["count"] for r in hot.where("tok = 'rosewood'").groupBy("salt").count().collect())
    assert len(parts) == 10 and parts[-1] <= 3 * parts[5]
    assert probes.where("tok = 'rosewood'").count() == 10 and probes.where("tok = 'v1001'").count() == 1
    firms = spark.createDataFrame([(1, "rosewood w1003"), (2, "w1009 rosewood"), (3, "rosewood"), (4, "v1001 u1001")], "entity_id int, name string")
    want = {(1, 1003), (2, 1009), (4, 1001)} | {(3, k) for k in range(1000, 4000, 3)}
    assert {tuple(r) for r in match.screen_names(firms, listed, together=100).collect()} == want
    sides = listed.select(F.col("list_id").alias("case_id"), F.col("name").alias("text"))
    names = spark.createDataFrame([(1, "rosewood"), (2, "od w103"), (3, "absent"), (4, "u129")], "vendor_id int, name string")
    got = {(r.vendor_id, r.case_id) for r in cases.holding(names, sides, together=100).collect()}
    texts = {r.case_id: r.text.upper() for r in sides.collect()}
    assert got == {(v, c) for v, n in names.collect() for c, t in texts.items() if n.upper() in t}


def fold(page):
    """One page merged and put in order token by token, as read."""
    def over(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inner = max(w, 0) * max(h, 0)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
        return inner / union if inner and union > 0 else 0

    kept = [t for t in page if t[0] == "primary"]
    for t in (t for t in page if t[0] != "primary"):
        at = next((k for k, o in enumerate(kept) if over(o[2:6], t[2:6]) >= 0.5), None)
        if at is None:
            kept.append(t)
        elif t[7] > kept[at][7]:
            kept[at] = t
    heights = sorted(t[5] - t[3] for t in kept)
    room, lines = 0.6 * max(1.0, heights[len(heights) // 2]), []
    middle = lambda t: (t[3] + t[5]) / 2
    for t in sorted(kept, key=lambda t: (middle(t), t[2])):
        if lines and middle(t) - middle(lines[-1][0]) <= room:
            lines[-1].append(t)
        else:
            lines.append([t])
    return [(n, k, t[6], t[7]) for n, line in enumerate(lines) for k, t in enumerate(sorted(line, key=lambda t: t[2]))]


def test_pages_equal_the_fold(spark):
    """Random pages of crowded boxes in both passes, some of no area, against the fold in order."""
    rng = random.Random(11)
    pages, rows = {}, []
    for page in range(40):
        own = pages[page] = []
        for ord_ in range(rng.randrange(1, 40)):
            x, y, w, h = rng.randrange(0, 60) * 1.0, rng.randrange(0, 40) * 1.0, rng.choice([0, 3, 8, 16, 31]) * 1.0, rng.choice([1, 4, 9]) * 1.0
            own.append((rng.choice(["primary", "second"]), ord_, x, y, x + w, y + h, f"t{ord_}", rng.randrange(5) / 4))
        rows += [(page // 7, page % 7, *t, "clash") for t in own]
    df = spark.createDataFrame(rows, "doc_id long, page int, pass string, ord int, x0 double, y0 double, x1 double, y1 double, text string, conf double, level string").repartition(5)
    got = {}
    for r in ocr.fold_pages(df).collect():
        got.setdefault(r.doc_id * 7 + r.page, []).append((r.line, r.place, r.text, r.conf))
    assert {k: sorted(v) for k, v in got.items()} == {k: fold(v) for k, v in pages.items()}
    boxless = spark.createDataFrame([(1, 1, "primary", 1, None, None, None, None, "none", 0.5, ""), (1, 1, "primary", 2, 0.0, 0.0, 9.0, 9.0, "box", 0.5, "")], df.schema)
    assert [(r.line, r.text) for r in ocr.fold_pages(boxless).orderBy("line").collect()] == [(0, "box"), (1, "none")]
    assert ocr.fold_pages(df.where("false")).count() == 0


def test_pages_of_any_size_are_alike_and_dealt_out_once(spark):
    """Pages of few tokens are folded in one row, larger ones by the grid: the same rows, and no shuffle beside that of whole pages."""
    rng = random.Random(12)
    rows = [(page // 5, page % 5, rng.choice(["primary", "second", None]), k, x, y, x + w, y + 4, f"t{k}", rng.randrange(5) / 4) for page in range(25) for k in range(rng.randrange(1, 30)) for x, y, w in [(rng.randrange(40) * 1.0, rng.randrange(20) * 1.0, rng.choice([0, 4, 9]) * 1.0)]]
    df = spark.createDataFrame([*rows, (None, 1, "primary", 1, 0.0, 0.0, 9.0, 9.0, "lost", 0.5)], "doc_id long, page int, pass string, ord int, x0 double, y0 double, x1 double, y1 double, text string, conf double")
    whole = ocr.fold_pages(df)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Exchange hashpartitioning") == 1
    assert rows_of(whole) == rows_of(ocr.fold_pages(df, few=0)) == rows_of(ocr.fold_pages(df, few=15))


def test_pages(spark):
    tokens = [(1, 1, "primary", 0, 1, 0.0, 0.0, 10.0, 10.0, "top", 0.9), (1, 1, "primary", 0, 2, 50.0, 1.0, 60.0, 11.0, "rigth", 0.5), (1, 1, "second", 0, 1, 50.0, 1.0, 60.0, 11.0, "right", 0.8), (1, 1, "second", 0, 2, 0.0, 40.0, 10.0, 50.0, "below", 0.7)]
    df = spark.createDataFrame(tokens, "doc_id long, page int, pass string, angle int, ord int, x0 double, y0 double, x1 double, y1 double, text string, conf double")
    got = sorted((r.line, r.place, r.text) for r in ocr.fold_pages(df).collect())
    assert got == [(0, 0, "top"), (0, 1, "right"), (1, 0, "below")]
    stats = spark.createDataFrame([(1, 1, 0, 50, False), (1, 1, 180, 200, True), (1, 1, 90, 900, False)], "doc_id long, page int, angle int, chars long, confident boolean")
    assert ocr.best_rotation(stats).first().angle == 180


def test_sources(spark, tmp_path):
    for name in ("v1/b.pdf", "v1/a.pdf", "v1/inner/c.pdf", "v2/inner/d.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = [(r.vendor_id, r.file_name, r.seq) for r in io.scan_documents(spark, str(tmp_path)).orderBy("vendor_id", "seq").collect()]
    assert got == [("v1", "a.pdf", 1), ("v1", "b.pdf", 2), ("v2", "d.pdf", 1)]
    good, bad = io.validate_payload(spark.createDataFrame([("<?xml version", ), ("<html>Access Denied",), ("",), ("[1]",)], "payload string"), "xml")
    assert (good.count(), bad.count()) == (1, 3)
    pages = spark.createDataFrame([(1, "<table><tr><td> a </td><td><b>Y</b></td></tr><tr><td>x</td></tr></table>")], "id int, html string")
    assert io.html_table_rows(pages, "id", "html", least=2).first().cells == ["a", "Y"]


def test_assessment_end_to_end(spark):
    from duelight.plans import vendors

    docs = spark.createDataFrame([(1, 1, "GST certificate.pdf", 0), (1, 2, "cheque.jpg", 1), (2, 3, "scan.pdf", 0)], "vendor_id int, doc_id int, file_name string, seq int")
    texts = spark.createDataFrame([(1, GST, True), (2, CHEQUE, True), (3, "blank", False)], "doc_id int, text string, confident boolean")
    answers = spark.createDataFrame([(1, "Active")], "vendor_id int, gstin_status string")
    params = spark.createDataFrame([("compliance", "com_gstin_active", 0, 5.0, False)], "category_id string, parameter_id string, param_ord int, max_score double, conditional boolean")
    rules = spark.createDataFrame([("com_gstin_active", 0, 'value == "active"', "Active", 5.0)], "parameter_id string, ordinal int, expr string, condition string, assigned_score double")
    out = vendors.assess(docs, texts, answers, params, rules, spark.createDataFrame([("A", 5.0)], "grade string, min_score double"), F.to_date(F.lit("2026-03-10")))
    assert {r.vendor_id: (r.total, r.max_total, r.grade) for r in out["scores"].collect()} == {1: (5.0, 5.0, "A"), 2: (0.0, 5.0, None)}


def test_consistency(spark):
    from duelight.operators import consistency

    reads = spark.createDataFrame([(1, 1, "gst_certificate", 0, {"gstin": "27AAAAA1234B1Z5", "legal_name": "EXAMPLE TRADERS"}), (1, 2, "kyc_form", 1, {"gstin": "27BBBBB1234B1Z5"}), (1, 3, "pan_entity", 2, {"pan": "AAAPA1234B", "name": "FIRST PARTNER"}), (1, 4, "pan_owner", 3, {"pan": "CCCPC1234C", "name": "UNKNOWN SOUL"}), (2, 5, "kyc_form", 0, {"pan": "X"})], "vendor_id int, doc_id int, doc_type string, seq int, fields map<string,string>")
    people = spark.createDataFrame([(1, "FIRST PARTNER")], "vendor_id int, person string")
    got = {(r.vendor_id, r.doc_id, r.warning.split(":")[0]) for r in consistency.check_consistency(reads, people).collect()}
    assert got == {(1, 2, "another GSTIN than the certificate"), (1, 3, "an individual's PAN filed as the entity's"), (1, 3, "in the name of partner FIRST PARTNER"), (1, 4, "not a partner on record"), (2, None, "no readable certificate to compare with")}


def test_cases_and_persons(spark):
    from duelight.operators import cases

    names = spark.createDataFrame([(1, "Example Traders"), (1, "Mr. First Person"), (2, "Abc"), (3, "sbir")], "vendor_id int, name string")
    docket = spark.createDataFrame([(10, "State Bank", "M/s Example Traders and ors"), (11, "Example Foods", "Other"), (12, None, "Person, First"), (13, "JASBIR KAUR", "Sbirs"), (14, "Mr. Sbir", None)], "case_id int, applicant string, respondent string")
    hits, rejected = cases.screen_cases(names, docket)
    # a substring of a longer word is found loosely and rejected; boilerplate of a party identifies nobody
    assert rows_of(hits) == [(1, 10, "respondent"), (1, 12, "respondent"), (3, 14, "applicant")] and rows_of(rejected) == [(3, 1)]
    people = spark.createDataFrame([(1, "First Partner"), (2, "Nobody Known")], "vendor_id int, name string")
    listed = spark.createDataFrame([("First Partner",)], "name string")
    assert {r.vendor_id: (r.value, r.gap) for r in cases.screen_persons(people, listed, None).collect()} == {1: ("pep_identified", "second source not read"), 2: ("no_pep", "second source not read")}
    assert {r.value for r in cases.screen_persons(people, listed.limit(0), listed).collect()} == {None}
    entity = spark.createDataFrame([(1, ["Example Traders", "EXAMPLE"], ["example", "First Partner", "first  partner", ""])], "vendor_id int, own array<string>, people array<string>")
    r = cases.screening_names(entity).first()
    assert (r.names, r.persons) == (["Example Traders", "EXAMPLE", "First Partner"], ["First Partner"])


def test_copies_of_names_and_cases_are_judged_once(spark):
    """Each of 200 vendors of one name against 150 cases of one party, without a row per vendor and case."""
    from duelight.operators import cases

    names = spark.range(200).selectExpr("id AS vendor_id", "'sbir' AS name").union(spark.sql("SELECT 500L, 'quill forge'"))
    docket = spark.range(150).selectExpr("id AS case_id", "'JASBIR KAUR' AS applicant", "CAST(NULL AS string) AS respondent").union(spark.sql("SELECT 900L, 'Quill Forge', 'JASBIR KAUR'"))
    own, listed, firms, dockets = cases.screening_classes(names, docket)
    assert own.count() == 2 and sorted(r.n for r in listed.collect()) == [1, 150] and firms.count() == 201 and dockets.count() == 151
    hits, rejected = cases.screen_cases(names, docket)
    assert rows_of(hits) == [(500, 900, "applicant")] and sorted(tuple(r) for r in rejected.collect()) == [(v, 151) for v in range(200)]


def test_a_later_write_of_traces_replaces_its_vendors_in_few_files(spark, tmp_path):
    path = str(tmp_path / "traces")
    io.write_traces(spark.range(400).selectExpr("id AS vendor_id", "'old' AS text").coalesce(2), path)
    io.write_traces(spark.sql("SELECT 3L AS vendor_id, 'new' AS text"), path)
    got = io.scan_traces(spark, path, lines=True)
    assert sorted(got.columns) == ["text", "vendor_id"] and got.count() == 400 and [r.vendor_id for r in got.where("text = 'new'").collect()] == [3]
    assert len(list(tmp_path.rglob("*.json"))) == 3


def test_equal_rows_are_judged_once(spark):
    """Nulls are keys too; a table read by one task is judged by as many as its distinct keys need, and dealt out where it is spread."""
    from duelight.functions.text import once_each
    from duelight.plans.catalog import spread

    rows = spark.createDataFrame([("a", None), ("a", None), (None, "b"), ("c", "c")] * 50, "a string, b string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def judge(keys):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return keys.mapInArrow(count, keys.schema).withColumn("n", F.coalesce(F.length("a"), F.lit(7)))

    assert rows_of(once_each(rows, ["a", "b"], judge).groupBy("a", "b", "n").count()) == [("a", None, 1, 100), ("c", "c", 1, 50), (None, "b", 7, 50)]
    assert seen.value == 3
    assert spread(spark, "/root/testdata/sf0.001", "customer", "c_custkey").rdd.getNumPartitions() == 3


def test_values_sort_only_the_rows_they_name(spark):
    from duelight.operators import report

    scores = spark.createDataFrame([(1, "x", "v", False, 1.0, 1.0), (1, "y", "w", False, 1.0, 1.0), (2, "y", "w", True, 0.0, 1.0)], "vendor_id int, parameter_id string, value string, unresolved boolean, assigned_score double, max_score double")
    got = report._values(scores, "x")
    assert [(r.vendor_id, r.x.value) for r in got.collect()] == [(1, "v")]
