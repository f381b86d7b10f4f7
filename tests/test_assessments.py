"""Golden cases of bank and bill evidence, corrections of fields, findings, and premises against plain matching; names are invented."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from duelight.functions import address
from duelight.operators import report, resolve, review
from duelight.plans import assessments, catalog, vendors  # noqa: F401


def bank(spark, accounts, called=None, holder=None, matched=None, live=None, portal=None, verified=None, status=None, marked=None):
    kind = "accounts array<struct<source:string,number:string>>, called boolean, holder string, matched boolean, live string, portal string, verified boolean, status string, marked boolean"
    df = spark.createDataFrame([(accounts, called, holder, matched, live, portal, verified, status, marked)], kind)
    value, note = resolve.bank_answer(*[F.col(c) for c in df.columns])
    r = df.select(value.alias("v"), note.alias("n")).first()
    return r.v, r.n


AGREE = [("cancelled cheque", "111"), ("MSME certificate", "111")]


def test_bank_evidence(spark):
    value, note = bank(spark, AGREE)
    assert value is None and "agrees across MSME certificate, cancelled cheque" in note and "paperwork agreement alone is not treated as bank verification" in note
    value, note = bank(spark, [("cancelled cheque", "111"), ("MSME certificate", " 222 "), ("form", None)])
    assert value is None and note.startswith("CRITICAL: the account number differs between sources: MSME certificate")
    assert "WARNING: the cheque shows no cancellation mark" in bank(spark, AGREE, marked=False)[1]
    assert "carries a cancellation mark" in bank(spark, AGREE, marked=True)[1]
    value, note = bank(spark, AGREE, True, "SOME OTHER", False, "111")
    assert value == "penny_success_gst_unavailable" and "CRITICAL: none of the vendor's names on record" in note and "no GST portal" in note
    value, note = bank(spark, AGREE, True, "X", True, "111", "999", False)
    assert value == "penny_success_gst_mismatch" and "registers a different account, 999" in note
    assert bank(spark, AGREE, True, "X", True, "111", "111", False) [0] == "penny_success_gst_match"
    assert bank(spark, AGREE, True, "X", None, None, "111")[0] == "penny_success_gst_unavailable"
    assert bank(spark, AGREE, True, None)[0] == "penny_unsuccessful"
    assert bank(spark, AGREE, verified=True)[0] == "penny_success_gst_match"
    value, note = bank(spark, AGREE, verified=False, status="NotValidated")
    assert value is None and "not scored: the portal shows the account as NotValidated" in note
    assert bank(spark, [], None)[1].startswith("no document names an account")


REGISTERED = "G100, MIDC, ROSEGAON, Rosegaon, Maharashtra, 425003"


@pytest.mark.parametrize(
    ("registered", "bill", "pin", "village", "licence", "want", "says"),
    [
        (REGISTERED, "PL.NO G-100, M.I.D.C. ROSEGAON", "422305", "ROSEGAON", None, "minor_discrepancy", "422305 differs from 425003, which is never a full match"),
        (REGISTERED, "PL.NO G-100, M.I.D.C. ROSEGAON", "425003", "ROSEGAON", None, "match", "PIN 425003 matches"),
        (REGISTERED, "FLAT 12B, SECTOR 5, NEWTOWN", "201301", None, None, "not_match", "share nothing"),
        (REGISTERED, "FLAT 12B, SECTOR 5, NEWTOWN", "201301", None, "Flat 12B Newtown Sector", "not_match", "NOTE: the bill's premises are those of the vendor's factory licence"),
        ("Plot 384 Rose Nagar 500055", "Plot 382 Rose Nagar", "500055", None, None, "not_match", "DISCREPANCY: the bill is for premises 382, the registration for 384"),
        ("Alpha Nagar 600001", "xxxx", "600001", None, None, "minor_discrepancy", "only the PIN agrees"),
        ("Sy. No. 12/3 Rose Nagar", "Door No. 12 Rose Nagar", None, None, None, "minor_discrepancy", "different registers"),
        (REGISTERED, None, None, None, "Flat 12B", "not_match", "no bill address could be read"),
        (None, "Plot 1", None, None, None, "not_match", "no registered address"),
    ],
)
def test_bill_notes(spark, registered, bill, pin, village, licence, want, says):
    df = spark.createDataFrame([(registered, bill, pin, village, licence)], "r string, b string, p string, v string, l string")
    r = df.select(address.bill_answer(F.col("r"), F.col("b"), F.col("p"), F.col("v"), [("factory licence", F.col("l"))]).alias("x")).first().x
    assert r.value == want and says in r.note


def plain_words(text):
    """Lower-case words of an address, numbers joined over their separators."""
    t = re.sub(r"(?<=\d)[.\-/\\](?=\d)", "_", text.lower())
    t = re.sub(r"(?<=[a-z])\.?\s*/\s*(?=[a-z])", " ", t)
    return re.sub(r"[^a-z0-9_]+", " ", re.sub(r"[.\-/\\]", "", t)).strip("_ ").split()


def plain_verdict(a, b):
    """The verdict on two addresses, token by token."""
    def read(text):
        words, kinds, at = plain_words(text), {}, 0
        while at < len(words):
            kind = next((k for k, ws in address.KINDS.items() if words[at] in ws), None)
            at += 1
            if kind:
                while at < len(words) and words[at] in ("no", "nos", "number", "numbers"):
                    at += 1
                while at < len(words) and re.fullmatch(r"_*\d{1,5}(_+\d{1,5})*_*", words[at]):
                    kinds.setdefault(kind, set()).update(n for n in words[at].split("_") if n)
                    at += 1
        kept = {w for w in words if w not in address.STOP_WORDS}
        pins = {w for w in kept if re.fullmatch(r"\d{6}", w)}
        premises = {w for w in kept - pins if re.search(r"\d", w) and re.search("[a-z]", w) or re.fullmatch(r"\d{3,5}", w) or "_" in w}
        premises |= {p for w in kept if "_" in w for p in w.split("_") if re.fullmatch(r"\d{3,5}", p)}
        return kinds, premises, {w for w in kept if re.fullmatch("[a-z]{3,}", w) and w not in address.STATE_WORDS}, pins

    (ka, pa, la, za), (kb, pb, lb, zb) = read(a), read(b)
    common = ka.keys() & kb.keys()
    conflict, agree = any(not ka[k] & kb[k] for k in common), any(ka[k] & kb[k] for k in common)
    inside = {x for one, two in ((la, lb), (lb, la)) for x in one if len(x) >= 6 and any(x in y and x != y for y in two)}
    place, same = bool(la & lb or inside), (bool(pa & pb) or agree) and not conflict
    za, zb = (min(z) if z else None for z in (za, zb))
    if conflict:
        return "not_match"
    if same and place and not (za and zb and za != zb):
        return "match"
    return "minor_discrepancy" if same or place or za and za == zb else "not_match"


def test_bill_verdicts_equal_plain_matching(spark):
    rng = random.Random(8)
    words = ["Plot", "No.", "Sy.", "S.F.", "Door", "Flat", "12", "12/3", "384-385", "K-77", "7", "Rose", "Nagar", "Rosenagar", "AjRosenagar", "Alphatown", "M.I.D.C.", "Road", "Goa", "600001", "600002", ",", "135/11/A/2"]
    pairs = [(" ".join(rng.choices(words, k=rng.randrange(1, 9))), " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for _ in range(800)]
    df = spark.createDataFrame(pairs, "a string, b string")
    none = F.lit(None).cast("string")
    got = df.select("a", "b", address.bill_verdict(F.col("a"), F.col("b"), none, none).alias("v")).collect()
    assert [(r.a, r.b, r.v) for r in got if r.v != plain_verdict(r.a, r.b)] == []
    assert {r.v for r in got} == {"match", "minor_discrepancy", "not_match"}


FOUND = "vendor_id long, pass long, ord long, parameter_id string, field string, proposed_value string, confidence string, action string"


def test_field_corrections(spark):
    rows = [
        (1, 1, 1, None, "date_of_registration", "2024-01-02", "verified", "correct"), (1, 2, 1, "", "date_of_registration", "2024-02-03", "verified", "correct"), (1, 1, 2, None, "gst_since", "x", "verified", "correct"),
        (1, 1, 3, None, None, "x", "verified", "correct"), (1, 1, 4, None, "gstin", " ", "verified", "correct"), (1, 1, 5, None, "state", "Goa", "likely", "correct"), (1, 1, 6, None, "state", None, "verified", "confirm_ok"),
        (1, 1, 7, "com_gst_vintage", "state", "Goa", "verified", "correct"), (2, 1, 1, None, "pan", "NEW", "verified", "correct"),
    ]
    routed = review.route_field_corrections(spark.createDataFrame(rows, FOUND))
    got = {(r.vendor_id, r["pass"], r.ord): (r.route, r.reason) for r in routed.collect()}
    assert (1, 1, 7) not in got and got[1, 1, 1] == got[1, 2, 1] == ("apply", None)
    assert got[1, 1, 2][0] == "escalate" and "does not read gst_since" in got[1, 1, 2][1] and "date_of_registration" in got[1, 1, 2][1]
    assert [got[1, 1, k][0] for k in (3, 4, 5, 6)] == ["escalate", "escalate", "escalate", "none"]
    entity = spark.createDataFrame([(1, {"gstin": "G"}), (2, {"pan": "OLD", "state": "Goa"}), (3, {"pan": "P"}), (4, None)], "vendor_id long, fields map<string,string>")
    out = {r.vendor_id: r for r in review.apply_field_corrections(entity, routed).collect()}
    assert out[1].fields == {"gstin": "G", "date_of_registration": "2024-02-03"} and out[1].version == 2
    assert [(c.before, c.after) for c in out[1].changes] == [(None, "2024-01-02"), ("2024-01-02", "2024-02-03")]
    assert out[2].fields == {"pan": "NEW", "state": "Goa"} and out[2].changes[0].before == "OLD"
    assert out[3].fields == {"pan": "P"} and (out[3].version, out[3].changes) == (0, []) and out[4].fields is None


def test_state_text_shows_missing_fields(spark):
    resolved = spark.createDataFrame([(1, "a", "x"), (1, "b", None)], "vendor_id long, parameter_id string, value string")
    entity = spark.createDataFrame([(1, {"gstin": "G"})], "vendor_id long, fields map<string,string>")
    lines = review.state_text(resolved, entity).first().text.split("\n")
    assert lines[:2] == ["a = x", "b = UNRESOLVED"] and "- gstin: G" in lines and "- date_of_registration: None (the report shows N/A)" in lines
    assert len(lines) == 2 + len(review.REPORT_FIELDS)


SCORES = "vendor_id long, category_id string, parameter_id string, value string, matched_condition string, assigned_score double, max_score double, unresolved boolean, note string"


def told(spark, *rows):
    full = [(1, c, p, v, v and f"option {v}", s, m, v is None, n) for c, p, v, s, m, n in rows]
    return {(r.kind, r.text) for r in report.findings(spark.createDataFrame(full, SCORES)).collect()}


def test_findings(spark):
    legal = lambda p, v, s, n="": ("legal_aml", p, v, s, 1.0, n)
    assert told(spark, ("compliance", "com_multiple_registrations", "cancelled_present", 2.0, 2.0, "one in Goa")) == {("n", "Cancelled registrations on the entity's PAN: one in Goa")}
    assert told(spark, ("proof_of_address", "addr_ownership_type", "owned", 5.0, 5.0, "NO SALE DEED ON FILE")) == {("c", "Business premises owned, by inference: no sale deed on file")}
    assert told(spark, ("compliance", "com_pf_filing_status", None, 0.0, 0.0, "N/A")) == set()
    assert told(spark, ("compliance", "com_hsn_match", None, 0.0, 2.0, "no map.")) == {("n", "com_hsn_match: not verified automatically"), ("n", "com_hsn_match, not determined: no map.")}
    assert told(spark, legal("legal_pep", "no_pep", 1.0), legal("legal_ecourts", "no_criminal", 1.0)) == {("c", "No legal or AML record on any register")}
    assert told(spark, legal("legal_pep", "no_pep", 1.0), legal("legal_ecourts", None, 0.0)) == {("c", "No record on the registers that were screened: legal_pep"), ("n", "1 of 2 legal and AML registers could not be screened, and do not count as clean")}
    assert told(spark, legal("legal_pep", "pep_identified", 0.0)) == set()
    both = told(spark, ("proof_of_identity", "ident_pan_active", "active", 2.0, 2.0, ""), ("proof_of_identity", "ident_pan_name_match", "match", 3.0, 3.0, "WARNING: one letter differs."))
    assert both == {("c", "PAN is active, and its name agrees with the registered name"), ("n", "ident_pan_name_match: WARNING: one letter differs.")}
    assert report.findings(spark.createDataFrame([], SCORES)).count() == 0


def test_free_lists_where_no_sweep_is_comprehensive(spark):
    """Hits of the owner's screen count, the firm's namesakes are dismissed, and without a sweep the free lists speak."""
    entity = spark.createDataFrame([(1, "Rose Mills", None, None, "AAAFA1234B"), (2, "Quill Forge", None, None, None)], "vendor_id long, legal_name string, trade_name string, pan_entity_name string, pan string")
    people = spark.createDataFrame([(1, "Asha Kumar"), (2, "Bela Rao")], "vendor_id long, name string")
    hit = lambda **row: [row]
    screens = spark.createDataFrame([
        (1, False, {"SanctionCheck": 1, "PEPCheck": 0}, {"SanctionCheck": hit(list="UN", matched_name="Other Works", source="a"), "PEPCheck": hit(list="x")}, None),
        (1, True, {"PEPCheck": 1}, {"PEPCheck": hit(list="Heads", matched_name="Asha Kumar", source="b", score="90%")}, None),
    ], "vendor_id long, owner boolean, hits_found map<string,int>, categories map<string,array<map<string,string>>>, error string")
    lists = spark.createDataFrame([("un", "1", "Quill Forge")], "source string, list_id string, name string")
    docket = spark.createDataFrame([(7, None, "Bela Rao")], "case_id long, applicant string, respondent string")
    r = vendors.Registers(people=people, screens=screens, watch_names=lists, watch_sources=("un",), unread_sources=("eu",), office_holders=spark.createDataFrame([("Nobody",)], "name string"), docket=docket)
    got = {(x.vendor_id, x.parameter_id): (x.value, x.note) for x in vendors.legal_rows(entity, vendors.own_names(entity, people), r).collect()}
    assert len(got) == 10
    assert got[1, "legal_sanctions"] == ("not_listed", "NOT SCREENED: eu | namesakes dismissed: UN: another name")
    assert got[1, "legal_pep"] == ("pep_identified", "Heads (PEPCheck): 1 rows, score 90%") and got[2, "legal_pep"][0] == "no_pep"
    assert got[2, "legal_sanctions"] == ("listed", "NOT SCREENED: eu") and got[2, "legal_drt_sarfaesi"] == ("active_drt", "1 cases, 0 loose matches rejected")
    assert got[1, "legal_drt_sarfaesi"][0] == "no_drt" and got[1, "legal_ecourts"] == (None, "only a comprehensive sweep decides")


def test_vendors_of_any_key_equal_their_sql(spark, sf, tmp_path):
    """Customers whose keys would be industry codes of waste and trade, and suppliers of one name, one of whom has cases."""
    con = duckdb.connect()
    for t in ("orders", "events", "nation"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet' limit 50")
    con.execute("create view customer as select 12341 + 12000 * i as c_custkey, 'AUTOMOBILE' as c_mktsegment from range(4) r(i) union all select 10 * i, 'AUTOMOBILE' from unnest([3601, 4500, 6999]) r(i)")
    con.execute("create view supplier as select i as s_suppkey, 'Supplier#000000001' as s_name from unnest([3601, 4500, 6999, 4834, 3634]) r(i)")
    for t in "customer supplier orders events nation".split():
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    rel = con.execute(catalog.ORACLE["assessed_parameters"])
    cols = [c[0] for c in rel.description]
    assert sorted(map(tuple, catalog.QUERIES["assessed_parameters"](spark, str(tmp_path)).select(*cols).collect())) == sorted(rel.fetchall())
