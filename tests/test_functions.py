"""Golden cases of column functions; names and numbers are invented."""

import datetime as dt
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from duelight.functions import address, names, text


def one(spark, make, *values):
    """The value of a column expression over string literals."""
    row = spark.range(1).select(make(*[F.lit(v).cast("string") for v in values]).alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    ("given", "want"),
    [("Plot No. 210-211", "plot no 210_211"), ("A.B.C.D. K-77", "abcd k77"), ("Sy. No. 21/4", "sy no 21_4"), ("City/Town/Village: X", "city town village x"), ("प्लॉट ३८२", "382"), (None, "")],
)
def test_norm_addr(spark, given, want):
    assert one(spark, address.norm_addr, given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Sy. No. 21/4, Door No. 6, Plot 210", {"survey": ["21", "4"], "door": ["6"], "plot": ["210"]}),
        ("Road Number 2, Phase 2", {}),
        ("plot no 10 11 x", {"plot": ["10", "11"]}),
        ("PLNO 9 x", {"plot": ["9"]}),
        ("Plot Nos. 384-385, Estate", {"plot": ["384", "385"]}),
        ("Plot 12a", {}),
    ],
)
def test_premises_ids(spark, given, want):
    got = one(spark, address.premises_ids, given)
    assert {k: sorted(v, key=int) for k, v in got.items()} == {k: sorted(v, key=int) for k, v in want.items()}


@pytest.mark.parametrize(
    ("a", "b", "conflict", "comparable"),
    [("plot no 10 11 x", "PLNO 9 x", True, True), ("Sy. No. 12/3 y", "Door No. 12 y", False, False), ("x", "plot 1", False, True)],
)
def test_compare_premises(spark, a, b, conflict, comparable):
    r = one(spark, lambda x, y: address.compare_premises(address.premises_ids(x), address.premises_ids(y)), a, b)
    assert (r.conflict, r.comparable) == (conflict, comparable)


@pytest.mark.parametrize(
    ("registered", "bill", "want"),
    [
        ("Plot 12 Alphatown Betacity PIN 600001", "Plot 12 Alphatown 600001", "match"),
        ("Plot 12 Alphatown Betacity PIN 600001", "Alphatown 600001", "minor_discrepancy"),
        ("Plot 12 Alphatown Betacity PIN 600001", "xxxx 600001", "minor_discrepancy"),
        ("Plot 12 Alphatown Betacity PIN 600001", "Plot 14 Alphatown Betacity 600001", "not_match"),
        ("Plot 12 Alphatown Betacity PIN 600001", None, "not_match"),
        (None, "Plot 12", "not_match"),
    ],
)
def test_bill_verdict(spark, registered, bill, want):
    assert one(spark, lambda a, b: address.bill_verdict(a, b, F.lit(None).cast("string"), F.lit(None).cast("string")), registered, bill) == want


def test_place_overlap(spark):
    over = lambda a, b: spark.range(1).select(address.place_overlap(F.array(F.lit(a)), F.array(F.lit(b))).alias("x")).first().x
    assert over("gammanagar", "ajgammanagar") == ["gammanagar"]
    assert over("road", "broadway") == []


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("EXAMPLE TRAIING ?O", "EXAMPLE TRADING CO", True), ("EXAMPLE TRADING CO", "EXAMPLE ENGINEERING WORKS", False), ("ALPHA IRON PVT.LTD.", "ALPHA IRON PRIVATE LIMITED", True), (None, "X", None), ("Ltd", "Alpha", None)],
)
def test_name_match(spark, a, b, want):
    assert one(spark, names.name_match, a, b) is want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("A PERSON", "B PERSON", False), ("NAVIN K", "KANNU NAVIN", True), ("M/S B.R. TRADING CO", "B R TRADING COMPANY", True), ("EXAMPLE PARTNER", "ANOTHER PARTNER", False), ("", "X", None)],
)
def test_names_agree(spark, a, b, want):
    assert one(spark, names.names_agree, a, b) is want


@pytest.mark.parametrize(
    ("entity", "listed", "want"),
    [("Tata Steel Works", "TATA STEEL LIMITED", True), ("Tata", "batata chips", False), ("Zenith", "Zenith Alpha", True), ("Zenith", "one two three Zenith four", False), ("Bank of", "Bank of", True), (None, "x", False)],
)
def test_token_match(spark, entity, listed, want):
    assert one(spark, names.token_match, entity, listed) is want


def test_identifiers(spark):
    assert one(spark, lambda t, i: text.garbled_id(t, i), "see AAAAL23u4B", "AAAAA1234B") is True
    assert one(spark, lambda t, i: text.garbled_id(t, i), "see AAAAL23u4B", "ZZZZZ9999Z") is False
    assert one(spark, text.fix_ifsc, "SBIN O123456") == "SBIN0123456"
    assert one(spark, text.bank_from_ifsc, "HDFC0000001") == "HDFC Bank"
    assert one(spark, text.state_from_gstin, "27ABCDE1234F1Z5") == "Maharashtra"
    assert one(spark, text.pan_from_gstin, "27ABCDE1234F1Z5") == "ABCDE1234F"
    assert one(spark, text.pan_category, "ABCPE1234F") == "individual"
    assert one(spark, text.status_class, "Cancelled suo motu") == "cancelled"
    assert one(spark, text.status_class, "Inactive") == "ambiguous"


def test_dates(spark):
    as_of = F.to_date(F.lit("2026-03-10"))
    assert one(spark, lambda d: text.years_since(d, as_of), "10/03/2020") == 6.0
    assert one(spark, lambda d: text.vintage_phrase(d, as_of), "2020-03-11") == "~5 years 11 months"
    assert one(spark, lambda d: text.vintage_phrase(d, as_of), "2027-01-01") is None
    assert one(spark, lambda m, y: text.period_start(m, y), "February", "2025-2026") == dt.date(2026, 2, 1)
    assert one(spark, lambda m, y: text.period_start(m, y), "Annual", "2025-2026") is None
    assert one(spark, lambda m, y: text.due_date(text.period_start(m, y), F.lit("GSTR1")), "December", "2025-2026") == dt.date(2026, 1, 11)
    assert one(spark, text.spelt_date, "TWENTY NINETH day of NOVEMBER TWO THOUSAND TWENTY THREE") == "29/11/2023"
    assert one(spark, text.spelt_date, "FORTY day of NOVEMBER TWO THOUSAND") is None
    assert one(spark, text.to_dmy, "2024-01-31") == "31/01/2024"


def test_small_functions(spark):
    assert one(spark, text.slug, " A & B, Co. ") == "a-b-co"
    assert one(spark, text.score_value, "100%") == 100.0
    assert one(spark, text.score_value, "?") == -1.0
    assert one(spark, lambda c: text.dig(F.parse_json(c), "a.0.b"), '{"a": [{"b": "x"}]}') == "x"
    assert one(spark, lambda c: text.first_of(F.parse_json(c), "a", "b"), '{"a": "", "b": 0}') == "0"
    rows = spark.createDataFrame([(i, j) for i, j in enumerate(['{"a": {"k": "v"}}', '{"a": "\\"k\\": 1", "b": [1, {"c": {"k": 2}}], "k": null}', '{"b": {"k": 3}, "k": 4}', '[{"x": []}, {"k": {"k": 5}}]', '{"a": 1}', None, '{"k": [6]}', '{"k": [6]}'])], "i int, j string")
    got = text.find_key(rows.select("i", F.try_parse_json("j").alias("v")), "v", "k", "found").select("i", F.to_json("found").alias("f"))
    assert {r.i: r.f for r in got.collect()} == {0: '"v"', 1: "2", 2: "4", 3: '{"k":5}', 4: None, 5: None, 6: "[6]", 7: "[6]"}
    assert one(spark, text.clean_party, "MESSRS KINGSTON INDUSTRIES AND OTHERS") == "KINGSTON INDUSTRIES"
    assert one(spark, lambda c: text.split_code(c)["code"], "22209 - Plastics") == "22209"
    assert one(spark, text.seller_type_kw, "Retail trade") == "trader"
    assert one(spark, text.seller_type_nic, "46620") == "trader"
    assert one(spark, text.constitution, "Limited Liability Partnership") == "llp"
    assert one(spark, text.headline, "No. 5 is fine. WARNING: look here. Rest.") == "WARNING: look here."
    assert one(spark, text.strip_honorifics, "Late Shri. A  Person") == "a person"
    assert one(spark, lambda c: text.split_flag(c)["head"], "a.pdf: missing page") == "a.pdf"
    assert one(spark, text.fmt_value, "5.0") == "5"
    assert one(spark, text.escape_html, "<a&b>") == "&lt;a&amp;b&gt;"
    assert one(spark, text.display_address, "Block: -, City: Alpha, State: Beta") == "Alpha, Beta"
    assert one(spark, text.location, "Plot 1, Alphatown, Beta State 600001") == "Alphatown, Beta State"
    assert one(spark, text.location, "City: alpha State: beta PIN: 1") == "Alpha, Beta"


def plain_match(a, b):
    parts = lambda s: {w for w in re.sub(r"[^a-z0-9 ]", " ", s.lower()).split() if w not in names.NOISE}
    sa, sb = parts(a), parts(b)
    if not sa or not sb:
        return None
    clean = lambda s: " ".join(re.sub(r"[^a-z0-9 ]", "", s.lower()).split())
    return len(sa & sb) / max(len(sa), len(sb)) >= 0.6 or SequenceMatcher(None, clean(a), clean(b)).ratio() >= 0.85


def plain_agree(a, b):
    def parts(s):
        s = re.sub(r"^\s*m\s*/?\s*s\.?\s+", "", s.lower())
        s = re.sub(r"\b(private|pvt|limited|ltd|llp|co|company|and|&)\b\.?", " ", s)
        return set(re.sub(r"[^a-z0-9 ]", "", s.replace(".", " ")).split())

    sa, sb = parts(a), parts(b)
    if not sa or not sb:
        return None
    shared, lost = sa & sb, False
    for x, y in ((sa, sb), (sb, sa)):
        begins = {t[0] for t in y if len(t) > 1}
        for t in x:
            if len(t) == 1:
                shared |= {t} & begins
                lost |= t not in begins and t not in y
    long = [{t for t in s if len(t) > 1} for s in (sa, sb)]
    if lost and long[0] and long[0] == long[1]:
        return False
    if len(shared) >= 2 and any(len(t) > 1 for t in shared) or min(len(sa), len(sb)) == 1 and shared:
        return True
    return SequenceMatcher(None, " ".join(sorted(sa)), " ".join(sorted(sb))).ratio() >= 0.8


def test_names_equal_plain_matching_and_few_reach_python(spark):
    """Both matchers against difflib on all pairs of garbled names; rows whose letters settle the ratio never reach Python."""
    rng = random.Random(4)
    words = ["asha", "traders", "quill", "forge", "m", "a.b.", "rose", "mills", "pvt", "ltd", "kumar", "k", "engineering", "&", "works", "rosé"]
    some = ["", "  ", "LTD", None] + [" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(60)]
    some += ["".join(rng.choice("aeiou?") if rng.random() < 0.15 else c for c in n) for n in some[4:40]]
    pairs = [(x, y) for x in some for y in some]
    df = spark.createDataFrame(pairs, "a string, b string")
    for question, plain in ((names.match_question, plain_match), (names.agree_question, plain_agree)):
        got = names.split_by(df, "v", question, "a", "b").collect()
        assert len(got) == len(pairs)
        for r in got:
            assert r.v is (None if r.a is None or r.b is None else plain(r.a, r.b)), (r.a, r.b)
        reach = df.where(question(F.col("a"), F.col("b")).left.isNotNull()).count()
        able = sum(x is not None and y is not None and plain(x, y) is not None for x, y in pairs)
        assert 0 < reach < 0.1 * able
    plan = names.split_by(df, "v", names.match_question, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" in plan
