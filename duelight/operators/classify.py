"""Document types by file name and by content, as ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File-name patterns by type, the first type that matches wins.
NAME_RULES = (
    ("gst_certificate", (r"gst[\s_-]*cert", r"\bgst\b.*\.pdf$")),
    ("gst_portal", (r"gst[\s_-]*portal", r"gst[\s_-]*snap", r"gst\s*proof", r"bank\s*detail", r"new\s*b[an]?ak?\s*detail")),
    ("cancelled_cheque", (r"cancel+ed?[\s_-]*cheque", r"cancel\s*cheque", r"\bcheque\b")),
    ("pan_owner", (r"owner[\s_-]*pan", r"director[\s_-]*pan", r"partner[\s_-]*pan", r"proprietor[\s_-]*pan")),
    ("pan_entity", (r"entity[\s_-]*pan", r"company[\s_-]*pan", r"\bpan\s*card\b", r"(?<![a-z])pan(?![a-z])")),
    ("msme_certificate", (r"(?<![a-z])msme(?![a-z])", r"(?<![a-z])udyam(?![a-z])")),
    ("certificate_of_incorporation", (r"certificate[\s_-]*of[\s_-]*incorporation", r"\bcoi\b", r"incorporation[\s_-]*cert")),
    ("kyc_form", (r"\bkyc\b",)),
    ("electricity_bill", (r"electricity", r"elec\w*[\s_-]*bill", r"e[\s_-]*bill", r"power[\s_-]*bill", r"current[\s_-]*bill", r"\beb[\s_-]*bill",
                          r"(?<![a-z])(tsspdcl|tgspdcl|tsnpdcl|apspdcl|apepdcl|apcpdcl|bescom|tneb|tangedco|msedcl|mahadiscom|kseb|bses|cesc|pspcl|wbsedcl|uhbvn|dhbvn|mgvcl|pgvcl|ugvcl|dgvcl|torrent[\s_-]*power|adani[\s_-]*electricity|tata[\s_-]*power)(?![a-z])")),
    ("sale_deed", (r"sale[\s_-]*deed", r"property[\s_-]*tax", r"index[\s_-]*ii", r"7\s*/\s*12\s*extract")),
    ("landlord_declaration", (r"landlord", r"\bnoc\b", r"no[\s_-]*objection")),
    ("rental_agreement", (r"rental", r"\blease\b", r"rent[\s_-]*agreement", r"proof[_\s]*of[_\s]*premises")),
    ("aadhaar", (r"aadha?ar",)),
    ("client_photo", (r"customer[\s_-]*photo", r"customer\s*image", r"owner\s*image", r"\bphoto\b")),
    ("factory_license", (r"factory[\s_-]*licen[cs]e",)),
    ("pcb_certificate", (r"\bpcb\b", r"pollution[\s_-]*control", r"consent[\s_-]*to[\s_-]*operate")),
    ("trade_licence", (r"trade[\s_-]*licen[cs]e", r"shop[\s_-]*act", r"shop[\s_-]*establishment")),
)
# Content signatures by type; a group's patterns must all occur, one group is enough.
CONTENT_RULES = (
    ("gst_certificate", (("certificate of registration",), ("form gst reg-06",), ("goods and services tax", "registration certificate"))),
    ("msme_certificate", (("udyam registration certificate",), (r"udyam-[a-z]{2}-\d{2}-\d{7}",))),
    ("gst_portal", (("gst", "bank account status"), ("account status", "gstin"))),
    ("cancelled_cheque", (("ifsc", r"a\s*/?\s*c\s*no"), ("ifs code", r"a\s*/?\s*c\s*no"), ("payable at par at all branches",))),
    ("aadhaar", (("unique identification authority",), ("aadhaar", "government of india"))),
    ("certificate_of_incorporation", (("certificate of incorporation",), ("corporate identity number", "registrar of companies"), ("ministry of corporate affairs", r"\bcin\b"))),
    ("pan_entity", ((r"income\s*tax\s*dep\w*", r"permanent\s*account\s*num\w*"), (r"permanent\s*account\s*num\w*", r"\b[a-z]{5}\d{4}[a-z]\b"),
                    (r"go[vy]t\.?\s*of\s*india", r"permanent\s*account\s*num\w*"), (r"go[vy]t\.?\s*of\s*india", r"\b[a-z]{5}\d{4}[a-z]\b"), (r"income\s*tax\s*dep\w*", r"\b[a-z]{5}\d{4}[a-z]\b"))),
    ("electricity_bill", (("electricity bill",), ("vidyut vitran",), ("विद्युत वितरण",), ("वीज बिल",), ("बिजली बिल",), ("ವಿದ್ಯುತ್ ಬಿಲ್",), ("ಬೆಸ್ಕಾಂ",), ("విద్యుత్ బిల్లు",), ("மின் கட்டண ரசீது",),
                          ("sanctioned load", "billed demand"), ("kwh", "meter number"), ("kwh", "sanctioned load"), ("unique service number",), (r"\bkwh\b",), ("connected load",), ("contracted demand",),
                          ("consumer name", "service number"), ("consumer number", "units"), ("consumer no", "units"), (r"\bero\b", "service number"), ("current month bill", "consumer"))),
    ("trade_licence", (("shops and commercial establishment",), ("registration certificate of shop",), ("trade licence",), ("trade license",))),
    ("rental_agreement", (("lessor",), ("lessee",), ("this rental agreement",), ("this lease agreement",))),
    ("sale_deed", (("sale deed",), ("vendor", "purchaser", "consideration"))),
)


def _chain(rules, test) -> Column:
    """The first rule's name whose test holds; CASE WHEN stops at it."""
    out = None
    for name, patterns in rules:
        held = test(patterns)
        out = F.when(held, name) if out is None else out.when(held, name)
    return out


def by_name(file_name: Column, rules=NAME_RULES) -> Column:
    """Document type by file name, null if none (PRJ-01)."""
    low = F.lower(file_name)
    return _chain(rules, lambda patterns: low.rlike("|".join(f"(?:{p})" for p in patterns)))


def by_content(text: Column, rules=CONTENT_RULES) -> Column:
    """Document type by text, null if none (PRJ-02)."""
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    group = lambda g: reduce(lambda a, b: a & b, [low.rlike(p) for p in g])
    return _chain(rules, lambda groups: reduce(lambda a, b: a | b, [group(g) for g in groups]))


def classify(documents: DataFrame, doc_text: DataFrame | None = None) -> DataFrame:
    """documents with doc_type by name, else by confident text (PRJ-03), and whether text decided."""
    rows = documents.withColumn("name_type", by_name(F.col("file_name")))
    if doc_text is None:
        return rows.withColumnRenamed("name_type", "doc_type").withColumn("by_text", F.lit(False))
    rows = rows.join(doc_text.select("doc_id", "text", "confident"), "doc_id", "left")
    found = F.when(F.col("name_type").isNull() & F.col("confident"), by_content(F.col("text")))
    return rows.withColumn("_found", found).withColumn("doc_type", F.coalesce("name_type", "_found")).withColumn("by_text", F.col("name_type").isNull() & F.col("_found").isNotNull()).drop("_found", "name_type", "text", "confident")


def apply_doc_overrides(documents: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents with types moved or dropped ("ignore"), and overrides of unknown files (PRJ-04)."""
    moves = overrides.select("vendor_id", "file_name", F.lower(F.trim("doc_type")).alias("_to"))
    rows = documents.join(moves, ["vendor_id", "file_name"], "left")
    kept = rows.where(F.coalesce("_to", F.lit("")) != "ignore").withColumn("doc_type", F.coalesce("_to", "doc_type")).drop("_to")
    return kept, moves.join(documents, ["vendor_id", "file_name"], "left_anti")


def route_id_cards(cards: DataFrame) -> DataFrame:
    """cards (card_pan, text, entity_pan) with doc_type: the entity's, a garble of it, or unreadable stay; a clean other one is an owner's (PRJ-05)."""
    from duelight.functions.text import garbled_id

    mine = F.col("entity_pan").isNull() | F.col("card_pan").isNull() | (F.col("card_pan") == F.col("entity_pan")) | F.coalesce(garbled_id(F.col("text"), F.col("entity_pan")), F.lit(False))
    return cards.withColumn("doc_type", F.when(mine, F.col("doc_type")).otherwise("pan_owner"))


def page_is_scan(text: Column, image_cover: Column) -> Column:
    """Fewer than 30 characters, or under 300 beside an image over half the page (PRJ-18)."""
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    return (n < 30) | ((n < 300) & (image_cover >= 0.5))


def choose_text(tiers: list[tuple[str, Column]], least: dict[str, int] | None = None) -> Column:
    """struct(text, method): the first tier with text, OCR only with over 20 characters (SRC-02)."""
    least = least or {"ocr": 21}
    out = F.lit(None).cast("struct<text:string,method:string>")
    for method, text in reversed(tiers):
        good = F.length(F.trim(text)) >= least.get(method, 1)
        out = F.when(good, F.struct(text.alias("text"), F.lit(method).alias("method"))).otherwise(out)
    return F.coalesce(out, F.struct(F.lit(None).cast("string").alias("text"), F.lit("unavailable").alias("method")))


def choose_read(first: Column, second: Column, expected: Column) -> Column:
    """Of two maps of fields, the one that recovers more expected ones, the first read's values winning (PRJ-17)."""
    got = lambda m: F.size(F.filter(expected, lambda f: F.coalesce(F.try_element_at(m, f), F.lit("")) != ""))
    merged = F.map_concat(F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k)), first)
    return F.when(got(second) > got(first), merged).otherwise(first)
