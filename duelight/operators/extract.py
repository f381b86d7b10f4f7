"""Fields of documents by type: one pass of regular expressions, then long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelight.functions.text import EMAIL, GSTIN, IDENTIFIERS, MOBILE, PAN, UDYAM, any_of, bank_from_ifsc, extract, fix_ifsc, pan_from_gstin, spelt_date, squeeze, state_from_gstin

Fields = dict[str, Column]

# What the printed forms say around their fields, by type of document.
FORMS = {
    "gst_certificate": {
        "liability": r"Date of Liability\s*\n\s*(\d{2}/\d{2}/\d{4})",
        "validity": r"(?:Period|Date) of Validity\s*\n\s*From\s*\n\s*(\d{2}/\d{2}/\d{4})",
        "legal_name": r"Legal Name\s*\n\s*(.+)",
        "trade_name": r"Trade Name,?\s*if any\s*\n\s*(.+)",
        "constitution": r"Constitution of Business\s*\n\s*(.+)",
        "address": r"(?s)Address of Principal Place of\s*\n?\s*Business\s*\n\s*(.+?)(?:\n\s*\d\.|\n\s*Date of Liability)",
        "taxpayer_type": r"Type of Registration\s*\n\s*(\w+)",
    },
    "msme_certificate": {
        "block": r"(?s)OFFICI?AL ADDRESS OF\s*\n?\s*ENTERPRISE\s*\n(.+?)\n\s*(?:Mobile|Email)\b",
        "activity": r"MAJOR ACTIVITY\s*\n\s*(.+)",
        "bank": r"Bank Name\s*\n?\s*IFS Code\s*\n?\s*Bank Account Number\s*\n?\s*(.+?)\n\s*([A-Z]{4}0[A-Z0-9]{6})\s*\n\s*(\d{6,18})",
        "name": r"NAME OF ENTERPRISE\s*\n\s*(.+)",
        "class": r"\b(Micro|Small|Medium)\b",
        "begun": r"DATE OF (?:INCORPORATION|COMMENCEMENT)[^\n]*\n[^\n]*\n\s*(\d{2}/\d{2}/\d{4})",
        "founded": r"Date of Incorporation\s*\n?\s*(\d{2}/\d{2}/\d{4})",
        "organisation": r"Type of Organisation\s*\n?\s*(\w+)",
        "code_end": r"(?=\n\s*\n|\n\s*\d+\s*-\s*[A-Za-z]|\n\s*[A-Z][A-Z ]{5,}|\n\s*(?:Manufacturing|Trading|Services|Manufacture and Trading)\s*(?:\n|$)|\z)",
    },
    "cancelled_cheque": {
        "account": r"(?i)(?:A/?c\.?\s*NO\.?|Account\s*No\.?|खा\.?\s*सं\.?)\s*[:\-]?\s*(\d{9,18})",
        "holder": r"(?m)(^|\S\s+)FOR\s+([A-Z][A-Za-z .&]+)",
        "no_holder": r"(?i)\b(MONTHS?|ONLY|VALID|PAYEE|ORDER|BEARER|SELF)\b",
        "title": r"(?i)\b(PROPRIETOR|DIRECTOR|PRIVATE|PVT\.?|LTD\.?|LIMITED)\b",
        "strike": r"diagonal.{0,40}(cancel|strike)",
        "cancelled": r"\bcancel+ed?\b",
    },
    "electricity_bill": {
        "block": r"(?s)Name\s*/\s*Address\s*&?\s*GST of the Consumer\s*\n\s*(.+?)\n\s*(.+?)\n\s*State\s*[:\-]",
        "loose": r"(?im)^[ \t]*(m\s*/?\s*s\.?\s+\S.*)\s*\n((?:(?!.*\b\d{6}\b).+\s*\n){0,5}.*\b\d{6}\b.*)",
    },
    "gst_portal": {
        "marker": r"PARSED_STATUS:\s*(VERIFIED|NOT_VERIFIED)",
        "account": r"Account Number\s*[:\-]?\s*(\d{9,18})",
        "bank": r"Bank Name\s*[:\-]?\s*(.+)",
        "status": r"(?<!Bank )Account Status\s*[:\-]\s*([A-Za-z][\w ]*)",
        "kind_row": r"(?mi)^\s*\d+\s*\|\s*(CC|OD|SB|CA|OCC|BC|CD)\s*\|",
        "kind": r"Type of Account\s*[:\-]\s*([A-Za-z]{2,3})\b",
    },
    "pan_card": {
        "caption": r"^[^a-z]*(?:i\s+)?(?:fa[lt]her\S*\s+(?:s\s+)?|mother\S*\s+)?name\s*[:\-]?$",
        "label": r"permanent\s*account|income\s*tax|go[vy]t|government|electronically issued|fa[lt]her|d[ao][tl]e\s*[o0]f\s*birth|signature",
        "header": r"(?i)go[vy]t\.?\s*of\s*india",
    },
    "kyc_form": {
        "bank_row": r"(?i)Bank Account Details[^\n]*[:\-]\s*([^\n]+)",
    },
    "factory_license": {
        "premises": r"(?s)Description of Licensed Premises\s*(.+)",
        "signed": r"(?i)\b(?:digitally signed|joint director|deputy director|signature)\b",
        "number": r"Registration Number\s*:?\s*([A-Za-z0-9]+)",
    },
    "pcb_certificate": {
        "premises": r"(?si)(S\.?\s*F\.?\s*No\.?.+?District)",
        "number": r"(?i)Consent Order No\.?\s*:?\s*([A-Za-z0-9]+)",
    },
    "certificate_of_incorporation": {
        "name": r"(?si)certify that\s+(.+?)\s+is incorporated on",
        "pan": r"(?s)(?i:Permanent Account Number).*?\b([A-Z]{5}\d{4}[A-Z])\b",
        "date": r"(?si)incorporated on this\s+(.+?)\s+under the",
    },
}


def _gstin(t: Column) -> Column:
    return extract(F.replace(t, F.lit(" "), F.lit("")), f"({GSTIN})")


def _no_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^M/S\s+", "")


def _lines(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda s: s != "")


def gst_certificate(t: Column) -> Fields:
    number = _gstin(t)
    date = F.coalesce(extract(t, FORMS["gst_certificate"]["liability"]), extract(t, FORMS["gst_certificate"]["validity"]))
    return {
        "gstin": number,
        "legal_name": extract(t, FORMS["gst_certificate"]["legal_name"]),
        "trade_name": _no_prefix(extract(t, FORMS["gst_certificate"]["trade_name"])),
        "constitution": extract(t, FORMS["gst_certificate"]["constitution"]),
        "address": squeeze(extract(t, FORMS["gst_certificate"]["address"])),
        "date_of_registration": date,
        "taxpayer_type": extract(t, FORMS["gst_certificate"]["taxpayer_type"]),
        "state": state_from_gstin(number),
        "pan": pan_from_gstin(number),
    }


# Labels of the printed address block.
ADDRESS_LABELS = ("Flat/Door/Block No.", "Name of Premises/ Building", "Village/Town", "Block", "Road/Street/Lane", "City", "State", "District")


def address_block(t: Column) -> tuple[Column, Column]:
    """Address as "Label: value" and PIN of a block of labels and values on alternate lines (EXT-03)."""
    block = extract(t, FORMS["msme_certificate"]["block"])
    lines = _lines(block)
    start = F.struct(F.lit("").alias("label"), F.array().cast("array<string>").alias("out"))

    def step(a, line):
        pending, label = a["label"] != "", line.isin(*ADDRESS_LABELS)
        keep = pending & ~label & (line != "-")
        out = F.when(keep, F.concat(a["out"], F.array(F.concat_ws(": ", a["label"], line)))).otherwise(a["out"])
        return F.struct(F.when(~pending & label, line).otherwise("").alias("label"), out.alias("out"))

    text = F.nullif(F.array_join(F.aggregate(lines, start, step, lambda a: a["out"]), " "), F.lit(""))
    return text, F.when(text.isNotNull(), extract(block, r"\bPin\s*(\d{6})"))


def nic(t: Column, width: int) -> tuple[Column, Column]:
    """Industry code of a width, and its description over wrapped lines (EXT-04)."""
    stop = FORMS["msme_certificate"]["code_end"]
    pattern = rf"(?s)\b(\d{{{width}}})\s*-\s*([A-Za-z].*?){stop}"
    return extract(t, pattern), F.regexp_replace(squeeze(extract(t, pattern, 2)), ",+$", "")


def msme_certificate(t: Column) -> Fields:
    activity = extract(t, FORMS["msme_certificate"]["activity"])
    low = F.lower(activity)
    bank = FORMS["msme_certificate"]["bank"]
    address, pin = address_block(t)
    (code5, text5), (code4, text4) = nic(t, 5), nic(t, 4)
    return {
        "udyam_number": extract(t, f"({UDYAM})"),
        "enterprise_name": _no_prefix(extract(t, FORMS["msme_certificate"]["name"])),
        "enterprise_type": F.try_element_at(F.regexp_extract_all(t, F.lit(FORMS["msme_certificate"]["class"]), F.lit(1)), F.lit(-1)),
        "major_activity": F.when(any_of(low, ("manufactur",)), "Manufacturing").when(any_of(low, ("trad",)), "Trading").when(any_of(low, ("servic",)), "Services").otherwise(activity),
        "date_of_incorporation": F.coalesce(extract(t, FORMS["msme_certificate"]["begun"]), extract(t, FORMS["msme_certificate"]["founded"])),
        "mobile": extract(t, f"({MOBILE})"),
        "email": extract(t, f"({EMAIL})"),
        "organisation_type": extract(t, FORMS["msme_certificate"]["organisation"]),
        "address": address, "pincode": pin,
        "nic_5_code": code5, "nic_5_description": text5, "nic_4_code": code4, "nic_4_description": text4,
        "pan": extract(t, f"({PAN})"),
        "bank_name_msme": extract(t, bank), "ifsc_msme": extract(t, bank, 2), "account_number_msme": extract(t, bank, 3),
    }


def cancelled_cheque(t: Column) -> Fields:
    code = fix_ifsc(t)
    labelled = extract(t, FORMS["cancelled_cheque"]["account"])
    runs = F.regexp_extract_all(F.replace(t, F.lit(" "), F.lit("")), F.lit(r"\b\d{9,18}\b"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r"))))["r"]
    pattern = F.lit(FORMS["cancelled_cheque"]["holder"])
    held = F.arrays_zip(F.regexp_extract_all(t, pattern, F.lit(1)).alias("lead"), F.transform(F.regexp_extract_all(t, pattern, F.lit(2)), lambda x: F.trim(x)).alias("name"))
    held = F.filter(held, lambda h: ~h["name"].rlike(FORMS["cancelled_cheque"]["no_holder"]))
    best = F.array_max(F.transform(held, lambda h, i: F.struct((h["lead"] == "").cast("int").alias("a"), F.length(h["name"]).alias("n"), (-i).alias("i"), h["name"].alias("name"))))["name"]
    low = F.lower(t)
    return {
        "ifsc": code,
        "bank_name": bank_from_ifsc(code),
        "account_number": F.coalesce(labelled, longest),
        "account_holder": F.trim(F.regexp_replace(best, FORMS["cancelled_cheque"]["title"], "")),
        "cancellation_mark_present": (low.rlike(FORMS["cancelled_cheque"]["strike"]) | low.rlike(FORMS["cancelled_cheque"]["cancelled"])).cast("string"),
    }


# Labels of electricity bills in five scripts.
BILL_LABELS = {
    "consumer_name": "Consumer Name|ग्राहकाचे नाव|उपभोक्ता का नाम|ಗ್ರಾಹಕರ ಹೆಸರು|వినియోగదారు పేరు|நுகர்வோர் பெயர்",
    "address": "Address|पत्ता|पता|ವಿಳಾಸ|చిరునామా|முகவரி",
    "pincode": "Pin Code|पिन कोड|ಪಿನ್ ಕೋಡ್|పిన్ కోడ్|அஞ்சல் குறியீடு",
    "category": "Category|प्रवर्ग|श्रेणी|ವರ್ಗ|వర్గం|வகை",
    "activity": "Activity|वापर|उपयोग|ಬಳಕೆ|వినియోగం|பயன்பாடு",
    "village": "Village|गाव|गांव|ಗ್ರಾಮ|గ్రామం|கிராமம்",
    "connection_date": "Date of Connection|जोडणीची तारीख|कनेक्शन की तिथि|ಸಂಪರ್ಕ ದಿನಾಂಕ|కనెక్షన్ తేదీ|இணைப்பு தேதி",
    "sanctioned_load": "Sanctioned Load|मंजूर भार|मंजूर वीजभार|स्वीकृत भार|ಮಂಜೂರಾದ ಲೋಡ್|మంజూరైన లోడ్|அனுமதிக்கப்பட்ட சுமை",
}
BILL_STOPS = "Village|Pin Code|Category|गाव|पिन कोड|प्रवर्ग|गांव|ಗ್ರಾಮ|ವರ್ಗ|వర్గం|வகை|Section Name|Your Arrears|Current Month Bill|Total Amount|Due Date|Bill Date|Bill Period|Meter|Consumer No|Service No|Unique Service|ERO\\b|Tariff|Units"


def electricity_bill(t: Column) -> Fields:
    """Three layouts in order: a state-label block, labels, and an unlabelled block that ends at a PIN (EXT-06)."""
    label = lambda name, value: extract(t, rf"(?i)(?:{BILL_LABELS[name]})\s*[:\-]?\s*{value}")
    block = FORMS["electricity_bill"]["block"]
    named = label("consumer_name", r"(.+)")
    placed = extract(t, rf"(?si)(?<![/&\w])(?:{BILL_LABELS['address']})\s*[:\-]?\s*\n?\s*(.+?)(?:\n\s*(?:{BILL_STOPS})|\z)")
    placed = F.array_join(_lines(placed), ", ")
    free = F.coalesce(extract(t, block), named).isNull() & F.coalesce(extract(t, block, 2), placed).isNull()
    loose = FORMS["electricity_bill"]["loose"]
    loose_address = F.array_join(_lines(extract(t, loose, 2)), ", ")
    return {
        "consumer_name": F.coalesce(extract(t, block), named, F.when(free, extract(t, loose))),
        "address": F.nullif(F.coalesce(squeeze(extract(t, block, 2)), placed, F.when(free, loose_address)), F.lit("")),
        "pincode": label("pincode", r"(\d{6})"),
        "category": label("category", r"(\w+)"),
        "activity": label("activity", r"(.+)"),
        "village": label("village", r"([A-Za-z .]+)"),
        "date_of_connection": label("connection_date", r"(\d{2}/\d{2}/\d{4})"),
        "sanctioned_load": label("sanctioned_load", r"([\d.]+\s*\w+)"),
    }


def gst_portal(t: Column) -> Fields:
    marker, low = extract(t, FORMS["gst_portal"]["marker"]), F.lower(t)
    told = low.rlike(r"\bvalidated\b") & ~low.rlike(r"\bnot\b.{0,20}\bvalidated\b")
    return {
        "ifsc": fix_ifsc(t),
        "account_number": extract(t, FORMS["gst_portal"]["account"]),
        "bank_name": extract(t, FORMS["gst_portal"]["bank"]),
        "account_status": extract(t, FORMS["gst_portal"]["status"]),
        "type_of_account": F.upper(F.coalesce(extract(t, FORMS["gst_portal"]["kind_row"]), extract(t, FORMS["gst_portal"]["kind"]))),
        "bank_verified": F.coalesce(marker == "VERIFIED", told).cast("string"),
    }


def pan_card(t: Column) -> Fields:
    """Number, and name: the first line that can be one after the header, else after the number's line (EXT-08)."""
    lines = _lines(t)
    low = F.lower

    def is_name(s):
        caption = FORMS["pan_card"]["caption"]
        label = FORMS["pan_card"]["label"]
        number = F.replace(s, F.lit(" "), F.lit("")).rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$")
        return ~s.rlike(r"^\d{2}/\d{2}/\d{4}") & ~number & ~low(s).rlike(label) & s.rlike(r"[A-Za-z]{2,}") & ~low(s).rlike(caption)

    def after(test):
        at = F.array_min(F.filter(F.transform(lines, lambda s, i: F.when(test(s), i)), lambda i: i.isNotNull()))
        return F.get(F.filter(F.slice(lines, at + 2, F.size(lines)), is_name), 0)

    header = after(lambda s: s.rlike(FORMS["pan_card"]["header"]))
    number = after(lambda s: F.replace(s, F.lit(" "), F.lit("")).rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$"))
    return {"pan": extract(t, f"({PAN})"), "name": F.coalesce(header, number)}


def kyc_form(t: Column) -> Fields:
    row = extract(t, FORMS["kyc_form"]["bank_row"])
    return {
        "gstin": _gstin(t), "pan": extract(t, f"({PAN})"), "ifsc": fix_ifsc(t),
        "account_number": extract(row, r"\b(\d{9,18})\b"), "bank_name": extract(row, r"^\s*([A-Za-z][A-Za-z .&]+?)\s*,"),
        "mobile": extract(t, f"({MOBILE})"), "email": extract(t, f"({EMAIL})"),
    }


def factory_license(t: Column) -> Fields:
    premises = squeeze(extract(t, FORMS["factory_license"]["premises"]))
    premises = F.coalesce(extract(premises, r"^(.*?\b\d{3}\s?\d{3}\b)"), premises)
    premises = F.get(F.split(premises, FORMS["factory_license"]["signed"]), 0)
    return {"registration_number": extract(t, FORMS["factory_license"]["number"]), "premises_address": F.left(F.trim(premises), F.lit(400))}


def pcb_certificate(t: Column) -> Fields:
    span = squeeze(extract(t, FORMS["pcb_certificate"]["premises"]))
    return {"consent_order_no": extract(t, FORMS["pcb_certificate"]["number"]), "premises_address": F.left(span, F.lit(400))}


def certificate_of_incorporation(t: Column) -> Fields:
    return {
        "name": squeeze(extract(t, FORMS["certificate_of_incorporation"]["name"])),
        "cin": extract(t, r"\b([LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})\b"),
        "pan": extract(t, FORMS["certificate_of_incorporation"]["pan"]),
        "date_of_incorporation": spelt_date(extract(t, FORMS["certificate_of_incorporation"]["date"])),
    }


PARSERS = {
    "gst_certificate": gst_certificate, "certificate_of_incorporation": certificate_of_incorporation, "msme_certificate": msme_certificate,
    "cancelled_cheque": cancelled_cheque, "gst_portal": gst_portal, "pan_entity": pan_card, "pan_owner": pan_card, "kyc_form": kyc_form,
    "electricity_bill": electricity_bill, "factory_license": factory_license, "pcb_certificate": pcb_certificate,
}


def extract_fields(docs: DataFrame) -> DataFrame:
    """vendor_id, doc_id, doc_type, seq, field, value of every field found (docs with doc_type and text).

    CASE on the type runs only that type's expressions; empty values give no row.
    """
    rows = lambda t: F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in PARSERS[t](F.col("text")).items()])
    out = None
    for kind in PARSERS:
        out = F.when(F.col("doc_type") == kind, rows(kind)) if out is None else out.when(F.col("doc_type") == kind, rows(kind))
    held = F.filter(out, lambda f: F.coalesce(f["value"], F.lit("")) != "")
    return docs.select("vendor_id", "doc_id", "doc_type", "seq", F.explode(held).alias("f")).select("vendor_id", "doc_id", "doc_type", "seq", "f.*")


def find_identifiers(docs: DataFrame, key: str, text: str, kinds=tuple(IDENTIFIERS)) -> DataFrame:
    """key, kind, ident of every identifier in a text (EXT-13)."""
    named = lambda k: F.transform(F.regexp_extract_all(F.col(text), F.lit(IDENTIFIERS[k]), F.lit(0)), lambda m: F.struct(F.lit(k).alias("kind"), m.alias("ident")))
    found = [named(k) for k in kinds]
    return docs.select(key, F.explode(F.concat(*found)).alias("i")).select(key, "i.*")


# Words of the constitutions that have a company number.
COMPANY_FORMS = ("private", "public", "limited", "llp", "company")


def keep_company_number(entity: DataFrame) -> DataFrame:
    """entity with cin dropped, and a warning, where the constitution says that it is another's (PRJ-16); an unknown constitution keeps it."""
    form = F.lower(F.coalesce("constitution", F.lit("")))
    other = F.col("cin").isNotNull() & (form != "") & ~any_of(form, COMPANY_FORMS)
    warning = F.when(other, F.format_string("company number %s was ignored: a %s has none", "cin", "constitution"))
    return entity.withColumn("warning", warning).withColumn("cin", F.when(~other, F.col("cin")))


def company_number(docs: DataFrame) -> DataFrame:
    """The company number per vendor: the certificate's, else the first seen outside utility bills (PRJ-16)."""
    number = extract(F.col("text"), f"({IDENTIFIERS['cin']})")
    order = F.struct((F.col("doc_type") != "certificate_of_incorporation").cast("int"), "seq")
    rows = docs.where(F.coalesce("doc_type", F.lit("")) != "electricity_bill").withColumn("cin", number).where("cin is not null")
    return rows.groupBy("vendor_id").agg(F.min_by("cin", order).alias("cin"))
