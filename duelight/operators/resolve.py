"""Parameters of vendors: a value, or unresolved with a reason, never a guess.

Each function gives columns (value, note) over one wide row per vendor; `as_rows`
turns them into the long table that scoring reads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelight.functions.address import bill_answer, registration_note
from duelight.functions.names import name_match
from duelight.functions.text import any_of, constitution, seller_type_kw, seller_type_nic, years_since, once_each
from duelight.operators.screening import VERDICTS

# Keywords that a trade in the goods of a chapter is described with.
CHAPTERS = {
    "39": ("plastic", "polymer", "polythene", "polyethylene", "polypropylene", "pet", "hdpe", "ldpe", "lldpe", "pvc", "mould", "granul", "masterbatch", "resin", "film", "packaging"),
    "40": ("rubber", "tyre", "tube", "latex", "elastomer"),
    "46": ("plastic", "polymer", "strip", "monofilament", "mat", "matting", "woven", "plait", "basket", "weav"),
    "47": ("paper", "pulp", "waste paper", "recycl"),
    "48": ("paper", "paperboard", "carton", "corrugat", "packaging", "print"),
    "54": ("yarn", "filament", "man-made", "synthetic", "plastic", "polymer", "textile"),
    "55": ("fibre", "fiber", "staple", "synthetic", "polyester", "textile", "plastic"),
    "63": ("sack", "bag", "textile", "woven", "packaging", "plastic"),
    "70": ("glass",),
    "72": ("iron", "steel", "metal", "scrap", "ferrous"),
    "73": ("iron", "steel", "metal", "fabricat", "scrap", "ferrous"),
    "74": ("copper", "metal", "scrap", "non-ferrous"),
    "76": ("aluminium", "aluminum", "metal", "scrap", "non-ferrous"),
    "78": ("lead", "metal", "scrap", "battery", "non-ferrous"),
    "79": ("zinc", "metal", "scrap", "non-ferrous"),
    "84": ("machine", "machinery", "equipment", "plant", "engineering"),
    "85": ("electric", "electronic", "e-waste", "cable", "wire", "battery", "appliance"),
    "87": ("vehicle", "automobile", "auto", "motor"),
    "99": ("service", "job work", "consult", "transport", "logistic"),
}

Answer = tuple[Column, Column]


def _answer(value: Column, note: Column | str = "") -> Answer:
    return value, note if isinstance(note, Column) else F.lit(note)


def gstin_active(status: Column) -> Answer:
    """RES-01: inactive and unknown words stay unresolved."""
    low = F.lower(F.trim(status))
    value = (
        F.when(low.isin("active", "suspended"), low)
        .when(low.isin("cancelled", "canceled") | any_of(low, ("cancel", "suo motu")), "cancelled")
        .when(low.isin("not found", "invalid"), "not_found")
    )
    return _answer(value, F.when(status.isNull(), "no status returned").when(value.isNull(), F.concat(F.lit("status needs a manual check: "), status)))


def gst_vintage(detail: Column, aggregate: Column, certificate: Column, as_of: Column) -> Answer:
    """RES-02: years since the first date that a source gives."""
    some = lambda c: F.nullif(c, F.lit(""))
    return _answer(years_since(F.coalesce(some(detail), some(aggregate), certificate), as_of).cast("string"), "anchored on the registration")


def hsn_match(codes: Column, activity: Column) -> Answer:
    """RES-06 over an array of codes and the declared activity; null codes mean none on record."""
    blob = F.lower(F.coalesce(activity, F.lit("")))
    table = F.create_map(*[x for k, words in CHAPTERS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in words]))])
    words = lambda code: F.try_element_at(table, F.left(code, F.lit(2)))
    n = F.coalesce(F.size(codes), F.lit(0))
    matched = F.exists(codes, lambda c: F.coalesce(F.exists(words(c), lambda w: F.contains(blob, w)), F.lit(False)))
    unmapped = F.exists(codes, lambda c: words(c).isNull())
    value = F.when(n <= 0, "not_available").when(F.trim(blob) == "", F.lit(None)).when(matched, "match").when(~unmapped, "not_match")
    return _answer(value, F.when(value.isNull(), "codes on record cannot be compared"))


def bank_verification(called: Column, holder: Column, live_account: Column, portal_account: Column, portal_verified: Column, agreeing_sources: Column) -> Answer:
    """RES-07: a live result decides; without one only agreeing documents count, never negatively."""
    live = (
        F.when(F.coalesce(holder, F.lit("")) == "", "penny_unsuccessful")
        .when(portal_account.isNull() | live_account.isNull(), "penny_success_gst_unavailable")
        .when(portal_account == live_account, "penny_success_gst_match")
        .otherwise("penny_success_gst_mismatch")
    )
    paper = F.when(F.coalesce(portal_verified, F.lit(False)) & (agreeing_sources >= 2), "penny_success_gst_match")
    value = F.when(F.coalesce(called, F.lit(False)), live).otherwise(paper)
    return _answer(value, F.when(value.isNull(), "no live result and documents don't settle it"))


def bank_answer(accounts: Column, called: Column, holder: Column, holder_matched: Column, live_account: Column, portal_account: Column, portal_verified: Column, portal_status: Column, marked: Column) -> Answer:
    """RES-07 with its note, from one vendor's evidence: accounts is an array of (source, number).

    The groups of equal numbers decide both: one number on two sources agrees, several
    conflict. holder_matched says whether the holder bears a name of the vendor, null if
    it has none; marked, whether the cheque is cancelled, null if it was not looked at.
    """
    told = F.array_sort(F.filter(accounts, lambda x: F.coalesce(F.trim(x["number"]), F.lit("")) != ""))
    numbers = F.array_distinct(F.transform(told, lambda x: F.trim(x["number"])))
    sources = F.array_join(F.transform(told, lambda x: x["source"]), ", ")
    n, kinds = F.size(told), F.size(numbers)
    asked, named = F.coalesce(called, F.lit(False)), F.coalesce(holder, F.lit("")) != ""
    value, _ = bank_verification(called, holder, live_account, portal_account, portal_verified, F.when(kinds == 1, n).otherwise(0))
    papers = (
        F.when(kinds > 1, F.concat(F.lit("CRITICAL: the account number differs between sources: "), F.array_join(F.transform(told, lambda x: F.concat_ws(" ", x["source"], x["number"])), ", ")))
        .when(n >= 2, F.concat(F.lit("account "), F.get(numbers, 0), F.lit(" agrees across "), sources))
        .when(n == 1, F.concat(F.lit("account "), F.get(numbers, 0), F.lit(" is on one source only, not cross-checked: "), sources))
        .otherwise("no document names an account")
    )
    cheque = F.when(marked, "the cheque carries a cancellation mark").when(~marked, "WARNING: the cheque shows no cancellation mark, so it is no valid proof")
    whose = F.when(holder_matched, "a name on record").when(~holder_matched, "CRITICAL: none of the vendor's names on record").otherwise("the vendor has no name on record to compare")
    live = F.when(asked & named, F.concat(F.lit("the live check names "), holder, F.lit(" as holder: "), whose)).when(asked, "the live check returned no holder")
    portal = (
        F.when(value == "penny_success_gst_mismatch", F.concat(F.lit("CRITICAL: the tax portal registers a different account, "), portal_account))
        .when(asked & (value == "penny_success_gst_match"), "the tax portal registers this account")
        .when(value == "penny_success_gst_unavailable", "no GST portal page names an account to compare")
    )
    paper = F.when(
        ~asked,
        F.when(value.isNotNull(), "the portal shows the account as validated")
        .when(~portal_verified, F.concat(F.lit("not scored: the portal shows the account as "), F.coalesce(portal_status, F.lit("not validated")), F.lit(", which is no result of a live check")))
        .otherwise("not scored: paperwork agreement alone is not treated as bank verification"),
    )
    return value, F.concat_ws("; ", papers, cheque, live, portal, paper)


def pf_status(has_establishment: Column, page_flag: Column) -> Answer:
    """RES-09: without an establishment not applicable; with one, only a page's flag decides."""
    value = F.when(has_establishment & (page_flag == "compliant"), "compliant").when(has_establishment & page_flag.isNotNull(), "non_compliant")
    return _answer(value, F.when(~has_establishment, "N/A: no establishment").when(value.isNull(), "establishment without a filing page"))


def ownership(sale_deed: Column, rental: Column, bill: Column, bill_value: Column, consumer_is_entity: Column) -> Answer:
    """RES-10."""
    value = (
        F.when(sale_deed, "owned")
        .when(bill_value == "not_match", "address_mismatch")
        .when(rental, "rented")
        .when(bill & ~consumer_is_entity, "address_mismatch")
        .when(bill, "owned")
        .otherwise("address_mismatch")
    )
    note = F.when(sale_deed, "sale deed on file").when(value == "owned", "ownership is inferred; NO SALE DEED ON FILE").when(value == "address_mismatch", "GAP: the status of the registered premises is not established")
    return _answer(value, note)


def rental_validation(owner: Column, bill_value: Column) -> Answer:
    """RES-12, from two other rows, so that it can follow their overrides."""
    let = owner.isin("rented", "leased")
    return _answer(F.when(owner == "owned", "owned").when(let & (bill_value == "match"), "rented_matching").when(let & (bill_value == "minor_discrepancy"), "minor_discrepancy").otherwise("not_match"))


def landlord(present: Column, owner: Column) -> Answer:
    """RES-15."""
    value = F.when(present, "present").when(owner == "owned", "not_applicable").otherwise("absent")
    return _answer(value, F.when(value == "absent", "GAP: no landlord declaration on file"))


def msme(called: Column, registry_number: Column, document_number: Column) -> Answer:
    """RES-13: the registry, once asked, is final."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    value = F.when(some(registry_number), "valid_active").when(F.coalesce(called, F.lit(False)), "not_valid").when(some(document_number), "valid_active").otherwise("not_valid")
    return _answer(value, F.when(~some(registry_number) & ~F.coalesce(called, F.lit(False)) & some(document_number), "not cross-checked"))


def pan_active(status: Column, gstin_value: Column) -> Answer:
    """RES-16: the registry's word, else inferred from an active registration."""
    low = F.lower(F.trim(status))
    told = F.when(low == "valid", "active").when(low.isin("invalid", "not_found", "notfound"), "not_found").when(status.isNotNull(), "inactive")
    value = F.coalesce(told, F.when(gstin_value == "active", "active"))
    return _answer(value, F.when(told.isNull() & value.isNotNull(), "inferred from the active registration"))


def seller_type(registry: Column, nic_code: Column, major: Column, form: Column) -> Answer:
    """RES-17 / AGG-20: the strongest source that decides; others that differ are stated."""
    votes = F.filter(F.array(seller_type_kw(registry), seller_type_nic(nic_code), seller_type_kw(major), seller_type_kw(form)), lambda v: v.isNotNull())
    value = F.get(votes, 0)
    other = F.array_distinct(F.filter(votes, lambda v: v != value))
    return _answer(value, F.when(F.size(other) > 0, F.concat(F.lit("CONFLICT: also "), F.array_join(other, ", "))).when(value.isNull(), "no source names a type"))


def consumer_is_entity(consumer: Column, *names: Column) -> Column:
    """JN-07 on one row: true if any name matches, null if none can be compared."""
    plain = F.regexp_replace(consumer, r"(?i)^\s*m\s*/?\s*s\.?\s+", "")
    found = [name_match(plain, n) for n in names]
    any_true = reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in found])
    return F.when(any_true, True).when(reduce(lambda a, b: a | b, [f.isNotNull() for f in found]), False)


#: Where an account number can stand, and the column of the wide row that has it.
ACCOUNTS = {"cancelled cheque": "cheque_account", "MSME certificate": "account_number_msme", "customer form": "kyc_account", "GST portal": "portal_account"}


def resolve_all(entity: DataFrame, as_of: Column, legal: DataFrame | None = None) -> DataFrame:
    """vendor_id, parameter_id, value, note, unresolved from one wide row per vendor, and the legal parameters of `screening.resolve_legal`.

    Columns that are absent count as null, so partial inputs resolve what they can; without `legal` its five are unresolved.
    """
    c = lambda n, kind="string": F.col(n).cast(kind) if n in entity.columns else F.lit(None).cast(kind)
    flag = lambda n: F.coalesce(c(n, "boolean"), F.lit(False))
    # equal addresses and names are compared once, not a vendor each
    named = lambda *ns: [n for n in ns if n in entity.columns]
    addresses, said = named("address", "bill_address", "bill_pincode", "bill_village", "factory_address", "consent_address"), named("bill_consumer_name", "legal_name", "trade_name", "pan_entity_name")
    bill = bill_answer(c("address"), c("bill_address"), c("bill_pincode"), c("bill_village"), [("factory licence", c("factory_address")), ("pollution consent", c("consent_address"))])
    mine = consumer_is_entity(c("bill_consumer_name"), c("legal_name"), c("trade_name"), c("pan_entity_name"))
    compared = {"_mine": F.coalesce(mine, F.lit(True)), "_pan_name": name_match(c("pan_entity_name"), c("legal_name"))}
    rows = once_each(entity, addresses, lambda keys: keys.withColumn("_bill_answer", bill)) if addresses else entity.withColumn("_bill_answer", bill)
    rows = once_each(rows, said, lambda keys: keys.withColumns(compared)) if said else rows.withColumns(compared)
    rows = rows.withColumn("_bill", F.col("_bill_answer.value"))
    rows = rows.withColumn("_gstin", gstin_active(c("gstin_status"))[0])
    owner = ownership(flag("has_sale_deed"), flag("has_rental"), flag("has_bill"), F.col("_bill"), F.col("_mine"))
    rows = rows.withColumn("_owner", owner[0])
    codes = F.col("hsn_codes") if "hsn_codes" in entity.columns else F.lit(None).cast("array<string>")
    held = [F.struct(F.lit(source).alias("source"), c(name).alias("number")) for source, name in ACCOUNTS.items()]
    # a count given in place of the numbers stands for so many sources of one account
    counted = F.transform(F.sequence(F.lit(1), c("agreeing_accounts", "int")), lambda i: F.struct(F.concat(F.lit("source "), i.cast("string")).alias("source"), F.lit("the account").alias("number")))
    accounts = F.when(c("agreeing_accounts", "int") > 0, counted).otherwise(F.array(*held)) if "agreeing_accounts" in entity.columns else F.array(*held)
    answers: dict[str, Answer] = {
        "com_gstin_active": gstin_active(c("gstin_status")),
        "com_gst_vintage": gst_vintage(c("registered_on"), c("oldest_registration"), c("date_of_registration"), as_of),
        "com_gst_filing_compliance": _answer(c("filing_bucket"), F.coalesce(c("filing_note"), F.lit("no filing of the last twelve months"))),
        "com_filing_frequency": _answer(c("filing_frequency"), F.when(c("filing_frequency").isNull(), "no known frequency of filing").otherwise("")),
        "com_multiple_registrations": _answer(c("registration_value"), F.when(c("registration_value").isNull(), "a registration's status is unclear, or none is known").otherwise("")),
        "com_hsn_match": hsn_match(codes, F.concat_ws(" ", c("nic_5_description"), c("nic_4_description"), c("major_activity"), c("bill_activity"), c("trade_name"))),
        "com_bank_verification": bank_answer(accounts, c("bank_called", "boolean"), c("bank_holder"), c("holder_matched", "boolean"), c("account_number"), c("portal_account"), c("portal_verified", "boolean"), c("portal_status"), c("cheque_marked", "boolean")),
        "com_gst_delay_days": _answer(c("max_delay"), F.when(c("max_delay").isNull(), "no filing of the last twelve months").otherwise("")),
        "com_pf_filing_status": pf_status(flag("has_pf"), c("pf_flag")),
        "addr_ownership_type": owner,
        "addr_electricity_bill": _answer(F.col("_bill"), F.col("_bill_answer.note")),
        "addr_rental_validation": rental_validation(F.col("_owner"), F.col("_bill")),
        "addr_msme": (msme(c("msme_called", "boolean"), c("msme_number"), c("udyam_number"))[0], registration_note(c("address"), c("msme_address"))),
        "addr_landlord_declaration": landlord(flag("has_landlord"), F.col("_owner")),
        "ident_pan_active": pan_active(c("pan_status"), F.col("_gstin")),
        "ident_seller_type": seller_type(c("gst_nature"), c("nic_5_code"), c("major_activity"), c("form_activity")),
        "ident_constitution": _answer(constitution(c("constitution")), "no known constitution"),
        "ident_pan_name_match": _answer(F.when(F.col("_pan_name"), "match").when(~F.col("_pan_name"), "not_match")),
    }
    own = as_rows(rows, answers)
    if legal is None:
        none = F.array(*[F.struct(F.lit(p).alias("parameter_id"), F.lit(None).cast("string").alias("value"), F.lit("not screened").alias("note")) for p in VERDICTS])
        legal = rows.select("vendor_id", F.explode(none).alias("r")).select("vendor_id", "r.*")
    legal = legal.select("vendor_id", "parameter_id", "value", "note", F.col("value").try_cast("double").alias("num_value"), F.col("value").isNull().alias("unresolved"))
    return own.unionByName(legal)


def as_rows(rows: DataFrame, answers: dict[str, Answer]) -> DataFrame:
    each = [F.struct(F.lit(p).alias("parameter_id"), v.cast("string").alias("value"), n.alias("note")) for p, (v, n) in answers.items()]
    long = rows.select("vendor_id", F.explode(F.array(*each)).alias("r")).select("vendor_id", "r.*")
    return long.withColumn("num_value", F.col("value").try_cast("double")).withColumn("unresolved", F.col("value").isNull())


def enrich_entity(entity: DataFrame, registry: DataFrame, prefer_registry=("nic_5_code", "nic_5_description", "date_of_incorporation")) -> DataFrame:
    """entity with the registry's fields; the registry beats documents only where named (RES-24)."""
    extra = [c for c in registry.columns if c != "vendor_id"]
    both = entity.join(registry.select("vendor_id", *[F.col(c).alias(f"_r_{c}") for c in extra]), "vendor_id", "left")
    for c in extra:
        own = F.col(c) if c in entity.columns else F.lit(None)
        both = both.withColumn(c, F.coalesce(f"_r_{c}", own) if c in prefer_registry else F.coalesce(own, f"_r_{c}")).drop(f"_r_{c}")
    return both


# Words in notes that ask for a second look.
MARKERS = ("gap:", "warning:", "critical:", "not screened", "inferred", "not cross-checked", "needs a manual", "needs manual", "additional zigram finding", "treated as a utility-record data error")


def cross_check_items(resolved: DataFrame, limit: int = 220) -> DataFrame:
    """vendor_id, item of notes that hold a marker, cut to the limit (PRJ-07)."""
    note = F.trim("note")
    cut = F.when(F.length(note) > limit, F.concat(F.left(note, F.lit(limit)), F.lit("..."))).otherwise(note)
    return resolved.where(any_of(F.lower(note), MARKERS)).select("vendor_id", F.concat_ws(": ", "parameter_id", cut).alias("item"))
