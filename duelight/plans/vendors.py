"""From documents, registry answers, filings and screens to a score per vendor.

Fields are extracted once and written, and so is the wide row per vendor that all
resolvers read; what is derived from a table (delays, frequency, registrations, hits,
sweeps) is one row per vendor before it joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelight.functions.names import match_question, split_by
from duelight.operators import cases, classify, extract, filings, match, registry, resolve, score, screening
from duelight.sources.shared import write_once

# Fields that resolvers read of one type of document only.
SOURCED = {
    "bill_address": ("electricity_bill", "address"), "bill_pincode": ("electricity_bill", "pincode"), "bill_village": ("electricity_bill", "village"),
    "bill_consumer_name": ("electricity_bill", "consumer_name"), "factory_address": ("factory_license", "premises_address"), "consent_address": ("pcb_certificate", "premises_address"),
    "pan_entity_name": ("pan_entity", "name"), "msme_address": ("msme_certificate", "address"), "cheque_account": ("cancelled_cheque", "account_number"),
    "kyc_account": ("kyc_form", "account_number"), "portal_account": ("gst_portal", "account_number"), "portal_verified": ("gst_portal", "bank_verified"),
    "portal_status": ("gst_portal", "account_status"), "cheque_marked": ("cancelled_cheque", "cancellation_mark_present"),
}
PRESENT = {"has_sale_deed": "sale_deed", "has_rental": "rental_agreement", "has_bill": "electricity_bill", "has_landlord": "landlord_declaration"}


@dataclass
class Registers:
    """Tables beside the documents, each optional; a vendor without rows in one has no answer from it.

    answers: vendor_id and columns that resolvers read (gstin_status, registered_on,
    bank_called, bank_holder, ...). filings: vendor_id, return_type, tax_period,
    financial_year, date_of_filing. frequencies: vendor_id, financial_year, quarter, pos,
    frequency. by_pan, details: vendor_id, gstin, status, state. people: vendor_id, name.
    screens: vendor_id, owner, hits_found, categories (of rows as maps: matched_name,
    list, ids, score, status, source), error. watch_names: source, list_id, name.
    office_holders, candidates: name. docket: case_id, applicant, respondent.
    """

    answers: DataFrame | None = None
    filings: DataFrame | None = None
    frequencies: DataFrame | None = None
    by_pan: DataFrame | None = None
    details: DataFrame | None = None
    people: DataFrame | None = None
    screens: DataFrame | None = None
    watch_names: DataFrame | None = None
    watch_sources: tuple[str, ...] = ()
    unread_sources: tuple[str, ...] = ()
    office_holders: DataFrame | None = None
    candidates: DataFrame | None = None
    docket: DataFrame | None = None


def _wide(fields: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """vendor_id and one column per (document type, field)."""
    key = F.create_map(*[F.lit(x) for n, (kind, field) in names.items() for x in (f"{kind}|{field}", n)])
    rows = registry.merge_within_type(fields).withColumn("name", F.try_element_at(key, F.concat_ws("|", "doc_type", "field"))).where("name is not null")
    return rows.groupBy("vendor_id").pivot("name", sorted(names)).agg(F.first("value"))


def filing_columns(r: Registers, as_of: Column) -> list[DataFrame]:
    """What filings and registrations say of a vendor, a row each (RES-03, 04, 05, 08)."""
    out = []
    if r.filings is not None:
        found = filings.filing_summary(filings.delays(r.filings, as_of))
        note = F.format_string("%d late of %d periods", "late", "periods")
        out.append(found.select("vendor_id", filings.filing_bucket(F.col("late")).alias("filing_bucket"), F.col("max_delay").cast("double").alias("max_delay"), note.alias("filing_note")))
    if r.frequencies is not None:
        out.append(filings.latest_frequency(r.frequencies).withColumnRenamed("frequency", "filing_frequency"))
    return out


def wide_row(vendors: DataFrame, typed: DataFrame, fields: DataFrame, r: Registers, as_of: Column) -> DataFrame:
    """One row per vendor with all that resolvers read."""
    there = typed.groupBy("vendor_id").agg(*[F.coalesce(F.bool_or(F.col("doc_type") == kind), F.lit(False)).alias(name) for name, kind in PRESENT.items()])
    entity = vendors.join(registry.merge_entity(fields), "vendor_id", "left").join(_wide(fields, SOURCED), "vendor_id", "left").join(there, "vendor_id", "left")
    if r.answers is not None:
        entity = resolve.enrich_entity(entity, r.answers)
    for more in filing_columns(r, as_of):
        entity = entity.join(more, "vendor_id", "left")
    if r.by_pan is not None:
        none = r.by_pan.where("false")
        merged = match.merge_registrations(r.by_pan, r.details if r.details is not None else none)
        verdict = registry.registration_verdict(merged, entity.select("vendor_id", F.col("gstin").alias("subject_gstin")))
        entity = entity.join(verdict.select("vendor_id", F.col("value").alias("registration_value")), "vendor_id", "left")
    return entity


def own_names(entity: DataFrame, people: DataFrame | None) -> DataFrame:
    """vendor_id, name, person: names that a vendor goes by; person of those of its people only."""
    own = F.explode(F.array_compact(F.array("legal_name", "trade_name", "pan_entity_name"))).alias("name")
    firm = entity.select("vendor_id", own, F.lit(False).alias("person"))
    return firm if people is None else firm.unionByName(people.select("vendor_id", "name", F.lit(True).alias("person")))


def holder_matches(entity: DataFrame, names: DataFrame) -> DataFrame:
    """vendor_id, holder_matched: does the bank's holder bear a name of the vendor? Null where there is none to compare (JN-07)."""
    asked = entity.where(F.coalesce("bank_holder", F.lit("")) != "").select("vendor_id", F.col("bank_holder").alias("name"))
    pairs = asked.join(names.select("vendor_id", F.col("name").alias("candidate")), "vendor_id")
    return split_by(pairs, "same", match_question, "name", "candidate").groupBy("vendor_id").agg(F.bool_or("same").alias("holder_matched"))


def legal_rows(entity: DataFrame, names: DataFrame, r: Registers) -> DataFrame:
    """The five legal parameters: hits of the screens, else a comprehensive sweep, else the free lists, office-holders and dockets (RES-18..23)."""
    vendors = entity.select("vendor_id")
    spark = entity.sparkSession
    hits = told = spark.createDataFrame([], "slot string, owner boolean, seq int, text string").select(F.lit(None).cast(entity.schema["vendor_id"].dataType).alias("vendor_id"), "*")
    sweeps = vendors.select("vendor_id", F.lit(False).alias("comprehensive"))
    if r.screens is not None:
        rows = screening.hit_rows(r.screens.withColumn("vendor_id", F.struct("vendor_id", "owner")))
        of = lambda name: F.try_element_at("row", F.lit(name))
        listed = F.coalesce(of("list"), F.col("category"))
        rows = rows.select(F.col("vendor_id.vendor_id"), F.col("vendor_id.owner"), "category", listed.alias("list_name"), of("matched_name").alias("matched_name"), of("score").alias("score"), of("status").alias("status"), of("source").alias("source"), F.filter(F.split(F.coalesce(of("ids"), F.lit("")), ","), lambda i: i != "").alias("own_ids"))
        who = entity.select("vendor_id", F.coalesce("legal_name", "trade_name").alias("entity_name"), F.col("pan").alias("vendor_pan"))
        # the owner's screen is for a person: the firm's name and number dismiss nobody there
        rows = rows.join(who, "vendor_id", "left").withColumn("vendor_pan", F.when(~F.col("owner"), F.col("vendor_pan"))).withColumn("entity_name", F.when(~F.col("owner"), F.col("entity_name")))
        judged = write_once(match.dismiss_namesakes(rows), "screened-rows")
        live = judged.where("reason is null").withColumn("slot", screening.classify_hit(F.col("category"), F.col("list_name"))).withColumn("vendor_id", F.struct("vendor_id", "owner")).withColumn("seq", F.crc32(F.coalesce("source", F.lit("")).cast("binary")))
        lines = screening.summarize_hits(live)
        text = F.concat(F.col("list_name"), F.format_string(" (%s): %d rows", F.col("category"), F.col("n_rows")), F.coalesce(F.concat(F.lit(", score "), "score"), F.lit("")))
        hits = lines.select("vendor_id.vendor_id", "slot", "vendor_id.owner", F.lit(0).alias("seq"), text.alias("text"))
        gone = judged.where("reason is not null").withColumn("vendor_id", F.struct("vendor_id", "owner"))
        told = screening.summarize_dismissed(gone).select("vendor_id.vendor_id", "vendor_id.owner", F.lit(0).alias("seq"), F.concat("list_name", F.lit(": "), F.array_join("reasons", ", ")).alias("text"))
        firm = r.screens.where("not owner")
        sweeps = firm.select("vendor_id", screening.is_comprehensive(F.map_keys("categories"), F.col("error")).alias("comprehensive"))
    free = [vendors.select("vendor_id", F.lit(p).alias("parameter_id"), F.lit(None).cast("string").alias("value"), F.lit("only a comprehensive sweep decides").alias("note")) for p in ("legal_rbi_wilful_defaulter", "legal_ecourts")]
    firms = names.where("not person").select("vendor_id", "name")
    if r.watch_sources or r.unread_sources:
        found = None
        if r.watch_names is not None:
            ids = F.struct("source", "list_id").alias("list_id")
            met = match.screen_names(firms.select(F.struct("vendor_id", "name").alias("entity_id"), "name"), r.watch_names.select(ids, "name"))
            found = met.select("entity_id.vendor_id", "list_id.source").distinct().withColumn("severity", F.lit("high"))
        each = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(None if s in r.unread_sources else "none").cast("string").alias("base")) for s in (*r.watch_sources, *r.unread_sources)])
        asked = firms.select("vendor_id").distinct().select("vendor_id", F.explode(each).alias("s")).select("vendor_id", "s.*")
        asked = asked.join(found, ["vendor_id", "source"], "left").withColumn("severity", F.coalesce("severity", "base")) if found is not None else asked.withColumn("severity", F.col("base"))
        swept = screening.sweep_verdict(asked)
        gap = F.when(F.size("unscreened") > 0, F.concat(F.lit("NOT SCREENED: "), F.array_join("unscreened", ", "))).otherwise("free lists")
        free.append(swept.select("vendor_id", F.lit("legal_sanctions").alias("parameter_id"), F.col("verdict").alias("value"), gap.alias("note")))
    persons = names.where("person").select("vendor_id", "name")
    if r.office_holders is not None:
        pep = cases.screen_persons(persons, r.office_holders, r.candidates)
        free.append(pep.select("vendor_id", F.lit("legal_pep").alias("parameter_id"), "value", F.coalesce(F.concat(F.lit("GAP: "), "gap"), F.lit("office-holders")).alias("note")))
    if r.docket is not None:
        every = names.select("vendor_id", "name")
        met, loose = cases.screen_cases(every, r.docket)
        per = met.groupBy("vendor_id").agg(F.count_distinct("case_id").alias("n"))
        rows = every.select("vendor_id").distinct().join(per, "vendor_id", "left").join(loose, "vendor_id", "left")
        note = F.format_string("%d cases, %d loose matches rejected", F.coalesce("n", F.lit(0)), F.coalesce("rejected", F.lit(0)))
        free.append(rows.select("vendor_id", F.lit("legal_drt_sarfaesi").alias("parameter_id"), F.when(F.col("n") > 0, "active_drt").otherwise("no_drt").alias("value"), note.alias("note")))
    fallback = free[0]
    for part in free[1:]:
        fallback = fallback.unionByName(part)
    return screening.resolve_legal(vendors, hits, sweeps, fallback, told.select("vendor_id", "owner", "seq", "text"))


def resolve_vendors(typed: DataFrame, vendors: DataFrame, r: Registers, as_of: Column) -> dict[str, DataFrame]:
    """fields, entity and all 23 parameters of typed documents (vendor_id, doc_id, doc_type, seq, text)."""
    fields = write_once(extract.extract_fields(typed), "vendor-fields")
    entity = write_once(wide_row(vendors, typed, fields, r, as_of), "vendor-rows")
    names = own_names(entity, r.people)
    if "bank_holder" in entity.columns:
        entity = entity.join(holder_matches(entity, names), "vendor_id", "left")
    return {"fields": fields, "entity": entity, "resolved": resolve.resolve_all(entity, as_of, legal_rows(entity, names, r))}


def assess(documents: DataFrame, doc_text: DataFrame, registers: Registers | DataFrame, params: DataFrame, rules: DataFrame, grades: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Every stage's table of a batch of vendors: documents, fields, entity, resolved, scores.

    documents: vendor_id, doc_id, file_name, seq. doc_text: doc_id, text, confident.
    registers: a table of answers alone will do. Vendors without a usable document
    still get a row, and all 23 parameters.
    """
    r = registers if isinstance(registers, Registers) else Registers(answers=registers)
    typed = classify.classify(documents, doc_text)
    vendors = documents.select("vendor_id").distinct()
    out = resolve_vendors(typed.join(doc_text.select("doc_id", "text"), "doc_id"), vendors, r, as_of)
    resolved = write_once(out["resolved"], "vendor-parameters")
    parts = score.score_params(resolved, params, rules, vendors)
    scores = score.grade_band(score.vendor_scores(score.category_scores(parts)), grades)
    return out | {"documents": typed, "resolved": resolved, "param_scores": parts, "scores": scores}
