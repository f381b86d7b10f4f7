"""Documents, registry answers and their merging into one row per vendor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelight.functions.text import pan_category, status_class

# Document types that each merged field is taken from, first come first served.
PRIORITY = {
    "gstin": ("gst_certificate", "kyc_form"), "legal_name": ("gst_certificate", "kyc_form"), "trade_name": ("gst_certificate",),
    "constitution": ("gst_certificate",), "address": ("gst_certificate",), "date_of_registration": ("gst_certificate",),
    "taxpayer_type": ("gst_certificate",), "state": ("gst_certificate",),
    "pan": ("pan_entity", "gst_certificate", "certificate_of_incorporation", "msme_certificate", "kyc_form"),
    "udyam_number": ("msme_certificate",), "enterprise_type": ("msme_certificate",), "major_activity": ("msme_certificate",),
    "organisation_type": ("msme_certificate",), "date_of_incorporation": ("certificate_of_incorporation", "msme_certificate"),
    "nic_5_code": ("msme_certificate",), "nic_5_description": ("msme_certificate",), "nic_4_code": ("msme_certificate",),
    "nic_4_description": ("msme_certificate",), "mobile": ("msme_certificate", "kyc_form"), "email": ("msme_certificate", "kyc_form"),
    "bank_name": ("cancelled_cheque", "gst_portal"), "ifsc": ("cancelled_cheque", "gst_portal", "kyc_form"),
    "account_number": ("cancelled_cheque", "gst_portal"), "bank_name_msme": ("msme_certificate",),
    "ifsc_msme": ("msme_certificate",), "account_number_msme": ("msme_certificate",),
}
REQUIRED = ("gst_certificate", "pan_entity", "cancelled_cheque", "msme_certificate", "electricity_bill", "gst_portal")
# What a well-read document of a type yields.
EXPECTED = {
    "gst_certificate": ("gstin", "legal_name", "constitution", "address", "date_of_registration"),
    "msme_certificate": ("udyam_number", "enterprise_name", "nic_5_code", "address"),
    "cancelled_cheque": ("ifsc", "account_number"), "gst_portal": ("account_number", "ifsc", "account_status"),
    "pan_entity": ("pan", "name"), "pan_owner": ("pan", "name"), "kyc_form": ("gstin", "pan"),
    "certificate_of_incorporation": ("name", "cin", "pan", "date_of_incorporation"),
    "electricity_bill": ("consumer_name", "address"), "factory_license": ("premises_address",), "pcb_certificate": ("premises_address",),
}


def merge_within_type(fields: DataFrame) -> DataFrame:
    """The last file's value per vendor, type and field; nulls never overwrite (AGG-01)."""
    return fields.where(F.col("value").isNotNull()).groupBy("vendor_id", "doc_type", "field").agg(F.max_by("value", "seq").alias("value"))


def merge_by_priority(fields: DataFrame, priority: dict[str, tuple[str, ...]]) -> DataFrame:
    """The first non-empty value per vendor and field in the order of document types (AGG-02)."""
    ranks = F.create_map(*[F.lit(x) for f, types in priority.items() for r, t in enumerate(types) for x in (f"{f}|{t}", r)])
    rows = fields.withColumn("rank", F.try_element_at(ranks, F.concat_ws("|", "field", "doc_type"))).where("rank is not null and value <> ''")
    return rows.groupBy("vendor_id", "field").agg(F.min_by("value", "rank").alias("value"))


def merge_entity(fields: DataFrame) -> DataFrame:
    """One wide row per vendor."""
    return merge_by_priority(merge_within_type(fields), PRIORITY).groupBy("vendor_id").pivot("field", sorted(PRIORITY)).agg(F.first("value"))


def attach_registry(entity: DataFrame, snapshots: DataFrame, endpoints: list[str]) -> DataFrame:
    """entity with one column per endpoint, null where there is no answer (JN-01)."""
    wide = snapshots.where(F.col("endpoint").isin(*endpoints)).groupBy("vendor_id").pivot("endpoint", endpoints).agg(F.first("data"))
    return entity.join(wide, "vendor_id", "left")


def fresh_snapshots(attempts: DataFrame, as_of: Column, ttl_days: int) -> DataFrame:
    """The answer served per key: the freshest good one if within its time, or stale if the refetch failed (WIN-03).

    attempts: key, fetched_at, failed, retriable (network failure or status 429 or
    5xx), data. A time of 0 never expires.
    """
    good = F.max_by(F.struct("fetched_at", "data"), F.when(~F.col("failed"), F.col("fetched_at")))
    last = F.max_by(F.struct("failed", "retriable"), "fetched_at")
    rows = attempts.groupBy("key").agg(good.alias("good"), F.bool_or(~F.col("failed")).alias("any_good"), last.alias("last"))
    age_ok = F.lit(ttl_days == 0) | (F.col("good.fetched_at") >= as_of - F.expr(f"interval {ttl_days} days"))
    status = F.when(~F.col("any_good"), "missing").when(age_ok, "fresh").when(F.col("last.failed") & F.col("last.retriable"), "stale_served").otherwise("expired")
    rows = rows.withColumn("status", status)
    return rows.select("key", "status", F.when(F.col("status").isin("fresh", "stale_served"), F.col("good.data")).alias("data"), F.when(F.col("any_good"), F.col("good.fetched_at")).alias("fetched_at"))


def freshness_stats(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def registration_verdict(registrations: DataFrame, subjects: DataFrame) -> DataFrame:
    """no_additional, cancelled_present, active_multi_state, or null if a status is unclear (AGG-06)."""
    rows = registrations.join(subjects, "vendor_id", "left").withColumn("other", F.coalesce(F.upper("gstin") != F.upper(F.trim("subject_gstin")), F.lit(True)))
    kind = F.when(F.col("other"), status_class(F.col("status")))
    per = rows.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"), F.count(kind).alias("others"), F.bool_or(kind == "cancelled").alias("cancelled"), F.bool_and(kind == "active").alias("active"))
    value = F.when(F.col("others") == 0, "no_additional").when(F.col("cancelled"), "cancelled_present").when(F.col("active"), "active_multi_state")
    return per.select("vendor_id", "n", value.alias("value"))


def missing_documents(vendors: DataFrame, documents: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """vendor_id, doc_type of required documents not there (SET-01)."""
    need = vendors.select("vendor_id", F.explode(F.array(*[F.lit(t) for t in required])).alias("doc_type"))
    return need.join(documents.select("vendor_id", "doc_type").distinct(), ["vendor_id", "doc_type"], "left_anti")


def assess_reads(reads: DataFrame) -> DataFrame:
    """reads (doc_type, confident, found) with expected, missing, quality (AGG-11)."""
    table = F.create_map(*[x for t, f in EXPECTED.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in f]))])
    none = F.array().cast("array<string>")
    rows = reads.withColumn("expected", F.coalesce(F.try_element_at(table, "doc_type"), none)).withColumn("missing", F.array_except("expected", F.coalesce("found", none)))
    got = F.size("expected") - F.size("missing")
    quality = F.when(~F.col("confident"), "unreadable").when(F.size("missing") == 0, "read").when(got > 0, "partial").otherwise("poor")
    return rows.withColumn("quality", quality)


def lookup_plan(entity: DataFrame) -> DataFrame:
    """vendor_id, endpoint, key of the registry calls that a vendor's identifiers allow (PRJ-08)."""
    ask = lambda cond, endpoint, key: F.when(cond, F.struct(F.lit(endpoint).alias("endpoint"), key.alias("key")))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    firm = pan_category(F.col("pan")).isin("firm", "individual")
    calls = F.array_compact(F.array(
        ask(some("account_number") & some("ifsc"), "bank", F.concat_ws("|", "account_number", "ifsc")),
        ask(some("gstin"), "detail", F.col("gstin")),
        ask(some("pan"), "by_pan", F.col("pan")),
        ask(some("pan"), "msme", F.col("pan")),
        ask(some("cin"), "company_page", F.col("cin")),
        ask(some("cin"), "company_entity", F.col("cin")),
        ask(~some("cin") & firm, "firm", F.col("pan")),
        ask(some("pan"), "screening", F.col("pan")),
        ask(some("pan_owner_pan"), "owner_screening", F.col("pan_owner_pan")),
    ))
    return entity.select("vendor_id", F.explode(calls).alias("c")).select("vendor_id", "c.*")


def account_agreement(accounts: DataFrame) -> DataFrame:
    """agree, conflict, single or none over a vendor's account numbers by source (JN-20)."""
    value = F.nullif(F.trim("account_number"), F.lit(""))
    per = accounts.groupBy("vendor_id").agg(F.count(value).alias("n"), F.count_distinct(value).alias("kinds"), F.min(value).alias("account_number"))
    state = F.when(F.col("n") == 0, "none").when(F.col("kinds") > 1, "conflict").when(F.col("n") == 1, "single").otherwise("agree")
    return per.select("vendor_id", state.alias("state"), F.when(F.col("kinds") == 1, F.col("account_number")).alias("account_number"))


def anchor_doc(docs: DataFrame, doc_type: str) -> DataFrame:
    """The first document of a type per vendor (WIN-08)."""
    place = F.row_number().over(W.partitionBy("vendor_id").orderBy("seq"))
    return docs.where(F.col("doc_type") == doc_type).withColumn("nth", place).where("nth = 1").drop("nth")


def registry_errors(snapshots: DataFrame) -> DataFrame:
    """vendor_id, endpoint, error of failed calls and of errors inside good answers (PRJ-09)."""
    inner = F.map_entries(F.from_json(F.try_variant_get("data", "$.errors", "string"), "map<string,string>"))
    told = snapshots.select("vendor_id", "endpoint", F.explode(inner).alias("e")).select("vendor_id", "endpoint", F.concat_ws(": ", "e.key", "e.value").alias("error"))
    failed = snapshots.where("failed").select("vendor_id", "endpoint", F.concat(F.lit("status "), F.col("http_status").cast("string")).alias("error"))
    return told.unionByName(failed)


def top_rows(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key and how many more there are (SRT-03)."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return rows.withColumn("place", place).withColumn("more", F.greatest(n - k, F.lit(0))).where(F.col("place") <= k)


def compact_registry(detail: DataFrame, hsn: DataFrame, summary: DataFrame, recent: DataFrame, codes: int = 15, rows: int = 26) -> DataFrame:
    """One row per vendor: its scalars, the first codes with short descriptions, filing summary, latest filings (PRJ-14)."""
    short = top_rows(hsn, ["vendor_id"], ["code"], codes).groupBy("vendor_id").agg(F.array_sort(F.collect_list(F.struct("code", F.left("description", F.lit(80)).alias("description")))).alias("hsn"), F.max("more").alias("more_hsn"))
    last = top_rows(recent, ["vendor_id"], [F.col("period").desc(), "return_type"], rows).groupBy("vendor_id").agg(F.array_sort(F.collect_list(F.struct("place", "period", "return_type", "delay_days"))).alias("recent"))
    return detail.join(short, "vendor_id", "left").join(summary, "vendor_id", "left").join(last, "vendor_id", "left")


def run_summary(vendors: DataFrame, **lists: DataFrame) -> DataFrame:
    """One row per vendor with the sorted items of each list (vendor_id, item) (AGG-18)."""
    out = vendors.select("vendor_id")
    for name, rows in lists.items():
        items = rows.groupBy("vendor_id").agg(F.array_sort(F.collect_list("item")).alias(name))
        out = out.join(items, "vendor_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out
