"""Documents of a vendor against its registration certificate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelight.functions.names import agree_question, split_by
from duelight.functions.text import pan_from_gstin
from duelight.operators.registry import anchor_doc
from duelight.sources.shared import write_once

NAME_FIELDS = ("legal_name", "enterprise_name", "name", "account_holder")


def check_consistency(reads: DataFrame, people: DataFrame) -> DataFrame:
    """vendor_id, doc_id, warning (JN-19).

    reads: vendor_id, doc_id, doc_type, seq, fields map<string,string>. The anchor is
    the first certificate with a number; owners' cards may carry their own number,
    and a partner's name is explained, not flagged.
    """
    get = lambda f: F.try_element_at("fields", F.lit(f))
    sure = reads.where((F.col("doc_type") == "gst_certificate") & get("gstin").isNotNull())
    anchor = anchor_doc(sure, "gst_certificate").select(
        "vendor_id", F.col("doc_id").alias("_doc"), get("gstin").alias("_gstin"), F.coalesce(get("pan"), pan_from_gstin(get("gstin"))).alias("_pan"),
        get("legal_name").alias("_legal"), get("trade_name").alias("_trade"),
    )
    lone = reads.where(F.col("doc_type") != "gst_certificate").select("vendor_id").distinct().join(anchor.select("vendor_id"), "vendor_id", "left_anti")
    missing = lone.select("vendor_id", F.lit(None).cast("long").alias("doc_id"), F.lit("no readable certificate to compare with").alias("warning"))
    rows = reads.join(anchor, "vendor_id").where(F.col("doc_id") != F.col("_doc"))
    number = F.when(get("gstin").isNotNull() & (get("gstin") != F.col("_gstin")), "another GSTIN than the certificate")
    other = get("pan").isNotNull() & (get("pan") != F.col("_pan")) & (F.col("doc_type") != "pan_owner")
    person = (F.col("doc_type") == "pan_entity") & (F.substring(get("pan"), 4, 1) == "P")
    card = F.when(other & person, "an individual's PAN filed as the entity's").when(other, "another PAN than the certificate")
    ids = rows.select("vendor_id", F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_compact(F.array(number, card))).alias("warning"))
    named = rows.select("vendor_id", "doc_id", "doc_type", "_legal", "_trade", F.explode(F.array_compact(F.array(*[get(f) for f in NAME_FIELDS]))).alias("said"))
    named = write_once(named.where(F.col("_legal").isNotNull() | F.col("_trade").isNotNull()), "said-names")
    key = ["vendor_id", "doc_id", "said"]
    own = named.select(*key, F.explode(F.array_compact(F.array("_legal", "_trade"))).alias("other"), F.lit(False).alias("person"))
    partners = named.select(*key).join(people.select("vendor_id", F.col("person").alias("other")), "vendor_id").withColumn("person", F.lit(True))
    agreed = split_by(own.unionByName(partners), "same", agree_question, "said", "other")
    met = agreed.groupBy(*key).agg(F.coalesce(F.bool_or(F.col("same") & ~F.col("person")), F.lit(False)).alias("mine"), F.min(F.when(F.col("same") & F.col("person"), F.col("other"))).alias("partner"))
    known = people.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n_people"))
    odd = named.join(met, key).where(~F.col("mine")).join(known, "vendor_id", "left")
    owner = F.col("doc_type") == "pan_owner"
    text = (
        F.when(owner & F.col("partner").isNull() & (F.col("n_people") > 0), F.concat(F.lit("not a partner on record: "), F.col("said")))
        .when(~owner & F.col("partner").isNotNull(), F.concat(F.lit("in the name of partner "), F.col("partner")))
        .when(~owner, F.concat(F.lit("name does not match the certificate: "), F.col("said")))
    )
    flagged = odd.select("vendor_id", F.col("doc_id").cast("long").alias("doc_id"), text.alias("warning")).where("warning is not null")
    return missing.unionByName(ids).unionByName(flagged)


def verification_rows(documents: DataFrame, reads: DataFrame, warnings: DataFrame) -> DataFrame:
    """vendor_id, file_name, doc_type, status: ok, warning or unrecognized, in file order (JN-18, SRT-01)."""
    warned = warnings.select("vendor_id", "doc_id").where("doc_id is not null").distinct().withColumn("_w", F.lit(True))
    rows = documents.join(reads.select("vendor_id", "doc_id", "quality"), ["vendor_id", "doc_id"], "left").join(warned, ["vendor_id", "doc_id"], "left")
    status = F.when(F.col("doc_type").isNull(), "unrecognized").when(F.col("_w") | (F.coalesce("quality", F.lit("read")) != "read"), "warning").otherwise("ok")
    return rows.select("vendor_id", "file_name", "doc_type", status.alias("status")).orderBy("vendor_id", F.lower("file_name"))
