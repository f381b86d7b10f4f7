"""Screening responses: which hits count, what they say, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelight.functions.text import any_of, score_value

# Words that place a hit, in order.
SANCTIONS = ("sanctioncheck", "uani check", "country regimes watchlist")
PEP = ("pepcheck",)
DEFAULTER = ("cibil", "wilful defaulter", "wilful defaulters")
COURTS = ("high court", "supreme court", "district court", "nclt", "nclat", "litigation")
RECOVERY = ("debt recovery tribunal", "sarfaesi", " drt ", "drat")
LEAST_CATEGORIES = 10


def is_comprehensive(categories: Column, error: Column) -> Column:
    """A response of at least ten listed categories and no error (PRJ-10); false for nulls."""
    return F.coalesce(error.isNull() & (F.size(categories) >= LEAST_CATEGORIES), F.lit(False))


def hit_rows(responses: DataFrame) -> DataFrame:
    """vendor_id, category, row of categories whose counter is positive (PRJ-11); filtered before any row is opened."""
    positive = F.filter(F.map_entries("categories"), lambda e: F.coalesce(F.try_element_at("hits_found", e["key"]), F.lit(0)) > 0)
    found = responses.where(F.col("hits_found").isNotNull()).select("vendor_id", F.explode(positive).alias("e"))
    return found.select("vendor_id", F.col("e.key").alias("category"), F.explode("e.value").alias("row")).where(F.size("row") > 0)


def classify_hit(category: Column, list_name: Column) -> Column:
    """One of five parameters, or other (PRJ-12)."""
    low = F.lower(F.coalesce(category, F.lit("")))
    blob = F.concat_ws(" ", low, F.lower(F.coalesce(list_name, F.lit(""))))
    return (
        F.when(any_of(low, SANCTIONS), "legal_sanctions")
        .when(any_of(low, PEP), "legal_pep")
        .when(any_of(blob, DEFAULTER), "legal_rbi_wilful_defaulter")
        .when(any_of(blob, COURTS), "legal_ecourts")
        .when(any_of(blob, RECOVERY), "legal_drt_sarfaesi")
        .otherwise("other")
    )


def summarize_hits(hits: DataFrame) -> DataFrame:
    """One row per vendor, slot, list, category and status: rows, strongest score, first source and how many more (AGG-07)."""
    keys = ["vendor_id", "slot", "list_name", "category", "status"]
    source = F.when(F.coalesce("source", F.lit("")) != "", F.col("source"))
    return hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max_by("score", F.struct(score_value(F.col("score")), -F.col("seq"))).alias("score"),
        F.min_by(source, F.when(source.isNotNull(), F.col("seq"))).alias("first_source"),
        F.greatest(F.count_distinct(source) - 1, F.lit(0)).alias("more_sources"),
    )


def summarize_dismissed(hits: DataFrame) -> DataFrame:
    return hits.groupBy("vendor_id", "list_name").agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def sweep_verdict(findings: DataFrame) -> DataFrame:
    """listed, not_listed or null (nothing screened) per vendor, with unscreened sources (AGG-12).

    findings: vendor_id, source, severity (none, watch, elevated, high; null where
    the source could not be read).
    """
    rows = findings.groupBy("vendor_id").agg(
        F.bool_or(F.col("severity").isin("high", "elevated")).alias("hit"),
        F.count("severity").alias("screened"),
        F.array_sort(F.collect_set(F.when(F.col("severity").isNull(), F.col("source")))).alias("unscreened"),
    )
    verdict = F.when(F.coalesce("hit", F.lit(False)), "listed").when(F.col("screened") > 0, "not_listed")
    return rows.select("vendor_id", verdict.alias("verdict"), "unscreened")


# What a hit and a comprehensive sweep without one give, by parameter.
VERDICTS = {
    "legal_sanctions": ("listed", "not_listed"), "legal_pep": ("pep_identified", "no_pep"),
    "legal_rbi_wilful_defaulter": ("listed", "not_listed"), "legal_ecourts": ("active_criminal", "no_criminal"),
    "legal_drt_sarfaesi": ("active_drt", "no_drt"),
}


def resolve_legal(vendors: DataFrame, hits: DataFrame, sweeps: DataFrame, fallback: DataFrame, dismissed: DataFrame) -> DataFrame:
    """vendor_id, parameter_id, value, note, unresolved of the five legal parameters (AGG-13, RES-18..23).

    hits: vendor_id, slot (a parameter or "other"), owner (of the owner's screen, not
    the firm's), seq, text, summarised to a line per list. sweeps: vendor_id,
    comprehensive, of the firm. fallback: vendor_id, parameter_id, value, note of the
    free sources. dismissed: vendor_id, owner, seq, text of namesakes.

    Hits beat a comprehensive clean sweep, which beats the fallback; without any of
    them a parameter is unresolved. Hits outside the five slots turn sanctions that
    are not listed into "adverse_watchlist", and are told beside listed ones; so are
    dismissed namesakes.
    """
    told = lambda rows, *keys: rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("owner", "seq", "text"))), lambda r: r["text"]), "; ").alias("told"))
    each = F.array(*[F.struct(F.lit(p).alias("parameter_id"), F.lit(bad).alias("bad"), F.lit(good).alias("good")) for p, (bad, good) in VERDICTS.items()])
    grid = vendors.select("vendor_id", F.explode(each).alias("p")).select("vendor_id", "p.*")
    sanctions = F.lit("legal_sanctions").alias("parameter_id")
    key = ["vendor_id", "parameter_id"]
    rows = grid.join(told(hits.where("slot <> 'other'").withColumnRenamed("slot", "parameter_id"), *key).withColumnRenamed("told", "hit"), key, "left")
    rows = rows.join(sweeps.groupBy("vendor_id").agg(F.bool_or("comprehensive").alias("swept")), "vendor_id", "left")
    rows = rows.join(fallback.select(*key, F.col("value").alias("_value"), F.col("note").alias("_note")), key, "left")
    rows = rows.join(told(dismissed, "vendor_id").select("vendor_id", sanctions, F.concat(F.lit("namesakes dismissed: "), "told").alias("namesakes")), key, "left")
    rows = rows.join(told(hits.where("slot = 'other'"), "vendor_id").select("vendor_id", sanctions, F.col("told").alias("other")), key, "left")
    swept = F.coalesce("swept", F.lit(False))
    value = F.when(F.col("hit").isNotNull(), F.col("bad")).when(swept, F.col("good")).otherwise(F.col("_value"))
    note = F.when(F.col("hit").isNotNull(), F.col("hit")).when(swept, "a comprehensive sweep found no match").otherwise(F.col("_note"))
    rows = rows.withColumn("value", value).withColumn("note", F.concat_ws(" | ", F.nullif(note, F.lit("")), "namesakes"))
    outside = F.col("other").isNotNull() & ~F.coalesce(F.col("value") == "listed", F.lit(False))
    lists = F.when(F.col("value").isNotNull() & (F.col("note") != ""), F.concat(F.lit("sanctions lists: "), "note"))
    note = F.when(outside, F.concat_ws(" | ", F.concat(F.lit("WATCHLIST HIT (confirm or dismiss): "), "other"), lists)).otherwise(F.concat_ws(" | ", F.nullif("note", F.lit("")), F.concat(F.lit("ALSO: "), "other")))
    value = F.when(outside, "adverse_watchlist").otherwise(F.col("value"))
    return rows.select(*key, value.alias("value"), note.alias("note"), value.isNull().alias("unresolved"))
