"""Screening of firms and persons against tribunal cases and lists of office-holders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelight.functions.text import clean_party, normalize, strip_honorifics
from duelight.operators.match import TOGETHER, screen_names, split_hot
from duelight.sources.shared import write_once


def screening_names(entity: DataFrame) -> DataFrame:
    """vendor_id, names, persons: distinct names without regard to case, the entity's first; persons are the others (SET-02).

    entity: vendor_id, own array<string> (legal, trade), people array<string>.
    """
    every = entity.select("vendor_id", F.posexplode(F.concat("own", F.coalesce("people", F.array().cast("array<string>")))).alias("pos", "name"), F.transform("own", lambda n: normalize(n)).alias("_own"))
    every = every.where(F.trim("name") != "").withColumn("flat", normalize(F.col("name")))
    first = every.groupBy("vendor_id", "flat").agg(F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"), F.bool_or(F.array_contains("_own", F.col("flat"))).alias("mine"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "name", "mine")))
    lists = first.groupBy("vendor_id").agg(rows.alias("r"))
    return lists.select("vendor_id", F.transform("r", lambda r: r["name"]).alias("names"), F.transform(F.filter("r", lambda r: ~r["mine"]), lambda r: r["name"]).alias("persons"))


def screen_cases(names: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (vendor_id, case_id, party) of names of four letters and more, and per vendor how many loose matches were rejected (JN-04).

    Applicant and respondent are matched apart, after titles and boilerplate are
    gone. A loose match is a name and a case with the whole name, whatever its case,
    somewhere in a party's text; those whose case is no hit of the vendor are rejected.
    Both are judged between `screening_classes` and counted by their sizes; only hits are
    given to every member.
    """
    own, n_cases, firms, dockets = screening_classes(names.where(F.length(F.trim("name")) >= 4), cases)
    sides = n_cases.select("case_id", F.explode("sides").alias("side")).select("case_id", F.explode(F.map_from_arrays(F.array(F.lit("applicant"), F.lit("respondent")), F.array("side.applicant", "side.respondent"))).alias("party", "text"))
    sides = sides.where(F.col("text").isNotNull())
    listed = sides.select(F.struct("case_id", "party", F.col("text")).alias("list_id"), clean_party(F.col("text")).alias("name"))
    found = screen_names(own.select(F.struct("vendor_id", "name").alias("entity_id"), strip_honorifics(F.col("name")).alias("name")), listed)
    met = found.select("entity_id.vendor_id", "list_id.case_id", "list_id.party").distinct()
    hits = met.withColumnsRenamed({"vendor_id": "_firm", "case_id": "_case"}).join(firms, "_firm").join(dockets, "_case").select("vendor_id", "case_id", "party")
    loose = holding(own, sides).join(met.select("vendor_id", "case_id").distinct(), ["vendor_id", "case_id"], "left_anti")
    rejected = loose.join(n_cases.select("case_id", "n"), "case_id").groupBy(F.col("vendor_id").alias("_firm")).agg(F.sum("n").alias("rejected"))
    return hits, rejected.join(firms, "_firm").select("vendor_id", "rejected")


def screening_classes(names: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Names and cases without repeats: vendors of the same names, and cases of the same parties, are each taken once, under the least key among them.

    Gives vendor_id, name; case_id, sides array<struct<applicant, respondent>>, n (cases it stands for); and
    the members: _firm, vendor_id and _case, case_id.
    """
    firms = names.groupBy("vendor_id").agg(F.array_sort(F.collect_set("name")).alias("own"))
    dockets = cases.groupBy("case_id").agg(F.array_sort(F.collect_set(F.struct("applicant", "respondent"))).alias("sides"))
    firm = firms.groupBy("own").agg(F.min("vendor_id").alias("_firm"))
    docket = dockets.groupBy("sides").agg(F.min("case_id").alias("_case"), F.count(F.lit(1)).alias("n"))
    own = write_once(firm.select(F.col("_firm").alias("vendor_id"), F.explode("own").alias("name")), "screened-names")
    listed = write_once(docket.select(F.col("_case").alias("case_id"), "sides", "n"), "screened-cases")
    return own, listed, firms.join(firm, "own").select("_firm", "vendor_id"), dockets.join(docket, "sides").select("_case", "case_id")


def holding(names: DataFrame, sides: DataFrame, width: int = 4, together: int = TOGETHER) -> DataFrame:
    """vendor_id, name, case_id, once each, of cases with a party text that holds a whole name of `width` letters or more.

    Names meet texts at one run of `width` letters: of a name's runs the one that
    fewest texts hold. A name with a run that no text holds meets none. Texts of a run that
    more than `together` of them hold are split over tasks.
    """
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - width + 1), lambda i: F.substring(c, i, F.lit(width))))
    flat = lambda c: F.upper(F.trim(c))
    texts = sides.select("case_id", flat(F.col("text")).alias("text")).where(F.length("text") >= width).withColumn("run", F.explode(runs(F.col("text"))))
    held = texts.groupBy("run").agg(F.count(F.lit(1)).alias("df"))
    own = names.select("vendor_id", "name", flat(F.col("name")).alias("flat")).where(F.length("flat") >= width).distinct()
    each = own.withColumn("run", F.explode(runs(F.col("flat")))).join(held, "run", "left")
    anchor = each.groupBy("vendor_id", "name", "flat").agg(F.min_by("run", F.struct(F.coalesce("df", F.lit(0)), "run")).alias("run"), F.count_if(F.col("df").isNull()).alias("lacking"))
    texts, anchor = split_hot(texts, anchor.where("lacking = 0"), held, "run", "case_id", together)
    met = anchor.join(texts, ["run", "salt"]).where(F.contains("text", F.col("flat")))
    return met.select("vendor_id", "name", "case_id").distinct()


def screen_persons(persons: DataFrame, required: DataFrame, best_effort: DataFrame | None) -> DataFrame:
    """vendor_id, hits, gap over natural persons (JN-05): the first source must be there, a missing second one is stated.

    An absent or empty required source leaves the verdict null, never clean.
    """
    own = persons.select(F.struct("vendor_id", "name").alias("entity_id"), strip_honorifics(F.col("name")).alias("name"))
    listed = required.select(F.struct(F.lit("required").alias("source"), F.col("name").alias("n")).alias("list_id"), "name")
    if best_effort is not None:
        listed = listed.unionByName(best_effort.select(F.struct(F.lit("best_effort").alias("source"), F.col("name").alias("n")).alias("list_id"), "name"))
    hits = screen_names(own, listed).groupBy(F.col("entity_id.vendor_id").alias("vendor_id")).agg(F.count(F.lit(1)).alias("hits"))
    there = not required.isEmpty()
    rows = persons.select("vendor_id").distinct().join(hits, "vendor_id", "left")
    value = F.when(F.lit(there), F.when(F.col("hits") > 0, "pep_identified").otherwise("no_pep"))
    gap = F.lit("required source not read" if not there else "second source not read" if best_effort is None else None).cast("string")
    return rows.select("vendor_id", F.coalesce("hits", F.lit(0)).alias("hits"), value.alias("value"), gap.alias("gap"))


def union_hits(firm: DataFrame, owner: DataFrame) -> DataFrame:
    """Hits of the firm and of its owner in one table (SET-04)."""
    return firm.withColumn("screened", F.lit("firm")).unionByName(owner.withColumn("screened", F.lit("owner")), allowMissingColumns=True)


def partners(first: Column, second: Column) -> Column:
    """The first source's people if it names any, else the second's (SET-07)."""
    return F.coalesce(F.when(F.size(first) > 0, first), F.when(F.size(second) > 0, second))
