"""Joins of names without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelight.functions.names import agree_question, match_question, significant, split_by, tokens
from duelight.functions.text import normalize


#: Postings of one key that are dealt out together; more are split.
TOGETHER = 20_000


def split_hot(postings: DataFrame, probes: DataFrame, held: DataFrame, key: str, owner: str, together: int) -> tuple[DataFrame, DataFrame]:
    """postings and probes with a `salt` that spreads each key of over `together` postings (by held: key, df) over as many tasks as it needs.

    Only probes of such keys are repeated. Hot keys are few (the postings divided by
    `together` at most); how their table is joined is left to the planner, which knows its size.
    """
    hot = held.where(F.col("df") > together).select(key, F.ceil(F.col("df") / together).cast("int").alias("n_salt"))
    postings = postings.join(hot, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(owner), F.col("n_salt")).cast("int"), F.lit(0))).drop("n_salt")
    probes = probes.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("n_salt", F.lit(1)) - 1))).drop("n_salt")
    return postings, probes


def screen_names(entities: DataFrame, listed: DataFrame, together: int = TOGETHER) -> DataFrame:
    """entity_id, list_id pairs whose names match by whole tokens (JN-03).

    An inverted index replaces the comparison of all pairs. Names of two significant
    tokens or more need two in common, so a pair shares one of all but the entity's
    commonest token: only those are looked up, and the commonest one just verifies.
    Single-token names need a short listed name; equal names always match. A pair is
    given once, at its rarest common token, and verified there with the tokens that
    both sides carry. Postings of a token that more than `together` listed names hold are
    split by its own frequency; those of others stay whole.
    """
    own = entities.select("entity_id", normalize(F.col("name")).alias("flat"), significant(F.col("name")).alias("toks")).where("flat <> ''")
    other = listed.select("list_id", normalize(F.col("name")).alias("flat"), F.array_distinct(tokens(F.col("name"))).alias("toks"), F.size(F.array_distinct(significant(F.col("name")))).alias("n_significant")).where("flat <> ''")
    b = other.select("list_id", F.col("toks").alias("listed"), "n_significant", F.explode("toks").alias("tok"))
    held = b.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    each = own.select("entity_id", "flat", "toks", F.posexplode("toks").alias("pos", "tok")).join(held, "tok")
    by_df = F.array_sort(F.collect_list(F.struct("df", "tok", "pos")))
    ranked = each.groupBy("entity_id", "flat", "toks").agg(by_df.alias("r"))
    # tokens that the list lacks find nothing, so two common ones are two of these
    n_probe = F.when(F.size("toks") == 1, 1).otherwise(F.size("r") - 1)
    probe = F.array_distinct(F.transform(F.slice("r", F.lit(1), n_probe), lambda r: r["tok"]))
    a = ranked.select("entity_id", "toks", probe.alias("probe")).withColumn("tok", F.explode("probe"))
    b, a = split_hot(b, a, held, "tok", "list_id", together)
    hits = F.size(F.filter("toks", lambda w: F.array_contains("listed", w)))
    rarest = F.get(F.filter("probe", lambda w: F.array_contains("listed", w)), 0)
    enough = ((F.size("toks") >= 2) & (hits >= 2)) | ((F.size("toks") == 1) & (F.col("n_significant") <= 3))
    by_tokens = a.join(b, ["tok", "salt"]).where((rarest == F.col("tok")) & enough).select("entity_id", "list_id")
    equal = own.join(other.select("list_id", "flat"), "flat").select("entity_id", "list_id")
    return by_tokens.union(equal).distinct()


def match_any(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """vendor_id, matched: does a vendor's name match any candidate? Null if nothing could be compared (JN-07)."""
    pairs = split_by(names.join(candidates, "vendor_id", "left"), "same", match_question, "name", "candidate")
    return pairs.groupBy("vendor_id").agg(F.bool_or("same").alias("matched"))


def dismiss_namesakes(hits: DataFrame) -> DataFrame:
    """hits (own_ids, vendor_pan, matched_name, entity_name) with reason: why a hit is someone else, null to keep it (JN-06)."""
    pans = F.array_distinct(F.flatten(F.transform("own_ids", lambda t: F.concat(F.regexp_extract_all(t, F.lit(r"\b\d{2}([A-Z]{5}[0-9]{4}[A-Z])\d[A-Z\d]{2}\b"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"), F.lit(1))))))
    rows = hits.withColumn("pans", pans)
    other_id = (F.size("pans") > 0) & F.col("vendor_pan").isNotNull() & ~F.array_contains("pans", F.upper("vendor_pan"))
    rows = split_by(rows, "agree", agree_question, "entity_name", "matched_name")
    return rows.withColumn("reason", F.when(F.coalesce(other_id, F.lit(False)), "another id").when(~F.col("agree"), "another name")).drop("agree")


def merge_registrations(by_pan: DataFrame, details: DataFrame) -> DataFrame:
    """Two lists of registrations; a status of the second one wins and is named as source (JN-02)."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    a = by_pan.where(blank("gstin").isNotNull()).select("vendor_id", F.trim("gstin").alias("gstin"), F.col("status").alias("s1"), F.col("state").alias("st1"))
    b = details.where(blank("gstin").isNotNull()).select("vendor_id", F.trim("gstin").alias("gstin"), F.col("status").alias("s2"), F.col("state").alias("st2"))
    both = a.join(b, ["vendor_id", "gstin"], "full_outer")
    return both.select("vendor_id", "gstin", F.coalesce(blank("s2"), "s1").alias("status"), F.coalesce("st1", "st2").alias("state"), F.when(blank("s2").isNotNull(), "details").otherwise("by_pan").alias("status_source"))
