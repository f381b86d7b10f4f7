"""Scoring resolved parameters by an ordered rule table.

Rule expressions are parsed once on the rule table (a few rows per parameter) into
plain bounds, so that scoring a table of vendors is a broadcast join on the
parameter and column comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCORED_CATEGORIES = ("compliance", "proof_of_address", "proof_of_identity", "legal_aml")
_NUMBER = r"(-?\d+\.?\d*)"
#: Rules that are broadcast at most; a larger table joins by shuffle.
MOST_RULES = 50_000


def parse_rules(rules: DataFrame) -> DataFrame:
    """rules with kind, text, lo, lo_incl, hi, hi_incl; kind null for an unknown form (PRJ-06)."""
    e = F.trim("expr")
    part = lambda pattern, g=1: F.nullif(F.regexp_extract(e, pattern, g), F.lit(""))
    word = r'^value\s*==\s*"([^"]*)"$'
    same, span = rf"^value\s*==\s*{_NUMBER}$", rf"^value\s+IN\s+([\[\(])\s*{_NUMBER}\s*,\s*{_NUMBER}\s*([\]\)])$"
    side = lambda op: part(rf"^value\s*{op}\s*{_NUMBER}$").cast("double")
    equal = part(same).cast("double")
    lo = F.coalesce(equal, side(">="), side(">"), part(span, 2).cast("double"))
    hi = F.coalesce(equal, side("<="), side("<"), part(span, 3).cast("double"))
    kind = F.when(e.rlike(word), "text").when(lo.isNotNull() | hi.isNotNull(), "number")
    return rules.withColumns({
        "kind": kind,
        "text": F.when(e.rlike(word), F.lower(F.trim(F.regexp_extract(e, word, 1)))),
        "lo": lo,
        "lo_incl": side(">").isNull() & F.coalesce(part(span, 1) == "[", F.lit(True)),
        "hi": hi,
        "hi_incl": side("<").isNull() & F.coalesce(part(span, 4) == "]", F.lit(True)),
    })


def rule_holds(value: Column) -> Column:
    """Does a parsed rule (columns of the row) hold for a value? False for nulls and words where numbers are asked."""
    n = value.try_cast("double")
    low = F.col("lo").isNull() | (n > F.col("lo")) | (F.col("lo_incl") & (n == F.col("lo")))
    high = F.col("hi").isNull() | (n < F.col("hi")) | (F.col("hi_incl") & (n == F.col("hi")))
    number = (F.col("kind") == "number") & n.isNotNull() & low & high
    return F.coalesce(F.when(F.col("kind") == "text", F.lower(F.trim(value)) == F.col("text")).otherwise(number), F.lit(False))


def small(table: DataFrame) -> DataFrame:
    """A rule table as a broadcast side, if it is one by count."""
    return F.broadcast(table) if table.limit(MOST_RULES + 1).count() <= MOST_RULES else table


def bounded(table: DataFrame, most: int = 1_000) -> list:
    """The rows of a model table (parameters, grades) on the driver; more than `most` are refused."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a scoring model has at most {most} parameters or grades")
    return rows


def score_params(resolved: DataFrame, params: DataFrame, rules: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row per vendor and scored parameter with the first rule that holds (JN-09).

    Missing values of required parameters score 0 against their maximum; conditional
    ones leave the denominator. A rule of unknown form that comes before any that
    holds leaves the parameter unresolved, with the form in the note.
    """
    scored = params.where(F.col("category_id").isin(*SCORED_CATEGORIES))
    parsed = small(parse_rules(rules).select("parameter_id", "ordinal", "expr", "condition", "assigned_score", "kind", "text", "lo", "lo_incl", "hi", "hi_incl"))
    known = resolved.where(~F.coalesce("unresolved", F.lit(False)) & F.col("value").isNotNull()).select("vendor_id", "parameter_id", "value")
    hit = known.join(parsed, "parameter_id").where(rule_holds(F.col("value")) | F.col("kind").isNull())
    first = hit.groupBy("vendor_id", "parameter_id").agg(F.min_by(F.struct("condition", "assigned_score", "kind", "expr"), "ordinal").alias("m"))
    each = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in scored.columns]) for r in bounded(scored)])
    grid = vendors.select("vendor_id", F.explode(each).alias("p")).select("vendor_id", "p.*")
    rows = grid.join(first, ["vendor_id", "parameter_id"], "left").join(resolved.select("vendor_id", "parameter_id", "value", "note"), ["vendor_id", "parameter_id"], "left")
    good = F.col("m").isNotNull() & F.col("m.kind").isNotNull()
    note = F.when(F.col("m").isNotNull() & F.col("m.kind").isNull(), F.concat(F.lit("gap: unknown rule "), F.col("m.expr"))).otherwise(F.col("note"))
    return rows.select(
        "vendor_id", "category_id", "parameter_id", F.when(good, F.col("value")).alias("value"), F.when(good, F.col("m.condition")).alias("matched_condition"),
        F.when(good, F.col("m.assigned_score")).otherwise(0.0).alias("assigned_score"),
        F.when(good | ~F.col("conditional"), F.col("max_score")).otherwise(0.0).alias("max_score"), (~good).alias("unresolved"), note.alias("note"),
    )


def category_scores(param_scores: DataFrame) -> DataFrame:
    return param_scores.groupBy("vendor_id", "category_id").agg(F.sum("assigned_score").alias("earned"), F.sum("max_score").alias("max_score"))


def vendor_scores(categories: DataFrame) -> DataFrame:
    """total, max_total, and report_total, the sum of rounded categories (half to even) (AGG-10)."""
    return categories.groupBy("vendor_id").agg(F.sum("earned").alias("total"), F.sum("max_score").alias("max_total"), F.sum(F.bround("earned")).alias("report_total"))


def grade_band(scores: DataFrame, grades: DataFrame) -> DataFrame:
    """scores with the grade of the greatest min_score not above the total; null if none (JN-10)."""
    bands = sorted(((r["min_score"], r["grade"]) for r in bounded(grades)), reverse=True)
    grade = F.lit(None).cast("string")
    for least, name in reversed(bands):
        grade = F.when(F.col("total") >= least, name).otherwise(grade)
    return scores.withColumn("grade", grade)


def param_specs(rules: DataFrame) -> DataFrame:
    """numeric or buckets per parameter, mixed ones numeric, with the allowed buckets (OVR-04, REV-01)."""
    parsed = parse_rules(rules)
    return parsed.groupBy("parameter_id").agg(F.bool_or(F.col("kind") == "number").alias("numeric"), F.array_sort(F.collect_set("text")).alias("buckets"))


def rules_hash(rules: DataFrame) -> DataFrame:
    """Twelve characters that change with any rule (AGG-19)."""
    line = F.concat_ws("|", "parameter_id", F.col("ordinal").cast("string"), "expr", "condition", F.col("assigned_score").cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("parameter_id", "ordinal", line.alias("line"))))
    return rules.agg(F.left(F.sha2(F.array_join(F.transform(lines, lambda r: r["line"]), "\n"), 256), F.lit(12)).alias("rules_hash"))


def display_codes(params: DataFrame) -> DataFrame:
    """COM-01, ADD-01 and so on in model order per category (WIN-02)."""
    prefix = {"compliance": "COM", "proof_of_address": "POA", "proof_of_identity": "POI", "legal_aml": "AML"}
    place = F.row_number().over(W.partitionBy("category_id").orderBy("param_ord"))
    code = F.create_map(*[F.lit(x) for kv in prefix.items() for x in kv])[F.col("category_id")]
    return params.where(F.col("category_id").isin(*prefix)).select("parameter_id", F.format_string("%s-%02d", code, place).alias("code"))
