"""Reviewers' corrections, analysts' overrides, their audit, and traces of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelight.operators import score
from duelight.operators.resolve import cross_check_items, landlord, rental_validation

ADDRESS_ROWS = ("addr_ownership_type", "addr_electricity_bill", "addr_rental_validation", "addr_msme", "addr_landlord_declaration")


def normalise_codes(findings: DataFrame, codes: DataFrame) -> DataFrame:
    """Display codes as parameter ids; unknown ones stay (JN-15)."""
    table = codes.select(F.upper("code").alias("_code"), F.col("parameter_id").alias("_pid"))
    rows = findings.join(table, F.upper(F.trim(findings["parameter_id"])) == F.col("_code"), "left")
    return rows.withColumn("parameter_id", F.coalesce("_pid", "parameter_id")).drop("_code", "_pid")


def route_corrections(findings: DataFrame, resolved: DataFrame, specs: DataFrame) -> DataFrame:
    """findings with route and reason: apply, note_only, escalate, or none (JN-16).

    Only verified findings that ask to correct a known parameter act; a value must be
    a number where the rules ask for one, else an allowed bucket. Findings that ask for
    neither a correction nor an escalation ask for nothing.
    """
    rows = findings.join(specs, "parameter_id", "left").join(resolved.select("vendor_id", "parameter_id", F.col("value").alias("_now")), ["vendor_id", "parameter_id"], "left")
    value = F.nullif(F.trim("proposed_value"), F.lit(""))
    reason = (
        F.when((F.col("action") != "correct") | (F.col("confidence") != "verified"), "not a verified correction")
        .when(F.col("numeric").isNull(), "unknown parameter")
        .when(value.isNull() & F.col("_now").isNull(), "no value to note on")
        .when(F.col("numeric") & value.isNotNull() & value.try_cast("double").isNull(), "not a number")
        .when(~F.col("numeric") & value.isNotNull() & ~F.array_contains("buckets", F.lower(value)), "not an allowed value")
    )
    asks = F.coalesce(F.col("action").isin("correct", "escalate"), F.lit(False))
    route = F.when(~asks, "none").when(reason.isNotNull(), "escalate").when(value.isNull(), "note_only").otherwise("apply")
    return rows.withColumn("reason", F.when(asks, reason)).withColumn("route", route).drop("_now", "numeric", "buckets")


# Fields of the entity that reports read.
REPORT_FIELDS = (
    "address", "bank_name", "bank_name_msme", "constitution", "date_of_incorporation", "date_of_registration", "declared_hsn", "electricity_bill_activity", "enterprise_type",
    "gst_annual_aggregate_turnover", "gst_annual_aggregate_turnover_year", "gst_nature_of_business_activity", "gstin", "legal_name", "major_activity", "nature_of_business",
    "nic_5_code", "nic_5_description", "pan", "state", "taxpayer_type", "trade_name", "udyam_number",
)


def route_field_corrections(findings: DataFrame, fields: tuple[str, ...] = REPORT_FIELDS) -> DataFrame:
    """Findings that name no parameter, with route and reason (JN-16): verified corrections of a field that reports read apply."""
    rows = findings.where(F.coalesce(F.trim("parameter_id"), F.lit("")) == "")
    reason = (
        F.when((F.col("action") != "correct") | (F.col("confidence") != "verified"), "not a verified correction")
        .when(F.coalesce(F.trim("field"), F.lit("")) == "", "names neither a parameter nor a field")
        .when(~F.col("field").isin(*fields), F.concat(F.lit("the report does not read "), "field", F.lit("; it reads "), F.lit(", ".join(fields))))
        .when(F.coalesce(F.trim("proposed_value"), F.lit("")) == "", "no value is proposed")
    )
    asks = F.coalesce(F.col("action").isin("correct", "escalate"), F.lit(False))
    return rows.withColumn("reason", F.when(asks, reason)).withColumn("route", F.when(~asks, "none").when(reason.isNotNull(), "escalate").otherwise("apply"))


def apply_field_corrections(entity: DataFrame, routed: DataFrame) -> DataFrame:
    """vendor_id, fields, version, changes: fields (a map) after every patch (JN-16).

    The last writer of a field by pass and order wins; version counts the patches, and
    changes tells each one in order with the value before it.
    """
    live = routed.where("route = 'apply'").select("vendor_id", "pass", "ord", "field", F.col("proposed_value").alias("after"))
    earlier = F.lag("after").over(W.partitionBy("vendor_id", "field").orderBy("pass", "ord"))
    live = live.withColumn("earlier", earlier)
    last = live.groupBy("vendor_id", "field").agg(F.max_by("after", F.struct("pass", "ord")).alias("after"), F.collect_list(F.struct("pass", "ord", "field", "earlier", "after")).alias("steps"))
    per = last.groupBy("vendor_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "after"))).alias("patch"), F.array_sort(F.flatten(F.collect_list("steps"))).alias("steps"))
    # within one select a lambda would see the new column of the same name
    rows = entity.withColumnRenamed("fields", "own").join(per, "vendor_id", "left")
    kept = F.map_filter("own", lambda k, _: ~F.map_contains_key("patch", k))
    before = F.transform("steps", lambda s: F.struct(s["pass"].alias("pass"), s["ord"].alias("ord"), s["field"].alias("field"), F.coalesce(s["earlier"], F.try_element_at("own", s["field"])).alias("before"), s["after"].alias("after")))
    patched = F.when(F.col("patch").isNull(), F.col("own")).otherwise(F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), "patch"))
    return rows.select("vendor_id", patched.alias("fields"), F.coalesce(F.size("steps"), F.lit(0)).alias("version"), F.coalesce(before, F.array().cast("array<struct<pass:bigint,ord:bigint,field:string,before:string,after:string>>")).alias("changes"))


def apply_corrections(resolved: DataFrame, routed: DataFrame) -> DataFrame:
    """resolved with the latest applied correction per parameter."""
    live = routed.where(F.col("route").isin("apply", "note_only"))
    last = live.groupBy("vendor_id", "parameter_id").agg(F.max_by(F.struct(F.nullif(F.trim("proposed_value"), F.lit("")).alias("v"), F.col("proposed_note").alias("n")), F.struct("pass", "ord")).alias("c"))
    rows = resolved.join(last, ["vendor_id", "parameter_id"], "left")
    rows = rows.withColumn("value", F.coalesce("c.v", "value")).withColumn("note", F.coalesce("c.n", "note"))
    return rows.withColumn("unresolved", F.col("value").isNull()).drop("c")


def apply_overrides(fresh: DataFrame, carried: DataFrame, overrides: DataFrame) -> DataFrame:
    """Analyst over carried correction over fresh value, with what was before and whether the fresh one changed since issue (JN-17)."""
    key = ["vendor_id", "parameter_id"]
    a = overrides.select(*key, F.nullif(F.trim("analyst_value"), F.lit("")).alias("analyst"), "issued_original")
    b = carried.select(*key, F.col("value").alias("carried"))
    rows = fresh.select(*key, F.col("value").alias("fresh")).join(b, key, "left").join(a, key, "left")
    return rows.select(
        *key,
        F.coalesce("analyst", "carried", "fresh").alias("value"),
        F.when(F.col("analyst").isNotNull(), "analyst").when(F.col("carried").isNotNull(), "review").otherwise("fresh").alias("kind"),
        F.coalesce("carried", "fresh").alias("before"),
        (F.col("issued_original").isNotNull() & ~F.col("fresh").eqNullSafe(F.col("issued_original"))).alias("stale"),
    )


def validate_overrides(overrides: DataFrame, specs: DataFrame) -> DataFrame:
    """vendor_id, parameter_id, problem: every override that may not be applied (OVR-01)."""
    rows = overrides.join(specs, "parameter_id", "left")
    value = F.lower(F.trim("analyst_value"))
    blank = F.coalesce(value, F.lit("")) == ""
    problem = (
        F.when(F.col("numeric").isNull(), "unknown parameter")
        .when(blank, F.lit(None))
        .when((value == "unresolved") & F.col("parameter_id").isin(*ADDRESS_ROWS), "address rows always resolve")
        .when(value == "unresolved", F.lit(None))
        .when(F.col("numeric") & value.try_cast("double").isNull(), "not a number")
        .when(~F.col("numeric") & ~F.array_contains("buckets", value), "not an allowed value")
    )
    return rows.withColumn("problem", problem).where("problem is not null").select("vendor_id", "parameter_id", "problem")


def validate_entity_overrides(overrides: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """vendor_id, field, problem of overrides of fields that no report reads (OVR-01)."""
    rows = overrides.where(F.trim(F.coalesce("analyst_value", F.lit(""))) != "")
    return rows.where(~F.col("field").isin(*fields)).select("vendor_id", "field", F.lit("not a field of the report").alias("problem"))


def validate_doc_overrides(overrides: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """vendor_id, file_name, problem of overrides to an unknown document type (OVR-01); "ignore" is one."""
    kind = F.lower(F.trim("doc_type"))
    return overrides.where((kind != "") & ~kind.isin("ignore", *types)).select("vendor_id", "file_name", F.concat(F.lit("not a document type: "), kind).alias("problem"))


def rederive_address(resolved: DataFrame, overridden: DataFrame) -> DataFrame:
    """Rental and landlord rows after their sources changed, unless overridden themselves (OVR-02); a row that changes takes its new note."""
    pick = lambda p: F.max(F.when(F.col("parameter_id") == p, F.col("value")))
    wide = resolved.groupBy("vendor_id").agg(pick("addr_ownership_type").alias("o"), pick("addr_electricity_bill").alias("b"), F.coalesce(F.bool_or((F.col("parameter_id") == "addr_landlord_declaration") & (F.col("value") == "present")), F.lit(False)).alias("noc"))
    let, declared = rental_validation(F.col("o"), F.col("b")), landlord(F.col("noc"), F.col("o"))
    row = lambda p, answer: F.struct(F.lit(p).alias("parameter_id"), answer[0].alias("derived"), answer[1].alias("_why"))
    new = F.array(row("addr_rental_validation", let), row("addr_landlord_declaration", declared))
    new = wide.select("vendor_id", F.explode(new).alias("n")).select("vendor_id", "n.*").join(overridden.select("vendor_id", "parameter_id"), ["vendor_id", "parameter_id"], "left_anti")
    rows = resolved.join(new, ["vendor_id", "parameter_id"], "left")
    if "note" in resolved.columns:
        changed = F.col("derived").isNotNull() & ~F.col("derived").eqNullSafe(F.col("value"))
        rows = rows.withColumn("note", F.when(changed, F.coalesce("_why", F.lit(""))).otherwise(F.col("note")))
    return rows.withColumn("value", F.coalesce("derived", "value")).drop("derived", "_why")


def append_audit(prior: DataFrame, new: DataFrame) -> DataFrame:
    return prior.unionByName(new, allowMissingColumns=True)


def usage_rollup(messages: DataFrame) -> DataFrame:
    """Token counters per run and pass, and per run (pass null) (AGG-15)."""
    names = ("input_tokens", "output_tokens", "total_tokens", "reasoning_tokens")
    sums = [F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names]
    return messages.rollup("vendor_id", "pass").agg(F.count(F.lit(1)).alias("messages"), *sums).where("vendor_id is not null")


#: The call with which a reviewer hands in a pass; it looks nothing up.
REPORT_CALL = "ReviewReport"


def evaluate_traces(findings: DataFrame, calls: DataFrame, expected: DataFrame, corrections: DataFrame | None = None, report_call: str = REPORT_CALL) -> DataFrame:
    """Per vendor (AGG-16): findings, verified ones in passes without a look-up, expected ids hit and missed, calls in all, and by
    tool, findings by action and confidence, corrections applied and escalations.

    findings: vendor_id, pass, parameter_id, confidence (and action, field). calls:
    vendor_id, pass (and tool). corrections: routed findings (route). Counts are summed
    per kind before they meet in one row, so a long trace is never gathered.
    """
    has = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    real = F.coalesce(has(calls, "tool") != report_call, F.lit(True))
    used = calls.where(real).select("vendor_id", "pass").distinct().withColumn("_used", F.lit(True))
    rows = findings.join(used, ["vendor_id", "pass"], "left")
    named = F.coalesce(F.col("parameter_id"), has(findings, "field"))
    per = rows.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if((F.col("confidence") == "verified") & F.col("_used").isNull()).alias("unsupported"),
        F.collect_set(named).alias("flagged"),
    )
    kinds = lambda df, c, name: df.groupBy("vendor_id", F.coalesce(c, F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("vendor_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    both = per.join(expected.groupBy("vendor_id").agg(F.collect_set("parameter_id").alias("want")), "vendor_id", "full_outer")
    both = both.join(calls.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("calls")), "vendor_id", "left")
    both = both.join(kinds(calls.where(real), has(calls, "tool"), "tools"), "vendor_id", "left")
    both = both.join(kinds(findings, has(findings, "action"), "by_action"), "vendor_id", "left").join(kinds(findings, F.col("confidence"), "by_confidence"), "vendor_id", "left")
    if corrections is not None:
        routes = corrections.groupBy("vendor_id").agg(F.count_if(F.col("route").isin("apply", "note_only")).alias("corrections"), F.count_if(F.col("route") == "escalate").alias("escalations"))
        both = both.join(routes, "vendor_id", "left")
    else:
        both = both.withColumns({"corrections": F.lit(0), "escalations": F.lit(0)})
    none, blank = F.array().cast("array<string>"), F.create_map().cast("map<string,bigint>")
    hit, missed = recall_sets(F.coalesce("want", none), F.coalesce("flagged", none))
    count = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("calls", "corrections", "escalations")]
    maps = [F.coalesce(c, blank).alias(c) for c in ("tools", "by_action", "by_confidence")]
    return both.select("vendor_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("unsupported", F.lit(0)).alias("unsupported"), hit.alias("hit"), missed.alias("missed"), *count, *maps)


def recall_sets(expected: Column, flagged: Column) -> tuple[Column, Column]:
    """What was found of what was expected, and what was not (SET-03)."""
    return F.array_sort(F.array_intersect(expected, flagged)), F.array_sort(F.array_except(expected, flagged))


def dedupe_calls(calls: DataFrame) -> DataFrame:
    """calls with the number of the first identical one in its pass, null for the first (WIN-06)."""
    first = F.min("call_no").over(W.partitionBy("vendor_id", "pass", "tool", "args"))
    return calls.withColumn("repeats", F.when(F.col("call_no") > first, first))


def pass_history(passes: DataFrame) -> DataFrame:
    """passes with the ordered summaries of earlier ones (WIN-07)."""
    before = W.partitionBy("vendor_id").orderBy("pass").rowsBetween(W.unboundedPreceding, -1)
    return passes.withColumn("history", F.collect_list("summary").over(before))


def route_passes(passes: DataFrame, most: int = 4) -> DataFrame:
    """Another pass while the verdict asks for it and the cap allows, else final (REV-02)."""
    again = (F.col("verdict") == "needs_another_pass") & (F.col("pass") < most)
    return passes.withColumn("route", F.when(again, "llm_review").otherwise("finalize")).withColumn("approved", F.col("verdict") == "approved")


def state_text(resolved: DataFrame, entity: DataFrame | None = None, fields: tuple[str, ...] = REPORT_FIELDS) -> DataFrame:
    """One text per vendor with a line per parameter, and where entity (vendor_id, fields map) is given one per field that reports read (REV-04)."""
    line = F.concat_ws(" = ", "parameter_id", F.coalesce("value", F.lit("UNRESOLVED")))
    rows = F.array_sort(F.collect_list(F.struct("parameter_id", line.alias("line"))))
    per = resolved.groupBy("vendor_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))
    if entity is None:
        return per
    value = lambda f: F.coalesce(F.nullif(F.try_element_at("fields", F.lit(f)), F.lit("")), F.lit("None (the report shows N/A)"))
    told = entity.select("vendor_id", F.concat_ws("\n", *[F.concat(F.lit(f"- {f}: "), value(f)) for f in fields]).alias("told"))
    return per.join(told, "vendor_id", "full_outer").select("vendor_id", F.concat_ws("\n", "text", "told").alias("text"))


def cap_result(c: Column, limit: int = 6000) -> Column:
    """struct(truncated, total_chars, preview) of a long text (PRJ-15)."""
    n = F.length(c)
    return F.struct((n > limit).alias("truncated"), n.alias("total_chars"), F.left(c, F.lit(limit)).alias("preview"))


def preview_scores(fresh: DataFrame, carried: DataFrame, overrides: DataFrame, params: DataFrame, rules: DataFrame, vendors: DataFrame) -> DataFrame:
    """Scores as they would be with the overrides (OVR-03)."""
    state = apply_overrides(fresh, carried, overrides).withColumn("note", F.lit("")).withColumn("unresolved", F.col("value").isNull())
    return score.vendor_scores(score.category_scores(score.score_params(state, params, rules, vendors)))


def finalise(resolved: DataFrame, carried: DataFrame, overrides: DataFrame, params: DataFrame, rules: DataFrame, vendors: DataFrame, grades: DataFrame) -> dict[str, DataFrame]:
    """Problems, state, scores, stale lines and cross-checks after overrides (OVR-05).

    A vendor with any problem keeps none of its overrides. A fresh value keeps its
    note, a carried one has the correction's, an analyst's the one given with it
    (column note of overrides, if there is one). Cross-checks are read from the state
    so reached: what the analyst settled is not raised again, what went stale is.
    """
    problems = validate_overrides(overrides, score.param_specs(rules))
    good = overrides.join(problems.select("vendor_id").distinct(), "vendor_id", "left_anti")
    state = apply_overrides(resolved, carried, good)
    key = ["vendor_id", "parameter_id"]
    told = lambda rows, name: rows.select(*key, (F.col("note") if "note" in rows.columns else F.lit(None).cast("string")).alias(name))
    noted = state.join(told(resolved, "_fresh"), key, "left").join(told(carried, "_carried"), key, "left").join(told(good, "_given"), key, "left")
    note = F.when(F.col("kind") == "analyst", F.col("_given")).when(F.col("kind") == "review", F.col("_carried")).otherwise(F.col("_fresh"))
    derived = rederive_address(noted.withColumn("note", F.coalesce(note, F.lit(""))).drop("_fresh", "_carried", "_given"), good)
    derived = derived.withColumn("unresolved", F.col("value").isNull())
    scores = score.grade_band(score.vendor_scores(score.category_scores(score.score_params(derived, params, rules, vendors))), grades)
    stale = state.where("stale").select("vendor_id", F.concat_ws(": ", F.lit("stale"), "parameter_id").alias("item"))
    return {"problems": problems, "state": derived, "scores": scores, "stale": stale, "cross_checks": cross_check_items(derived).unionByName(stale)}


def flatten_messages(traces: DataFrame) -> DataFrame:
    """vendor_id, pass, ord, kind, text, tool_calls of trace messages whose content is text or a list of parts (REV-03)."""
    m = traces.select("vendor_id", "pass", F.posexplode("messages").alias("ord", "m"))
    parts = F.array_join(F.filter(F.transform("m.parts", lambda p: F.when(p["type"] == "text", p["text"])), lambda t: t.isNotNull()), "\n")
    return m.select("vendor_id", "pass", "ord", F.col("m.type").alias("kind"), F.coalesce("m.content", parts).alias("text"), F.transform("m.tool_calls", lambda c: c["name"]).alias("tool_calls"))
