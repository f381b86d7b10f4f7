"""Report rows as tables: scores, findings, chips, entity lines, and one text per vendor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelight.functions.text import headline, location, split_flag, vintage_phrase


def scoring_rows(param_scores: DataFrame, codes: DataFrame) -> DataFrame:
    """code, option text and points per parameter (RPT-01)."""
    option = F.when(F.col("unresolved") & (F.col("max_score") == 0), "N/A").when(F.col("unresolved"), "Not determined").otherwise(F.col("matched_condition"))
    return param_scores.join(codes, "parameter_id", "left").select("vendor_id", "parameter_id", "code", option.alias("option"), "assigned_score", "max_score")


#: parameter, what it must be (ok from 60% of its points, low below, open; "any" of the first two), a value and a word of the note it
#: must have (None: any), kind (c confirmed, n note), text. The first that fits a parameter tells of it; {v} is the option scored.
TEMPLATES = [
    ("com_gstin_active", "ok", None, None, "c", "GST registration is active{since}{taxpayer}"), ("com_gstin_active", "low", None, None, "n", "GST registration status: {v}"),
    ("com_gst_vintage", "ok", None, None, "c", "GST vintage: {vintage}"), ("com_gst_vintage", "low", None, None, "n", "Short GST record: {v}"),
    ("com_gst_filing_compliance", "ok", None, None, "c", "GST returns filed: {v}"), ("com_gst_filing_compliance", "low", None, None, "n", "GST returns filed late: {v}"),
    ("com_filing_frequency", "ok", None, None, "c", "Filing frequency: {v}"), ("com_filing_frequency", "low", None, None, "n", "Filing frequency: {v}, not monthly"),
    ("com_multiple_registrations", "any", "cancelled_present", None, "n", "Cancelled registrations on the entity's PAN: {note}"),
    ("com_multiple_registrations", "any", "active_multi_state", None, "c", "Several active registrations on the entity's PAN: it works in several states"),
    ("com_multiple_registrations", "ok", None, None, "c", "A single clean registration on the entity's PAN"), ("com_multiple_registrations", "low", None, None, "n", "Registrations on the entity's PAN: {v}"),
    ("com_multiple_registrations", "open", None, None, "n", "Other registrations on the entity's PAN are neither clearly cancelled nor active: check by hand"),
    ("com_hsn_match", "ok", None, None, "c", "Goods codes match the declared trade"), ("com_hsn_match", "low", None, None, "n", "Goods codes: {v}"),
    ("com_gst_delay_days", "ok", None, None, "c", "No filing delay of over ten days"), ("com_gst_delay_days", "low", None, None, "n", "Longest filing delay: {v} days"),
    ("com_bank_verification", "ok", None, None, "c", "Bank account checked live and registered with the tax portal"), ("com_bank_verification", "low", None, None, "n", "Bank account check: {v}"),
    ("com_bank_verification", "open", None, None, "n", "Bank account not independently verified: no live check, and the tax portal does not vouch for it"),
    ("com_pf_filing_status", "ok", None, None, "c", "Provident fund returns filed in time"), ("com_pf_filing_status", "low", None, None, "n", "Provident fund returns: {v}"),
    ("addr_ownership_type", "any", "owned", "NO SALE DEED", "c", "Business premises owned, by inference: no sale deed on file"),
    ("addr_ownership_type", "ok", None, None, "c", "Business premises: {v}"), ("addr_ownership_type", "low", None, None, "n", "Business premises: {v}"),
    ("addr_electricity_bill", "ok", None, None, "c", "Electricity bill agrees with the registered address"), ("addr_electricity_bill", "low", None, None, "n", "Electricity bill address: {v}"),
    ("addr_msme", "ok", None, None, "c", "MSME registration valid{udyam}"), ("addr_msme", "low", None, None, "n", "MSME registration: {v}"),
    ("ident_pan_active", "ok", None, None, "c", "PAN is active"), ("ident_pan_active", "low", None, None, "n", "PAN status: {v}"),
    ("ident_pan_name_match", "ok", None, None, "c", "PAN name agrees with the registered name"), ("ident_pan_name_match", "low", None, None, "n", "PAN name against the registered name: {v}; ask for clarification"),
]
#: Open parameters of these have no line of their own: their ownership is told by its note, legal ones are pooled.
SILENT = ("addr_ownership_type",)
NOTE_MARKERS = r"\b(GAP|WARNING|CRITICAL|DISCREPANCY|NOTE|CONFLICT|WATCHLIST HIT|namesakes dismissed)\b"


def findings(param_scores: DataFrame, entity: DataFrame | None = None) -> DataFrame:
    """vendor_id, kind (c confirmed, n note), text, without repeats (RPT-02).

    Per parameter the first template that fits; PAN status and name in one line where
    both are right; legal parameters pooled to a watchlist line, a clean line and how
    many could not be screened; then why a parameter is open, and what marked notes say.
    param_scores: vendor_id, category_id, parameter_id, value, matched_condition,
    assigned_score, max_score, unresolved, note. entity: date_of_registration,
    taxpayer_type, udyam_number, vintage per vendor, as far as it has them.
    """
    told = ("date_of_registration", "taxpayer_type", "udyam_number", "vintage")
    have = [] if entity is None else [c for c in told if c in entity.columns]
    rows = param_scores.join(entity.select("vendor_id", *have), "vendor_id", "left") if have else param_scores
    known = {c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in have else F.lit(None).cast("string") for c in told}
    ok = F.col("assigned_score") >= 0.6 * F.col("max_score")
    state = F.when(F.col("unresolved"), F.when(F.col("max_score") > 0, "open")).when(ok, "ok").otherwise("low")
    note = F.trim(F.coalesce("note", F.lit("")))
    rows = rows.withColumn("_state", state).withColumn("_note", note)

    templates = param_scores.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "t_ord int, t_param string, t_state string, t_value string, t_word string, t_kind string, t_text string")
    fits = (F.col("t_param") == F.col("parameter_id")) & ((F.col("t_state") == F.col("_state")) | ((F.col("t_state") == "any") & F.col("_state").isin("ok", "low")))
    fits = fits & (F.col("t_value").isNull() | (F.col("t_value") == F.col("value"))) & (F.col("t_word").isNull() | F.contains("_note", F.col("t_word")))
    pan = F.col("parameter_id").isin("ident_pan_active", "ident_pan_name_match")
    right = F.coalesce((F.col("_state").isin("ok", "low")) & F.col("value").isin("active", "match"), F.lit(False))
    both = rows.where(pan).groupBy("vendor_id").agg(F.count_if(right).alias("n")).where("n = 2").select("vendor_id", F.lit(True).alias("_both"))
    rows = rows.join(both, "vendor_id", "left")
    each = rows.where((F.col("category_id") != "legal_aml") & F.col("_state").isNotNull() & ~(F.coalesce("_both", F.lit(False)) & pan))
    scored = F.coalesce("matched_condition", "value", F.lit(""))
    fill = {
        "{v}": scored, "{note}": F.coalesce(F.nullif("_note", F.lit("")), F.lit("see the scores")),
        "{since}": F.coalesce(F.concat(F.lit(" since "), known["date_of_registration"]), F.lit("")), "{taxpayer}": F.coalesce(F.concat(F.lit(", "), known["taxpayer_type"], F.lit(" taxpayer")), F.lit("")),
        "{vintage}": F.coalesce(known["vintage"], scored), "{udyam}": F.coalesce(F.concat(F.lit(": "), known["udyam_number"]), F.lit("")),
    }
    text = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), kv[1]), fill.items(), F.col("t_text"))
    first = each.join(F.broadcast(templates), fits, "left").groupBy("vendor_id", "parameter_id", "_state").agg(F.min_by(F.struct("t_kind", text.alias("text")), "t_ord").alias("t"))
    silent = (F.col("_state") == "open") & ~F.col("parameter_id").isin(*SILENT)
    lines = first.select("vendor_id", F.when(F.col("t").isNotNull(), F.col("t")).when(silent, F.struct(F.lit("n").alias("t_kind"), F.concat("parameter_id", F.lit(": not verified automatically")).alias("text"))).alias("t"))
    lines = lines.where("t is not null").select("vendor_id", F.col("t.t_kind").alias("kind"), "t.text")
    out = [lines, both.select("vendor_id", F.lit("c").alias("kind"), F.lit("PAN is active, and its name agrees with the registered name").alias("text"))]

    aml = rows.where("category_id = 'legal_aml'")
    pool = aml.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("unresolved").alias("missing"), F.count_if(~F.col("unresolved") & (F.col("max_score") != 0) & (F.col("assigned_score") < F.col("max_score"))).alias("hit"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("unresolved"), F.col("parameter_id")))), ", ").alias("screened"),
        F.max(F.when(~F.col("unresolved") & (F.col("parameter_id") == "legal_sanctions") & (F.col("value") == "adverse_watchlist"), F.col("_note"))).alias("watch"),
    )
    line = lambda when, kind, c: F.when(when, F.struct(F.lit(kind).alias("kind"), c.alias("text")))
    clean, some = F.col("hit") == 0, F.col("missing") < F.col("n")
    hit = F.left(F.trim(F.element_at(F.split(F.element_at(F.split("watch", r" \| "), 1), ":", 2), -1)), F.lit(280))
    pooled = F.array_compact(F.array(
        line(F.col("watch").isNotNull(), "n", F.concat(F.lit("Watchlist hit, to confirm or dismiss: "), hit)),
        line(clean & some & (F.col("missing") == 0), "c", F.lit("No legal or AML record on any register")),
        line(clean & some & (F.col("missing") > 0), "c", F.concat(F.lit("No record on the registers that were screened: "), "screened")),
        line(F.col("missing") > 0, "n", F.format_string("%d of %d legal and AML registers could not be screened, and do not count as clean", "missing", "n")),
    ))
    out.append(pool.select("vendor_id", F.explode(pooled).alias("l")).select("vendor_id", "l.*"))

    why = F.when((F.col("_state") == "open") & (F.col("_note") != ""), F.concat("parameter_id", F.lit(", not determined: "), headline(F.col("_note"))))
    marked = F.when(F.col("_state").isin("ok", "low") & F.col("_note").rlike(NOTE_MARKERS), F.concat("parameter_id", F.lit(": "), headline(F.col("_note"), marker=NOTE_MARKERS)))
    out.append(rows.select("vendor_id", F.lit("n").alias("kind"), F.coalesce(why, marked).alias("text")).where("text is not null"))
    return reduce(lambda x, y: x.unionByName(y), out).dropDuplicates(["vendor_id", "kind", "text"])


# Chips and the values that earn them.
CHIPS = (("GST active", "com_gstin_active", ("active",)), ("Filings timely", "com_gst_filing_compliance", ("timely",)), ("Bank verified", "com_bank_verification", ("penny_success_gst_match",)), ("PAN matched", "ident_pan_name_match", ("match",)), ("No sanctions", "legal_sanctions", ("not_listed",)))


def chips(param_scores: DataFrame) -> DataFrame:
    """vendor_id, chips earned from resolved values only (RPT-03)."""
    earned = F.coalesce(*[F.when((F.col("parameter_id") == p) & F.col("value").isin(*v), name) for name, p, v in CHIPS])
    return param_scores.groupBy("vendor_id").agg(F.array_sort(F.collect_set(earned)).alias("chips"))


def entity_rows(entity: DataFrame, fields: dict[str, str]) -> DataFrame:
    """vendor_id, ordinal, label, value of the fields that have one (RPT-04)."""
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for i, (c, label) in enumerate(fields.items()) if c in entity.columns])
    return entity.select("vendor_id", F.explode(F.filter(rows, lambda r: F.coalesce(r["value"], F.lit("")) != "")).alias("r")).select("vendor_id", "r.*")


def improvement_tags(scores: DataFrame) -> DataFrame:
    """Tags of late filing, weak address proof and name mismatch (RPT-06); late, max_delay, address_score, pan_name columns."""
    tags = F.array_compact(F.array(
        F.when((F.col("late") > 0) | (F.col("max_delay") > 10), "File returns on time"),
        F.when(F.col("address_score") < 6, "Strengthen proof of address"),
        F.when(F.col("pan_name") == "not_match", "Align PAN and registered name"),
    ))
    return scores.select("vendor_id", tags.alias("tags"))


def text_report(rows: DataFrame) -> DataFrame:
    """One text per vendor of report rows (section, ordinal, c1..c3) in order (RPT-07)."""
    line = F.concat_ws(" | ", "c1", "c2", "c3")
    lines = F.array_sort(F.collect_list(F.struct("section", "ordinal", line.alias("line"))))
    return rows.groupBy("vendor_id").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("text"))


def first_k_summary(rows: DataFrame, keys: list[str], item: str, order: str, k: int) -> DataFrame:
    """The first k items in order and how many more there are (SRT-02).

    Only k rows of a key leave each task, and counts are summed before the shuffle.
    """
    named = rows.select(*keys, F.col(order).alias("o"), F.col(item).cast("string").alias("i"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("o", "i"))
    first = named.withColumn("place", place).where(F.col("place") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "i"))).alias("a"))
    total = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    same = reduce(lambda x, y: x & y, [F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys])
    both = total.alias("t").join(first.alias("f"), same, "left").select("t.*", "f.a")
    shown = F.array_join(F.transform("a", lambda r: r["i"]), "; ")
    return both.select(*keys, F.when(F.col("n") > k, F.concat(shown, F.lit(" (+"), (F.col("n") - k).cast("string"), F.lit(" more)"))).otherwise(shown).alias("summary"))


def flags_table(parts: dict[str, DataFrame]) -> DataFrame:
    """Sections of (vendor_id, item) as one table, "where: detail" split (SET-05)."""
    rows = [d.select("vendor_id", F.lit(n).alias("section"), split_flag(F.col("item")).alias("s")).select("vendor_id", "section", "s.*") for n, d in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def profile(entity: DataFrame) -> DataFrame:
    """vendor_id, text: one paragraph of what is known (RPT-05)."""
    say = lambda lead, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(lead), F.col(c))) if c in entity.columns else F.lit(None).cast("string")
    parts = [say("", "legal_name"), say("constitution: ", "constitution"), say("registered on ", "date_of_registration"), say("in ", "state"), say("activity: ", "major_activity")]
    return entity.select("vendor_id", F.concat(F.concat_ws("; ", *parts), F.lit(".")).alias("text"))


def _values(param_scores: DataFrame, *parameters: str) -> DataFrame:
    """vendor_id and a struct (value, unresolved, assigned_score, max_score) per named parameter, null where a vendor has no such row; of vendors with one of them."""
    pick = lambda p: F.max(F.when(F.col("parameter_id") == p, F.struct("value", "unresolved", "assigned_score", "max_score"))).alias(p)
    # rows of other parameters are left out before they are sorted
    return param_scores.where(F.col("parameter_id").isin(*parameters)).groupBy("vendor_id").agg(*[pick(p) for p in parameters])


def _field(entity: DataFrame, name: str) -> Column:
    """A field of the entity, null where it is blank or not there."""
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name in entity.columns else F.lit(None).cast("string")


def header_chips(param_scores: DataFrame, entity: DataFrame) -> DataFrame:
    """vendor_id, ordinal, kind, label: what the head of a report may claim (RPT-03), each from a resolved value.

    Legal rows first (a scored hit before unscreened registers), then GST, bank and PAN
    (only where active), place and type of seller.
    """
    aml = param_scores.where("category_id = 'legal_aml'").groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("unresolved").alias("missing"), F.count_if(~F.col("unresolved") & (F.col("max_score") > 0) & (F.col("assigned_score") < F.col("max_score"))).alias("hits")
    )
    own = entity.select("vendor_id", F.coalesce(location(_field(entity, "address")), _field(entity, "state"), F.lit("N/A")).alias("place"))
    rows = own.join(_values(param_scores, "com_gstin_active", "com_bank_verification", "ident_pan_active", "ident_seller_type"), "vendor_id", "left").join(aml, "vendor_id", "left")
    known = lambda p: F.coalesce(~F.col(p)["unresolved"], F.lit(False))
    chip = lambda kind, label: F.struct(F.lit(kind).alias("kind"), (label if isinstance(label, Column) else F.lit(label)).alias("label"))
    gst, pan, seller = F.col("com_gstin_active"), F.col("ident_pan_active"), F.col("ident_seller_type")
    legal = F.when(F.col("hits") > 0, chip("amber", "AML adverse finding")).when(F.col("missing") > 0, chip("amber", F.format_string("AML partly screened (%d/%d)", F.col("n") - F.col("missing"), F.col("n")))).when(F.col("n") > 0, chip("teal", "AML cleared"))
    status = F.when(known("com_gstin_active") & (gst["value"] == "active"), chip("teal", "GST active")).when(known("com_gstin_active"), chip("amber", F.concat(F.lit("GST "), gst["value"]))).otherwise(chip("amber", "GST status unconfirmed"))
    bank = F.when(known("com_bank_verification") & (F.col("com_bank_verification")["assigned_score"] > 0), chip("blue", "Bank verified")).otherwise(chip("amber", "Bank not verified"))
    card = F.when(known("ident_pan_active") & (pan["value"] == "active"), chip("white", "PAN active"))
    kind = chip("white", F.when(known("ident_seller_type"), F.initcap(seller["value"])).otherwise("Unclassified"))
    every = F.array_compact(F.array(legal, status, bank, card, chip("white", F.col("place")), kind))
    return rows.select("vendor_id", F.posexplode(every).alias("ordinal", "c")).select("vendor_id", "ordinal", "c.*")


def registration_rows(entity: DataFrame, param_scores: DataFrame) -> DataFrame:
    """vendor_id, ordinal, label, value, ok (null: not verified) of the registrations (RPT-04)."""
    rows = entity.join(_values(param_scores, "com_gstin_active", "com_bank_verification"), "vendor_id", "left")
    gst, bank = F.col("com_gstin_active"), F.col("com_bank_verification")
    none = F.lit(None).cast("boolean")
    line = lambda label, value, ok=none: F.struct(F.lit(label).alias("label"), value.alias("value"), ok.alias("ok"))
    told = lambda name, otherwise: F.coalesce(_field(entity, name), F.lit(otherwise))
    resolved = lambda p: F.coalesce(~p["unresolved"], F.lit(False))
    each = F.array(
        line("PAN number", told("pan", "Not available")), line("GSTIN", told("gstin", "Not available")), line("Udyam number", told("udyam_number", "Not available")),
        line("GST status", F.when(resolved(gst), F.initcap(gst["value"])).otherwise("Unknown"), F.when(resolved(gst), gst["value"] == "active")),
        line("Taxpayer type", told("taxpayer_type", "N/A")), line("GST since", told("date_of_registration", "N/A")),
        line("Bank", F.coalesce(_field(entity, "bank_name"), _field(entity, "bank_name_msme"), F.lit("Not available")), F.when(resolved(bank), bank["assigned_score"] > 0)),
    )
    return rows.select("vendor_id", F.posexplode(each).alias("ordinal", "r")).select("vendor_id", "ordinal", "r.*")


def profile_text(entity: DataFrame, param_scores: DataFrame, as_of: Column) -> DataFrame:
    """vendor_id, text: who the vendor is, where, since when, and under what registrations (RPT-05).

    The age of its registration and that of the firm itself are told apart.
    """
    f = lambda name: _field(entity, name)
    rows = entity.join(_values(param_scores, "addr_msme"), "vendor_id", "left")
    trade, kind = F.coalesce(f("trade_name"), f("legal_name"), F.lit("The entity")), F.coalesce(F.lower(f("constitution")), F.lit("firm of unknown form"))
    nic = F.lower(F.regexp_replace(f("nic_5_description"), r"\.$", ""))
    seen = F.concat(F.lit(", as its electricity bill says too ("), f("electricity_bill_activity"), F.lit(")"))
    trade_in = F.concat(nic, F.coalesce(F.concat(F.lit(" (NIC "), f("nic_5_code"), F.lit(")")), F.lit("")), F.coalesce(seen, F.lit("")))
    lead = F.concat(trade, F.lit(" is a "), kind, F.lit(" engaged in "), F.coalesce(trade_in, F.lower(f("nature_of_business")), F.lower(f("major_activity")), F.lit("an undeclared trade")), F.lit("."))
    since = F.concat(F.lit(" and has held its GSTIN for "), vintage_phrase(f("date_of_registration"), as_of), F.lit(" (since "), f("date_of_registration"), F.lit(")"))
    founded = F.when(f("date_of_incorporation") != F.coalesce(f("date_of_registration"), F.lit("")), F.concat(F.lit("; the firm itself dates to "), f("date_of_incorporation"), F.coalesce(F.concat(F.lit(" ("), vintage_phrase(f("date_of_incorporation"), as_of), F.lit(")")), F.lit(""))))
    place = F.concat(F.lit("It is based in "), F.coalesce(f("state"), location(f("address")), F.lit("an unknown place")), F.coalesce(since, F.lit("")), F.coalesce(founded, F.lit("")), F.lit("."))
    msme = F.when(F.coalesce(~F.col("addr_msme")["unresolved"], F.lit(False)) & (F.col("addr_msme")["value"] == "valid_active"), F.concat(F.lit("Its MSME registration is valid"), F.coalesce(F.concat(F.lit(", class "), f("enterprise_type")), F.lit("")), F.lit(".")))
    band = F.trim(F.regexp_replace(f("gst_annual_aggregate_turnover"), r"(?i)^\s*slab\s*:\s*", ""))
    turnover = F.concat(F.lit("GST records place its turnover in the band "), band, F.coalesce(F.concat(F.lit(" for "), f("gst_annual_aggregate_turnover_year")), F.lit("")), F.lit("."))
    under = F.concat(F.lit("It operates under GSTIN "), F.coalesce(f("gstin"), F.lit("N/A")), F.coalesce(F.concat(F.lit(" as a "), F.lower(f("taxpayer_type")), F.lit(" taxpayer")), F.lit("")), F.lit("."))
    return rows.select("vendor_id", F.concat_ws(" ", lead, place, msme, turnover, under).alias("text"))
