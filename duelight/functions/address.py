"""Address comparison: premises numbers by kind, places and PINs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelight.functions.text import once

# Words of addresses that name no place.
STOP_WORDS = (
    "plot", "plno", "pl", "no", "nos", "number", "door", "flat", "block", "building", "premises", "bldg", "gala",
    "unit", "shed", "room", "floor", "road", "street", "lane", "marg", "village", "vtc", "town", "city", "dist",
    "district", "state", "pin", "code", "near", "opp", "opposite", "behind", "at", "post", "po", "the", "and",
    "of", "ms", "mrs", "mr", "shri", "india", "name", "section", "sl", "sr", "sno",
)
# Words of state names.
STATE_WORDS = (
    "maharashtra", "gujarat", "karnataka", "kerala", "punjab", "haryana", "rajasthan", "delhi", "telangana",
    "assam", "goa", "bihar", "jharkhand", "odisha", "sikkim", "tripura", "mizoram", "manipur", "nagaland",
    "meghalaya", "uttarakhand", "chandigarh", "puducherry", "pradesh", "bengal", "nadu", "kashmir",
    "chhattisgarh", "tamil", "tamilnadu", "uttar", "madhya", "himachal", "arunachal", "andhra", "jammu", "west",
)
# Words that announce a premises number, by the register it belongs to.
KINDS = {
    "plot": ("plot", "plno", "pl", "plotno"),
    "survey": ("survey", "sy", "syno", "sno", "sf", "sfno", "ts", "tsno", "khasra", "gat", "hissa"),
    "door": ("door", "flat", "shed", "unit", "gala", "house", "hno", "dno", "holding"),
}
DIGITS = "०१२३४५६७८९"


def norm_addr(c: Column) -> Column:
    """Lower-case words; separators between digits join them with "_" (STR-06)."""
    c = F.translate(F.lower(F.coalesce(c, F.lit(""))), DIGITS, "0123456789")
    c = F.regexp_replace(c, r"(?<=\d)[.\-/\\](?=\d)", "_")
    c = F.regexp_replace(c, r"(?<=[a-z])\.?\s*/\s*(?=[a-z])", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[.\-/\\]", ""), r"[^a-z0-9_]+", " ")
    return F.regexp_replace(c, r"^[_ ]+|[_ ]+$", "")


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(norm_addr(c), F.lit(r"[^\s]+"), F.lit(0))


def addr_tokens(c: Column) -> Column:
    """struct(premises, places, pins) of an address (STR-07)."""
    return once(F.array_distinct(F.filter(_tokens(c), lambda t: ~t.isin(*STOP_WORDS))), _sorted_tokens)


def _sorted_tokens(toks: Column) -> Column:
    pin = lambda t: t.rlike(r"^\d{6}$")
    mid = lambda t: t.rlike(r"^\d{3,5}$")
    own = F.filter(toks, lambda t: ~pin(t) & ((t.rlike(r"\d") & t.rlike("[a-z]")) | mid(t) | t.contains("_")))
    parts = F.filter(F.flatten(F.transform(F.filter(toks, lambda t: t.contains("_")), lambda t: F.split(t, "_"))), mid)
    places = F.filter(toks, lambda t: t.rlike(r"^[a-z]{3,}$") & ~t.isin(*STATE_WORDS))
    return F.struct(F.array_sort(F.array_union(own, parts)).alias("premises"), F.array_sort(places).alias("places"), F.array_sort(F.filter(toks, pin)).alias("pins"))


def premises_ids(c: Column) -> Column:
    """map(kind, numbers): runs of numbers after a word of that kind (STR-08); kinds without numbers are absent."""
    return once(F.concat(F.lit(" "), norm_addr(c), F.lit(" ")), _numbers)


def _numbers(text: Column) -> Column:
    entries = []
    for kind, words in KINDS.items():
        run = rf" (?:{'|'.join(words)})(?: (?:nos?|numbers?))*((?: _*\d{{1,5}}(?:_+\d{{1,5}})*_*(?= ))+)"
        numbers = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(1)), lambda r: F.split(r, "[ _]+")))
        entries.append(F.struct(F.lit(kind).alias("key"), F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n != ""))).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def compare_premises(a: Column, b: Column) -> Column:
    """struct(conflict, agree, comparable, a, b, kinds_a, kinds_b) of two maps of premises numbers (JN-13)."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    shares = lambda k: F.arrays_overlap(F.element_at(a, k), F.element_at(b, k))
    all_of = lambda m: F.array_sort(F.array_distinct(F.flatten(F.map_values(m))))
    return F.struct(
        F.exists(common, lambda k: ~shares(k)).alias("conflict"),
        F.exists(common, shares).alias("agree"),
        ((F.size(common) > 0) | (F.size(F.map_keys(a)) == 0) | (F.size(F.map_keys(b)) == 0)).alias("comparable"),
        all_of(a).alias("a"),
        all_of(b).alias("b"),
        F.array_sort(F.map_keys(a)).alias("kinds_a"),
        F.array_sort(F.map_keys(b)).alias("kinds_b"),
    )


def place_overlap(a: Column, b: Column) -> Column:
    """Places in common; names of six letters may lie inside a longer one of the other side (JN-14)."""
    inside = lambda x, y: F.filter(x, lambda t: (F.length(t) >= 6) & F.exists(y, lambda o: (o != t) & F.contains(o, t)))
    return F.array_sort(F.array_distinct(F.concat(F.array_intersect(a, b), inside(a, b), inside(b, a))))


def licensed_note(bill: Column, licences: list[tuple[str, Column]]) -> Column:
    """The first licence whose premises corroborate the bill's: a shared number, or two shared places (JN-12)."""
    out = F.lit(None).cast("string")
    for label, address in reversed(licences):
        met = once(F.struct(addr_tokens(bill).alias("own"), addr_tokens(address).alias("other")), lambda s: F.arrays_overlap(s["own"]["premises"], s["other"]["premises"]) | (F.size(F.array_intersect(s["own"]["places"], s["other"]["places"])) >= 2))
        out = F.when(bill.isNotNull() & address.isNotNull() & F.coalesce(met, F.lit(False)), label).otherwise(out)
    return out


def bill_answer(registered: Column, bill: Column, bill_pin: Column, village: Column, licences: list[tuple[str, Column]] | None = None) -> Column:
    """struct(value, note): match, minor_discrepancy or not_match of a bill's and a registered address, and on what evidence (RES-11); never null."""
    some = lambda *c: F.concat_ws(" ", *c)
    read = F.struct(
        addr_tokens(registered).alias("reg"), addr_tokens(some(bill, village, bill_pin)).alias("own"), premises_ids(registered).alias("ids_a"), premises_ids(some(bill, village)).alias("ids_b"),
        registered.alias("registered"), bill.alias("bill"), bill_pin.alias("pin"), (licensed_note(some(bill, village), licences) if licences else F.lit(None).cast("string")).alias("licensed"),
    )
    compared = lambda s: once(F.struct(s.alias("s"), compare_premises(s["ids_a"], s["ids_b"]).alias("plots"), place_overlap(s["reg"]["places"], s["own"]["places"]).alias("places")), _bill)
    return once(read, compared)


def _bill(c: Column) -> Column:
    """The verdict on a bill, from its tokens beside the registered address's."""
    s, plots, places = c["s"], c["plots"], c["places"]
    reg, own, registered, bill, bill_pin = s["reg"], s["own"], s["registered"], s["bill"], s["pin"]
    pin_a, pin_b = F.get(reg["pins"], 0), F.coalesce(bill_pin, F.get(own["pins"], 0))
    same = (F.arrays_overlap(reg["premises"], own["premises"]) | plots["agree"]) & ~plots["conflict"]
    place = F.size(places) > 0
    agree, differ = F.coalesce(pin_a == pin_b, F.lit(False)), F.coalesce(pin_a != pin_b, F.lit(False))
    unread, alone = bill.isNull() & bill_pin.isNull(), registered.isNull()
    value = (
        F.when(alone | unread, "not_match")
        .when(plots["conflict"], "not_match")
        .when(same & place & ~differ, "match")
        .when(same | place | agree, "minor_discrepancy")
        .otherwise("not_match")
    )
    slashes = lambda a: F.array_join(F.transform(a, lambda t: F.replace(t, F.lit("_"), F.lit("/"))), ", ")
    shared = F.array_intersect(reg["premises"], own["premises"])
    pieces = F.flatten(F.transform(F.filter(shared, lambda t: t.contains("_")), lambda t: F.split(t, "_")))
    shared = F.array_except(shared, pieces)
    shared = F.when(F.size(shared) > 0, shared).otherwise(F.array_intersect(plots["a"], plots["b"]))
    said = F.concat_ws(
        "; ",
        F.when(plots["conflict"], F.concat(F.lit("DISCREPANCY: the bill is for premises "), slashes(plots["b"]), F.lit(", the registration for "), slashes(plots["a"]))).when(same, F.concat(F.lit("premises match: "), slashes(shared))),
        F.when(place, F.concat(F.lit("places match: "), F.array_join(places, ", "))),
        F.when(agree, F.concat(F.lit("PIN "), pin_a, F.lit(" matches"))),
        F.when(~plots["conflict"] & ~same & (place | agree), F.when(plots["comparable"], "the premises could not be matched").otherwise("the premises are numbered in different registers and cannot be compared")),
        F.when(~plots["conflict"] & same & ~place, "but the place is named differently"),
        F.when(~plots["conflict"] & ~same & ~place & agree, "only the PIN agrees; check the bill's text"),
        F.when(~plots["conflict"] & ~same & ~place & ~agree, "the two addresses share nothing"),
        F.when(differ, F.concat(F.lit("NOTE: the bill's PIN "), pin_b, F.lit(" differs from "), pin_a, F.when(same & place, ", which is never a full match").otherwise(""))),
    )
    licensed = F.when(bill.isNotNull() & (value == "not_match"), F.concat(F.lit("NOTE: the bill's premises are those of the vendor's "), s["licensed"]))
    note = F.when(unread, "no bill address could be read").when(alone, "no registered address to compare the bill with").otherwise(F.concat_ws("; ", said, licensed))
    return F.struct(value.alias("value"), note.alias("note"))


def bill_verdict(registered: Column, bill: Column, bill_pin: Column, village: Column) -> Column:
    return bill_answer(registered, bill, bill_pin, village)["value"]


def registration_note(registered: Column, other: Column) -> Column:
    """How two registrations' addresses compare (RES-14); null where there is nothing to say."""
    read = F.struct(addr_tokens(registered).alias("a"), addr_tokens(other).alias("b"), premises_ids(registered).alias("ids_a"), premises_ids(other).alias("ids_b"), (registered.isNull() | other.isNull()).alias("lacking"))
    compared = lambda s: F.struct(s.alias("s"), compare_premises(s["ids_a"], s["ids_b"]).alias("plots"), (F.size(place_overlap(s["a"]["places"], s["b"]["places"])) > 0).alias("near"))
    return once(read, lambda s: once(compared(s), _note))


def _note(c: Column) -> Column:
    """The note on two registrations, from their tokens."""
    a, b, plots, near = c["s"]["a"], c["s"]["b"], c["plots"], c["near"]
    return (
        F.when(c["s"]["lacking"], F.lit(None))
        .when(~plots["comparable"], "premises identifiers of different kinds cannot be compared")
        .when(plots["conflict"] & near, "WARNING: different premises in the same locality")
        .when(plots["conflict"], "WARNING: different premises in a different locality")
        .when((F.size(plots["a"]) > 0) & (F.size(plots["b"]) > 0), "same premises")
        .when(near & F.coalesce(F.get(a["pins"], 0) == F.get(b["pins"], 0), F.lit(False)), "locality and PIN agree")
        .when(~near, "WARNING: no locality text in common")
    )
