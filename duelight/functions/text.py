"""Column functions on strings: names, identifiers, dates, numbers, JSON paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier patterns.
GSTIN = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
UDYAM = r"UDYAM-[A-Z]{2}-\d{2}-\d{7}"
MOBILE = r"\b[6-9]\d{9}\b"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
CIN = r"\b[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b"
IDENTIFIERS = {"gstin": GSTIN, "pan": PAN, "ifsc": IFSC, "udyam": UDYAM, "mobile": MOBILE, "email": EMAIL, "cin": CIN}

# State by the first two digits of a GSTIN.
STATES = {
    "01": "Jammu & Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand",
    "06": "Haryana", "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim",
    "12": "Arunachal Pradesh", "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura",
    "17": "Meghalaya", "18": "Assam", "19": "West Bengal", "20": "Jharkhand", "21": "Odisha",
    "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat", "27": "Maharashtra", "29": "Karnataka",
    "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry", "36": "Telangana", "37": "Andhra Pradesh",
}
# Bank by the first four letters of a branch code.
BANKS = {
    "SBIN": "State Bank of India", "ICIC": "ICICI Bank", "HDFC": "HDFC Bank", "KKBK": "Kotak Mahindra Bank",
    "PUNB": "Punjab National Bank", "CNRB": "Canara Bank", "UBIN": "Union Bank of India", "INDB": "IndusInd Bank",
    "KVBL": "Karur Vysya Bank", "BARB": "Bank of Baroda", "IOBA": "Indian Overseas Bank", "IDIB": "Indian Bank",
    "UTIB": "Axis Bank", "YESB": "Yes Bank", "BKID": "Bank of India", "CBIN": "Central Bank of India",
}
# Keywords of seller types in order of precedence.
SELLER_TYPES = (
    ("manufacturer", ("manufactur", "factory", "production", "fabricat", "mill", "plant")),
    ("processor", ("process", "recycl", "shredding", "granulat", "washing")),
    ("trader", ("trad", "wholesale", "retail", "dealer", "supplier", "merchant", "distributor")),
)
# Words for numbers, as spelt on certificates (one misspelling is common).
NUMBERS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
}
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8,
    "ninth": 9, "nineth": 9, "tenth": 10, "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14,
    "fifteenth": 15, "sixteenth": 16, "seventeenth": 17, "eighteenth": 18, "nineteenth": 19, "twentieth": 20,
    "thirtieth": 30,
}
# Titles before persons' names.
HONORIFICS = ("shri", "smt", "sri", "kumari", "km", "dr", "mr", "mrs", "ms", "prof", "adv", "late", "thiru", "shrimati", "sardar", "haji")
# Phrases of tribunal parties that identify nobody, as patterns.
PARTY_BOILERPLATE = (
    "messrs", r"m\s*/?\s*s", r"and\s+others", r"&\s*others", "anr", "ors", "others", r"through\s+its\s+\w+", "proprietor",
    "proprietrix", "partner", "partners", "director", "directors", r"represented\s+by",
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row, however often `then` names it, as a lambda's argument is."""
    return F.get(F.transform(F.array(value), then), 0)


def once_each(rows: DataFrame, columns: list[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that judge(keys) adds; keys are the distinct values of `columns`, nulls too, so equal rows are judged once.

    Keys are dealt out by their own shuffle, however few tasks read the rows.
    """
    keys = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    # what refers to the count is computed on keys: a filter on it can't move below the grouping
    answers = judge(keys.select(*[F.when(F.col("_n") > 0, F.col(c)).alias(c) for c in columns]))
    named = answers.withColumnsRenamed({c: f"_key_{i}" for i, c in enumerate(columns)})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(columns)])
    return rows.join(named, same, "left").drop(*[f"_key_{i}" for i in range(len(columns))])


def lookup(key: Column, table: dict) -> Column:
    """The table's value for a key, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, trimmed; null without a match."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# ---- STR
def normalize(c: Column) -> Column:
    return squeeze(F.lower(c))


def strip_honorifics(c: Column) -> Column:
    """A name in lower case without titles, wherever they stand (STR-02)."""
    return F.array_join(F.filter(F.split(normalize(c), " "), lambda w: ~F.regexp_replace(w, r"^\.+|\.+$", "").isin(*HONORIFICS)), " ")


def clean_party(c: Column) -> Column:
    """A tribunal party without the phrases of its cause title (STR-02)."""
    return squeeze(F.regexp_replace(c, rf"(?i)\b({'|'.join(PARTY_BOILERPLATE)})\b", " "))


def garbled_id(text: Column, ident: Column) -> Column:
    """Does a token of 9 to 12 characters look like the id misread (same first three letters, at most four edits)?"""
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+"), F.lit(0))
    near = lambda t: F.length(t).between(9, 12) & (F.upper(F.left(t, F.lit(3))) == F.left(ident, F.lit(3))) & (F.levenshtein(F.upper(t), ident) <= 4)
    return F.exists(tokens, near)


def fix_ifsc(c: Column) -> Column:
    """A branch code, its fifth character read as zero."""
    flat = F.replace(F.upper(c), F.lit(" "), F.lit(""))
    repaired = F.regexp_replace(extract(flat, r"\b([A-Z]{4}[O0][A-Z0-9]{6})\b"), r"^(.{4}).", "$10")
    return F.coalesce(extract(flat, f"({IFSC})"), repaired)


def bank_from_ifsc(c: Column) -> Column:
    return lookup(F.left(c, F.lit(4)), BANKS)


def state_from_gstin(c: Column) -> Column:
    return lookup(F.left(c, F.lit(2)), STATES)


def pan_from_gstin(c: Column) -> Column:
    return F.when(F.length(c) >= 12, F.substring(c, 3, 10))


def pan_category(c: Column) -> Column:
    """The holder's kind by the fourth letter."""
    return lookup(F.substring(c, 4, 1), {"C": "company", "F": "firm", "P": "individual", "H": "huf", "A": "aop", "B": "boi", "G": "govt", "J": "juridical", "L": "local_authority", "T": "trust"})


def any_of(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def seller_type_kw(c: Column) -> Column:
    low, out = F.lower(c), None
    for kind, words in SELLER_TYPES:
        out = F.when(any_of(low, words), kind) if out is None else out.when(any_of(low, words), kind)
    return out


def seller_type_nic(c: Column) -> Column:
    """Seller type by the industry division of a NIC code."""
    division = F.left(c, F.lit(2)).try_cast("int")
    return F.when(division.between(10, 33), "manufacturer").when(division.between(36, 39), "processor").when(division.between(45, 47), "trader")


def constitution(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(any_of(low, ("llp", "limited liability partnership")), "llp")
        .when(any_of(low, ("private", "public", "listed")), "pvt_public_listed")
        .when(any_of(low, ("partnership", "proprietor", "huf")), "partnership_proprietorship")
    )


def status_class(c: Column) -> Column:
    """Registration status: active, cancelled, ambiguous or unknown (PRJ-13)."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(low == "active", "active")
        .when(any_of(low, ("cancel", "suo motu", "suo-motu", "suomotu")), "cancelled")
        .when(any_of(low, ("inactive", "suspend", "provisional", "surrender", "migrat")), "ambiguous")
        .otherwise("unknown")
    )


def sentences(c: Column) -> Column:
    """Sentences; a stop after an abbreviation or inside a number doesn't end one."""
    return F.filter(F.split(squeeze(c), r"(?<!\b(?:No|Sr|Dr|Mr|Ms|St|Sy|Co|Ltd|Pvt|Rs)\.)(?<=[.!?;])\s+(?=[A-Z0-9(])"), lambda s: s != "")


def headline(c: Column, limit: int = 260, marker: str = "WARNING|CONFLICT|DISCREPANCY|GAP") -> Column:
    """The sentence with a marker, else the first, cut to the limit."""
    parts = sentences(c)
    best = F.coalesce(F.get(F.filter(parts, lambda s: s.rlike(marker)), 0), F.get(parts, 0))
    return F.when(F.length(best) > limit, F.concat(F.left(best, F.lit(limit - 3)), F.lit("..."))).otherwise(best)


def location(c: Column) -> Column:
    """"City, State" of a labelled address, else its last comma parts without the PIN (STR-13)."""
    stop = r"(?=\s+(?:Flat|Name|Village|Block|Road|City|State|District|PIN|Pin)\b|,|$)"
    city = F.coalesce(extract(c, rf"(?i)\bcity(?:/town/village)?\s*:\s*(.+?){stop}"), extract(c, rf"(?i)\bdistrict\s*:\s*(.+?){stop}"))
    state = extract(c, rf"(?i)\bstate\s*:\s*(.+?){stop}")
    plain = F.filter(F.transform(F.split(F.regexp_replace(c, r"\b\d{6}\b|\bIndia\b", ""), ","), lambda x: F.trim(x)), lambda p: (p != "") & ~p.rlike(r"\d"))
    tail = F.array_join(F.slice(plain, F.greatest(F.size(plain) - 1, F.lit(1)), F.lit(2)), ", ")
    return F.initcap(F.coalesce(F.concat_ws(", ", city, state).substr(F.when(city.isNotNull() | state.isNotNull(), 1), F.length(c)), F.nullif(tail, F.lit(""))))


def display_address(c: Column) -> Column:
    """An address without field labels, blanks and repeats (STR-14)."""
    label = r"(?i)(?:flat/door/block no\.?|name of premises/ ?building|road/street(?:/lane)?|city/town/village|village/town|building no\.?/flat no\.?|block|city|district|state|pin code|pin)\s*:"
    parts = F.transform(F.split(c, label), lambda p: F.trim(F.regexp_replace(p, r"[\s,]+$", "")))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: (p != "") & (p != "-"))), ", ")


def clean_bank(c: Column) -> Column:
    return F.initcap(squeeze(F.regexp_replace(c, r"(?i)\b(ltd|limited|pvt|private)\b\.?", "")))


def escape_html(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def plain_text(c: Column) -> Column:
    """Text of HTML: tags out, entities back."""
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for safe, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return squeeze(c)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def split_flag(c: Column, limit: int = 48) -> Column:
    """struct(head, detail) of "head: detail" with a short head; else the whole as detail."""
    head = extract(c, rf"^([^:]{{1,{limit}}}):\s")
    return F.struct(head.alias("head"), F.when(head.isNotNull(), F.trim(F.substring_index(c, ":", -1).substr(F.lit(1), F.length(c)))).otherwise(c).alias("detail"))


def fmt_value(c: Column) -> Column:
    """A number without needless zeros, else the text."""
    number = c.cast("string").try_cast("double")
    return F.when(number.isNotNull() & (number == F.floor(number)), F.floor(number).cast("string")).otherwise(c.cast("string"))


def parse_override(c: Column) -> Column:
    """Non-empty items of a ";" list."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def parse_pairs(c: Column) -> Column:
    """array<struct(code, description)> of a ";" list of "code - description" (STR-18); a description may be empty."""
    part = lambda x, n: F.coalesce(F.trim(F.get(F.split(x, " - ", 2), n)), F.lit(""))
    return F.transform(parse_override(c), lambda x: F.struct(part(x, 0).alias("code"), part(x, 1).alias("description")))


def split_code(c: Column) -> Column:
    """struct(code, description) of "code - description" (JSN-04)."""
    return F.struct(extract(c, r"^\s*(\d+)\s*-").alias("code"), extract(c, r"^\s*\d+\s*-\s*(.+)$").alias("description"))


# ---- DAT
def any_date(c: Column) -> Column:
    return F.coalesce(F.try_to_date(c, "dd/MM/yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def years_since(c: Column, as_of: Column) -> Column:
    return F.round(F.date_diff(as_of, any_date(c)) / 365.25, 2)


def period_start(month: Column, financial_year: Column) -> Column:
    """First day of a month of an April-to-March year "2026-2027"; null for other periods."""
    number = lookup(month, {m: i + 1 for i, m in enumerate(MONTHS)})
    first = extract(financial_year, r"^\s*(\d{4})").try_cast("int")
    return F.make_date(first + F.when(number >= 4, 0).otherwise(1), number, F.lit(1))


def due_date(period: Column, return_type: Column) -> Column:
    """20th of the next month for GSTR3B, else the 11th."""
    return F.date_add(F.add_months(period, 1), F.when(return_type == "GSTR3B", 19).otherwise(10))


def in_window(period: Column, as_of: Column, months: int = 12) -> Column:
    return period >= F.date_sub(as_of, months * 31)


def whole_months(since: Column, as_of: Column) -> Column:
    return 12 * (F.year(as_of) - F.year(since)) + F.month(as_of) - F.month(since) - (F.day(as_of) < F.day(since)).cast("int")


def vintage_phrase(c: Column, as_of: Column) -> Column:
    months = whole_months(any_date(c), as_of)
    return F.when(months >= 0, F.format_string("~%d years %d months", F.floor(months / 12).cast("int"), F.pmod(months, F.lit(12)).cast("int")))


def spelt_date(c: Column) -> Column:
    """"TWENTY NINTH day of NOVEMBER TWO THOUSAND TWENTY THREE" as dd/MM/yyyy, null out of range (DAT-06)."""
    pattern = r"(?i)([A-Za-z]+(?:[\s-]+[A-Za-z]+)?)\s+day\s+of\s+([A-Za-z]+)\s+((?:[A-Za-z]+\s+){1,6}[A-Za-z]+)"
    words = lambda g: F.split(F.lower(extract(c, pattern, g)), r"[\s-]+")
    value = lambda w, t: F.coalesce(lookup(w, t), F.lit(0))
    day = F.aggregate(words(1), F.lit(0), lambda a, w: a + value(w, NUMBERS | ORDINALS))
    month = lookup(F.initcap(extract(c, pattern, 2)), {m: i + 1 for i, m in enumerate(MONTHS)})
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"))

    def step(a, w):
        n = value(w, NUMBERS)
        scaled = F.greatest(a["now"], F.lit(1)) * n
        return (
            F.when(n == 1000, F.struct((a["total"] + scaled).alias("total"), F.lit(0).alias("now")))
            .when(n == 100, F.struct(a["total"].alias("total"), scaled.alias("now")))
            .otherwise(F.struct(a["total"].alias("total"), (a["now"] + n).alias("now")))
        )

    year = F.aggregate(words(3), start, step, lambda a: a["total"] + a["now"])
    good = day.between(1, 31) & month.isNotNull() & year.between(1900, 2100)
    return F.when(good, F.format_string("%02d/%02d/%d", day, month, year))


def to_dmy(c: Column) -> Column:
    return F.date_format(any_date(c), "dd/MM/yyyy")


# ---- MTH, JSN, ARR
def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs of x0, y0, x1, y1)."""
    zero = F.lit(0.0)
    inner = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), zero) * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), zero)
    area = lambda s: (s["x1"] - s["x0"]) * (s["y1"] - s["y0"])
    union = area(a) + area(b) - inner
    return F.when(union > 0, inner / union).otherwise(0.0)


def score_value(c: Column) -> Column:
    return F.coalesce(F.rtrim(c, F.lit("%")).try_cast("double"), F.lit(-1.0))


def json_path(path: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))


def dig(v: Column, path: str, kind: str = "string") -> Column:
    """A dotted path into a VARIANT; numbers index arrays."""
    return F.try_variant_get(v, json_path(path), kind)


def first_of(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(dig(v, p), F.lit("")) for p in paths])


def find_key(rows: DataFrame, doc: str, key: str, out: str, levels: int = 8) -> DataFrame:
    """rows with `out`: the value (VARIANT) of a key anywhere in the VARIANT column `doc` (JSN-03).

    A container's own value goes before those inside it, earlier parts before later
    ones; a VARIANT keeps the fields of an object in order of their names. JSON nulls
    don't count as found. Containers up to `levels` deep are opened, one
    `variant_explode` each, without a shuffle; only the choice at the end groups.
    `rows` gets a column _row meanwhile, so that repeated rows stay apart.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    spark = rows.sparkSession
    level = numbered.select("_row", F.array().cast("array<int>").alias("_at"), F.col(doc).alias("_v"))
    steps = F.lit(f"$['{key}']")
    found = None
    for depth in range(levels):
        kind = F.schema_of_variant("_v")
        mine = F.when(kind.startswith("OBJECT"), F.try_variant_get("_v", steps, "variant"))
        hit = level.select("_row", "_at", mine.alias("_hit")).where(F.col("_hit").isNotNull() & ~F.is_variant_null("_hit"))
        found = hit if found is None else found.unionByName(hit)
        inner = level.where(kind.rlike("^(OBJECT|ARRAY)"))
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        level = parts.select("_row", F.concat("_at", F.array("pos")).alias("_at"), F.col("value").alias("_v"))
    first = found.groupBy("_row").agg(F.min_by("_hit", "_at").alias(out))
    return numbered.join(first, "_row", "left").drop("_row")


def hsn_rows(goods: Column, services: Column) -> Column:
    """Codes of goods then services, without empty ones (arrays of struct(code, description))."""
    none = F.array().cast("array<struct<code:string,description:string>>")
    return F.filter(F.concat(F.coalesce(goods, none), F.coalesce(services, none)), lambda r: F.coalesce(F.trim(r["code"]), F.lit("")) != "")
