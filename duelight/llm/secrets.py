"""Secret scans through a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: a set
of clauses, each a set of trigrams that a match must hold (in lower case) if it
takes that alternative. The index keeps postings of just the trigrams that some
query names, one row per trigram and document. A rule's candidates are the
documents in the intersection of a clause's postings; only they are verified with
the rule's expression. A rule without mandatory trigrams scans every document. Documents
whose own trigrams satisfy no clause are known in the scan to be in no intersection:
they send no postings, and their texts are not dealt out to meet candidates.

Spans count code points, end exclusive, and are leftmost and non-overlapping per
kind. Positions come from the lengths of the matches and of the texts between them;
so an expression runs over a candidate three times (once less where the whole match
is measured), and over others once where its rule has no mandatory trigrams. Lengths
are summed in chunks, so time grows with matches times the root of their number.

Defined cases: a null text is empty and has no spans; texts of any length are scanned
whole; spans of one place come in the order of the rules; repeated rows and ids are
each scanned (the index may only add candidates, and null ids are one id for it);
extra columns, whatever their names, are carried by `redact` and ignored by `scan`; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sre = re._parser  # the standard library's parse tree of a pattern


@dataclass(frozen=True)
class Rule:
    """One kind of secret. `group` is measured against `least`; a shorter match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: What lies between the header of a key and its END line; or, without one, headers and base64 lines, the last of which may be short.
PEM_BODY = r"[^-]*+(?:-(?!----)[^-]*+)*+"
PEM_LINES = r"(?:\s*+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{40,}+={0,2})++(?:(?:\s|\\[nr])++[A-Za-z0-9+/]++={0,2}(?=\s|$))?)?"

#: The base rules of the contract, then well-known public token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----(?:" + PEM_BODY + r"-----END \1PRIVATE KEY-----|" + PEM_LINES + ")"),
)
MOST_STRINGS, MOST_CLAUSES = 16, 64

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])


def _and(a: Clauses, b: Clauses) -> Clauses:
    out = frozenset(x | y for x in a for y in b)
    return out if len(out) <= MOST_CLAUSES else a


def _of_strings(strings: set[str]) -> Clauses:
    """A match holds one of these strings."""
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(tree) -> tuple[set[str] | None, Clauses]:
    """Of a parsed sequence: all strings it matches, if few; the clauses a match satisfies."""
    exact: set[str] | None = {""}
    run, clauses = {""}, ANY
    for op, arg in tree:
        name, strings, own = str(op), None, ANY
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "SUBPATTERN":
            strings, own = _walk(arg[3])
        elif name == "BRANCH":
            parts = [_walk(b) for b in arg[1]]
            own = frozenset(c for s, q in parts for c in (_of_strings(s) if s is not None else q))
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            inner, _ = _walk(arg[2])
            strings = None if inner is None else inner | {""}
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            inner, own = _walk(arg[2])
            own = _of_strings(inner) if inner is not None else own
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            strings = {chr(v).lower() for _, v in arg}
        joined = None if strings is None else {a + b for a in run for b in strings}
        if joined is not None and len(joined) <= MOST_STRINGS:
            run = joined
        else:
            exact = None
            clauses = _and(_and(clauses, _of_strings(run)), own)
            run = {""} if joined is None else set(strings)
    return (run if exact is not None else None), _and(clauses, _of_strings(run))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of mandatory trigrams, or None where some alternative has none."""
    exact, clauses = _walk(sre.parse(pattern))
    if exact is not None:
        clauses = _of_strings(exact)
    least = [c for c in clauses if not any(d < c for d in clauses)]
    return None if any(not c for c in least) else sorted(least, key=sorted)


def _held(trigrams: list[str]) -> Column:
    """Which of the given trigrams a text holds."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    low = F.array(F.lower(F.coalesce("text", F.lit(""))))
    return F.flatten(F.transform(low, lambda t: F.filter(wanted, lambda g: F.contains(t, g))))


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams."""
    return docs.select("doc_id", F.explode(_held(trigrams)).alias("trigram"))


def hopeful(queries: dict[str, list[frozenset[str]]], trigrams: list[str]) -> Column:
    """Does a text hold all trigrams of some clause? Others are in no intersection of postings, so neither they nor their postings are dealt out."""
    clauses = {c for cs in queries.values() for c in cs}
    least = sorted((sorted(c) for c in clauses if not any(d < c for d in clauses)), key=lambda c: (len(c), c))
    every = lambda h: reduce(lambda x, y: x | y, [F.size(F.array_except(F.array(*[F.lit(t) for t in c]), h)) == 0 for c in least])
    return F.get(F.transform(F.array(_held(trigrams)), every), 0)


CLAUSES = (("kind", "string"), ("clause", "int"), ("trigram", "string"), ("bit", "long"), ("every", "long"))


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id, kinds: for which rules a document is in the intersection of some clause's postings."""
    spark = postings.sparkSession
    rows = [(kind, n, t, 1 << bit, (1 << len(c)) - 1) for kind, cs in queries.items() for n, c in enumerate(cs) for bit, t in enumerate(sorted(c))]
    if any(r[4] >= 1 << 62 for r in rows):
        raise ValueError("a clause names over 62 trigrams")
    one = lambda r: F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r, CLAUSES)])
    clauses = spark.range(1).select(F.inline(F.array(*map(one, rows))))  # createDataFrame would start Python workers on the executors
    held = postings.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "kind", "clause", "every").agg(F.bit_or("bit").alias("bits"))
    return held.where("bits = every").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


#: Matches of a text that are placed together.
CHUNK = 128


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in a text."""
    pattern = F.lit(rule.pattern)
    lengths = lambda strings: F.transform(strings, F.length)
    columns = [lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("long")]
    if rule.group:
        columns.append(lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("measure"))

    def step(acc, x):
        here = acc["at"] + x["gap"]
        span = F.struct(here.alias("start"), F.lit(rank).alias("rank"), (here + x["long"]).alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(x["measure" if rule.group else "long"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        # the text after the last match has no match of its own
        return F.when(x["long"].isNull(), acc).otherwise(F.struct((here + x["long"]).alias("at"), kept.alias("out")))

    def place(done, chunk):
        last = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0))
        return F.concat(done, F.array(F.aggregate(chunk, F.struct(last.alias("at"), F.array().cast(SPAN).alias("out")), step)))

    def placed(rows):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda k: F.slice(rows, k * CHUNK + 1, F.lit(CHUNK)))
        return F.flatten(F.transform(F.aggregate(chunks, F.array().cast(f"array<struct<at:int,out:{SPAN}>>"), place), lambda c: c["out"]))

    # a lambda's argument is computed once, however often it is named
    return F.get(F.transform(F.array(F.arrays_zip(*columns)), placed), 0)


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text, and others not named spans) with `spans`: all verified spans by start, then rule order."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    own, text, none = docs.columns, F.coalesce("text", F.lit("")), F.array().cast(SPAN)

    def scanned(rows: DataFrame, may: bool) -> DataFrame:
        parts = []
        for rank, rule in enumerate(rules):
            if rule.kind not in indexed:
                scan = text.rlike(rule.pattern)
            elif may:
                scan = F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False))
            else:
                continue
            parts.append(F.when(scan, _spans(text, rule, rank)).otherwise(none))
        return rows.select(*own, F.array_sort(F.concat(none, *parts)).alias("spans"))

    if not indexed:
        return scanned(docs, False)
    trigrams = sorted({t for q in indexed.values() for c in q for t in c})
    hope = hopeful(indexed, trigrams)
    rest = docs.where(hope)
    may = candidates(index(rest, trigrams), indexed).select(F.col("doc_id").alias("_id"), F.col("kinds").alias("_kinds"))
    met = rest.join(may, rest["doc_id"].eqNullSafe(may["_id"]), "left")
    return scanned(met, True).union(scanned(docs.where(~hope), False))


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, count of each base kind, digest of the base spans, and all spans as text."""
    found = with_spans(docs.select("doc_id", "text"), rules)
    base = [k for k, r in enumerate(rules) if r.base]
    of_rank = lambda k: F.filter("spans", lambda s: s["rank"] == k)
    count = [F.size(of_rank(k)).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    own = F.filter("spans", lambda s: s["rank"].isin(base))
    return found.select("doc_id", *count, F.sha2(render(own).cast("binary"), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """docs with every span of the text replaced by a mask (overlapping spans by one)."""
    own = docs.columns
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        clear = F.col("text").substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return (
            F.when(s["end"] <= acc["at"], acc)
            .when(s["start"] < acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out")))
            .otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], clear, F.lit(mask)).alias("out")))
        )

    rest = [c for c in own if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("rest"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("text")
    columns = {"doc_id": F.col("doc_id"), "text": text}
    return with_spans(packed, rules).select(*[columns[c] if c in columns else F.col(f"rest.`{c}`").alias(c) for c in own])
