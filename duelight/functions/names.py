"""Name matching: whole tokens, suffix-free overlap, initials, and a character ratio."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelight.functions.text import normalize, once_each

# Words of organisation names that identify nobody.
STOP_WORDS = (
    "bank", "corp", "corporation", "ltd", "limited", "inc", "incorporated", "group", "holdings", "holding",
    "company", "co", "services", "industries", "industry", "state", "national", "trust", "financial", "finance",
    "the", "of", "and", "&", "ltd.", "inc.", "plc", "sa", "gmbh", "pvt", "private", "public", "enterprises",
    "international", "global",
)
# Suffixes that name_match leaves out.
NOISE = ("private", "pvt", "limited", "ltd", "llp", "co", "company", "ms", "m", "s", "messrs", "the")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def seq_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two strings (UDF-01); rows with a null never reach Python's matcher."""
    return _ratio(a, b)


#: What cleaned names consist of.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


def shared_letters(a: Column, b: Column) -> Column:
    """Letters of ALPHABET that two strings have in common, copies counted: no alignment matches more."""
    count = lambda c, letter: F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))
    return reduce(lambda x, y: x + y, [F.least(count(a, letter), count(b, letter)) for letter in ALPHABET])


@dataclass
class Question:
    """A verdict, null where it takes a ratio of `left` and `right` (null elsewhere) of at least `least`, or where nothing can be compared."""

    known: Column
    left: Column
    right: Column
    least: float


def _question(a: Column, b: Column, least: float, open_: Column, known: Column) -> Question:
    """Open only where the lengths, and then the letters in common, allow the ratio; equal strings need none."""

    def settle(s: Column) -> Column:
        x, y = s["a"], s["b"]
        need = least * (F.length(x) + F.length(y))
        can = F.when(~s["open"], False).when(2 * F.least(F.length(x), F.length(y)) < need, False).when(x == y, False).otherwise(2 * shared_letters(x, y) >= need)
        verdict = F.when(s["open"] & (x == y), True).otherwise(s["known"])
        return F.when(F.coalesce(can, F.lit(False)), F.struct(F.lit(None).cast("boolean").alias("known"), x.alias("left"), y.alias("right"))).otherwise(
            F.struct(verdict.alias("known"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))
        )

    # a lambda's argument is computed once, however often it is named
    found = F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), open_.alias("open"), known.alias("known"))), settle), 0)
    return Question(found["known"], found["left"], found["right"], least)


def decide(rows: DataFrame, out: str, question: Question) -> DataFrame:
    """rows with the verdict as `out`. Only rows whose verdict is open pass through Python; they are split off, so rows should be cheap to read twice."""
    marked = rows.withColumns({out: question.known, "_left": question.left, "_right": question.right})
    settled, open_ = marked.where("_left is null"), marked.where("_left is not null")
    open_ = open_.withColumn(out, seq_ratio(F.col("_left"), F.col("_right")) >= question.least)
    return settled.unionByName(open_).drop("_left", "_right")


def _answered(question: Question) -> Column:
    """The verdict as a column, for plans that cannot split their rows: all of them pass Python's matcher, settled ones as nulls."""
    return F.when(question.left.isNull(), question.known).otherwise(seq_ratio(question.left, question.right) >= question.least)


def _words(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def tokens(c: Column) -> Column:
    """All tokens of three letters or digits and more."""
    return _words(normalize(c), r"\b[a-zA-Z0-9]{3,}\b")


def significant(c: Column) -> Column:
    """Tokens without stop words, repeats kept."""
    return F.filter(tokens(c), lambda w: ~w.isin(*STOP_WORDS))


def token_match(entity: Column, target: Column) -> Column:
    """Whole-token match of an entity's name in a listed one (STR-03); asymmetric, false on nulls."""
    own, listed = significant(entity), F.array_distinct(tokens(target))
    hits = F.size(F.filter(own, lambda w: F.array_contains(listed, w)))
    several = (F.size(own) >= 2) & ((hits == F.size(own)) | (hits >= 2))
    single = (F.size(own) == 1) & (hits == 1) & (F.size(F.array_distinct(significant(target))) <= 3)
    named = (F.coalesce(entity, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "")
    return F.coalesce(named & ((normalize(entity) == normalize(target)) | several | single), F.lit(False))


def match_question(a: Column, b: Column) -> Question:
    """Same name by 60% of its tokens, else by a ratio of 0.85; null if a side has nothing to compare (STR-04)."""
    parts = lambda c: F.array_distinct(F.filter(_words(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), r"[^\s]+"), lambda w: ~w.isin(*NOISE)))
    sa, sb = parts(a), parts(b)
    share = F.size(F.array_intersect(sa, sb)) / F.greatest(F.size(sa), F.size(sb))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", ""), r"\s+", " "))
    some = (F.size(sa) > 0) & (F.size(sb) > 0)
    return _question(clean(a), clean(b), 0.85, F.coalesce(some & (share < 0.6), F.lit(False)), F.when(some, share >= 0.6))


def name_match(a: Column, b: Column) -> Column:
    return _answered(match_question(a, b))


def name_parts(c: Column) -> Column:
    """Distinct words of a name without firm prefix and corporate suffixes; "B.R." is two initials."""
    c = F.regexp_replace(F.lower(c), r"^\s*m\s*/?\s*s\.?\s+", "")
    c = F.regexp_replace(c, r"\b(private|pvt|limited|ltd|llp|co|company|and|&)\b\.?", " ")
    c = F.regexp_replace(F.replace(c, F.lit("."), F.lit(" ")), r"[^a-z0-9 ]", "")
    return F.array_distinct(_words(c, r"[^\s]+"))


def agree_question(a: Column, b: Column) -> Question:
    """Agreement of two names with initials standing for words (STR-05); null if a side is empty."""
    sa, sb = name_parts(a), name_parts(b)
    initial = lambda t: F.length(t) == 1
    # an initial stands for any longer word of the other side that begins with it
    begins = lambda x: F.transform(F.filter(x, lambda t: ~initial(t)), lambda t: F.left(t, F.lit(1)))
    met = lambda x, y: F.array_intersect(F.filter(x, initial), begins(y))
    lost = lambda x, y: F.size(F.array_except(F.array_except(F.filter(x, initial), begins(y)), y)) > 0
    shared = F.array_distinct(F.concat(F.array_intersect(sa, sb), met(sa, sb), met(sb, sa)))
    long = lambda x: F.array_sort(F.filter(x, lambda t: ~initial(t)))
    apart = (lost(sa, sb) | lost(sb, sa)) & (F.size(long(sa)) > 0) & (long(sa) == long(sb))
    full = F.size(F.filter(shared, lambda t: ~initial(t))) > 0
    agree = ((F.size(shared) >= 2) & full) | ((F.least(F.size(sa), F.size(sb)) == 1) & (F.size(shared) > 0))
    some = (F.size(sa) > 0) & (F.size(sb) > 0)
    text = lambda s: F.array_join(F.array_sort(s), " ")
    return _question(text(sa), text(sb), 0.8, F.coalesce(some & ~apart & ~agree, F.lit(False)), F.when(some, ~apart & agree))


def names_agree(a: Column, b: Column) -> Column:
    return _answered(agree_question(a, b))


def split_by(rows: DataFrame, out: str, question: Callable[[Column, Column], Question], a: str, b: str) -> DataFrame:
    """`decide` over the distinct pairs of two columns of rows."""
    return once_each(rows, [a, b], lambda pairs: decide(pairs, out, question(F.col(a), F.col(b))))
