"""Quality rules with thresholds that adapt to each language and source.

Counts of every whole text give ratios: characters a word, and the shares of symbols,
repeated lines and repeated words. Mergeable quantile sketches (percentile_approx) of
each ratio are taken per language and source, per language, and over all. A group's
quantiles shrink towards those of its language by the weight n / (n + PRIOR), and a
language's towards those of all. A document fails when a ratio lies beyond its group's
fence.

Word length, as a logarithm, is fenced on both sides: the outer quartile plus STEPS times
its distance to the median, which counts as LEAST_WIDTH at least, so that a group whose
texts are alike keeps some room. A share is mostly zero, so its fence rises for two
reasons: what a quarter of the group does is its habit (the same steps from the upper
quartile, zero where that is zero), and its tail (TAIL times the 95% quantile) counts
within a hard range of the rule, so that the junk of a group can neither raise it without
bound nor a group without any lose its first such document. On the supplied tables few
groups have a tail of repeated lines or words, so these two fences mostly lie at the lower
end of their range. No label enters.

The thresholds are joined back by group. Defined cases: a null text has no words and
fails the base rule, as every text of under 50 words does; null languages and sources
are groups; documents that fail the base rule don't shape thresholds; a ratio on its
fence is kept; texts of any length are counted whole; repeated rows count each and get
the same verdict; other columns, whatever their names, are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelight.llm.tables import materialise
from duelight.llm.textstats import rule_counts

LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
PRIOR, ACCURACY, STEPS, LEAST_WIDTH, TAIL = 100, 10_000, 5, 0.05, 4
QUANTILES = (0.25, 0.5, 0.75, 0.95)
#: A ratio this close to its fence is on it (rounding).
ON = 1e-9

#: name -> (part, whole)
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Range of what a tail may allow.
RANGES = {"symbols": (0.1, 0.3), "dup_lines": (0.35, 0.7), "repeats": (0.3, 0.45)}


def _ratio(name: str) -> Column:
    part, of = RATIOS[name]
    ratio = F.try_divide(F.col(part).cast("double"), F.col(of))
    return ratio if name in RANGES else F.log(ratio)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of the text, base_failed and the ratios."""
    rows = docs.select("doc_id", "lang", "source", rule_counts("text").alias("c")).select("doc_id", "lang", "source", "c.*")
    rows = rows.withColumn("base_failed", base_failed())
    return rows.select("*", *[_ratio(n).alias(f"r_{n}") for n in RATIOS])


def _shrunk(n: str, own: str, wide: list[Column]) -> list[Column]:
    """Quantiles of a group, drawn to those of the wider one by its size."""
    return [(F.col(n) * F.col(own)[k] + PRIOR * wide[k]) / (F.col(n) + PRIOR) for k in range(len(QUANTILES))]


def thresholds(rows: DataFrame) -> DataFrame:
    """_lang, _source, and the fences of each ratio: most_<name>, and least_<name> where it is checked below."""
    sound = rows.where(~F.col("base_failed"))
    sketch = [F.percentile_approx(f"r_{n}", list(QUANTILES), ACCURACY).alias(f"q_{n}") for n in RATIOS]
    levels = materialise(sound.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *sketch), "op6-sketches")
    whole = levels.where("level = 3").first()
    small = levels.where("level = 0")
    wide = levels.where("level = 1").select(F.col("lang").alias("_lang"), F.col("n").alias("lang_n"), *[F.col(f"q_{n}").alias(f"lang_{n}") for n in RATIOS])
    both = small.join(wide, small["lang"].eqNullSafe(wide["_lang"]))
    out = []
    for name in RATIOS:
        every = [F.lit(q) for q in (whole[f"q_{name}"] if whole and whole["n"] else (None,) * len(QUANTILES))]
        low, mid, high, tail = _shrunk("n", f"q_{name}", _shrunk("lang_n", f"lang_{name}", every))
        if name in RANGES:
            habit = F.when(high > 0, high + STEPS * (high - mid)).otherwise(0.0)
            least, most = RANGES[name]
            out.append((F.greatest(habit, F.least(F.greatest(TAIL * tail, F.lit(least)), F.lit(most))) + ON).alias(f"most_{name}"))
        else:
            width = lambda d: STEPS * F.greatest(d, F.lit(LEAST_WIDTH))
            out += [(high + width(high - mid) + ON).alias(f"most_{name}"), (low - width(mid - low) - ON).alias(f"least_{name}")]
    return both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *out)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept, and the first rule that failed (null if kept).

    The fences are joined by group; one that holds a third of all documents is split
    by the adaptive join, as nothing after it needs the group together.
    """
    rows = materialise(counts(docs), "op6-counts")
    fence = thresholds(rows)
    met = rows.join(fence, rows["lang"].eqNullSafe(fence["_lang"]) & rows["source"].eqNullSafe(fence["_source"]), "left")
    reason = F.when(F.col("n_words") < LEAST_WORDS, "few_words").when(F.col("base_failed"), "repetition")
    for name in RATIOS:
        outside = F.col(f"r_{name}") > F.col(f"most_{name}")
        reason = reason.when(outside if name in RANGES else outside | (F.col(f"r_{name}") < F.col(f"least_{name}")), name)
    met = met.withColumn("failed_rule", reason)
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule")
