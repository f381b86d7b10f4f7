"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, linear between knots.
Its integral is the source's weight in the mix; the schedule's cumulative demand,
inverted, gives the time at which each word of the source is due. Documents of a
source lie one after another in the order of a hash of their id, pass after pass,
until the source's target is met, and are range-sorted by the time of their first
word. The document on which the target falls is taken in part.

Prefix sums never put a source into one task: a source is cut into hash ranges of
about `bucket_rows` documents, ranges are summed, and only these sums are
accumulated per source.

Defined cases: null text or size counts 0 words; a null source is a source, ordered
last; a null id hashes as the empty text; repeated rows lie next to each other and
each counts; an empty table gives no rows; sources of size 0 have target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: (time, weight) knots; sources take them in turn. Integrals: 3, 1, 2.
CURRICULUM = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 2.0), (1.0, 2.0)))

Schedule = Sequence[tuple[float, float]]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def _segments(schedule: Schedule) -> Column:
    """array of (t0, w0, slope, cumulative weight before, and after)."""
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        after = done + (t1 - t0) * (w0 + w1) / 2
        out.append(F.struct(F.lit(t0).alias("t"), F.lit(w0).alias("w"), F.lit((w1 - w0) / (t1 - t0)).alias("slope"), F.lit(done).alias("done"), F.lit(after).alias("after")))
        done = after
    return F.array(*out)


def due(schedules: Sequence[Schedule], turn: Column, share: Column) -> Column:
    """The time at which the `share` (0..1) of a source's demand is reached: its schedule's integral, inverted."""
    total = F.element_at(F.array(*[F.lit(integral(s)) for s in schedules]), turn + 1)
    rows = F.element_at(F.array(*[_segments(s) for s in schedules]), turn + 1)
    part = F.get(F.filter(rows, lambda s: s["after"] >= share * total), 0)
    rest = share * total - part["done"]
    root = F.sqrt(F.greatest(part["w"] * part["w"] + 2 * part["slope"] * rest, F.lit(0.0)))
    return F.when(rest <= 0, part["t"]).otherwise(part["t"] + 2 * rest / (part["w"] + root))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source_rank, source, source_size, n, weight, target from (source, size) rows.

    Targets are weight * level, stopped at cap * size, where the level is the one
    that spends the whole budget: with sources in the order of cap * size / weight,
    the first that its own level does not fill.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("source_rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_rank") % len(weights) + 1))
    per = per.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    order = W.orderBy("full_at", "source_rank")
    per = (
        per.withColumn("total", F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("spent", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("own_level", (F.lit(float(share)) * F.col("total") - F.col("spent")) / F.col("open_weight"))
        .withColumn("level", F.max(F.when(F.col("own_level") <= F.col("full_at"), F.col("own_level"))).over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    target = F.when(F.col("level").isNull() | (F.col("full_at") < F.col("level")), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source_rank", "source", "source_size", "n", target.alias("target"))


def layout(docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, share: float = 1.5, cap: float = 2.0, bucket_rows: int = 5_000, sizes: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, source, size and whatever else) with source_size, target, before, turn.

    `before` counts the words of the source that lie ahead of the document in one
    pass. `sizes` may give (source, size) more cheaply than `docs`.
    """
    own = [c for c in docs.columns]
    weights = [integral(s) for s in schedules]
    src = targets((docs if sizes is None else sizes).select("source", "size"), weights, share, cap)
    src = src.select(F.col("source").alias("_source"), F.col("source_rank").alias("_rank"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.ceil(F.col("n") / bucket_rows).alias("_buckets"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumn("_key", key).join(src, docs["source"].eqNullSafe(src["_source"]))
    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rows = rows.withColumn("_bucket", F.floor(at * F.col("_buckets")))
    sums = rows.groupBy("_rank", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(W.partitionBy("_rank").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_rank", "_bucket", ahead.alias("_ahead"))
    here = W.partitionBy("_rank", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(here), F.lit(0))
    return rows.withColumn("_before", before).join(sums, ["_rank", "_bucket"]).select(
        *own,
        F.col("_source_size").cast("long").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_ahead") + F.col("_before")).cast("long").alias("before"),
        (F.col("_rank") % len(schedules)).alias("turn"),
    )


def taken_in_pass(number: Column) -> Column:
    """Words of a laid-out document that the given pass (from 0) takes."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - number * F.col("source_size") - F.col("before"))).cast("long")


def position(schedules: Sequence[Schedule], number: Column) -> Column:
    """Training time of a laid-out document's first word in the given pass."""
    reached = (number * F.col("source_size") + F.col("before")).cast("double") / F.floor("target").cast("double")
    return due(schedules, F.col("turn"), reached)


def mix(docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, share: float = 1.5, cap: float = 2.0, **options) -> DataFrame:
    """One row per document: its words, its source's words and target, what the mix takes, and when it first does; in training order."""
    rows = layout(docs.select("doc_id", "source", "size"), schedules, share, cap, **options)
    passes = [taken_in_pass(F.lit(k)) for k in range(int(-(-cap // 1)))]
    taken = sum(passes[1:], passes[0])
    first = F.when(passes[0] > 0, position(schedules, F.lit(0)))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), first.alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def stream(docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, share: float = 1.5, cap: float = 2.0, **options) -> DataFrame:
    """The mix itself: a row per document and pass that takes words of it: the document as struct `row`, `words` taken and `position`; not yet sorted."""
    rows = layout(docs.select("doc_id", "source", "size", F.struct(*docs.columns).alias("row")), schedules, share, cap, **options)
    rows = rows.withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1))))
    rows = rows.withColumn("words", taken_in_pass(F.col("pass_no"))).where(F.col("words") > 0)
    return rows.select("row", "pass_no", "words", position(schedules, F.col("pass_no")).alias("position"))


def first_words(text: Column, number: Column) -> Column:
    """The text up to its number-th word, white space as it is."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.array_join(F.slice(parts, F.lit(1), (number + lead).cast("int")), "")
