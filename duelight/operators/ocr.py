"""Tokens of scanned pages: pass statistics, rotation, merging of passes, reading order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelight.functions.text import iou
from duelight.sources.shared import write_once

LEAST_CONFIDENCE, SURE_CHARS, SURE_CONFIDENCE, SAME_BOX = 0.4, 120, 0.6, 0.5
ANGLES = (0, 180, 90, 270)
#: Tokens of a page up to which all its pairs are compared.
FEW_TOKENS = 64


def pass_stats(tokens: DataFrame) -> DataFrame:
    """Kept characters, length-weighted confidence and whether a pass is confident (AGG-14)."""
    n = F.length("text")
    per = tokens.where(F.col("conf") >= LEAST_CONFIDENCE).groupBy("doc_id", "page", "angle").agg(F.sum(n).alias("chars"), (F.sum(n * F.col("conf")) / F.sum(n)).alias("mean_conf"))
    return per.withColumn("confident", (F.col("chars") >= SURE_CHARS) & (F.col("mean_conf") >= SURE_CONFIDENCE))


def best_rotation(stats: DataFrame) -> DataFrame:
    """The angle with most characters among those tried up to the first confident one (WIN-04)."""
    place = F.array_position(F.array(*[F.lit(a) for a in ANGLES]), F.col("angle"))
    rows = stats.withColumn("place", place)
    stop = rows.groupBy("doc_id", "page").agg(F.min(F.when(F.col("confident"), F.col("place"))).alias("stop"))
    tried = rows.join(stop, ["doc_id", "page"]).where("stop is null or place <= stop")
    return tried.groupBy("doc_id", "page").agg(F.max_by("angle", F.struct("chars", -F.col("place"))).alias("angle"))


PAGE = ["doc_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]


def _level(box: Column) -> Column:
    """The least power of two that a box's longer side fits into."""
    return F.ceil(F.log2(F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"]))).cast("int")


def overlapping(tokens: DataFrame) -> DataFrame:
    """doc_id, page, tid, other, other_conf: tokens of the second pass with each earlier token of their page that they overlap by SAME_BOX.

    Two such boxes differ by a factor of two at most in either side, and their centres
    lie apart by half the smaller one at most. So a box goes into one cell, that of its
    centre in a grid as wide as itself; it is looked up from the cells within half a
    width of its centre, of its own grid and the next finer and coarser one.
    """
    box = F.struct(*BOX)
    sized = tokens.where("x1 > x0 and y1 > y0").select(*PAGE, "tid", "conf", (F.col("pass") != "primary").alias("second"), box.alias("box"))
    x, y = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    sized = sized.withColumn("level", _level(F.col("box")))
    cell = lambda c, width: F.floor(c / width)
    own = F.pow(F.lit(2.0), F.col("level"))
    held = sized.select(*PAGE, F.col("tid").alias("other"), F.col("conf").alias("other_conf"), F.col("box").alias("other_box"), "level", cell(x, own).alias("cx"), cell(y, own).alias("cy"))
    asked = sized.where("second").withColumn("level", F.explode(F.array(*[F.col("level") + k for k in (-1, 0, 1)])))
    near = lambda c: F.array_distinct(F.array(cell(c - own / 2, own), cell(c + own / 2, own)))
    asked = asked.withColumn("cx", F.explode(near(x))).withColumn("cy", F.explode(near(y))).drop("conf", "second")
    met = asked.join(held, [*PAGE, "level", "cx", "cy"]).where("other < tid").where(iou(F.col("box"), F.col("other_box")) >= SAME_BOX)
    return met.select(*PAGE, "tid", "other", "other_conf")


def merge_passes(tokens: DataFrame) -> DataFrame:
    """tokens of both passes that stay, with the place `slot` in which each stands (JN-08).

    The second pass is merged in order: a token that overlaps one in place takes the place
    of the first such one if it is surer, and is dropped if not; others come after all.
    Only tokens that overlap an earlier one are taken in turn, over what they overlap,
    so a page's turn is as long as its contested tokens. A token without an area overlaps none.
    """
    at = W.partitionBy(*PAGE).orderBy(F.col("pass") != "primary", "ord", *BOX, "text", "conf")
    rows = tokens.withColumn("tid", F.row_number().over(at))
    pairs = overlapping(rows)
    steps = pairs.groupBy(*PAGE, "tid").agg(F.collect_set("other").alias("others")).join(rows.select(*PAGE, "tid", "conf"), [*PAGE, "tid"])
    steps = steps.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("tid", "conf", "others"))).alias("steps"))
    first = pairs.groupBy(*PAGE).agg(F.collect_set(F.struct(F.col("other").alias("slot"), F.col("other").alias("tid"), F.col("other_conf").alias("conf"))).alias("first"))
    both = steps.join(first, PAGE)
    step_ids = F.transform("steps", lambda s: s["tid"])
    start = F.filter("first", lambda h: ~F.array_contains(step_ids, h["tid"]))

    def turn(held: Column, step: Column) -> Column:
        hit = F.array_min(F.filter(held, lambda h: F.array_contains(step["others"], h["tid"])))
        entry = lambda slot: F.array(F.struct(slot.alias("slot"), step["tid"].alias("tid"), step["conf"].alias("conf")))
        surer = F.concat(F.filter(held, lambda h: h["slot"] != hit["slot"]), entry(hit["slot"]))
        return F.when(hit.isNull(), F.concat(held, entry(step["tid"]))).when(step["conf"] > hit["conf"], surer).otherwise(held)

    fixed = both.select(*PAGE, F.aggregate("steps", start, turn).alias("held"), F.array_union(step_ids, F.transform("first", lambda h: h["tid"])).alias("contested"))
    slot = F.get(F.filter("held", lambda h: h["tid"] == F.col("tid")), 0)["slot"]
    met = rows.join(fixed, PAGE, "left")
    free = ~F.coalesce(F.array_contains("contested", F.col("tid")), F.lit(False))
    return met.withColumn("slot", F.when(free, F.col("tid")).otherwise(slot)).where("slot is not null").drop("tid", "held", "contested")


def reading_order(tokens: DataFrame) -> DataFrame:
    """doc_id, page, line, place, text, conf of tokens (with `slot`): lines from the top, each from the left (WIN-05).

    From the top down, a token whose middle is over 60% of the page's median height below
    that of its line's first token begins a line. One without a box ends the page.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    rows = tokens.withColumn("middle", middle)
    pages = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.col("y1") - F.col("y0"))).alias("heights"), F.array_sort(F.collect_set("middle")).alias("middles"))
    room = 0.6 * F.greatest(F.lit(1.0), F.get("heights", F.floor(F.size("heights") / 2).cast("int")))
    begins = lambda acc, y: F.when((F.size(acc) == 0) | (y - F.get(acc, F.size(acc) - 1) > F.col("room")), F.concat(acc, F.array(y))).otherwise(acc)
    lines = pages.withColumn("room", room).select(*PAGE, F.aggregate("middles", F.array().cast("array<double>"), begins).alias("lines"))
    line = F.coalesce(F.size(F.filter("lines", lambda y: y <= F.col("middle"))) - 1, F.size("lines"))
    line = F.when(F.col("middle").isNull(), F.size("lines")).otherwise(line)
    placed = rows.join(lines, PAGE).withColumn("line", line)
    place = F.row_number().over(W.partitionBy(*PAGE, "line").orderBy(F.col("x0").asc_nulls_last(), "middle", "slot")) - 1
    return placed.select(*PAGE, "line", place.alias("place"), "text", F.col("conf").cast("double").alias("conf"))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once: a lambda's argument is, however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def _merged(tokens: Column) -> Column:
    """Tokens of one page, in order, as merge_passes leaves them: of each the place `slot`, and its fields."""
    has_area = lambda t: (t["x1"] > t["x0"]) & (t["y1"] > t["y0"])
    seated = F.transform(tokens, lambda t, i: F.struct(i.alias("slot"), *[t[c].alias(c) for c in (*BOX, "text", "conf", "second")]))
    second = lambda t: F.coalesce(t["second"], F.lit(False))

    def turn(held: Column, t: Column) -> Column:
        # most boxes lie beside each other, which the first comparisons tell
        same = lambda h: (h["x0"] < t["x1"]) & (h["x1"] > t["x0"]) & (h["y0"] < t["y1"]) & (h["y1"] > t["y0"]) & has_area(h) & (iou(h, t) >= SAME_BOX)
        seat = lambda slot: F.struct(slot.alias("slot"), *[t[c].alias(c) for c in (*BOX, "text", "conf", "second")])
        settle = lambda hit: (
            F.when(hit.isNull(), F.concat(held, F.array(t)))
            .when(t["conf"] > hit["conf"], F.transform(held, lambda h: F.when(h["slot"] == hit["slot"], seat(h["slot"])).otherwise(h)))
            .otherwise(held)
        )
        return _bound(F.when(has_area(t), F.get(F.filter(held, same), 0)), settle)

    return _bound(seated, lambda ts: F.aggregate(F.filter(ts, second), F.filter(ts, lambda t: ~second(t)), turn))


def _lines(held: Column) -> Column:
    """Middles at which the lines of a page begin, from the top (see reading_order)."""
    heights = F.array_sort(F.array_compact(F.transform(held, lambda h: h["y1"] - h["y0"])))
    middles = F.array_sort(F.array_distinct(F.array_compact(F.transform(held, lambda h: (h["y0"] + h["y1"]) / 2))))
    room = _bound(heights, lambda hs: 0.6 * F.greatest(F.lit(1.0), F.get(hs, F.floor(F.size(hs) / 2).cast("int"))))
    return _bound(room, lambda r: F.aggregate(middles, F.array().cast("array<double>"), lambda acc, y: F.when((F.size(acc) == 0) | (y - F.get(acc, F.size(acc) - 1) > r), F.concat(acc, F.array(y))).otherwise(acc)))


def _in_order(held: Column) -> Column:
    """Tokens of one page with their line, in reading order."""

    def placed(s: Column) -> Column:
        def one(h: Column) -> Column:
            middle = (h["y0"] + h["y1"]) / 2
            line = F.when(middle.isNull(), F.size(s["lines"])).otherwise(F.size(F.filter(s["lines"], lambda y: y <= middle)) - 1)
            return F.struct(line.alias("line"), h["x0"].isNull().alias("loose"), h["x0"].alias("x0"), middle.alias("middle"), h["slot"].alias("slot"), h["text"].alias("text"), h["conf"].alias("conf"))

        return F.array_sort(F.transform(s["held"], one))

    return _bound(F.struct(held.alias("held"), _lines(held).alias("lines")), placed)


def _plain_pages(tokens: DataFrame) -> DataFrame:
    """fold_pages of pages of few tokens: each is one row, whose tokens are compared with each other."""
    order = F.struct((F.col("pass") != "primary").alias("second"), "ord", *BOX, "text", F.col("conf").cast("double").alias("conf"))
    # by number: work on a page costs far more than its bytes tell, by which partitions would be put together
    dealt = tokens.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PAGE)
    pages = dealt.groupBy(*PAGE).agg(F.array_sort(F.collect_list(order)).alias("tokens"))
    held = pages.select(*PAGE, _bound(_merged(F.col("tokens")), _in_order).alias("held"))
    rows = held.select(*PAGE, F.transform("held", lambda h: h["line"]).alias("lines"), F.posexplode("held").alias("nth", "h"))
    place = F.col("nth") - F.array_position("lines", F.col("h.line")).cast("int") + 1
    return rows.select(*PAGE, "h.line", place.alias("place"), "h.text", "h.conf")


def fold_pages(tokens: DataFrame, few: int = FEW_TOKENS) -> DataFrame:
    """Both passes of each page merged, in reading order (JN-08, WIN-05, UDF-02).

    A page of up to `few` tokens is dealt out once, as a whole. Larger ones, where
    comparing all pairs would grow with the square, take the grid of `overlapping`.
    """
    tokens = tokens.where(" and ".join(f"{c} is not null" for c in PAGE))
    large = write_once(tokens.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select(*PAGE), "large-pages")
    if large.isEmpty():
        return _plain_pages(tokens)
    return _plain_pages(tokens.join(large, PAGE, "left_anti")).unionByName(reading_order(merge_passes(tokens.join(large, PAGE, "left_semi"))))
