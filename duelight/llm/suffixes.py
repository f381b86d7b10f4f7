"""Removal of byte strings that occur more than once, by a sparse suffix array.

A byte goes if a string of WINDOW bytes over it also starts anywhere else in the corpus.
That is a question about neighbours in the sorted order of all suffixes; but only
suffixes that can have such a neighbour are sorted:

1. Every window has an anchor, the least hash among its first REACH + 1 strings of GRAM
   bytes (the leftmost of equal ones), so equal windows have equal anchors at equal
   places. Windows with one anchor are consecutive, a run. The first
   WINDOW - REACH bytes from an anchor on lie in all its windows; where they occur once
   in the corpus, no window of the run occurs again. Runs whose whole bytes occur again
   are repeated, all windows of them. What is left are runs at the edges of repeats, and
   one copy each of repeated runs that may match them. Of these, stretches of PART windows
   at one distance from the anchor go on if two runs agree in all that their windows share.
2. Windows of those runs are the suffixes that are sorted. Sampled splitters
   range-partition them by their leading tokens (two words of 8 bytes) and a word that
   stands for the rest (a 64-bit hash; so neighbours equal in all three words are taken
   as equal, which for n suffixes of equal leading words is wrong with a probability
   below n * n / 2**65). Each bucket is sorted in memory by a multikey quicksort, word
   by word, and neighbours are compared; a last grouping compares the suffixes at the
   borders of buckets.

A block of documents settles its own repeats before anything is shuffled, so a passage
in a third of all documents sends one row per block; and a salt follows the words, so
that sampled splitters cut a run of equal suffixes too. A bucket holds about BUCKET
suffixes at any size of the input.

Defined cases: a null text is empty; texts of fewer than WINDOW bytes lose nothing; rows
of equal id and text are documents each, copies of one another; null ids are an id; texts
of any length up to 4 GB are cut whole; other columns, whatever their names, are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelight.llm.substrings import squeeze
from duelight.llm.tables import materialise
from duelight.llm.words import HASH, U, blocks, inverse, mix

WINDOW, REACH, GRAM, PART = 400, 200, 16, 41
PARTS = REACH // PART + 1
BUCKET = 400_000
#: Of a run: hash from its anchor on, of all of it, of what each of its parts shares (4 bytes, only compared under one lead), and the anchor's distance.
RUNS = "lead long, full long, " + "".join(f"k{i} int, " for i in range(PARTS)) + "back int, copies int, doc_id long, text_hash long, start int, n int"
SUFFIXES = "w0 long, w1 long, w2 long, copies int, doc_id long, text_hash long, start int, n int"
_LOW = U(0xFFFFFFFF)


class Prefixes:
    """Hashes of any stretch of some bytes, from one array of prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(HASH.table[data] * HASH.powers(HASH.byte_base, n), out=self.sums[1:])
        self.inverse = HASH.powers(inverse(HASH.byte_base), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def runs_of(data: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]] | None:
    """Runs of windows in some documents: first window, number of windows, document, and the keys of RUNS up to `back`."""
    long = np.diff(doc_start)
    if not len(long) or long.max() < WINDOW:
        return None
    prefixes = Prefixes(data)
    at = np.arange(len(data) - GRAM + 1)
    # the upper half of a gram's hash, then its place: the least is the leftmost of the least hashes
    least = prefixes.of(at, at + GRAM) & ~_LOW | at.astype(np.uint64)
    size = 1
    while size < REACH + 1:
        step = min(size, REACH + 1 - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    has = np.maximum(long - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(long)), has)
    start = np.arange(has.sum()) - np.repeat(np.cumsum(has) - has, has) + doc_start[:-1][doc]
    anchor = (least[start] & _LOW).astype(np.int64)
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(fresh)
    n = np.diff(np.append(begin, len(start)))
    first, anchor = start[begin], anchor[begin]
    back = anchor - first
    lead = prefixes.of(anchor, anchor + WINDOW - REACH)
    full = mix(prefixes.of(first, first + n - 1 + WINDOW) + mix(back.astype(np.uint64) * U(256) + n.astype(np.uint64)))
    keys = [lead.view(np.int64), full.view(np.int64)]
    for i in range(PARTS):
        held = (back >= PART * i) & (back - n + 1 < PART * (i + 1))
        at = np.where(held, anchor - PART * i, first)
        keys.append((prefixes.of(at, at + WINDOW - PART + 1) >> U(33)).astype(np.int32))
    return first, n, doc[begin], [*keys, back.astype(np.int32)]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row whether it is the first of its equals, and how many they are."""
    _, first, kind, count = np.unique(keys, axis=0, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), dtype=bool)
    is_first[first] = True
    return is_first, count[kind.ravel()]


def _merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (n from start on) with those that touch joined."""
    by = np.lexsort((start, doc))
    doc, start, n = doc[by], start[by], n[by]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n[:-1])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(doc)) - 1
    return doc[begin], start[begin], start[end] + n[end] - start[begin]


class _Ids:
    """doc_id and text_hash of a batch's rows."""

    def __init__(self, batch: pa.RecordBatch):
        ids = batch.column("doc_id").cast(pa.int64())
        self.null = np.array(ids.is_null())
        self.ids = np.array(ids.fill_null(0))
        self.texts = np.array(batch.column("text_hash"))

    def rows(self, own: np.ndarray, keys: list[np.ndarray] | None, copies: np.ndarray, start: np.ndarray, n: np.ndarray, names: str) -> pa.RecordBatch:
        """Rows of suffixes or runs, or (without keys) of windows known to be repeated."""
        kinds = {"long": pa.int64(), "int": pa.int32()}
        fields = [c.split() for c in names.split(", ")][:-5]
        words = [pa.nulls(len(own), kinds[kind]) for _, kind in fields] if keys is None else [pa.array(k, kinds[kind]) for k, (_, kind) in zip(keys, fields)]
        rest = [pa.array(copies.astype(np.int32)), pa.array(self.ids[own], mask=self.null[own]), pa.array(self.texts[own]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays(words + rest, [c.split()[0] for c in names.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over documents: one row of RUNS per run, and windows repeated within a block (lead null)."""
    for batch in batches:
        ids = _Ids(batch)
        for block in blocks(batch.column("text")):
            runs = runs_of(block.data, block.doc_start)
            if runs is None:
                continue
            first, n, doc, keys = runs
            new, copies = _grouped(keys[1])
            own, start = doc + block.first_doc, first - block.doc_start[doc]
            yield ids.rows(own[new], [k[new] for k in keys], copies[new], start[new], n[new], RUNS)
            if not new.all():
                again, begin, many = _merged(own[~new], start[~new], n[~new])
                yield ids.rows(again, None, np.full(len(again), 2), begin, many, RUNS)


def words_of(data: np.ndarray, start: np.ndarray, prefixes: Prefixes) -> list[np.ndarray]:
    """The two leading words of suffixes, in an order as signed numbers, and a hash of the rest of their windows."""
    lead = [data[start[:, None] + np.arange(k, k + 8)].copy().view(">u8").ravel().astype(np.uint64) ^ U(1 << 63) for k in (0, 8)]
    return [w.view(np.int64) for w in (*lead, prefixes.of(start + 16, start + WINDOW))]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over squeezed documents with runs: SUFFIXES of their windows, and windows repeated within a batch (w0 null)."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        ids, parts = _Ids(batch), []
        for own, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
            data = np.frombuffer(codec.decompress(text[8:], int.from_bytes(text[:8], "little"), asbytes=True), dtype=np.uint8)
            first, n = np.divmod(np.array(spans, dtype=np.int64), 256)
            start = np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()))
            # an empty document has no runs, so it never comes here
            parts.append([np.full(len(start), own), start, *words_of(data, start, Prefixes(data))])
        if not parts:
            continue
        own, start, *words = (np.concatenate(c) for c in zip(*parts))
        new, copies = _grouped(np.stack(words, axis=1))
        one = np.ones(len(own), dtype=np.int64)
        yield ids.rows(own[new], [w[new] for w in words], copies[new], start[new], one[new], SUFFIXES)
        if not new.all():
            again, begin, many = _merged(own[~new], start[~new], one[~new])
            yield ids.rows(again, None, np.full(len(again), 2), begin, many, SUFFIXES)


def multikey_order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of strings of words, and of each place whether it equals the one before.

    Multikey quicksort: strings are sorted by one word, and only those equal in it go on, each group by the next word.
    """
    order = np.argsort(words[0])
    equal = np.zeros(len(order), dtype=bool)
    equal[1:] = words[0][order[1:]] == words[0][order[:-1]]
    for word in words[1:]:
        tied = equal.copy()
        tied[:-1] |= equal[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~equal)[at]
        own = order[at]
        own = own[np.lexsort((word[own], group))]
        order[at] = own
        same = np.zeros(len(at), dtype=bool)
        same[1:] = (word[own[1:]] == word[own[:-1]]) & (group[1:] == group[:-1])
        equal[at] = same
    return order, equal


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over one bucket: windows found repeated (border false), and its first and last suffix (border true)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    words = [np.array(table.column(c)) for c in ("w0", "w1", "w2")]
    copies = np.array(table.column("copies"))
    order, equal = multikey_order(words)
    again = equal.copy()
    again[:-1] |= equal[1:]
    again |= copies[order] > 1
    pick = order[again]
    border = order[[0, len(order) - 1]] if len(order) > 1 else order[:1]
    # a border's suffix that is repeated already tells only its neighbours
    known = again[[0, len(order) - 1]] if len(order) > 1 else again[:1]
    for rows, flag in ((pick, None), (border, known)):
        part = table.select(["w0", "w1", "w2", "doc_id", "text_hash", "start", "n"]).take(pa.array(rows))
        if flag is None:  # their words are of no use any more
            for k, name in enumerate(("w0", "w1", "w2")):
                part = part.set_column(k, name, pa.nulls(len(rows), pa.int64()))
        part = part.append_column("border", pa.array(np.full(len(rows), flag is not None)))
        part = part.append_column("times", pa.array(np.ones(len(rows), np.int32) if flag is None else np.where(flag, 2, 1).astype(np.int32)))
        yield from part.combine_chunks().to_batches()


def _edges(again: DataFrame) -> DataFrame:
    """doc_id, text_hash, span (256 * first window + number of windows): windows of edges that another run may hold too."""
    parts = [F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("k")) for i in range(PARTS)]
    rows = again.select("lead", "back", "doc_id", "text_hash", "start", "n", F.explode(F.array(*parts)).alias("p")).select("*", "p.i", "p.k")
    low = F.greatest(F.lit(0), F.col("back") - PART * F.col("i") - (PART - 1))
    high = F.least(F.col("n") - 1, F.col("back") - PART * F.col("i"))
    rows = rows.withColumn("low", low).withColumn("high", high).where("high >= low")
    met = rows.groupBy("lead", "i", "k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    span = (F.col("start").cast("long") + F.col("low")) * 256 + F.col("high") - F.col("low") + 1
    return rows.join(met, ["lead", "i", "k"], "left_semi").select("doc_id", "text_hash", span.alias("span"))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, n: the n windows from byte `start` on occur elsewhere too (docs: doc_id, text_hash, text)."""
    spark = docs.sparkSession
    place = ["doc_id", "text_hash", "start", "n"]
    runs = materialise(docs.select("doc_id", "text_hash", "text").mapInArrow(_runs, RUNS), "op11-runs")
    found = [runs.where("lead is null").select(place)]
    runs = runs.where("lead is not null")
    leads = runs.groupBy("lead").agg(F.sum("copies").alias("c"), (F.min("full") != F.max("full")).alias("mixed")).where("c > 1").select("lead", "mixed")
    place_hash = F.xxhash64("doc_id", "text_hash", "start")
    fulls = runs.groupBy("full").agg(F.sum("copies").alias("c"), F.min(place_hash).alias("one")).where("c > 1").select("full", "one")
    again = materialise(runs.join(leads, "lead").join(fulls, "full", "left"), "op11-again")
    found.append(again.where("one is not null").select(place))
    edges = _edges(again.where(F.col("mixed") & (F.col("one").isNull() | (F.col("one") == place_hash))))
    spans = edges.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("span").alias("spans"))
    texts = docs.select("doc_id", "text_hash", squeeze("text").alias("text"))
    met = texts.join(spans, texts["doc_id"].eqNullSafe(spans["_id"]) & (texts["text_hash"] == spans["_hash"])).select("doc_id", "text_hash", "text", "spans")
    suffixes = materialise(met.mapInArrow(_suffixes, SUFFIXES), "op11-suffixes")
    found.append(suffixes.where("w0 is null").select(place))
    suffixes = suffixes.where("w0 is not null").withColumn("salt", F.xxhash64("doc_id", "text_hash", "start"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // BUCKET))
    buckets = suffixes.repartitionByRange(parts, "w0", "w1", "w2", "salt")
    words = "w0 long, w1 long, w2 long, doc_id long, text_hash long, start int, n int, border boolean, times int"
    compared = materialise(buckets.drop("salt").mapInArrow(_bucket, words), "op11-sorted")
    found.append(compared.where("not border").select(place))
    border = compared.where("border")
    across = border.groupBy("w0", "w1", "w2").agg(F.sum("times").alias("c"), F.collect_set(F.struct(place)).alias("m")).where("c > 1 and size(m) > 1")
    found.append(across.select(F.explode("m").alias("m")).select("m.*"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


@F.arrow_udf(T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
def strip(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Bytes, removed bytes, runs of these, and digest of the rest of each squeezed text."""
    codec, out = pa.Codec("zstd", 1), []
    for text, span in zip(texts.to_pylist(), spans):
        raw = b"" if text is None else codec.decompress(text[8:], int.from_bytes(text[:8], "little"), asbytes=True)
        gone = runs = 0
        if span.is_valid and len(span.values):
            first, n = np.divmod(np.asarray(span.values), 1 << 31)
            edge = np.zeros(len(raw) + 1, dtype=np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + n - 1 + WINDOW, -1)
            covered = np.cumsum(edge[:-1]) > 0
            gone, runs = int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
            kept = np.frombuffer(raw, dtype=np.uint8)[~covered].tobytes()
        else:
            kept = raw
        out.append((len(raw), gone, runs, hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*out)) or [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    packed = F.col("start").cast("long") * (1 << 31) + F.col("n")
    marks = repeated(rows).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(packed).alias("spans"))
    texts = rows.select("doc_id", "text_hash", squeeze("text").alias("text"))
    met = texts.join(marks, texts["doc_id"].eqNullSafe(marks["_id"]) & (texts["text_hash"] == marks["_hash"]), "left")
    return met.select("doc_id", strip("text", "spans").alias("s")).select("doc_id", "s.*")
