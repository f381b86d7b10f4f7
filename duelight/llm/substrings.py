"""Removal of repeated passages.

Every window of WINDOW words gets a Rabin-Karp hash. A window is repeated when the
same words start earlier (smaller doc_id, or same document and earlier start);
windows are judged on the input, and overlapping ones merge into removal intervals.

So that windows which occur once are not dealt out one by one, each goes with its
anchor: the least hash among its ANCHOR-word shingles. Equal windows have equal
anchors. Anchors are counted first; only windows whose anchor occurs again, packed
in runs, are then compared, under their anchor of 64 bits and 56 more of their own
hash. Among n different windows under one anchor two are taken for one with a
probability of about n * n / 2**57 (for a million, 7 in a million).

Blocks of documents settle repeats among themselves before anything is shuffled, so
a passage in a third of all documents sends one copy per block. An anchor that holds over
1 / MOST_HOT of all runs is hot; there are fewer than MOST_HOT of them, so their list
is broadcast. Windows of a hot anchor are dealt out by their own hashes, and of each
the first ones of SALTS groups of documents compete for the first place.

Defined cases: a null text has no words; null ids come last, and rows of one id are
ordered by a hash of the text; repeated rows (same id and text) are one document and
get the same result; texts of fewer than WINDOW words lose nothing; texts of any
length are cut whole; other columns, whatever their names, are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelight.llm.tables import materialise
from duelight.llm.words import Block, blocks

WINDOW, ANCHOR = 20, 5
#: Windows that one packed run holds at most (their number fits a byte), and bytes of each hash.
RUN, WIDE = 250, 7
#: Hot anchors there can be, and groups in which their windows are ranked first.
MOST_HOT, SALTS = 10_000, 64
_SPAN = WINDOW - ANCHOR + 1
RUNS = "anchor long, doc_id long, text_hash long, start int, n int, hashes binary"


def _anchors(block: Block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor and whether it lies in one document."""
    doc = block.doc_of_word()
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least, _ = block.windows(words, ANCHOR)
    size = 1
    while size < _SPAN:
        step = min(size, _SPAN - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    return least[:n], doc[:n] == doc[WINDOW - 1 :]


def _runs(which: np.ndarray, anchor: np.ndarray, doc: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of consecutive windows of one document and anchor."""
    if not len(which):
        return which, which
    fresh = np.ones(len(which), dtype=bool)
    fresh[1:] = (which[1:] != which[:-1] + 1) | (anchor[which[1:]] != anchor[which[:-1]]) | (doc[which[1:]] != doc[which[:-1]])
    if most:
        at = np.arange(len(which))
        fresh |= (at - np.maximum.accumulate(np.where(fresh, at, 0))) % most == 0
    begin = np.flatnonzero(fresh)
    return begin, np.append(begin[1:], len(which))


def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchor of each run."""
    for batch in batches:
        for block in blocks(batch.column("text")):
            anchor, whole = _anchors(block, block.hashes())
            which = np.flatnonzero(whole)
            begin, _ = _runs(which, anchor, block.doc_of_word())
            yield pa.RecordBatch.from_arrays([pa.array(anchor[which[begin]].view(np.int64))], ["anchor"])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed runs of windows that are first in their block; those already repeated in it come without hashes."""
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        null = np.array(ids.is_null())
        ids = np.array(ids.fill_null(0))
        texts = np.array(batch.column("text_hash"))
        for block in blocks(batch.column("text")):
            docs = slice(block.first_doc, block.first_doc + block.docs)
            words = block.hashes()
            anchor, whole = _anchors(block, words)
            hashes, _ = block.windows(words, WINDOW)
            which = np.flatnonzero(whole)
            doc = block.doc_of_word()
            start = np.arange(len(words)) - block.word_from[doc]
            # documents in order; repeated rows share a rank
            key = np.stack([null[docs].astype(np.int64), ids[docs], texts[docs]], axis=1)
            _, rank = np.unique(key, axis=0, return_inverse=True)
            rank = rank.ravel()
            order = which[np.lexsort((start[which], rank[doc[which]], hashes[which]))]
            place = np.stack([rank[doc[order]], start[order]])
            new = np.ones(len(order), dtype=bool)
            new[1:] = hashes[order[1:]] != hashes[order[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            late = order[(place != place[:, first]).any(axis=0)] if len(order) else order
            repeated = np.zeros(len(words), dtype=bool)
            repeated[late] = True
            for group, with_hash in ((which[~repeated[which]], True), (np.flatnonzero(repeated), False)):
                begin, end = _runs(group, anchor, doc, RUN)
                if not len(begin):
                    continue
                head = group[begin]
                raw = hashes[group].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes() if with_hash else b""
                cut = np.append(begin, len(group)).astype(np.int32) * WIDE if with_hash else np.zeros(len(begin) + 1, np.int32)
                own = doc[head] + block.first_doc
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[head].view(np.int64)),
                        pa.array(ids[own], mask=null[own]),
                        pa.array(texts[own]),
                        pa.array(start[head].astype(np.int32)),
                        pa.array((end - begin).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(raw)]),
                    ],
                    ["anchor", "doc_id", "text_hash", "start", "n", "hashes"],
                )


def _windows(runs: DataFrame) -> DataFrame:
    """One row per window of runs with hashes: key, doc_id, text_hash, span (its place), hash."""
    start = F.shiftright("span", 8)
    each = F.transform(F.sequence(F.lit(0), F.col("span") % 256 - 1), lambda k: F.struct(F.substring("hashes", k * WIDE + 1, F.lit(WIDE)).alias("hash"), F.shiftleft(start + k, 8).alias("at")))
    return runs.withColumn("w", F.explode(each)).select("key", "doc_id", "text_hash", "w.hash", (F.col("w.at") + 1).alias("span"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, span: the n windows from the word `place` on are repeated, where span = 256 * place + n."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    again = rows.select("text").mapInArrow(count_anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n_runs")).where("n_runs > 1")
    again = materialise(again, "op5-anchors")
    all_runs = again.agg(F.sum("n_runs")).first()[0] or 0
    hot = F.broadcast(again.where(F.col("n_runs") > all_runs / MOST_HOT).select("anchor"))
    runs = rows.mapInArrow(pack, RUNS).select(F.col("anchor"), "doc_id", "text_hash", (F.shiftleft(F.col("start").cast("long"), 8) + F.col("n")).alias("span"), "hashes")
    known = F.octet_length("hashes") == 0
    # packed once: known and hot runs go on, others if their anchor occurs again. Only these look for an anchor; the rest is dealt out by place
    free = known | F.col("hot").isNotNull()
    runs = runs.join(hot.withColumn("hot", F.lit(True)), "anchor", "left").withColumn("free", free)
    runs = runs.withColumn("k", F.when(F.col("free"), F.xxhash64("doc_id", "text_hash", "span")).otherwise(F.col("anchor")))
    runs = runs.join(again.select(F.col("anchor").alias("k"), F.lit(True).alias("met")), "k", "left").where("free or met")
    runs = materialise(runs.select("anchor", "doc_id", "text_hash", "span", "hashes", F.col("hot").isNotNull().alias("hot")), "op5-runs")
    open_ = runs.where(~known).withColumnRenamed("anchor", "key")

    order = [F.col("doc_id").asc_nulls_last(), F.col("text_hash"), F.col("span")]
    rank = lambda *by: F.rank().over(W.partitionBy(*by).orderBy(*order))
    cold = _windows(open_.where("not hot")).withColumn("nth", rank("key", "hash")).where("nth > 1")
    warm = _windows(open_.where("hot")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)))
    warm = warm.withColumn("nth", rank("key", "hash", "salt")).withColumn("salt", F.when(F.col("nth") > 1, F.col("salt")))
    warm = warm.withColumn("first", rank("key", "hash", "salt")).where("nth > 1 or first > 1")
    late = [part.select("doc_id", "text_hash", "span") for part in (runs.where(known), cold, warm)]
    return late[0].union(late[1]).union(late[2])


@F.arrow_udf(T.BinaryType())
def squeeze(texts: pa.Array) -> pa.Array:
    """Each text compressed, for its way to its marks."""
    codec = pa.Codec("zstd", 1)
    raw = [None if t is None else t.encode() for t in texts.to_pylist()]
    return pa.array([None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in raw], pa.binary())


def _words(squeezed: bytes | None) -> list[bytes]:
    if squeezed is None:
        return []
    return pa.Codec("zstd", 1).decompress(squeezed[8:], int.from_bytes(squeezed[:8], "little"), asbytes=True).split()


@F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
def strip(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Words, removed words, and digest of what is left of each squeezed text."""
    n_words, n_removed, digest = [], [], []
    for text, span in zip(texts, spans):
        words = _words(text.as_py())
        gone = 0
        if span.is_valid and len(span.values):
            first, n = np.divmod(np.asarray(span.values), 256)
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + n - 1 + WINDOW, -1)
            covered = np.cumsum(edge[:-1]) > 0
            gone = int(covered.sum())
            words = [w for w, c in zip(words, covered) if not c]
        n_words.append(len(words) + gone)
        n_removed.append(gone)
        digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], ["n_words", "n_removed", "kept_sha256"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    marks = repeated_windows(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("span").alias("spans"))
    rows = docs.select("doc_id", squeeze("text").alias("text"), F.xxhash64("text").alias("text_hash"))
    met = rows.join(marks, rows["doc_id"].eqNullSafe(marks["_id"]) & (rows["text_hash"] == marks["_hash"]), "left")
    return met.select("doc_id", strip("text", "spans").alias("s")).select("doc_id", "s.*")
