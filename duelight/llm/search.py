"""Ranked lexical search by two trees: one over items, one over documents.

Terms are runs of letters, digits and non-ASCII characters, ASCII letters lower-cased. A
document's coordinate in a term is (10**9 * tf) div (1000 * tf + 8 * m), an item's is the
term's weight times its count there; a pair scores their inner product, in whole
numbers. No coordinate is negative, so the inner product of two nodes' coordinate maxima
bounds every pair below them.

Items come in waves of bounded size, as a stated query set does; a wave's terms and
items are broadcast. Per wave the documents are read once to count the wave's terms
in each (only these vectors go on, and their counts by term give the weights), and the
vectors are searched where they lie: a task builds trees over up to CHUNK of them and
over the wave's items, both ordered by each row's heaviest term so that nodes are
alike, and opens pairs of nodes from the most promising down. A pair is dropped, with
all pairs below it, when its bound is below the weakest k-th score among its items (at
the k-th score ties are still looked at); a pair of leaves is scored by one matrix
product. k-th scores carry over from chunk to chunk of a task, and a first look at one
vector in SEED gives every task a k-th score to start from. Each task's best k go into
one ranking.

Products are in doubles: all sums of an item are whole and below 2**53, else the item is
summed in 64-bit integers. Bounds are rounded up.

Defined cases: null and wordless texts have no terms: as documents they count nowhere,
as items they find nothing; equal scores go by doc_id, null ids last, and among repeated
rows each counts as a document; repeated rows of an item id are one item, of the least
text; documents of any length are counted whole; other columns, whatever their names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelight.llm.tables import discard, materialise

#: Bounds of a wave: items, and bytes of their texts (one longer item is a wave alone).
WAVE_ITEMS, WAVE_BYTES = 1024, 1 << 20
#: Vectors under one document tree, leaves of either tree, children of a node, and the share of vectors that is looked at first.
CHUNK, DOC_LEAF, ITEM_LEAF, FAN, SEED = 8192, 32, 8, 4, 64
VECTOR = "doc_id long, row long, n long, terms binary, tfs binary"
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return text.encode().translate(_SPLIT).split(b" ") if text else []


def _counts(text: str | None) -> Counter:
    counts = Counter(terms_of(text))
    counts.pop(b"", None)
    return counts


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _vectors(vocabulary) -> "callable":
    """mapInArrow function: of each document its terms that the wave names, and of a batch the number and terms of its documents (row null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            ids, rows, out = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), []
            for doc, row, text in zip(ids, rows, batch.column("text").to_pylist()):
                counts = _counts(text)
                if counts:
                    held = [(number[t], c) for t, c in counts.items() if t in number]
                    terms, tfs = np.array(held, dtype=np.int32).reshape(-1, 2).T
                    out.append((doc, row, counts.total(), terms.tobytes(), tfs.tobytes()))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "row", "n", "terms", "tfs"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over vectors: in how many each term is; documents and terms in all as terms -1 and -2."""
    df, docs, length = Counter(), 0, 0
    for batch in batches:
        docs += batch.num_rows
        length += sum(batch.column("n").to_pylist())
        held = np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype=np.int32)
        df.update(dict(zip(*(a.tolist() for a in np.unique(held, return_counts=True)))))
    rows = [*df.items(), (-1, docs), (-2, length)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], ["term", "n"])


@dataclass
class Tree:
    """Sparse rows (term, value) in leaves; of each level, leaves first, the maxima of every node's columns."""

    cut: np.ndarray  # offsets of rows, one more than rows
    terms: np.ndarray
    values: np.ndarray
    leaf: int
    levels: list[np.ndarray]

    @classmethod
    def over(cls, rows: list[tuple[np.ndarray, np.ndarray]], columns: int, leaf: int) -> "Tree":
        cut = np.cumsum([0, *[len(t) for t, _ in rows]])
        terms, values = (np.concatenate([r[k] for r in rows] or [np.zeros(0)]) for k in (0, 1))
        terms = terms.astype(np.int64)
        top = np.zeros((max(1, -(-len(rows) // leaf)), columns))
        np.maximum.at(top, (np.repeat(np.arange(len(rows)), np.diff(cut)) // leaf, terms), values)
        levels = [top]
        while len(levels[-1]) > FAN:
            levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
        return cls(cut, terms, values, leaf, levels)

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1])))

    def members(self, node: int) -> slice:
        return slice(node * self.leaf, min((node + 1) * self.leaf, len(self.cut) - 1))

    def dense(self, node: int, place: np.ndarray, width: int) -> np.ndarray:
        """The rows of a leaf in the columns that have a place."""
        own = self.members(node)
        at = slice(self.cut[own.start], self.cut[own.stop])
        row = np.repeat(np.arange(own.stop - own.start), np.diff(self.cut[own.start : own.stop + 1]))
        to = place[self.terms[at]]
        out = np.zeros((own.stop - own.start, width))
        out[row[to >= 0], to[to >= 0]] = self.values[at][to >= 0]
        return out


class Best:
    """The k best documents of every item so far: scores, and whom they belong to."""

    def __init__(self, items: int, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors
        self.held: list[list[tuple]] = [[] for _ in range(items)]

    def kth(self) -> np.ndarray:
        """Scores below which nothing can count any more."""
        own = np.array([h[0][0] if len(h) == self.k else 1 for h in self.held], dtype=np.int64)
        return np.maximum(own, self.floors)

    def add(self, item: int, score: int, null: bool, doc: int, row: int) -> None:
        # the worst comes first: least score, then greatest id
        entry = (score, not null, -doc, -row)
        if len(self.held[item]) < self.k:
            heapq.heappush(self.held[item], entry)
        elif entry > self.held[item][0]:
            heapq.heapreplace(self.held[item], entry)


def search(items: Tree, docs: Tree, owners: list[tuple], best: Best, exact: np.ndarray) -> int:
    """Dual-tree descent; owners: (null, doc_id, row) of each document. Returns how many pairs of leaves were scored."""
    top_i, top_d = len(items.levels) - 1, len(docs.levels) - 1
    kth = best.kth()
    weakest = []
    for level in items.levels:
        base = kth if not weakest else weakest[-1]
        weakest.append(np.minimum.reduceat(base, np.arange(0, len(base), items.leaf if not weakest else FAN)))

    def raise_(leaf: int) -> None:
        """After new k-th scores in a leaf: its own weakest and those above it."""
        own = items.members(leaf)
        kth[own] = [max(best.floors[i], best.held[i][0][0]) if len(best.held[i]) == best.k else kth[i] for i in range(own.start, own.stop)]
        weakest[0][leaf] = kth[own].min()
        for level in range(1, len(weakest)):
            leaf //= FAN
            kids = items.children(level, leaf)
            weakest[level][leaf] = weakest[level - 1][kids.start : kids.stop].min()

    def bounds(li: int, i: range, ld: int, d: range) -> np.ndarray:
        a = items.levels[li][i.start : i.stop]
        used = np.flatnonzero(a.any(axis=0))
        return np.floor((a[:, used] @ docs.levels[ld][d.start : d.stop][:, used].T) * (1 + 1e-9)) + 1

    queue: list[tuple] = []

    def open_(li: int, i: range, ld: int, d: range) -> None:
        got = bounds(li, i, ld, d)
        for x, y in np.argwhere(got >= weakest[li][i.start : i.stop][:, None]).tolist():
            heapq.heappush(queue, (-got[x, y], li, i[x], ld, d[y]))

    open_(top_i, range(len(items.levels[-1])), top_d, range(len(docs.levels[-1])))
    scored = 0
    place = np.full(items.levels[0].shape[1], -1)
    named: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while queue:
        bound, li, i, ld, d = heapq.heappop(queue)
        if -bound < weakest[li][i]:
            continue
        if li or ld:
            open_(max(li - 1, 0), items.children(li, i) if li else range(i, i + 1), max(ld - 1, 0), docs.children(ld, d) if ld else range(d, d + 1))
            continue
        own, other = items.members(i), docs.members(d)
        if i not in named:
            used = np.flatnonzero(items.levels[0][i])
            place[used] = np.arange(len(used))
            named[i] = used, items.dense(i, place, len(used))
            place[used] = -1
        used, left = named[i]
        place[used] = np.arange(len(used))
        right = docs.dense(d, place, len(used))
        place[used] = -1
        scores = (left @ right.T).astype(np.int64)
        if not exact[own].all():
            scores = left.astype(np.int64) @ right.astype(np.int64).T
        scored += 1
        hits = np.argwhere((scores > 0) & (scores >= kth[own][:, None]))
        for x, y in hits.tolist():
            best.add(own.start + x, int(scores[x, y]), *owners[other.start + y])
        if len(hits):
            raise_(i)
    return scored


def _ordered(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> list[int]:
    """Rows by their heaviest term, then by the next one."""

    def key(row: tuple[np.ndarray, np.ndarray]) -> tuple:
        terms, values = row
        heavy = values * weights[terms]
        return tuple(terms[np.lexsort((terms, -heavy))[:2]].tolist())

    keys = [key(r) for r in rows]
    return sorted(range(len(rows)), key=keys.__getitem__)


def _searcher(wave, k: int):
    """mapInArrow function over vectors: item (its number in the wave), score, doc_id, row of each task's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, entries, idf, n_docs, length, floors = wave.value
        weights = np.asarray(idf, dtype=np.float64)
        items = [(terms, counts * weights[terms]) for terms, counts in (np.array(e, dtype=np.int64).reshape(-1, 2).T for e in entries)]
        order = _ordered(items, np.ones(columns))
        tree = Tree.over([items[i] for i in order], columns, ITEM_LEAF)
        exact = np.array([items[i][1].sum() * 1e6 < 2**53 for i in order])
        best = Best(len(entries), k, np.asarray(floors, dtype=np.int64)[order])

        def chunk(table: pa.Table) -> None:
            ids, rows, n = (table.column(c).to_pylist() for c in ("doc_id", "row", "n"))
            vectors = []
            for terms, tfs, size in zip(table.column("terms").to_pylist(), table.column("tfs").to_pylist(), n):
                tf = np.frombuffer(tfs, dtype=np.int32).astype(np.int64)
                m = 25 + 75 * size * n_docs // length
                vectors.append((np.frombuffer(terms, dtype=np.int32), (1_000_000_000 * tf // (1000 * tf + 8 * m)).astype(np.float64)))
            by = _ordered(vectors, weights)
            docs = Tree.over([vectors[a] for a in by], columns, DOC_LEAF)
            search(tree, docs, [(ids[a] is None, ids[a] or 0, rows[a]) for a in by], best, exact)

        # the maxima of a chunk's leaves take 64 MB at most
        most, held = int(np.clip((1 << 23) // max(columns, 1), 1, CHUNK // DOC_LEAF)) * DOC_LEAF, []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= most:
                table = pa.Table.from_batches(held)
                chunk(table.slice(0, most))
                held = table.slice(most).to_batches()
        if sum(b.num_rows for b in held):
            chunk(pa.Table.from_batches(held))
        out = [(int(order[i]), e[0], None if not e[1] else -e[2], -e[3]) for i, h in enumerate(best.held) for e in h]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kinds)], ["item", "score", "doc_id", "row"])

    return run


def waves(items: DataFrame) -> Iterator[list[Row]]:
    """Items (item_id, text), once each, in blocks of bounded size."""
    wave, size = [], 0
    for row in items.groupBy("item_id").agg(F.min("text").alias("text")).where("text is not null").toLocalIterator():
        if wave and (len(wave) == WAVE_ITEMS or size + len(row.text) > WAVE_BYTES):
            yield wave
            wave, size = [], 0
        wave.append(row)
        size += len(row.text)
    if wave:
        yield wave


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k best documents with a score above 0."""
    spark = documents.sparkSession
    kind = items.schema["item_id"].dataType
    empty = spark.createDataFrame([], "rank int, doc_id long, score long").select(F.lit(None).cast(kind).alias("item_id"), "*")
    out = []
    for wave in waves(items.select("item_id", "text")):
        counted = [_counts(r.text) for r in wave]
        number = {t: n for n, t in enumerate(sorted(set().union(*counted)))}
        entries = [[(number[t], c) for t, c in counts.items()] for counts in counted]
        vocabulary = spark.sparkContext.broadcast(number)
        rows = documents.select("doc_id", F.xxhash64("text").alias("row"), "text").where("text is not null")
        vectors = materialise(rows.mapInArrow(_vectors(vocabulary), VECTOR), "op12-vectors")
        totals = {r.term: r.n for r in vectors.select("n", "terms").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_docs, length = totals.pop(-1, 0), totals.pop(-2, 0)
        if not n_docs:
            continue
        idf = [weight(n_docs, totals.get(t, 0)) for t in range(len(number))]
        look = lambda some, floors: some.mapInArrow(_searcher(spark.sparkContext.broadcast((len(number), entries, idf, n_docs, length, floors)), k), "item int, score long, doc_id long, row long")
        first = look(vectors.where(F.pmod("row", F.lit(SEED)) == 0), [1] * len(wave))
        floors = {r.item: r.score for r in _ranked(first, k).where(F.col("rank") == k).select("item", "score").collect()}
        found = materialise(_ranked(look(vectors, [floors.get(i, 1) for i in range(len(wave))]), k).select("item", "rank", "doc_id", "score"), "op12-found")
        discard(vectors)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(wave)], ["item", "item_id"]).select("item", F.col("item_id").cast(kind))
        out.append(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    for part in out:
        empty = empty.union(part.select("item_id", "rank", "doc_id", "score"))
    return empty
