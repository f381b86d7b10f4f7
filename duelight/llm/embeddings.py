"""Near-duplicate vectors by p-stable Euclidean hashing and exact cosines.

Normalised vectors fall into buckets of quantised Gaussian projections, in several
tables. Only ids go through the buckets; those that share a bucket with another one
are joined with their values. Vectors of a bucket are compared in blocks by their
exact cosine in double precision; a pair that meets in several tables counts in the
first of them (the keys of linked vectors are computed again for that), so links
are counted without ever being listed. A bucket of more than CHUNK vectors is cut
into chunks, and each pair of chunks is a block of its own. From a block only each
vector's number of new links and the least vector of its part of the block go on.

The number of projections grows with the logarithm of the number n of vectors, so
that a bucket holds about MATES unrelated ones, few enough that values are sent for
hardly any vectors but linked ones; the number of tables follows so that a pair at
the threshold is missed with probability MISS at most. It grows as n to the power
0.19 (WIDTH and the threshold set it), and ids through buckets as n to the power 1.19.

Defined cases: null, zero, and non-finite vectors, or such with a null component,
have no links; vectors of different lengths have none with each other; equal vectors
are one node with a multiplicity; repeated ids are vectors of their own, and rows of
null ids too; a cosine equal to the threshold links; other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelight.llm.graph import components
from duelight.llm.tables import discard, materialise
from duelight.llm.words import U, mix

WIDTH, MATES, MISS, CHUNK = 2.0, 0.25, 0.005, 1024
#: Numbers that the blocks compared at once hold.
TOGETHER = 1 << 20


def meet(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection agrees at a distance (p-stable, p = 2)."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Projections per table, and tables, for n vectors."""
    near, far = meet(math.sqrt(2 - 2 * cosine)), meet(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(1, n / MATES)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column, nulls as NaN."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.array(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.append(0, np.cumsum(sizes)), column.flatten().to_numpy(zero_copy_only=False)


def _valid(v: np.ndarray) -> bool:
    return len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())


@functools.lru_cache(maxsize=4)
def _axes(d: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([d, k, tables])
    return rng.standard_normal((d, k * tables)), rng.random(k * tables) * WIDTH, rng.integers(1, 1 << 62, k, dtype=np.uint64) * U(2) + U(1)


def bucket_keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Bucket keys (a row of 32 bits per table) of normalised vectors of one length."""
    axes, shift, odd = _axes(x.shape[1], k, tables)
    out = np.empty((len(x), tables), dtype=np.uint32)
    for a in range(0, len(x), 256):
        cell = np.floor((x[a : a + 256] @ axes + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, tables, k)
        out[a : a + 256] = mix((cell * odd).sum(axis=2, dtype=np.uint64) + U(x.shape[1])) >> U(32)
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hash_keys(k: int, tables: int):
    """UDF: bucket keys of a vector, with the table's number in the high half; null if it can link with nothing."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(column: pa.Array) -> pa.Array:
        at, flat = _matrix(column)
        out: list = [None] * len(column)
        sizes = np.diff(at)
        place = np.arange(tables, dtype=np.int64) << 32
        for d in np.unique(sizes[sizes > 0]):
            which = [i for i in np.flatnonzero(sizes == d) if _valid(flat[at[i] : at[i + 1]])]
            for a in range(0, len(which), 4096):
                part = which[a : a + 4096]
                x = np.stack([flat[at[i] : at[i + 1]] for i in part])
                for i, row in zip(part, bucket_keys(normalised(x), k, tables).astype(np.int64) + place):
                    out[i] = row
        return pa.array(out, pa.list_(pa.int64()))

    return keys


def _near(x: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, ...]:
    """Block and places of all pairs within the threshold, of m blocks of n vectors each (two-sided ones across their sides only)."""
    x = x / np.abs(x).max(axis=2, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=2))
    near = (x @ x.transpose(0, 2, 1)) / (norm[:, :, None] * norm[:, None, :]) >= cosine
    two = side.any(axis=1) & ~side.all(axis=1)
    return np.nonzero(np.triu(near & (~two[:, None, None] | (side[:, :, None] != side[:, None, :])), 1))


def _links(i: np.ndarray, j: np.ndarray, nid: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in pairs: their ids, links (with multiplicity), and the least id that the pairs of their block reach."""
    links = np.zeros(len(nid), dtype=np.int64)
    np.add.at(links, i, weight[j])
    np.add.at(links, j, weight[i])
    label = np.arange(len(nid))
    while len(i):
        least = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == old).all():
            break
    some = np.flatnonzero(links)
    return nid[some], links[some], nid[label[some]]


def compare(cosine: float, k: int, tables: int):
    """mapInArrow function over blocks (rows sorted by bucket, p, q): nid, links, label."""
    names = ("g", "p", "q", "d")

    def flush(table: pa.Table) -> pa.RecordBatch:
        cols = [np.array(table.column(c)) for c in names]
        edge = np.ones(table.num_rows, dtype=bool)
        edge[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        begin = np.flatnonzero(edge)
        size, dim, turn = np.diff(np.append(begin, table.num_rows)), cols[3][begin], cols[0] >> 32
        nid, weight, side = (np.array(table.column(c)) for c in ("nid", "weight", "side"))
        at, flat = _matrix(table.column("v").combine_chunks())
        found = []
        for n, d in {(int(n), int(d)) for n, d in zip(size, dim) if n > 1}:
            first = begin[(size == n) & (dim == d)]
            step = max(1, TOGETHER // (n * (n + d)))
            for a in range(0, len(first), step):
                rows = first[a : a + step, None] + np.arange(n)
                x = flat[at[rows][:, :, None] + np.arange(d)]
                m, i, j = _near(x, side[rows], cosine)
                # a pair counts in its first common table
                some = np.unique(np.concatenate([m * n + i, m * n + j]))
                place = np.zeros(rows.size, dtype=np.int64)
                place[some] = np.arange(len(some))
                keys = bucket_keys(normalised(x.reshape(-1, d)[some]), k, tables)
                ki, kj, before = place[m * n + i], place[m * n + j], turn[rows[m, i]]
                fresh = np.ones(len(m), dtype=bool)
                for b in range(0, len(m), 65536):
                    c = slice(b, b + 65536)
                    fresh[c] = ~((keys[ki[c]] == keys[kj[c]]) & (np.arange(tables) < before[c, None])).any(axis=1)
                i, j = (m * n + i)[fresh], (m * n + j)[fresh]
                found.append(_links(i, j, nid[rows].ravel(), weight[rows].ravel()))
        parts = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in parts], ["nid", "links", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [np.array(held.column(c)) for c in names]
            last = np.flatnonzero(np.any([c != c[-1] for c in keys], axis=0)) if held.num_rows else np.zeros(0, int)
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield flush(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield flush(held.combine_chunks())

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    k, tables = plan(vectors.count(), cosine)
    spelt = F.md5(F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string"))).cast("binary"))
    rows = vectors.select("vec_id", "embedding", hash_keys(k, tables)("embedding").alias("keys"), spelt.alias("spelt"), F.monotonically_increasing_id().alias("rid"))
    rows = materialise(rows, "op3-vectors")
    same = rows.where("keys is not null").groupBy("spelt").agg(F.min("rid").alias("nid"), F.count(F.lit(1)).alias("weight"))
    member = materialise(rows.select("rid", "vec_id", F.when(F.col("keys").isNotNull(), F.col("spelt")).alias("spelt")).join(same, "spelt", "left").withColumn("nid", F.coalesce("nid", "rid")).drop("spelt"), "op3-members")
    own = rows.where("keys is not null").join(member.where("rid = nid").select("rid", "weight"), "rid")
    node = own.select(F.col("rid").alias("nid"), "weight", F.size("embedding").alias("d"), F.col("embedding").alias("v"))

    entry = own.select(F.col("rid").alias("nid"), F.size("embedding").alias("d"), F.explode("keys").alias("g"))
    size = entry.groupBy("g", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    entry = entry.join(size, ["g", "d"]).withColumn("m", chunks).withColumn("own", F.pmod(F.xxhash64("nid"), F.col("m")).cast("int"))
    entry = entry.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    entry = entry.select("nid", "g", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    block = entry.join(node, "nid").select("g", "p", "q", "d", "side", "nid", "weight", "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = block.repartition(parts, "g", "p", "q", "d").sortWithinPartitions("g", "p", "q", "d")
    found = materialise(block.mapInArrow(compare(cosine, k, tables), "nid long, links long, label long"), "op3-links")
    discard(rows)

    joined = components(found.where("nid <> label").select(F.col("nid").alias("a"), F.col("label").alias("b")), "op3-components")
    links = found.groupBy("nid").agg(F.sum("links").alias("links"))
    all_ = member.join(links, "nid", "left").join(joined, F.col("nid") == F.col("node"), "left")
    all_ = all_.withColumn("part", F.coalesce("component", "nid"))
    least = all_.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    n = F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1
    return all_.join(least, "part").select("vec_id", n.cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
