"""Language identification by cross-parsing.

A suffix automaton of labelled text is built per language; every substring of that
text is a path from its root. A document is cut greedily into the longest phrases
that each automaton spells (Ziv-Merhav cross-parsing); phrases * log2(length of the
labelled text) estimates the code length, and the shortest wins.

Texts are lower-cased; whatever is not a letter becomes one space. One array step
advances all texts of a batch in all languages together. For that, long texts are
parsed in segments of SEGMENT characters at once, each as if a phrase began there;
then each segment is parsed again from the state in which the one before it ends,
until both parses are in the same state, mostly within a phrase or two. So phrases
are those of the whole text, whatever its length.

The automata are fitted on a bounded sample of labelled rows: of each language
SAMPLE_BUCKETS documents at most, chosen by a hash of their id, and of each of them
SAMPLE_CHARS characters at most: a longer text gives EXCERPTS evenly spaced pieces.
There may be MOST_LANGUAGES of them. Letters beyond the COMMON most frequent ones of
the sample are spelled by two symbols, so a state has at most 2 * COMMON transitions
in any script. Every document is scored over its whole text.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go
to the first language in code point order; with no labelled row all is `und`; of the
rows of one id the sample takes the least excerpt; rows are independent, so
repeated rows get the same result and extra columns with any names change nothing.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of what is learned from: rows and characters of a language, and the length over which a text is only taken for want of shorter ones.
SAMPLE_BUCKETS, SAMPLE_CHARS, SHORT, MOST_LANGUAGES = 48, 40_000, 4_000, 500
COMMON = 120
SEGMENT = 2_048
#: Characters times languages that are parsed together.
TOGETHER = 6_000_000
#: Bits of code length by which the probability of a language falls by a factor e.
BITS_PER_E = 8.0

_DEAD = np.int32(1 << 30)
#: Stands for the symbol of states that lead on by none or by several.
NO_SYMBOL = -1


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence (online construction)."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Parser:
    """The automata of all languages: state, symbol -> next state.

    Most states lead on by one symbol only. These have no row of their own in the table:
    they share that of their language's restart, and their symbol and next state stand beside.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        clean = {k: _clean(samples[k]) for k in self.languages}
        often = Counter()
        for t in clean.values():
            often.update(t)
        del often[" "]
        # symbols: 0 is no letter, then the common letters, one for unknown letters, then first and second symbols of the rare ones
        alphabet = sorted(often, key=lambda c: (-often[c], c))
        common = min(len(alphabet), COMMON)
        self.rare = common + 2
        self.lut = np.where(_LETTERS(), common + 1, 0).astype(np.uint32)
        for k, c in enumerate(alphabet):
            self.lut[ord(c)] = k + 1 if k < common else k + 2
        self.second = self.rare + -(-(len(alphabet) - common) // COMMON)
        self.width = self.second + min(COMMON, len(alphabet) - common)
        tables, rows, self.starts, base, n_rows = [], [], [], 0, 0
        only, onward = [], []
        for k in self.languages:
            step = _suffix_automaton(self.symbols(clean[k]).tolist())
            # the last state is between phrases: whatever comes starts one
            between = base + len(step)
            many = [s for s, out in enumerate(step) if len(out) > 1 or s == 0]
            row = np.zeros(len(step) + 1, dtype=np.int32)  # the first one is the restart's
            row[many] = np.arange(1, len(many) + 1)
            table = np.full((len(many) + 1, self.width), -1, dtype=np.int32)
            for k, s in enumerate(many, 1):
                table[k, list(step[s])] = np.fromiter(step[s].values(), np.int32, len(step[s])) + base
            table = np.where(table < 0, (np.where(table[1] < 0, between, table[1]) | _DEAD)[None, :], table)
            single = np.array([next(iter(out.items())) if len(out) == 1 and s else (NO_SYMBOL, 0) for s, out in enumerate(step)] + [(NO_SYMBOL, 0)], dtype=np.int32)
            only.append(single[:, 0].astype(np.int16))
            onward.append(single[:, 1] + np.int32(base))
            del step  # one automaton at a time
            tables.append(table)
            rows.append(row + np.int32(n_rows))
            self.starts.append(between)
            base, n_rows = between + 1, n_rows + len(table)
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.row, self.only, self.onward = joined(rows, np.int32), joined(only, np.int16), joined(onward, np.int32)
        self.table = joined([t.ravel() for t in tables], np.int32)
        self.at = np.int32 if len(self.table) < 1 << 31 else np.int64
        self.bits = np.array([np.log2(max(2, len(clean[k]))) for k in self.languages])

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states, with _DEAD where a phrase ends."""
        got = self.table[self.row[state] * self.at(self.width) + symbol]
        return np.where(self.only[state] == symbol, self.onward[state], got)

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text, runs of non-letters as one."""
        got = self.lut[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
        keep = np.ones(len(got), dtype=bool)
        keep[1:] = (got[1:] != 0) | (got[:-1] != 0)
        got = got[keep]
        rare = got >= self.rare
        if rare.any():
            rest = got[rare] - self.rare
            two = np.repeat(got, 1 + rare)
            at = np.flatnonzero(rare) + np.arange(len(rest))
            two[at], two[at + 1] = self.rare + rest // COMMON, self.second + rest % COMMON
            got = two
        return got.astype(np.uint16)

    def classes(self, text: str) -> np.ndarray:
        """Symbols of a text in lower case, with a space in front."""
        return self.symbols(" " + text.lower())

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        langs = len(self.languages)
        out = np.zeros((len(texts), langs), dtype=np.int64)
        pieces = [(k, i, t[i : i + SEGMENT]) for k, t in enumerate(texts) for i in range(0, len(t), SEGMENT)]
        pieces.sort(key=lambda p: -len(p[2]))
        if not pieces or not langs:
            return out
        sizes = np.array([len(p) for *_, p in pieces])
        grid = np.zeros((sizes[0], len(pieces)), dtype=np.int32)
        for j, (*_, p) in enumerate(pieces):
            grid[: len(p), j] = p
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        place = {(k, i): j for j, (k, i, _) in enumerate(pieces)}
        after = np.array([place.get((k, i + SEGMENT), -1) for k, i, _ in pieces])
        continued = int(max((j for j in after if j >= 0), default=-1)) + 1
        path = np.zeros((sizes[0], langs, continued), dtype=np.int32)  # of segments that others lead into
        state = np.repeat(np.array(self.starts, dtype=np.int32)[:, None], len(pieces), axis=1)
        count = np.zeros((langs, len(pieces)), dtype=np.int64)
        for i, n in enumerate(alive):
            got = self.follow(state[:, :n], grid[i, :n])
            count[:, :n] += got >> 30
            path[i, :, : min(n, continued)] = got[:, :continued]
            state[:, :n] = got & ~_DEAD
        changed, ends = np.zeros_like(count), state.copy()
        lang, todo = (x.ravel() for x in np.meshgrid(np.arange(langs), np.flatnonzero(after >= 0), indexing="ij"))
        while len(todo):
            to, now = after[todo], state[lang, todo]
            changed[lang, to] = 0
            moved = np.ones(len(to), dtype=bool)
            live = np.arange(len(to))
            for i in range(sizes[to].max()):
                live = live[sizes[to[live]] > i]
                if not len(live):
                    break
                j, k = to[live], lang[live]
                got, old = self.follow(now[live], grid[i, j]), path[i, k, j]
                changed[k, j] += (got >> 30) - (old >> 30)
                now[live] = got & ~_DEAD
                same = now[live] == old & ~_DEAD
                moved[live[same]] = False
                live = live[~same]
            # where the two parses never met, the segment ends in another state, and the next one is parsed again
            now = np.where(moved, now, ends[lang, to])
            again = (state[lang, to] != now) & (after[to] >= 0)
            state[lang, to] = now
            lang, todo = lang[again], to[again]
        np.add.at(out, np.array([k for k, *_ in pieces]), (count + changed).T)
        return out

    def predict(self, texts: pa.Array) -> pa.StructArray:
        lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        at = 0
        while at < len(texts) and self.languages:
            batch, place, size = [], [], 0
            while at < len(texts) and (not batch or size < TOGETHER // len(self.languages)):
                t = texts[at].as_py()
                if t is not None and (got := self.classes(t)).any():
                    batch.append(got)
                    place.append(at)
                    size += len(got)
                at += 1
            if batch:
                bits = self.phrases(batch) * self.bits
                best = bits.argmin(axis=1)
                p = 1 / np.exp(-(bits - bits.min(axis=1, keepdims=True)) / BITS_PER_E).sum(axis=1)
                lang[place] = np.array(self.languages, dtype=object)[best]
                score[place] = p
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])


_TABLE: list[np.ndarray] = []


def _LETTERS() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def _clean(text: str) -> str:
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def fit(docs: DataFrame, buckets: int = SAMPLE_BUCKETS) -> dict[str, str]:
    """A bounded sample of labelled text per language (doc_id, text, lang): whole texts only.

    One row per language and hash bucket is picked, by its id's hash among those of up
    to SHORT characters, else the shortest; of these, bucket by bucket, as many as make up
    SAMPLE_CHARS characters (the first one whatever its length). Only those few reach the driver.
    """
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    place, long = F.xxhash64("doc_id"), F.length("text")
    first = F.min_by(F.struct("doc_id", long.alias("long")), F.struct(F.when(long > SHORT, long).otherwise(0), place, long))
    picks = labelled.groupBy("lang", F.pmod(place, F.lit(buckets)).alias("bucket")).agg(first.alias("p")).select("lang", "bucket", "p.*")
    so_far = F.sum("long").over(W.partitionBy("lang").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    picks = picks.withColumn("so_far", so_far).where((F.col("so_far") <= SAMPLE_CHARS) | (F.col("so_far") == F.col("long"))).select("lang", "doc_id")
    picks = picks.limit(buckets * MOST_LANGUAGES + 1).collect()
    if len(picks) > buckets * MOST_LANGUAGES:
        raise ValueError(f"there are over {MOST_LANGUAGES} languages")
    ids = [r.doc_id for r in picks]
    rows = labelled.where(F.col("doc_id").isin(ids)).groupBy("lang", "doc_id").agg(F.min_by("text", F.struct(long, "text")).alias("text")).collect() if ids else []
    wanted = {(r.lang, r.doc_id) for r in picks}
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        if (r.lang, r.doc_id) in wanted:
            samples[r.lang] = samples.get(r.lang, "") + " " + r.text
    return samples


def predict(spark: SparkSession, text: Column, samples: dict[str, str]) -> Column:
    """struct(lang_pred, score) of a text column.

    The automata come of the bounded sample, so they are built once, here. Workers load
    their tables, and let go of them with the broadcast when they turn to other tasks.
    """
    shared = spark.sparkContext.broadcast(Parser(samples))

    @F.arrow_udf("lang_pred string, score double")
    def udf(texts: pa.Array) -> pa.Array:
        return shared.value.predict(texts)

    return udf(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from its labelled rows."""
    spark = docs.sparkSession
    samples = fit(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(spark, F.col("text"), samples).alias("p")).select("doc_id", "held_out", "p.*")
