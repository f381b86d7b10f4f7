"""Byte-level BPE encoding and decoding.

Bytes are read as Latin-1 characters so that a character automaton can find, at
every place of a piece, the longest vocabulary entry that starts there. A piece is
then encoded by backtracking: take the longest token, keep it while it is
compatible with the token before it, else shorten it, else drop the token before.
Two tokens are compatible when merging their joined bytes by rank gives back just
those two; this is memoised. A sequence whose neighbours are all compatible is the
one that the merges themselves produce, and each place fails once at most, so the
time is linear in the piece.

Defined cases: a null text encodes as an empty one; a piece that is itself a
vocabulary entry is that single token; of two places where a merge is due the first
comes first; special tokens are ordinary text; a text of any length is encoded whole
(a piece is found in it at a time); repeated rows get the same result; other columns,
whatever their names, are ignored; an empty table gives no rows; decoding an empty or
null list gives empty bytes; an id outside the vocabulary raises.
"""

from __future__ import annotations

import base64
import hashlib
import weakref
from collections.abc import Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries that the memo tables of a worker hold before they are emptied.
MEMO = 1 << 19
#: Documents whose ids a task holds at once.
TOGETHER = 200


def load_ranks(path: str, limit: int = 1 << 20) -> dict[bytes, int]:
    """Token bytes -> rank from a tiktoken rank file of at most `limit` lines."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if len(ranks) > limit:
        raise ValueError(f"the vocabulary has {len(ranks)} entries; {limit} are sent to executors at most")
    return ranks


class _Known(dict):
    """Pieces already encoded; emptied when full."""

    def __init__(self, codec: Codec):
        self.codec = weakref.proxy(codec)  # a cycle would outlive the codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.codec.encode_piece(piece.encode("utf-8").decode("latin-1"))
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """One vocabulary, with its automaton and memo tables."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = regex.compile(pattern)
        self.rank_of = {b.decode("latin-1"): i for b, i in ranks.items()}
        size = max(ranks.values(), default=-1) + 1
        self.text_of: list[str] = [""] * size
        self.bytes_of: list[bytes | None] = [None] * size
        for s, i in self.rank_of.items():
            self.text_of[i], self.bytes_of[i] = s, s.encode("latin-1")
        self.names = list(map(str, range(size)))
        self.automaton = ahocorasick.Automaton()
        for s, i in self.rank_of.items():
            self.automaton.add_word(s, (i, len(s) - 1))
        if ranks:
            self.automaton.make_automaton()
        self.halves = [self._split(s, i) for i, s in enumerate(self.text_of)]
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, list[int]] = {}
        self._known = _Known(self)

    def _split(self, s: str, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice for a single byte."""
        if len(s) < 2:
            return token, token
        parts, rank_of = list(s), self.rank_of
        while len(parts) > 2:
            best, at = min((rank_of.get(parts[k] + parts[k + 1], 1 << 62), k) for k in range(len(parts) - 1))
            if best == 1 << 62 or best >= token:
                return token, token
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return rank_of[parts[0]], rank_of[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Would merging by rank leave these two tokens side by side?

        Undoes their merges from the last to the first and looks whether, at any
        moment, joining the two that touch would have come sooner.
        """
        key = (left, right)
        fits = self._fits.get(key)
        if fits is not None:
            return fits
        rank_of, text_of, halves = self.rank_of, self.text_of, self.halves
        before, fits = 1 << 62, True
        while True:
            if rank_of.get(text_of[left] + text_of[right], before) < before:
                fits = False
                break
            inner, outer = halves[left][1], halves[right][0]
            undo_left = inner != left and (left > right or outer == right)
            if undo_left:
                before, left = left, inner
            elif outer != right:
                before, right = right + 1, outer
            else:
                break
        if len(self._fits) >= MEMO:
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def prefixes(self, token: int) -> list[int]:
        """The token and all vocabulary entries it starts with, longest first."""
        found = self._shorter.get(token)
        if found is None:
            s = self.text_of[token]
            found = self._shorter[token] = [self.rank_of[s[:n]] for n in range(len(s), 0, -1) if s[:n] in self.rank_of]
        return found

    def longest_from(self, s: str) -> list[int]:
        """The longest token that starts at each place.

        The automaton reports the entries that end at a place; each one claims its
        start, and later ends overwrite earlier, so shorter, ones.
        """
        out = [-1] * len(s)
        for end, (token, before) in self.automaton.iter(s):
            out[end - before] = token
        return out

    def encode_piece(self, s: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 characters."""
        whole = self.rank_of.get(s)
        if whole is not None:
            return (whole,)
        longest, n, text_of, fits = self.longest_from(s), len(s), self.text_of, self._fits
        closed: set[int] = set()
        out: list[int] = []
        at, last = 0, -1
        choices, more = (longest[0],), True
        while at < n:
            for token in choices:
                if token < 0:
                    raise ValueError("the vocabulary cannot spell a byte of the text")
                end = at + len(text_of[token])
                if end in closed:
                    continue
                if last >= 0:
                    fit = fits.get((last, token))
                    if not (self.compatible(last, token) if fit is None else fit):
                        continue
                out.append(token)
                at, last = end, token
                choices, more = longest[at : at + 1], True
                break
            else:
                if more:
                    choices, more = self.prefixes(longest[at])[1:], False
                    continue
                closed.add(at)
                if not out:
                    raise ValueError("the vocabulary cannot spell the text")
                at -= len(text_of[out.pop()])
                last = out[-1] if out else -1
                choices = self.prefixes(longest[at])
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return list(chain.from_iterable(map(self._known.__getitem__, self.pieces.findall(text or ""))))

    def decode(self, ids) -> bytes:
        """Bytes of a list of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids)) if ids is not None else b""


_CODECS: weakref.WeakKeyDictionary[Broadcast, Codec] = weakref.WeakKeyDictionary()


def _codec(shared: Broadcast, pattern: str) -> Codec:
    """The worker's codec, built once per broadcast vocabulary; it goes with the broadcast when the worker turns to other tasks."""
    if shared not in _CODECS:
        _CODECS[shared] = Codec(shared.value, pattern)
    return _CODECS[shared]


def share(spark: SparkSession, path: str) -> Broadcast:
    """Read a rank file on the driver and send it to the executors (a vocabulary is bounded, see load_ranks)."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(spark: SparkSession, text: Column, path: str, pattern: str) -> Column:
    """array<int> of token ids of a text column."""
    shared = share(spark, path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        codec = _codec(shared, pattern)
        return pd.Series([np.array(codec.encode(t), dtype=np.int32) for t in texts], dtype=object)

    return ids(text)


def decode(spark: SparkSession, ids: Column, path: str, pattern: str) -> Column:
    """binary of a column of token ids."""
    shared = share(spark, path)

    @F.pandas_udf(T.BinaryType())
    def back(lists: pd.Series) -> pd.Series:
        codec = _codec(shared, pattern)
        return pd.Series([codec.decode(None if x is None else x.tolist()) for x in lists], dtype=object)

    return back(ids)


def tokenised(spark: SparkSession, docs: DataFrame, path: str, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """docs' doc_id and the whole numbers named by `keep`, with n_tokens, the token ids, and the digest of the bytes that they decode to.

    A task holds the ids of TOGETHER documents at once.
    """
    shared = share(spark, path)
    own = ["doc_id", *keep]
    schema = pa.schema([*[(c, pa.int64()) for c in own], ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sizes, ids, digests = [], [], []
                for text in part.column("text"):
                    got = codec.encode(text.as_py())
                    sizes.append(len(got))
                    ids.append(np.array(got, dtype=np.int32))
                    digests.append(hashlib.sha256(codec.decode(got)).hexdigest())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*[part.column(c).cast(pa.int64()) for c in own], pa.array(sizes, pa.int64()), lists, pa.array(digests)], schema=schema)

    names = ", ".join(f"{c} long" for c in own)
    return docs.select(*own, "text").mapInArrow(run, f"{names}, n_tokens long, token_ids array<int>, decoded_sha256 string")


def digests(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Ids and decoded bytes exist only inside the task that digests them, so nothing
    the size of the corpus is written or shuffled.
    """
    shared = share(spark, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        codec, rows = _codec(shared, pattern), []
        names = codec.names.__getitem__
        for t in texts:
            ids = codec.encode(t)
            rows.append((len(ids), hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
