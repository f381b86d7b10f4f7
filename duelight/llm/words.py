"""Vectorised word arithmetic over Arrow string batches.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. All
hashes are polynomial (Rabin-Karp) modulo 2**64 over random byte values, taken
from prefix sums and passed through a mixer, so each one costs a constant number
of array operations per byte whatever the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATORS = bytes([32, 9, 10, 11, 12, 13])
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[list(SEPARATORS)] = True
#: Bytes of text that are worked on at once; a longer document is a block alone.
BLOCK_BYTES = 1 << 20


def inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


class Hasher:
    """Prefix-sum polynomial hashing with one seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
        self.byte_base = int(rng.integers(1, 1 << 62)) * 4 + 1 | 1
        self.word_base = int(rng.integers(1, 1 << 62)) * 4 + 3 | 1
        self._powers: dict[int, np.ndarray] = {}

    def powers(self, base: int, n: int) -> np.ndarray:
        have = self._powers.get(base)
        if have is None or len(have) < n:
            size = 1 << max(10, int(n - 1).bit_length())
            have = np.empty(size, dtype=np.uint64)
            have[0], done = 1, 1
            while done < size:
                have[done : 2 * done] = have[:done] * U(pow(base, done, 1 << 64))
                done *= 2
            self._powers[base] = have
        return have[:n]

    def spans(self, values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of values[start:end] for each pair."""
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.powers(base, len(values)), out=sums[1:])
        back = self.powers(inverse(base), len(values) + 1)
        return mix(((sums[end] - sums[start]) * back[start]) + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


HASH = Hasher(20240517)


@dataclass
class Block:
    """Words of some documents, one after another."""

    first_doc: int
    data: np.ndarray  # bytes of the documents
    doc_start: np.ndarray  # byte offsets, one more than documents
    start: np.ndarray  # of words, in data
    end: np.ndarray
    word_from: np.ndarray  # word offsets of documents, one more than documents

    @property
    def docs(self) -> int:
        return len(self.doc_start) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.word_from))

    def hashes(self) -> np.ndarray:
        return HASH.spans(HASH.table[self.data], HASH.byte_base, self.start, self.end)

    def windows(self, word_hash: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of `size` words (by its first word), and whether it stays in one document."""
        n = len(word_hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(n)
        doc = self.doc_of_word()
        return HASH.spans(word_hash, HASH.word_base, at, at + size), doc[:n] == doc[size - 1 :]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole documents in order; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield _block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def _block(first: int, data: np.ndarray, doc_start: np.ndarray) -> Block:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~IS_SEP[data]
    edge = inside[1:] != inside[:-1]
    begins = np.flatnonzero(edge & inside[1:])
    ends = np.flatnonzero(edge & inside[:-1])
    # a document's border splits a run that goes on into the next document
    border = np.unique(doc_start[1:-1])
    if len(border):
        cut = border[inside[border] & inside[border + 1]]
        if len(cut):
            begins = np.sort(np.concatenate([begins, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
    return Block(first, data, doc_start, begins, ends, np.searchsorted(begins, doc_start))
