"""Statistics of whole texts, by array operations over blocks of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelight.llm.words import IS_SEP, HASH, U, Block, blocks, mix

_SPREAD = U(0x9E3779B97F4A7C15)


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


SYMBOLS = _flags(b"#*$%&|<>")
UPPER = _flags(bytes(range(65, 91)))
DIGITS = _flags(b"0123456789")
STOPS = _flags(b".,;:?")
SINGLE = {"bang": _flags(b"!"), "bar": _flags(b"|"), "newline": _flags(b"\n")}


def _per_doc(block: Block, mask: np.ndarray) -> np.ndarray:
    """How many bytes of each document the mask marks."""
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[block.doc_start])


def _count(docs: int, which: np.ndarray) -> np.ndarray:
    return np.bincount(which, minlength=docs).astype(np.int64)


def _lines(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier one, per document."""
    breaks = np.flatnonzero(block.data == 10)
    start = np.sort(np.concatenate([block.doc_start[:-1], breaks + 1]))
    doc = np.sort(np.concatenate([np.arange(block.docs), np.searchsorted(block.doc_start, breaks, side="right") - 1]))
    end = np.sort(np.concatenate([block.doc_start[1:], breaks]))
    words = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(~IS_SEP[block.data], out=words[1:])
    held = words[end] > words[start]
    start, end, doc = start[held], end[held], doc[held]
    line = HASH.spans(HASH.table[block.data], HASH.byte_base, start, end)
    _, first = np.unique(mix(line + doc.astype(np.uint64) * _SPREAD), return_index=True)
    total = _count(block.docs, doc)
    return total, total - _count(block.docs, doc[first])


def _repeats(block: Block, words: np.ndarray, size: int) -> np.ndarray:
    """Words of each document inside windows that it holds twice or more."""
    window, whole = block.windows(words, size)
    doc = block.doc_of_word()
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(block.docs, dtype=np.int64)
    _, kind, count = np.unique(mix(window[at] + doc[at].astype(np.uint64) * _SPREAD), return_inverse=True, return_counts=True)
    at = at[count[kind] > 1]
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return _count(block.docs, doc[np.cumsum(edge[:-1]) > 0])


def rules_of(block: Block) -> dict[str, np.ndarray]:
    """The counts that quality rules use."""
    data = block.data
    n_lines, n_dup = _lines(block)
    return {
        "n_words": np.diff(block.word_from),
        "word_chars": _per_doc(block, ((data & 0xC0) != 0x80) & ~IS_SEP[data]),
        "n_symbols": _per_doc(block, SYMBOLS[data]),
        "n_lines": n_lines,
        "n_dup_lines": n_dup,
        "n_repeat_words": _repeats(block, block.hashes(), 3),
    }


RULE_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in RULE_COUNTS]))
def rule_counts(texts: pa.Array) -> pa.Array:
    parts = [rules_of(b) for b in blocks(texts)]
    columns = [pa.array(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0), pa.int64()) for n in RULE_COUNTS]
    return pa.StructArray.from_arrays(columns, RULE_COUNTS)


#: Names of the classifier's features, all transformed to be roughly symmetric.
FEATURES = ["length", "word_length", "symbols", "upper", "bangs", "bars", "digits", "stops", "dup_lines", "repeats", "variety", "wide", "newlines", "short_words"]


def features_of(block: Block) -> np.ndarray:
    """One row of FEATURES per document; a text without words is all zeros."""
    data, counts = block.data, rules_of(block)
    words = block.hashes()
    n = counts["n_words"]
    some = np.maximum(n, 1)
    chars = np.maximum(counts["word_chars"], 1)
    doc = block.doc_of_word()
    capital = UPPER[data]
    if len(data) > 1:
        capital[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    _, first = np.unique(mix(words + doc.astype(np.uint64) * _SPREAD), return_index=True)
    short = (block.end - block.start) <= 3
    share = lambda mask, of: _per_doc(block, mask) / of
    columns = [
        np.log1p(n),
        np.log1p(counts["word_chars"] / some),
        np.log1p(10 * counts["n_symbols"] / some),
        np.log1p(10 * share(capital, chars)),
        np.log1p(10 * share(SINGLE["bang"][data], some)),
        np.log1p(10 * share(SINGLE["bar"][data], some)),
        np.log1p(10 * share(DIGITS[data], chars)),
        np.log1p(10 * share(STOPS[data], some)),
        counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1),
        counts["n_repeat_words"] / some,
        np.log1p(_count(block.docs, doc[first]) / some),
        np.log1p(10 * share((data & 0xC0) == 0xC0, chars)),
        np.log1p(10 * share(SINGLE["newline"][data], some)),
        _count(block.docs, doc[short]) / some,
    ]
    out = np.stack(columns, axis=1).astype(np.float64)
    out[n == 0] = 0.0
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features(texts: pa.Array) -> pa.Array:
    rows = np.concatenate([features_of(b) for b in blocks(texts)] or [np.zeros((0, len(FEATURES)))])
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
