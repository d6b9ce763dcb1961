"""Numpy views of Arrow text columns: spans of words and lines, and rolling hashes.

Nothing here makes a Python object per word. Words are runs of bytes outside
``[\\x20\\x09-\\x0D]``; those bytes never occur inside a UTF-8 sequence, so the
work is done on bytes. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5  # odd and 5 modulo 8: its powers have a long period
_WORDS = 0xD1342543DE82EF95 | 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the whole word."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit integers."""
    return mix(mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) ^ U64(seed))


_BYTES = constants(17, 256)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n or more."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(_STEP + 64, n)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = both[0], both[1]
        if size <= 4 * _STEP:
            _powers[base] = have
    return have


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give memory that this worker no longer uses back to the system; a worker is used again for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about limit bytes of text, or one row."""
    for batch in batches:
        _, off = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't separators, within documents."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all \\n-split lines, empty ones included, and each document's first line."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    counts = 1 + np.diff(np.searchsorted(breaks, offsets))
    first = np.concatenate([[0], np.cumsum(counts)])
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    return starts, ends, first


def totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values in each segment; segments may be empty."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and don't overlap. Memory is bounded by the longest span."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _STEP, "right")))
        part = data[base : ends[j - 1]]
        up, down = powers(_BASE, len(part) + 1)
        c = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=c[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((c[e] - c[s]) * down[s] + (e - s).astype(U64) * U64(0x2545F4914F6CDD1D))
        i = j
    return out


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words of a flat array."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.empty(m, U64)
    for i in range(0, m, _STEP - n):
        part = words[i : i + _STEP - 1]
        k = min(m - i, _STEP - n)
        up, down = powers(_WORDS, len(part) + 1)
        c = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[: len(part)], out=c[1:])
        out[i : i + k] = mix((c[n : n + k] - c[:k]) * down[:k])
    return out


def run_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run words[start:end]; runs are in order and don't overlap; an empty run gives one value."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _STEP, "right")))
        part = words[base : ends[j - 1]]
        up, down = powers(_WORDS, len(part) + 1)
        c = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[: len(part)], out=c[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((c[e] - c[s]) * down[s] + (e - s).astype(U64) * U64(0x9FB21C651E98DF25))
        i = j
    return out


def windows(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n words that lie in one document, and the number of windows of each document."""
    per = np.maximum(counts - n + 1, 0)
    total = int(counts.sum())
    mask = np.ones(total, bool)
    ends = np.cumsum(counts)
    for back in range(1, n):  # the last n - 1 words of each document start none
        at = ends - back
        mask[at[(at >= ends - counts) & (counts >= back)]] = False
    return np.flatnonzero(mask), per


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    import pandas as pd

    return pd.Series(keys).duplicated(keep=False).to_numpy()
