"""NumPy helpers over the raw UTF-8 buffers of Arrow string columns.

A column is handled as one byte array plus row offsets; words, word hashes and
rolling hashes come from whole-array operations, never from a loop over rows.
Nulls count as empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, np.uint8)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 1
IS_WORD = (1 - _SPACE).astype(np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one uint8 array, and the int64 offsets of its rows (one more than rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D, never across rows): starts, ends, and word offsets by row."""
    w = IS_WORD[data]
    n = len(data)
    before = np.zeros(n, np.uint8)
    after = np.zeros(n, np.uint8)
    if n:
        before[1:] = w[:-1]
        after[:-1] = w[1:]
        inner = off[1:-1]
        before[inner[inner < n]] = 0
        after[inner[inner > 0] - 1] = 0
    starts = np.flatnonzero(w & (1 - before))
    ends = np.flatnonzero(w & (1 - after)) + 1
    return starts, ends, np.searchsorted(starts, off)


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; the first 2^21 are kept."""
    if n > (1 << 21) or base not in _KNOWN:
        p = np.full(max(n, 1 << 21), base, U64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if n > (1 << 21):
            return p[:n]
        _KNOWN[base] = p
    return _KNOWN[base][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes or of 64-bit tokens, equal for equal contents wherever they stand
    (a prefix polynomial). Spans come in the order of their starts and of their ends."""
    out = np.zeros(len(starts), U64)
    step = 1 << 20  # bytes at a time, so that scratch stays bounded for very long texts
    if not len(starts):
        return out
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + step, "right")))
        top = int(ends[hi - 1])
        part = (_BYTE[data[base:top]] if data.dtype == np.uint8 else data[base:top]) * _powers(BASE, top - base)
        pre = np.zeros(len(part) + 1, U64)
        np.cumsum(part, out=pre[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (pre[e] - pre[s]) * _powers(BASE_INV, top - base + 1)[s] + (e - s).astype(U64) * U64(0x632BE59BD9B4E019)
        lo = hi
    return mix(out)


def ngram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive token hashes, by start (rows are not looked at)."""
    m = max(0, len(tokens) - n + 1)
    h = np.full(m, n, U64)
    for i in range(n):
        h = mix(h * U64(BASE) + tokens[i:i + m])
    return h


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` consecutive 32-bit keys the place of its least key, the leftmost of equal ones."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    m = (keys.astype(U64) << U64(32)) | np.arange(len(keys), dtype=U64)
    span = 1
    while span * 2 <= w:
        m = np.minimum(m[:len(m) - span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[:n], m[w - span:w - span + n])
    return (m[:n] & U64(0xFFFFFFFF)).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of every span, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Booleans of length n, true where any span covers the place."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true values."""
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
